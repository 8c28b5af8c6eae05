"""Token counts per section from one encoding of the whole document.

The document is encoded once; the spans of its tokens are laid over the spans of its sections, and
a token that crosses a boundary is given away by a named rule:

- ``start``: the section of its first character (default),
- ``end``: the section of its last character,
- ``largest``: the section that holds most of its characters, the earlier one of equals,
- ``split``: every section by its share of the token's characters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "largest", "split")


@cache
def encoder(ranks: str, pattern: str):
    """(encode function, byte length of each id) of a byte-level rank file."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(table.values()) + 1, np.int64)
    for piece, rank in table.items():
        sizes[rank] = len(piece)
    made = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return made.encode_ordinary, sizes


def token_spans(text: str, ranks: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end character of every token of ``text``."""
    encode, sizes = encoder(ranks, pattern)
    stops = np.cumsum(sizes[np.array(encode(text), np.int64)]) if text else np.zeros(0, np.int64)
    starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
    if text.isascii():
        return starts, stops
    octets = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((octets & 0xC0) != 0x80) - 1
    return character[starts], character[stops - 1] + 1


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of lines; a line keeps its line end, and an empty text is one empty line."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    stops = np.array(ends, np.int64)
    return np.concatenate([[0], stops[:-1]]), stops


def attribute(
    starts: np.ndarray, stops: np.ndarray, begins: np.ndarray, ends: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each section and boundary-crossing tokens that touch it.

    Sections are sorted and do not overlap; characters between them belong to none, and a token
    given to such a place is not counted.
    """
    counts, crossing = np.zeros(len(begins)), np.zeros(len(begins), np.int64)
    if not len(starts) or not len(begins):
        return counts, crossing
    first = np.searchsorted(ends, starts, "right")  # first section that ends after the token starts
    last = np.searchsorted(begins, stops, "left") - 1  # last section that begins before it stops
    inside = np.minimum(first, len(begins) - 1)
    whole = (first == last) & (begins[inside] <= starts) & (stops <= ends[inside])
    counts += np.bincount(inside[whole], minlength=len(begins))
    for t in np.flatnonzero(~whole & (first <= last)).tolist():
        a, b = int(first[t]), int(last[t]) + 1
        shares = np.minimum(ends[a:b], stops[t]) - np.maximum(begins[a:b], starts[t])
        crossing[a:b] += 1
        if rule == "split":
            counts[a:b] += shares / (stops[t] - starts[t])
        elif rule == "largest":
            counts[a + int(shares.argmax())] += 1
        elif rule == "start":
            counts[a] += bool(begins[a] <= starts[t])
        else:
            counts[b - 1] += bool(stops[t] <= ends[b - 1])
    return counts, crossing


def section_tokens(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    sections: str | None = None,
    rule: str = "start",
) -> DataFrame:
    """(doc_id, section, begin, stop, n_tokens, n_crossing, doc_tokens), one row per section.

    ``sections`` names a column of ``array<struct<begin, stop>>`` in characters, sorted and without
    overlaps; without it the lines are the sections.  A null text counts as empty and a null list
    as one section over the whole text.  Repeated rows are counted as often as they occur.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = ["doc_id", "section", "begin", "stop", "n_tokens", "n_crossing", "doc_tokens"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, columns = [], [[] for _ in names[1:]]
            for n in range(b.num_rows):
                whole = b.column(1)[n].as_py()
                if sections is None:
                    begins, ends = line_spans(whole)
                else:
                    spans = b.column(2)[n].as_py()
                    spans = [{"begin": 0, "stop": len(whole)}] if spans is None else spans
                    begins, ends = (np.array([s[k] for s in spans], np.int64) for k in ("begin", "stop"))
                starts, stops = token_spans(whole, ranks, pattern)
                counts, crossing = attribute(starts, stops, begins, ends, rule)
                rows.append(np.full(len(begins), n))
                for column, values in zip(columns, (np.arange(len(begins)), begins, ends, counts, crossing, np.full(len(begins), len(starts)))):
                    column.append(values)
            if rows:
                take = pa.array(np.concatenate(rows).astype(np.int64))
                made = [np.concatenate(c) for c in columns]
                made = [x.astype(np.float64 if k == 3 else np.int64) for k, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), *map(pa.array, made)], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    picked = [F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    if sections is not None:
        picked.append(F.col(sections).alias("sections"))
    layout = f"doc_id {kind}, section bigint, begin bigint, stop bigint, n_tokens double, n_crossing bigint, doc_tokens bigint"
    return docs.select(*picked).mapInArrow(counted, layout)
