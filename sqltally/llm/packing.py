"""Best-fit packing of tokenised documents under several capacities at once.

A sequence offers tokens, places for documents and attention cost (the sum of squared piece
lengths).  Pieces are taken longest first; among the open sequences that can hold a piece under
every constraint, the one with the smallest weighted norm of what remains (or the largest weighted
dot product of need and rest) takes it.  Pieces are dealt evenly to shards of bounded size that are
packed independently, so each shard leaves at most about one sequence part-filled.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltally.llm.common import cut_lineage, tasks_for, text_key

#: Id written after every document.
END_ID = 1
#: Chunks remembered by a worker; more are forgotten and tokenised again.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 48


#: Characters whose case, composition and class do not depend on neighbours or Unicode versions.
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_LETTER = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + n) for n, b in enumerate(hidden)}


class Chunks(dict):
    """Ids (as little-endian bytes) of text between spaces and line ends.

    The vocabulary's splitting drops white space and never lets a piece cross it, so a text's ids
    are those of its chunks in order.  Chunks of plain characters are cut into the vocabulary's
    pieces here and only the merges are left to the tokenizer; all others go through it whole.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.merges = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.merges(spelled)]
        found = self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def __missing__(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk and len(chunk) <= LONGEST_REMEMBERED:
            known = self.pieces
            found = b"".join([known.get(p) or self._piece(p) for p in _PIECE.findall(chunk.lower())])
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids if chunk else []
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= LONGEST_REMEMBERED:
            self[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@cache
def chunks(vocabulary: str) -> Chunks:
    """One per worker."""
    return Chunks(vocabulary)


def pieces(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", longest: int = 4096
) -> DataFrame:
    """(doc_id, text_key, piece, start, length, ids_crc32): ids of each text and an end id, cut at ``longest``.

    A null text counts as empty and has one piece, the end id.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunks(vocabulary)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for n, text in enumerate(b.column(2)):
                data = known.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(data), 4 * longest)):
                    part = data[at : at + 4 * longest]
                    row.append(n)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                ["doc_id", "text_key", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, text_key bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(
    lengths: np.ndarray, tokens: int, documents: int, attention: int, weights: tuple[float, float, float], rule: str = "norm"
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (integers that fit into an empty bin)."""
    caps = np.array([tokens, documents, attention], np.float64)
    scale = np.array(weights) / caps**2
    order = np.argsort(-lengths, kind="stable")
    smallest = int(lengths.min()) if len(lengths) else 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rest = np.empty((len(lengths), 3), np.int64)
    open_bins = np.empty(len(lengths), np.int64)
    count = made = 0
    for step, item in enumerate(order.tolist()):
        n = int(lengths[item])
        need = np.array([n, 1, n * n], np.int64)
        after = rest[:count] - need
        fits = np.flatnonzero((after >= 0).all(1))
        if len(fits):
            left = after[fits].astype(np.float64)
            if rule == "norm":
                at = int(fits[np.argmin((left * left) @ scale)])
            else:
                at = int(fits[np.argmax((rest[fits] * need).astype(np.float64) @ scale)])
        else:
            at = count
            rest[at] = (tokens, documents, attention)
            open_bins[at] = made
            count, made = count + 1, made + 1
        bins[item] = open_bins[at]
        offsets[item] = tokens - rest[at, 0]
        rest[at] -= need
        if step % 64 == 63:  # sequences that cannot take even the smallest piece are closed
            live = np.flatnonzero((rest[:count, 0] >= smallest) & (rest[:count, 1] > 0) & (rest[:count, 2] >= smallest * smallest))
            count = len(live)
            rest[:count], open_bins[:count] = rest[live], open_bins[live]
    return bins, offsets


def pack(
    docs: DataFrame,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    tokens: int = 4096,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
    shard: int = 20_000,
) -> DataFrame:
    """Pieces of ``docs`` with their sequence and offset; capacities left None do not bind.

    Pieces are cut so that each fits into an empty sequence.  ``shard`` is the number of pieces
    packed together.  Repeated rows are packed as often as they occur; an empty table gives no row.
    """
    documents = tokens if documents is None else documents
    attention = tokens * tokens if attention is None else attention
    longest = min(tokens, isqrt(attention))
    if min(longest, documents) < 1:
        raise ValueError("capacities must hold at least one id")
    cut = cut_lineage(pieces(docs, vocabulary, doc_id, text, longest))
    shards = tasks_for(cut.count(), shard)
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "text_key", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = best_fit(rows["length"].to_numpy(np.int64), tokens, documents, attention, weights, rule)
        return rows.assign(sequence_id=rows["shard"].to_numpy() * (1 << 32) + bins, offset=offsets)

    kind = cut.schema["doc_id"].dataType.simpleString()
    layout = f"doc_id {kind}, text_key bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    names = ["doc_id", "text_key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return dealt.groupBy("shard").applyInPandas(lambda rows: packed(rows)[names], layout)
