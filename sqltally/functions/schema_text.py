"""CREATE TABLE texts of questions, written for a whole Arrow batch at once.

A catalog is the list of tables of ``operators.catalog``: ``table_id, ident`` and ``columns``, which hold ``column_id, ident,
head, comment, silent, number, samples, pk, fks``.  With ``cols`` (``column_id, low, is_key``) columns are chosen for training.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sqltally.functions.digests import seeded_draws

#: Characters of schema text that are made at once.
TEXT_AT_ONCE = 8_000_000
#: A comma at the end, or before the line break that ends a text, as ``,$`` in Java.
LAST_COMMA = re.compile(r",(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)")


def _quoted(value: str) -> str:
    """A text value as it stands in an example list."""
    return f'"{value}"' if "'" in value and '"' not in value else "'" + value.replace("'", "\\'") + "'"


def column_line(c: Mapping[str, Any], found: Sequence[str | None], silent: bool, limit: int) -> str | None:
    """The line of a column, with the values ``found`` for it first."""
    if c["head"] is None:
        return None
    values = list(dict.fromkeys([*found, *c["samples"]]))[:limit]
    shown = ", ".join(v if c["number"] else _quoted(v) for v in values if v is not None)
    said = ([] if silent else [c["comment"]]) + ([f"example: [{shown}]"] if values else [])
    return c["head"] + (" -- " + ", ".join(said) if said else "")


def _picked(texts: Sequence[str | None], at: np.ndarray, where: np.ndarray) -> pa.Array:
    """``texts[at]`` where it is wanted, else NULL."""
    return pc.take(pa.array(texts, pa.string()), pa.array(at.astype(np.int32), mask=~where))


def _joined(parts: Sequence[pa.Array], sep: str) -> pa.Array:
    """The parts that are not NULL, with ``sep`` between them."""
    if all(p.null_count for p in parts):
        # Arrow leaves out the rows that have no part at all
        bare = reduce(pc.and_, map(pc.is_null, parts))
        parts = [pc.if_else(bare, "", parts[0]), *parts[1:]]
    return pc.binary_join_element_wise(*parts, sep, null_handling="skip")


def _table_texts(t: Mapping[str, Any], on: np.ndarray, silent: np.ndarray, found: Mapping[int, list[tuple[int, tuple]]], limit: int) -> pa.Array:
    """The text of a table per question, NULL where no column is ``on``; ``found`` has the matched values by column and question."""
    some, none = on.any(axis=0), np.zeros(on.shape[1], np.int32)
    if t["ident"] is None:
        return pa.nulls(len(some), pa.string())
    # from the last part to the first: the last one loses its comma
    every = np.ones(len(some), bool)
    after, parts = ~every, [_picked([");"], none, every)]

    def put(texts: list[str | None], at: np.ndarray, where: np.ndarray) -> None:
        parts.append(_picked(texts, at, where))
        after[where] = True

    for c, here in reversed([*zip(t["columns"], on)]):
        if c["fks"]:
            whole = "\n".join(c["fks"])
            put([LAST_COMMA.sub("", whole), whole], after, here)
    keyed = [(c["ident"], here) for c, here in zip(t["columns"], on) if c["pk"]]
    if keyed:
        names = _joined([_picked([name], none, here) for name, here in keyed], ", ")
        here = np.any([h for _, h in keyed], axis=0)
        ends = _picked([")", "),"], after, here)
        parts.append(pc.binary_join_element_wise("    PRIMARY KEY (", names, ends, "", null_handling="emit_null"))
        after |= here
    for c, here, quiet in reversed([*zip(t["columns"], on, silent)]):
        lines = [column_line(c, (), q, limit) for q in (False, True)]
        if lines[0] is None:
            continue
        at = quiet + 0
        known: dict[tuple, int] = {}
        for row, values in found.get(c["column_id"], ()):
            key = (values, bool(quiet[row]))
            if key not in known:
                known[key] = len(lines)
                lines.append(column_line(c, *key, limit))
            at[row] = known[key]
        put([*lines, *(LAST_COMMA.sub("", line) for line in lines)], at + np.where(after, 0, len(lines)), here)
    if not after[some].all():
        parts.append(_picked([""], none, some & ~after))
    parts.append(_picked([f"CREATE TABLE {t['ident']} ("], none, every))
    return pc.if_else(pa.array(some), _joined(parts[::-1], "\n"), pa.scalar(None, pa.string()))


def _chosen(cols: Sequence[Mapping[str, Any]], sql: pa.Array, first: np.ndarray, last: np.ndarray, share: np.ndarray, cap: int) -> np.ndarray:
    """A row per column, true for the questions that show it: keys, columns named in ``sql`` and a share of the others, by their draws."""
    # sorted as (spare, draw), where an unknown ``spare`` comes first
    sort = np.empty(first.shape, np.uint64)
    for k, c in enumerate(cols):
        if c["is_key"]:
            sort[k] = 1
        elif c["low"] is None:
            sort[k] = 0
        else:
            sort[k] = pc.fill_null(pc.if_else(pc.match_substring(sql, c["low"]), 1, 2), 0).to_numpy(zero_copy_only=False)
    needed = (sort == 1).sum(axis=0)
    low_bits = first << np.uint64(62) | last >> np.uint64(2)
    sort = np.ascontiguousarray((sort << np.uint64(62) | first >> np.uint64(2)).T)
    order = np.argsort(sort, axis=1, kind="stable")
    in_order = np.take_along_axis(sort, order, axis=1)
    if (in_order[:, 1:] == in_order[:, :-1]).any():
        order = np.lexsort((low_bits.T, sort), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(cols))[None, :], axis=1)
    extra = np.minimum(share * (len(cols) - needed) // 10, np.maximum(0, cap - needed))
    return rank.T < needed + extra


def _texts(catalog: Mapping[str, Any], asked: pa.RecordBatch, training: bool, hide_comments: bool, seed: int, cap: int, limit: int) -> pa.Array:
    """The schema text of each question of one database."""
    tables, n = catalog["tables"], asked.num_rows
    columns = [c for t in tables for c in t["columns"]]
    items = {
        "share": [""] * training,
        "column": [f"|{c['column_id']}" for c in catalog["cols"]] if training else [],
        "table": [f"|{t['table_id']}" for t in tables] if training else [],
        "comment": [f"|{c['column_id']}" for c in columns] if hide_comments else [],
        "share of": [f"|{t['table_id']}" for t in tables] if hide_comments else [],
    }
    firsts, lasts = seeded_draws(seed, asked["_id"], [what + item for what, some in items.items() for item in some])
    cuts = np.cumsum([len(some) for some in items.values()])[:-1]
    first, last = (dict(zip(items, np.split(x, cuts))) for x in (firsts, lasts))
    below = lambda draw, most: (draw >> np.uint64(32)).astype(np.int64) % most
    on = np.ones((len(columns), n), bool)
    if training:
        chosen = _chosen(catalog["cols"], asked["_sql"], first["column"], last["column"], below(first["share"][0], 10) + 1, cap)
        for k, c in enumerate(columns):
            on[k] = chosen[[i for i, other in enumerate(catalog["cols"]) if other["column_id"] == c["column_id"]]].any(axis=0)
    if hide_comments:
        shares = np.repeat(below(first["share of"], 11) * 100, [len(t["columns"]) for t in tables], axis=0)
        silent = below(first["comment"], 1000) >= shares
    else:
        silent = np.repeat([[c["silent"]] for c in columns], n, axis=1)
    found: dict[int, list[tuple[int, tuple]]] = {}
    if "_found" in asked.schema.names:
        rows = np.flatnonzero(asked["_found"].is_valid().to_numpy(zero_copy_only=False))
        for row, matches in zip(rows.tolist(), pc.take(asked["_found"], pa.array(rows)).to_pylist()):
            for m in matches:
                found.setdefault(m["column_id"], []).append((row, tuple(m["values"])))
    texts, at = [], 0
    for t in tables:
        end = at + len(t["columns"])
        texts.append(_table_texts(t, on[at:end], silent[at:end], found, limit))
        at = end
    if training:
        order = np.lexsort((last["table"], first["table"]), axis=0)
        whole = pa.concat_arrays(texts)
        texts = [pc.take(whole, pa.array(places * n + np.arange(n))) for places in order]
    return _joined(texts, "\n\n")


def schema_texts(catalogs: Mapping[str, Mapping[str, Any]], training: bool, hide_comments: bool, seed: int, cap: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(question_id, db_id, ddl, n_chars)`` from batches of ``question_id, db_id, _id`` (as text), ``_sql`` for training and ``_found``, if any."""
    sizes = {db: sum(len(column_line(c, (), False, limit) or "") + sum(map(len, c["fks"])) + 40 for t in one["tables"] for c in t["columns"]) for db, one in catalogs.items()}

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for db in pc.unique(batch["db_id"]).to_pylist():
                if db not in catalogs:
                    continue
                mine = batch.filter(pc.equal(batch["db_id"], db))
                own = mine["_found"].nbytes // mine.num_rows if "_found" in mine.schema.names else 0
                step = max(1, TEXT_AT_ONCE // (sizes[db] + own + 1))
                for part in (mine.slice(at, step) for at in range(0, mine.num_rows, step)):
                    ddl = _texts(catalogs[db], part, training, hide_comments, seed, cap, limit)
                    n_chars = pc.utf8_length(ddl).cast(pa.int64())
                    yield pa.RecordBatch.from_arrays([part["question_id"], part["db_id"], ddl, n_chars], ["question_id", "db_id", "ddl", "n_chars"])

    return written
