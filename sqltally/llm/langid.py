"""Languages of a document as a mixture, inferred by expectation-maximisation.

Character trigram counts per language give likelihoods; each document's language proportions are
fitted by EM over its trigrams.  Among the sets of its 1, 2, ... and up to all most probable languages the
one with the best penalised likelihood (two logs of the trigram count per extra language, times
``strictness``) is kept.  Sizes whose penalty exceeds what any mixture could gain are not tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trigrams are hashed into this many counters.
BUCKETS = 1 << 15
SHIFT = np.uint32(32 - 15)
UNKNOWN = "und"
ROUNDS = 8
#: ASCII characters that are no letters read as a space.
FOLD = {c: " " for c in range(128) if not chr(c).isalpha()}
_TABLE = np.arange(128, dtype=np.uint32)
_TABLE[list(FOLD)] = 32


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased text, words padded by a space."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    points = np.where(points < 128, _TABLE[np.minimum(points, 127)], points)
    points = points[(points != 32) | np.concatenate([[True], points[:-1] != 32])]
    a, b, c = points[:-2], points[1:-1], points[2:]
    mixed = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + c * np.uint32(0xC2B2AE35)
    return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> SHIFT


def trigram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) over every row with a text and a language."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[str, np.ndarray] = {}
            for whole, name in zip(b.column(0), b.column(1).to_pylist()):
                found = np.bincount(trigrams(whole.as_py()), minlength=BUCKETS)
                sums[name] = sums[name] + found if name in sums else found
            for name, found in sums.items():
                at = np.flatnonzero(found)
                columns = [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(counted, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log likelihoods of trigrams per language; at most ``most`` languages of BUCKETS numbers each."""

    def __init__(self, counts: DataFrame, most: int = 256):
        names = sorted(r["lang"] for r in counts.select("lang").distinct().limit(most + 1).collect())
        if len(names) > most:
            raise ValueError(f"more than {most} languages; raise `most` if they are meant")
        table = np.full((len(names), BUCKETS), 0.5)
        per = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c"))
        for row in per.toLocalIterator():
            for cell in row["c"]:
                table[names.index(row["lang"]), cell["bucket"]] += cell["n"]
        self.names = names
        self.log = np.log(table / table.sum(1, keepdims=True)).astype(np.float32) if names else table


def fit_mixture(likelihood: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM proportions and mean log likelihood; ``likelihood`` is trigrams x languages."""
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    for _ in range(rounds):
        mixed = likelihood * share
        total = mixed.sum(1)
        share = (counts / total) @ mixed / counts.sum()
    return share, float(counts @ np.log(likelihood @ share))


def likelihood_bound(likelihood: np.ndarray, counts: np.ndarray, share: np.ndarray, score: float) -> float:
    """No proportions have a larger log likelihood than this, by the gradient at ``share``."""
    gains = (counts / (likelihood @ share)) @ likelihood / counts.sum()
    return score + float(counts.sum() * np.log(gains.max()))


def mixture(text: str, log: np.ndarray, strictness: float = 1.0) -> list[tuple[int, float]]:
    """(language index, proportion) of the chosen set, largest first."""
    grams, counts = np.unique(trigrams(text), return_counts=True)
    counts = counts.astype(np.float64)
    rows = log[:, grams].T.astype(np.float64)
    offset = rows.max(1)
    likelihood = np.exp(rows - offset[:, None])
    if likelihood.shape[1] == 1:
        return [(0, 1.0)]
    share, score = fit_mixture(likelihood, counts)
    bound = likelihood_bound(likelihood, counts, share, score)
    ranked = np.argsort(-share, kind="stable")
    single = counts @ (rows - offset[:, None])
    if single[ranked[0]] < single.max():  # the best single language leads the nested sets
        ranked = np.concatenate([[single.argmax()], ranked[ranked != single.argmax()]])
    best, kept = float(single[ranked[0]]), [(int(ranked[0]), 1.0)]
    fee = strictness * 2 * np.log(counts.sum() + 1)
    for size in range(2, len(ranked) + 1):
        if bound - fee * (size - 1) <= best:
            break
        chosen = ranked[:size]
        share, score = fit_mixture(likelihood[:, chosen], counts)
        if score - fee * (size - 1) > best:
            best = score - fee * (size - 1)
            kept = sorted(zip(chosen.tolist(), share.tolist()), key=lambda x: -x[1])
    return kept


def predict(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", strictness: float = 1.0
) -> DataFrame:
    """(doc_id, lang_pred, score, languages): leading language, its proportion, and the chosen set.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    """
    names, log = model.names, model.log
    item = pa.struct([("lang", pa.string()), ("share", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leads, scores, sets = [], [], []
            for cell in b.column(1):
                whole = cell.as_py()
                found = mixture(whole, log, strictness) if whole and names and has_letter(whole) else []
                leads.append(names[found[0][0]] if found else UNKNOWN)
                scores.append(min(1.0, found[0][1]) if found else 0.0)
                sets.append([{"lang": names[k], "share": s} for k, s in found])
            columns = [b.column(0), pa.array(leads, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(item))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "languages"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scored, f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def identify(
    docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", strictness: float = 1.0
) -> DataFrame:
    """Learn from the rows of ``docs`` where ``learn`` holds, then predict every row."""
    model = Model(trigram_counts(docs.where(learn), text, lang))
    return predict(docs, model, doc_id, text, strictness)
