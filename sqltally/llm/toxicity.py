"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words that mark toxic documents is learned from labelled rows.  Every whole text then
gives dense features: lexicon densities, hits next to second-person words, capitals, punctuation
and obfuscation (look-alike digits, masked or spaced letters).  Boosted trees are fitted on one
part of a bounded sample of the labelled rows, the isotonic curve on the other part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sqltally.llm.common import cut_lineage, raw_text, tasks_for, text_key

SECOND_PERSON = frozenset(
    w.encode()
    for w in "you your yours yourself youre u ur tu te ti toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes vosotros".split()
)
#: Hits this many words from a second-person word count as aimed at the reader.
REACH = 5
#: Sampled rows of one task of the trees, which are grown in many short rounds: trees times depth.
ROUND_ROWS = 4_000
FEATURES = (
    "hit_rate", "hits", "distinct_hits", "weight_rate", "top_weight", "disguised_rate", "disguised", "mask_rate",
    "second_person_rate", "aimed_share", "capital_share", "punctuation_share", "shout_share", "digit_share", "symbol_share", "words",
)
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_WORDS = bytes(c if c in _LETTERS else 32 for c in range(256))
_PLAIN = bytes.maketrans(b"013457@$!", b"oieastasi")
_LOOKALIKE = bytes(_PLAIN[c] if _PLAIN[c] in _LETTERS else 32 for c in range(256))
_SEPARATORS = b".-_*'`~"
_MASKED = re.compile(rb"(?<=[a-z])[*#@$%]+(?=[a-z])")
_SPACED = re.compile(rb"(?: [a-z]){4,}(?= )")
_CLASSES = {"capital": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "small": b"abcdefghijklmnopqrstuvwxyz", "punctuation": b".,;:!?'\"()-", "shout": b"!?", "digit": b"0123456789", "symbol": b"@#$%*&^~|"}
_INDEX = {k: list(v) for k, v in _CLASSES.items()}


def words_of(data: bytes) -> list[bytes]:
    return data.lower().translate(_WORDS).split()


def features(data: bytes, lexicon: dict[bytes, float]) -> list[float]:
    """Dense features of one text, in the order of FEATURES."""
    low = data.lower()
    words = low.translate(_WORDS).split()
    total = len(words) or 1
    hits = [w for w in words if w in lexicon]
    known = set(hits)
    weights = [lexicon[w] for w in hits]
    looks = Counter(w for w in low.translate(_LOOKALIKE, _SEPARATORS).split() if w in lexicon)
    looks -= Counter(hits)
    spaced = [m.group().replace(b" ", b"") for m in _SPACED.finditer(b" " + b" ".join(words) + b" ")] if b" " in low else []
    disguised = sum(looks.values()) + sum(any(k in s for k in lexicon) for s in spaced)
    aimed, second = 0, [i for i, w in enumerate(words) if w in SECOND_PERSON]
    if hits and second:
        at = np.array([i for i, w in enumerate(words) if w in known])
        near = np.searchsorted(second, at - REACH), np.searchsorted(second, at + REACH, "right")
        aimed = int((near[1] > near[0]).sum())
    octets = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = {k: int(octets[v].sum()) for k, v in _INDEX.items()}
    letters, size = share["capital"] + share["small"] or 1, len(data) or 1
    masked = len(_MASKED.findall(low))
    return [
        len(hits) / total, log1p(len(hits)), float(len(known)), sum(weights) / total, max(weights, default=0.0),
        disguised / total, log1p(disguised), masked / total, len(second) / total, aimed / (len(hits) or 1),
        share["capital"] / letters, share["punctuation"] / size, share["shout"] / size, share["digit"] / size, share["symbol"] / size, log1p(len(words)),
    ]


def learn_lexicon(labelled: DataFrame, size: int = 256, least: int = 5, z: float = 4.0) -> dict[bytes, float]:
    """Words (at most ``size``) that mark toxic texts, with their log odds; ``labelled`` has raw, label.

    A word must be in ``least`` toxic texts and more frequent there by ``z`` standard errors.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = {0: Counter(), 1: Counter()}
            for raw, label in zip(b.column(0), b.column(1).to_pylist()):
                sums[label].update(set(words_of(raw.as_py())))
            for label, found in sums.items():
                names = pa.array(list(found), pa.binary())
                yield pa.RecordBatch.from_arrays([names, pa.array([label] * len(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["word", "label", "n"])

    size_of = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size_of.get(1, 0), size_of.get(0, 0)
    if not toxic or not clean:
        return {}
    one, zero = F.sum(F.expr("if(label = 1, n, 0)")), F.sum(F.expr("if(label = 0, n, 0)"))
    per = labelled.select("raw", "label").mapInArrow(counted, "word binary, label int, n bigint").groupBy("word").agg(one.alias("t"), zero.alias("c"))
    p = (F.col("t") + F.col("c") + 1) / (toxic + clean + 2)
    gap = (F.col("t") / toxic - F.col("c") / clean) / F.sqrt(p * (1 - p) * (1 / toxic + 1 / clean))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    rows = per.where(F.col("t") >= least).select("word", gap.alias("z"), odds.alias("w")).where(F.col("z") >= z)
    return {bytes(r["word"]): r["w"] for r in rows.orderBy(F.desc("z"), "word").limit(size).collect()}


def with_features(rows: DataFrame, lexicon: dict[bytes, float]) -> DataFrame:
    """Replace the column ``raw`` by ``features ARRAY<DOUBLE>``; the other columns stay."""
    kept = [c for c in rows.columns if c != "raw"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(raw.as_py(), lexicon) for raw in b.column("raw")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(found, pa.list_(pa.float64()))], [*kept, "features"])

    layout = StructType([*[rows.schema[c] for c in kept], StructField("features", ArrayType(DoubleType()))])
    return rows.mapInArrow(made, layout)


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, label: str, doc_id: str, text: str, most: int) -> DataFrame:
    """(label, raw, part): about ``most`` labelled rows where ``learn`` holds, equal texts once.

    Rows are chosen by a hash of the id; a document with several labels has their rounded mean.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.round(F.avg(label)).cast("int").alias("label"))
    total = known.count()
    share = min(1.0, most / total) if total else 1.0
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    rows = docs.where(learn).select(F.col(doc_id).alias("_id"), raw_text(text).alias("raw"), text_key(text).alias("_key"))
    part = F.pmod(F.xxhash64(F.lit(7), "_key"), F.lit(4))
    mean = F.round(F.avg("label")).cast("int").alias("label")
    return rows.join(known, "_id").groupBy("_key").agg(mean, F.first("raw").alias("raw")).select("label", "raw", part.alias("part"))


class Model:
    """Lexicon, trees and isotonic curve; ``rate`` alone where the labels have fewer than two values."""

    def __init__(self, sample: DataFrame, trees: int = 30, depth: int = 4, seed: int = 7):
        sample = cut_lineage(sample)
        self.trees = self.curve = None
        self.lexicon = learn_lexicon(sample)
        rows = cut_lineage(with_features(sample, self.lexicon)).withColumn("label", F.col("label").cast("double"))
        rows = rows.withColumn("vector", array_to_vector("features"))
        rate, count = rows.agg(F.avg("label"), F.count(F.lit(1))).first()
        self.rate = rate or 0.0
        # every round runs as many tasks as there are partitions, so these follow the rows and not the shuffle
        rows = rows.coalesce(tasks_for(count, ROUND_ROWS))
        fit, held = rows.where("part > 0"), rows.where("part = 0")
        if fit.select("label").distinct().count() < 2 or held.select("label").distinct().count() < 2:
            return
        self.trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed).fit(fit)
        self.curve = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(self._margin(held))

    def _margin(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("margin", vector_to_array("probability")[1])

    def _scored(self, rows: DataFrame) -> DataFrame:
        """Replace the column ``raw`` by ``score``; the other columns stay."""
        kept = [c for c in rows.columns if c != "raw"]
        if self.trees is None:
            return rows.select(*kept, F.lit(float(self.rate)).alias("score"))
        made = with_features(rows, self.lexicon).withColumn("vector", array_to_vector("features"))
        found = self.curve.transform(self._margin(made))
        return found.select(*kept, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "calibrated")).alias("score"))

    def score(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, score) for every row; a null text counts as empty."""
        return self._scored(docs.select(F.col(doc_id).alias("doc_id"), raw_text(text).alias("raw")))

    def keep(self, docs: DataFrame, limit: float, text: str = "text") -> DataFrame:
        """Rows of ``docs`` that score under ``limit``, all of them where nothing could be learned.

        Whole rows pass the scorer, so nothing is joined.
        """
        if self.trees is None:
            return docs
        whole = docs.select(F.struct(*docs.columns).alias("row"), raw_text(text).alias("raw"))
        return self._scored(whole).where(F.col("score") < limit).select("row.*")


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", most: int = 20_000
) -> Model:
    """Fit on at most about ``most`` labelled rows where ``learn`` holds."""
    return Model(labelled_sample(docs, labels, learn, label, doc_id, text, most))
