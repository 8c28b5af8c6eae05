"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage of the whole text is encoded by dense statistics;
gated attention weighs the passages of a document, and a logistic output scores the weighted
passage representation.  Encoder weights, attention and output are learned together from document
labels, by Adam over a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltally.llm.common import raw_text, text_key

#: Bytes of a passage; it ends at the next white space after them.
PASSAGE = 512
#: Shares of these characters are features.
COUNTED = [bytes([c]) for c in b" \n.,;:!?|*#%&$@=<>{}[]()/\\_-+~^\"'"]
_GROUPS = [list(range(65, 91)), list(range(97, 123)), list(range(48, 58)), list(range(128, 256)), list(range(0, 32))]
_SINGLES = [c[0] for c in COUNTED]
WIDTH = len(_GROUPS) + len(_SINGLES) + 7


def passages(data: bytes) -> list[bytes]:
    """The text cut after PASSAGE bytes, at the next white space; an empty text is one empty passage."""
    cut, at = [], 0
    while len(data) - at > PASSAGE:
        stop = at + PASSAGE
        blank, line = data.find(b" ", stop, stop + PASSAGE), data.find(b"\n", stop, stop + PASSAGE)
        ends = [x for x in (blank, line) if x >= 0]
        stop = min(ends) + 1 if ends else stop
        cut.append(data[at:stop])
        at = stop
    cut.append(data[at:])
    return cut


def encode(passage: bytes) -> list[float]:
    """Character shares, word lengths, repetition and line statistics of one passage."""
    octets = np.bincount(np.frombuffer(passage, np.uint8), minlength=256)
    size = len(passage) or 1
    words = passage.split()
    n = len(words) or 1
    seen = Counter(words)
    lengths = [*map(len, words)] or [0]
    lines = passage.split(b"\n")
    shares = np.sqrt(np.concatenate([[octets[g].sum() for g in _GROUPS], octets[_SINGLES]]) / size)
    return [
        *shares.tolist(), len(seen) / n, max(seen.values(), default=0) / n, sum(lengths) / n / 10, max(lengths) / 40,
        len(set(lines)) / len(lines), min(1.0, n / 100), np.log1p(len(lines)) / 5,
    ]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Gated attention over bags: passages in rows, ``starts`` the first row of each bag."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 5):
        draw = np.random.default_rng(seed)

        def made(a: int, b: int) -> np.ndarray:
            return draw.normal(0, 1 / np.sqrt(a), (a, b))

        self.p = {"W": made(WIDTH, hidden), "b": np.zeros(hidden), "V": made(hidden, gate), "U": made(hidden, gate), "w": made(gate, 1)[:, 0], "c": made(hidden, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.spread = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        p = self.p
        bag = np.repeat(np.arange(len(starts)), np.diff([*starts, len(x)]))
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        pooled = np.add.reduceat(a[:, None] * h, starts)
        return {"bag": bag, "z": z, "h": h, "t": t, "g": g, "a": a, "pooled": pooled, "score": sigmoid(pooled @ p["c"] + p["d"])}

    def gradients(self, f: dict, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, out = self.p, (f["score"] - y) / len(y)
        pooled = out[:, None] * p["c"]
        by_row = pooled[f["bag"]]
        a = (by_row * f["h"]).sum(1)
        e = f["a"] * (a - np.add.reduceat(f["a"] * a, starts)[f["bag"]])
        tg = e[:, None] * p["w"]
        dt, dg = tg * f["g"] * (1 - f["t"] ** 2), tg * f["t"] * f["g"] * (1 - f["g"])
        h = f["a"][:, None] * by_row + dt @ p["V"].T + dg @ p["U"].T
        h *= 1 - f["h"] ** 2
        return {"W": f["z"].T @ h, "b": h.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ e, "c": f["pooled"].T @ out, "d": np.array([out.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, size: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Attention:
        rows = np.concatenate(bags)
        self.mean, self.spread = rows.mean(0), rows.std(0) + 1e-3
        draw, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = draw.permutation(len(bags))
            for at in range(0, len(order), size):
                picked = order[at : at + size]
                sizes = np.array([len(bags[i]) for i in picked])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                f = self.forward(np.concatenate([bags[i] for i in picked]), starts)
                step += 1
                for k, grad in self.gradients(f, starts, labels[picked]).items():
                    grad = grad + decay * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad**2
                    self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
        return self.forward(np.concatenate(bags), starts)["score"]


def encoded(data: bytes) -> np.ndarray:
    return np.array([encode(p) for p in passages(data)])


def bag_sample(docs: DataFrame, labels: DataFrame, learn: Column, label: str, doc_id: str, text: str, most: int) -> DataFrame:
    """(label, bag BINARY) of about ``most`` labelled rows where ``learn`` holds, equal texts once."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.round(F.avg(label)).cast("int").alias("label"))
    total = known.count()
    share = min(1.0, most / total) if total else 1.0
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    rows = docs.where(learn).select(F.col(doc_id).alias("_id"), raw_text(text).alias("raw"), text_key(text).alias("_key"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [encoded(raw.as_py()).astype(np.float32).tobytes() for raw in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bags, pa.binary())], ["label", "bag"])

    mean = F.round(F.avg("label")).cast("int").alias("label")
    sample = rows.join(known, "_id").groupBy("_key").agg(mean, F.first("raw").alias("raw")).select("label", "raw")
    return sample.mapInArrow(made, "label int, bag binary")


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", most: int = 4_000, epochs: int = 30
) -> tuple[Attention | None, float]:
    """(model, share of label 1) from about ``most`` labelled rows where ``learn`` holds.

    The model is None where the sample has fewer than two labels.
    """
    rows = sorted(bag_sample(docs, labels, learn, label, doc_id, text, most).collect())
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH).astype(np.float64) for r in rows]
    y = np.array([r["label"] for r in rows], np.float64)
    rate = float(y.mean()) if len(y) else 0.0
    return (Attention().fit(bags, y, epochs) if len(set(y.tolist())) > 1 else None), rate


def score(docs: DataFrame, model: Attention | None, rate: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, passages) for every row; a null text counts as empty, no model scores ``rate``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, sizes = [], []
            for at in range(0, b.num_rows, 256):
                bags = [encoded(raw.as_py()) for raw in b.column(1)[at : at + 256]]
                found.append(model.scores(bags) if model else np.full(len(bags), rate))
                sizes += map(len, bags)
            if found:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(found)), pa.array(sizes, pa.int32())], ["doc_id", "score", "passages"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), raw_text(text).alias("raw"))
    return rows.mapInArrow(scored, f"doc_id {kind}, score double, passages int")
