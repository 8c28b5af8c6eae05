"""Benchmark decontamination over canonical templates.

Numbers, names and units become typed placeholders, and neighbouring ones of a kind one placeholder,
so that a question asked again with other values keeps its template.  Windows of template tokens are
hash-joined between benchmark items and documents; the matches of a pair are put together over
neighbouring diagonals in increasing order, their share of the item is measured, and the values
behind the placeholders must map one to one between item and document.

Templates do not carry short items and those made of numbers and names.  Windows of the raw tokens
in lower case, or whole shorter items, are joined as well, so that every item of two characters or
more is found verbatim.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqltally.llm.common import cut_lineage, tasks_for, text_key

#: Template tokens, and any other character that is not white space.
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[^\w\s]|_")
SYMBOLS = frozenset("$€£¥%")
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yards mile miles mg g kg gram grams kilogram kilograms oz lb lbs pound pounds ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees mph kmh watt watts volt volts".split()
)
UNKNOWN, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: Values of one block of benchmark items held by every task: template tokens.
BLOCK_TOKENS = 1_000_000
REMEMBERED = 200_000
#: Stands between texts that are looked at together; no window reaches over it.
BORDER = " "
#: Tokens of texts looked at together; a longer text is alone.
TOGETHER = 200_000
#: Low bits of a window hash that a table of flags tests before the hash is looked up.
FLAG_BITS = 22
#: Code of tokens that are in no template.
SKIPPED = np.iinfo(np.int64).min
_BASE = [pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(64)]


class Codes(dict):
    """64-bit codes of tokens: UNKNOWN outside ``words``, a placeholder, or a hash of the lower case.

    Every different token is coded once, for templates and raw; the dictionary holds its row of the growing
    table of codes, where tokens with equal codes share a row.  A unit word has the negated code, since it
    is a unit only after a number.
    """

    def __init__(self, words: frozenset[str] | None = None):
        super().__init__()
        self.words, self.table = words, np.zeros((1024, 2), np.int64)
        self.rows: dict[tuple[int, int], int] = {}

    def _code(self, token: str) -> tuple[int, int]:
        low = token.lower()
        known, unit = self.words is None or low in self.words, low in UNITS
        if token == BORDER or not (known or unit) and token == low and low[0].isalpha():
            return UNKNOWN, UNKNOWN
        raw = (xxhash.xxh64_intdigest(low.encode(), 1) >> 2) + 16 if known or unit else UNKNOWN
        if low[0].isdigit():
            code = NUMBER
        elif not low[0].isalpha():
            code = UNIT if low in SYMBOLS or low[0].isalnum() else SKIPPED
        elif token[0].isupper() and (len(token) == 1 or token[1:].islower()):
            code = NAME
        elif not known and not unit:
            code = UNKNOWN
        else:
            code = -raw if unit else raw
        return code, raw if known else UNKNOWN

    def __missing__(self, token: str) -> int:
        pair = self._code(token)
        row = self.rows.get(pair)
        if row is None:
            row = self.rows[pair] = len(self.rows)
            if row == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[row] = pair
        self[token] = row
        return row

    def both(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Template codes and raw codes."""
        if len(self) >= REMEMBERED:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        codes = self.table[rows]
        return codes[:, 0], codes[:, 1]


class Template:
    """Placeholders and words of a text: codes, and the first and last place of each in ``places`` of template tokens."""

    def __init__(self, tokens: list[str], codes: np.ndarray):
        self.tokens, self.places = tokens, np.flatnonzero(codes != SKIPPED)
        codes = codes[self.places]
        unit = codes < 0
        if unit.any():
            counted = unit & np.concatenate([[False], codes[:-1] == NUMBER])
            codes = np.where(counted, UNIT, np.abs(codes))
        self.plain = codes
        # names in a row, and numbers with their units, are one placeholder
        kind = np.where(codes == NAME, 1, np.where((codes == NUMBER) | (codes == UNIT), 2, 0))
        self.starts = np.flatnonzero(np.concatenate([[True], (kind[1:] == 0) | (kind[1:] != kind[:-1])])) if len(codes) else np.zeros(0, np.int64)
        self.codes = np.minimum.reduceat(codes, self.starts) if len(codes) else codes
        self.ends = np.append(self.starts[1:], len(codes))

    def slots(self, at: int, width: int) -> str:
        """Placeholders of a window: place in it, kinds and values of their tokens."""
        out = []
        for i in range(at, at + width):
            if self.codes[i] <= UNIT:
                inside = range(int(self.starts[i]), int(self.ends[i]))
                parts = " ".join(self.tokens[self.places[k]].lower().replace(",", "") for k in inside)
                out.append(f"{i - at}\t{''.join(str(int(self.plain[k])) for k in inside)}\t{parts}")
        return "\n".join(out)


def _read(slots: str) -> list[tuple[int, str, list[str]]]:
    cells = (line.split("\t") for line in slots.split("\n")) if slots else ()
    return [(int(place), kinds, parts.split(" ")) for place, kinds, parts in cells]


def window_hashes(codes: np.ndarray, width: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows without unknown tokens that have at least ``literals`` words."""
    count = len(codes) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    plain = np.concatenate([[0], np.cumsum(codes > UNIT)])
    known = np.concatenate([[0], np.cumsum(codes != UNKNOWN)])
    at = np.flatnonzero((plain[width:] - plain[:-width] >= literals) & (known[width:] - known[:-width] == width))
    mixed = codes.view(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    total = np.full(len(at), width, np.uint64)
    for j in range(width):
        total += (mixed[at + j] ^ np.uint64(_BASE[j] >> 7)) * np.uint64(_BASE[j] | 1)
    return at, total.view(np.int64)


def item_windows(benchmark: DataFrame, item_id: str, text: str, width: int, literals: int, least: int) -> DataFrame:
    """(item_id, raw, size, width, offset, at, hash, slots, words, rich): windows of every item of two characters or more.

    Templates are made of items with at least ``least`` tokens, raw windows of all.  ``at`` counts the
    template tokens before the window.  A rich item has ``least`` different words besides its values.
    """
    names = ["item_id", "raw", "size", "width", "offset", "at", "hash", "slots", "words", "rich"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, whole in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = TOKEN.findall(whole)
                if len(whole.strip()) < 2:
                    continue
                codes, raw = Codes().both(tokens)
                template = Template(tokens, codes)
                words = sorted({t.lower() for t in tokens})
                rich = len(set(template.codes[template.codes > UNIT].tolist())) >= least
                span = min(width, len(tokens))
                for n, (at, h) in enumerate(zip(*(x.tolist() for x in window_hashes(raw, span, 0)))):
                    before = int(np.searchsorted(template.places, at))
                    rows.append((item, True, len(tokens), span, at, before, h, "", words if n == 0 else [], rich))
                count = len(template.codes)
                if count >= least:
                    span = min(width, count)
                    for at, h in zip(*(x.tolist() for x in window_hashes(template.codes, span, min(literals, span)))):
                        rows.append((item, False, count, span, at, int(template.starts[at]), h, template.slots(at, span), [], rich))
            kinds = [b.schema.field(0).type, pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    kind = benchmark.schema[item_id].dataType.simpleString()
    rows = benchmark.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(made, f"item_id {kind}, raw boolean, size int, width int, offset bigint, at bigint, hash bigint, slots string, words array<string>, rich boolean")


def _document_hits(docs: DataFrame, doc_id: str, text: str, words: frozenset[str], hashes: dict[tuple[bool, int], np.ndarray], literals: int, width: int) -> DataFrame:
    """Windows of documents whose hash is among ``hashes`` (sorted, by raw or not and window width).

    Raw windows shorter than ``width`` are whole items; the first of equal ones is enough.
    """
    names = ["doc_id", "text_key", "raw", "width", "position", "doc_at", "hash", "doc_slots"]

    low = (1 << FLAG_BITS) - 1

    def search(codes_of: Codes, flags: dict, tokens: list[str], starts: np.ndarray) -> Iterator[tuple]:
        """(text, raw, width, position, template tokens before, hash, slots) of the matching windows of texts from ``starts`` on."""
        codes, plain = codes_of.both(tokens)
        template = Template(tokens, codes)
        ahead = np.searchsorted(template.places, starts)  # template tokens before each text
        folded = np.searchsorted(template.starts, ahead)  # the same after placeholders are joined
        for (raw, span), wanted in hashes.items():
            at, found = window_hashes(plain, span, 0) if raw else window_hashes(template.codes, span, min(literals, span))
            maybe = np.flatnonzero(flags[raw, span][found & low])
            place = np.minimum(np.searchsorted(wanted, found[maybe]), len(wanted) - 1)
            hit = maybe[wanted[place] == found[maybe]]
            owner = np.searchsorted(starts if raw else folded, at[hit], "right") - 1
            if raw and span < width:
                pairs = np.stack([owner, found[hit]], 1)
                first = np.sort(np.unique(pairs, axis=0, return_index=True)[1])
                hit, owner = hit[first], owner[first]
            for i, n in zip(hit.tolist(), owner.tolist()):
                start = int(at[i])
                if raw:
                    before, slots = int(np.searchsorted(template.places, start)), ""
                else:
                    before, slots = int(template.starts[start]), template.slots(start, span)
                yield n, raw, span, start - int((starts if raw else folded)[n]), before - int(ahead[n]), int(found[i]), slots

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes_of = Codes(words)
        flags = {key: np.bincount(wanted & low, minlength=1 << FLAG_BITS).astype(bool) for key, wanted in hashes.items()}
        for b in batches:
            row, cells = [], [[] for _ in range(6)]
            tokens, starts, first = [], [], 0
            for n, whole in enumerate(b.column(2)):
                tokens.append(BORDER)
                starts.append(len(tokens))
                tokens += TOKEN.findall(whole.as_py())
                if len(tokens) >= TOGETHER or n + 1 == b.num_rows:
                    for k, *values in search(codes_of, flags, tokens, np.array(starts)):
                        row.append(first + k)
                        for cell, value in zip(cells, values):
                            cell.append(value)
                    tokens, starts, first = [], [], n + 1
            take = pa.array(row, pa.int64())
            kinds = [pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *[pa.array(c, t) for c, t in zip(cells, kinds)]], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(made, f"doc_id {kind}, text_key bigint, raw boolean, width int, position bigint, doc_at bigint, hash bigint, doc_slots string")


def _values(kinds: str, x: list[str], y: list[str], first: bool, last: bool) -> list[tuple[str, str, str]]:
    """(kind, value of the item, value of the document) of one placeholder with words ``x`` and ``y``.

    Values of equally many words are compared word by word; others as a whole, without the words
    that both begin or end with.  At the ends of an item the document's text around it may add words.
    """
    if first and last and any(y[k : k + len(x)] == x for k in range(len(y) - len(x) + 1)):
        y = x
    elif first and len(y) > len(x) and y[-len(x) :] == x or last and len(y) > len(x) and y[: len(x)] == x:
        y = x
    if len(x) == len(y):
        return list(zip(kinds, x, y))
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    same = [(k, v, v) for k, v in [*zip(kinds[:head], x[:head]), *zip(kinds[len(x) - tail :], x[len(x) - tail :])]]
    if head + tail == min(len(x), len(y)):
        same, head, tail = [], 0, 0
    return [*same, (min(kinds), " ".join(x[head : len(x) - tail]), " ".join(y[head : len(y) - tail]))]


def _one_to_one(slots: set[tuple[str, str, str]]) -> bool:
    return len({s[:2] for s in slots}) == len(slots) == len({(s[0], s[2]) for s in slots})


def _longest(hits: list[dict]) -> list[dict]:
    """Windows of the longest stretch without a gap."""
    best, now, size, end = [], [], 0, -1
    for h in sorted(hits, key=lambda h: h["offset"]):
        now = [*now, h] if h["offset"] <= end else [h]
        end = h["offset"] + h["width"]
        if end - now[0]["offset"] > size:
            best, size = now.copy(), end - now[0]["offset"]
    return best


def diagonal_unit(size: int, raw: bool, hits: list[dict]) -> tuple[int, int, int, int, int, set] | None:
    """(position, offset, end, start, mask, slots) of the windows on one diagonal, or None where values disagree.

    The mask has a bit for each covered token of the item.  Raw windows have no values to compare, so
    only a stretch without a gap counts.
    """
    mask, slots = 0, set()
    hits = _longest(hits) if raw else hits
    for h in hits:
        mask |= ((1 << h["width"]) - 1) << h["offset"]
        for (place, kinds, x), (_, _, y) in zip(_read(h["slots"]), _read(h["doc_slots"])):
            slots.update(_values(kinds, x, y, h["offset"] + place == 0, h["offset"] + place == size - 1))
    if not _one_to_one(slots):
        return None
    first = min(hits, key=lambda h: h["offset"])
    return first["position"], first["offset"], mask.bit_length(), first["doc_at"] - first["at"], mask, slots


def judge(size: int, raw: bool, rich: bool, units: list[tuple], coverage: float, shift: int, width: int) -> tuple[int, float, bool] | None:
    """(position, coverage, reworded) of the best run of diagonals of an item in a document, or None.

    Diagonals follow each other where offset and position both grow and the diagonal moves by at most
    ``shift`` tokens; their values must agree, and a run spans no more than ``_span`` tokens.  Raw ones stand alone.
    """
    units = sorted(units, key=lambda u: u[:2])
    runs: list[tuple[int, set, int, int]] = []
    best = None
    for n, (position, offset, end, start, mask, slots) in enumerate(units):
        run = (mask, slots, start, position)
        for k in range(n - 1, -1, -1) if not raw else ():
            p, o, e, *_ = units[k]
            if p < position - size - shift:
                break
            if abs((p - o) - (position - offset)) > shift or not (p < position and o < offset and e < end):
                continue
            if e + p - o > position + width // 2 or position - runs[k][3] >= _span(size, shift):
                continue
            joined = runs[k][0] | mask
            if joined.bit_count() > run[0].bit_count() and _one_to_one(runs[k][1] | slots):
                run = (joined, runs[k][1] | slots, *runs[k][2:])
        runs.append(run)
        share = run[0].bit_count() / size
        reworded = any(x != y for _, x, y in run[1])
        if share >= coverage and (rich or not reworded) and (best is None or (-share, run[2]) < (-best[1], best[0])):
            best = (run[2], share, reworded)
    return best


def _span(size, shift: int):
    """Tokens between the first and last place of a run; runs are looked for in blocks of twice as many."""
    return size * 2 + 8 * shift


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 6,
    literals: int = 3,
    coverage: float = 0.5,
    least: int = 5,
    block_tokens: int = BLOCK_TOKENS,
    shift: int = 8,
) -> DataFrame:
    """(doc_id, text_key, item_id, position, coverage, reworded): items found in documents.

    A pair is reported at its best run of neighbouring diagonals (``judge``) if at least ``coverage`` of
    the item's tokens lie in matching windows there and its slots are consistent; ``reworded`` tells
    whether a value differs, which counts only for items with ``least`` different words besides their
    values.  Items of any length are found verbatim, without regard to case, by their raw tokens; blank
    ones and single characters are not searched, and null texts count as empty.  ``position`` counts template tokens.  The
    benchmark is searched in blocks of about ``block_tokens`` tokens, each against all documents.
    """
    windows = cut_lineage(item_windows(benchmark, item_id, item_text, width, literals, least))
    blocks = tasks_for(windows.count(), block_tokens)
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    hits = None
    for n in range(blocks):
        here = windows.where(block == n)
        wanted = here.groupBy("raw", "width").agg(F.collect_set("hash").alias("h")).collect()
        words = frozenset(w for r in here.select(F.explode("words").alias("w")).distinct().collect() for w in [r["w"]])
        if not wanted:
            continue
        found = _document_hits(docs, doc_id, text, words, {(r["raw"], r["width"]): np.sort(np.array(r["h"], np.int64)) for r in wanted}, literals, width)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = _document_hits(docs.limit(0), doc_id, text, frozenset(), {}, literals, width)
    items = windows.drop("words").distinct()
    pairs = hits.distinct().join(items, ["raw", "hash", "width"])
    hit = F.struct("offset", "width", "position", "at", "doc_at", "slots", "doc_slots")
    pair = ["doc_id", "text_key", "item_id", "raw", "size", "rich"]
    diagonals = pairs.withColumn("diagonal", F.col("position") - F.col("offset")).groupBy(*pair, "diagonal").agg(F.collect_list(hit).alias("hits"))
    named = ["position", "offset", "end", "start", "mask", "values"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [diagonal_unit(size, raw, cells.as_py()) for raw, size, cells in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(6))]
            take = pa.array([n for n, f in enumerate(found) if f], pa.int64())
            units = [f for f in found if f]
            cells = [pa.array([u[k] for u in units], pa.int64()) for k in range(4)]
            cells.append(pa.array([u[4].to_bytes(-(-u[2] // 8), "little") for u in units], pa.binary()))
            cells.append(pa.array(["\n".join("\t".join(v) for v in sorted(u[5])) for u in units], pa.string()))
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in range(6)], *cells], [*pair, *named])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for raw, size, rich, cells in zip(*(b.column(k).to_pylist() for k in (3, 4, 5)), b.column(6)):
                units = [
                    (*[u[c] for c in named[:4]], int.from_bytes(u["mask"], "little"), {tuple(v.split("\t")) for v in u["values"].split("\n") if v})
                    for u in cells.as_py()
                ]
                found.append(judge(size, raw, rich, units, coverage, shift, width))
            take = pa.array([n for n, f in enumerate(found) if f], pa.int64())
            cells = [pa.array([f[k] for f in found if f], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in range(3)], *cells], ["doc_id", "text_key", "item_id", "position", "coverage", "reworded"])

    kinds = [pairs.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")]
    ids = f"doc_id {kinds[0]}, text_key bigint, item_id {kinds[1]}"
    units = diagonals.select(*pair, "hits").mapInArrow(
        made, f"{ids}, raw boolean, size int, rich boolean, position bigint, offset bigint, end bigint, start bigint, mask binary, values string"
    )
    # every run lies in one block: a unit goes to the block of its place and to the one before
    block_at = F.floor(F.col("position") / _span(F.col("size"), shift))
    blocked = units.withColumn("block", F.explode(F.array_distinct(F.array(block_at, F.greatest(block_at - 1, F.lit(0))))))
    runs = blocked.groupBy(*pair, "block").agg(F.collect_list(F.struct(*named)).alias("units"))
    judged = runs.select(*pair, "units").mapInArrow(judged, f"{ids}, position bigint, coverage double, reworded boolean")
    best = Window.partitionBy("doc_id", "text_key", "item_id").orderBy(F.desc("coverage"), "reworded", "position")
    return (
        judged.withColumn("_n", F.row_number().over(best))
        .where("_n = 1")
        .select("doc_id", "text_key", "item_id", "position", "coverage", "reworded")
    )


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` in which no item is found."""
    found = contaminated(docs, benchmark, doc_id, text, **options).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    found = cut_lineage(found)
    return docs.join(found, docs[doc_id].eqNullSafe(found["_id"]) & (text_key(text) == found["_key"]), "left_anti")
