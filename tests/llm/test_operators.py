"""Operators against plain restatements on small fixtures."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sqltally.llm import decontaminate, fingerprints, html_extract, langid, line_dedup, packing, quality, simhash, token_counts, toxicity

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def prose(rng, n, words=300):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


plain_prose = prose


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def later_lines(texts, least):
    """Lines covered by a run of at least ``least`` words that also starts at an earlier place."""
    lines = [t.split("\n") for t in texts]
    places = [(d, i) for d, ls in enumerate(lines) for i in range(len(ls))]
    gone = set()
    for n, (d, i) in enumerate(places):
        for e, j in places[:n]:
            size = 0
            while i + size < len(lines[d]) and j + size < len(lines[e]) and lines[d][i + size] == lines[e][j + size]:
                size += 1
            if sum(len(x.split()) for x in lines[d][i : i + size]) >= least:
                gone |= {(d, k) for k in range(i, i + size)}
    return gone, lines


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.choice((0, 1, 3, 6))) for _ in range(9)]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 14)) + [prose(rng, 4)] * rng.randint(0, 1)) for _ in range(25)]
    gone, lines = later_lines(texts, 12)
    got = line_dedup.without_later_copies(documents(spark, texts), 12)
    for r in got.collect():
        kept = [x for k, x in enumerate(lines[r.doc_id]) if (r.doc_id, k) not in gone]
        assert r.text == "\n".join(kept), r.doc_id
        assert r.removed_lines == len(lines[r.doc_id]) - len(kept)
    assert gone


def winnowed(text, k, window):
    words = text.lower().split()
    mask = (1 << 64) - 1
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def roll(part):
        x = part[0] if len(words) >= k else 0
        for y in part[1:] if len(words) >= k else part:
            x = ((x << 1) & mask | x >> 63) ^ y
        return x

    grams = [roll(h[i : i + k]) for i in range(len(h) - k + 1)] if len(h) >= k else ([roll(h)] if h else [])
    picked = set()
    for i in range(max(1, len(grams) - window + 1) if grams else 0):
        part = range(i, min(i + window, len(grams)))
        picked.add(min(part, key=lambda p: (grams[p] >> 32 & 0x7FFFFFFF, -p)))
    return [(p, grams[p]) for p in sorted(picked)]


def test_winnowing_and_edited_texts(spark):
    rng = random.Random(2)
    texts = [prose(rng, n, 12) for n in (0, 1, 2, 3, 5, 8, 9, 40, 200)] + ["é ü\t ñ x\n y", prose(rng, 30, 2), "a a a a a a a a a a a a a"]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(documents(spark, texts)).collect()}
    for d, t in enumerate(texts):
        follow = texts[d - 1] if d else texts[-1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + follow[:cut]
        assert got[d].edited == edited and got[d].n_chars == len(t)
        for text, found in ((t, got[d].fingerprint), (edited, got[d].edited_fingerprint)):
            assert [(g.position, g.hash & (1 << 64) - 1) for g in found] == winnowed(text, 3, 6)
        sets = [{g for _, g in winnowed(x, 3, 6)} for x in (t, edited, follow)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert got[d].near_edited == pytest.approx(like(sets[0], sets[1])) and got[d].near_next == pytest.approx(like(sets[0], sets[2]))


def test_winnowing_guarantee(spark):
    rng = random.Random(4)
    shared = prose(rng, 8, 10_000)
    rows = documents(spark, [f"{prose(rng, 50)} {shared} {prose(rng, 50)}" for _ in range(6)])
    found = fingerprints.with_fingerprint(rows, "text", "f").collect()
    assert set.intersection(*[{g.hash for g in r.f} for r in found])


def test_next_rows_across_stretches(spark):
    ids = [5, 5, 9, -3, 700, 701, 702, None, 10**15]
    rows = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id long, key long")
    got = {r.key: r.next_key for r in fingerprints.with_next(rows, ["key"], "id", "key", rows=2).collect()}
    order = sorted(range(len(ids)), key=lambda n: (ids[n] is None, -(ids[n] or 0), n))
    assert got == {a: b for a, b in zip(order, order[1:] + order[:1])}


def plain_simhash(text, width):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def grouped(fps, radius, linked=lambda a, b: True):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(x) for x in range(len(fps))]


@pytest.mark.parametrize(("radius", "tile"), [(4, 1024), (4, 3), (12, 4)])
def test_simhash_components(spark, radius, tile, monkeypatch):
    rng = random.Random(7)
    base = prose(rng, 120)
    texts = ["", " \n", "One", "one", "a b c", "A\tb  c", "É x y z w"] + [prose(rng, rng.randint(1, 60)) for _ in range(15)]
    for _ in range(25):
        words = base.split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    fps = [plain_simhash(t, 4) for t in texts]
    whole = simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda d, r, a: whole(d, r, a, tile))
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts), radius=radius).collect()}
    assert [got[d].fp & (1 << 64) - 1 for d in range(len(texts))] == fps
    assert [got[d].component_id for d in range(len(texts))] == grouped(fps, radius)


def test_components_of_a_chain(spark):
    nodes = random.Random(1).sample(range(1000), 90)
    edges = list(zip(nodes[:60], nodes[1:60])) + list(zip(nodes[60:], nodes[61:]))
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(nodes[:60] if n in nodes[:60] else nodes[60:]) for n in nodes}


def test_keep_first_needs_agreeing_sketches(spark):
    rng = random.Random(5)
    base = prose(rng, 400, 100_000).split()
    near = base.copy()
    for i in range(0, 400, 100):
        near[i] = "other"
    texts = [" ".join(base), " ".join(near), prose(rng, 300), "short one", "short two", "short one"]
    kept = simhash.keep_first(documents(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 3, 4]


@pytest.mark.parametrize("tile", [256, 3])
def test_near_copies_equal_all_pairs(spark, tile):
    rng = random.Random(11)
    texts = ["", " \n", None, "one", "One", "a b c d e", "a b c d e f"]
    passage = prose(rng, 30, 100_000)
    for words, most in ((60, 4), (150, 8), (400, 14), (400, 20), (30, 1)):
        base = prose(rng, words, 100_000)
        texts += [prose(rng, words, 100_000) + " " + passage, base]
        for _ in range(14):
            edited = base.split()
            for _ in range(rng.randint(0, most)):
                edited[rng.randrange(len(edited))] = f"x{rng.random()}"
            texts.append(" ".join(edited))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    near = [alike(sets[a], sets[b]) for a in range(len(sets)) for b in range(a)]
    assert sum(0.7 <= s < 0.8 for s in near) > 10 and sum(0.8 <= s < 0.95 for s in near) > 10
    want = grouped([0] * len(sets), 0, lambda a, b: alike(sets[a], sets[b]) >= 0.8)
    assert sorted(r.doc_id for r in simhash.keep_first(documents(spark, texts)).collect()) == sorted(set(want))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(documents(spark, texts), tile=tile).collect()}
    assert [got[d] for d in range(len(texts))] == want


def test_packing_pieces_and_bins(spark):
    rng = random.Random(3)
    odd = ["It's <|endoftext|> DON'T İstanbul ΑΣ á ẞ 漢字 x\x1cy 12,345.6 ½ ſ Ÿ naïve×÷ '''s 'S", "", None, " \n ", "ab" * 900]
    texts = odd + [prose(rng, rng.randint(1, 700)) for _ in range(60)] + ["same text"] * 5
    rows = packing.pack(documents(spark, texts), VOCABULARY, tokens=256, shard=40).collect()
    tokenizer, pieces = Tokenizer.from_file(VOCABULARY), {}
    for r in rows:
        pieces.setdefault(r.doc_id, {})[r.piece] = r
    import zlib

    total = 0
    for d, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        parts = [ids[a : a + 256] for a in range(0, len(ids), 256)]
        assert sorted(pieces[d]) == list(range(len(parts)))
        for k, part in enumerate(parts):
            r = pieces[d][k]
            assert (r.start, r.length, r.ids_crc32) == (256 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for cells in bins.values():
        at = 0
        for offset, length in sorted(cells):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-total // 256) + 6


def test_packing_under_every_constraint():
    lengths = np.random.default_rng(1).integers(1, 60, 300)
    for rule in ("norm", "dot"):
        bins, offsets = packing.best_fit(lengths, 100, 4, 4000, (1.0, 0.3, 0.3), rule)
        for b in set(bins.tolist()):
            inside = lengths[bins == b]
            assert inside.sum() <= 100 and len(inside) <= 4 and (inside**2).sum() <= 4000


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(spark, rule):
    texts = ["a\n\n\nb  é\n", "", None, "x" * 50 + "\n" + "漢字 \n\n z", "no line end", "\n"]
    encode, _ = token_counts.encoder(RANKS, public_tokenizers.PATTERN)
    got = {}
    for r in token_counts.section_tokens(documents(spark, texts), RANKS, public_tokenizers.PATTERN, rule=rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = r
    for d, t in enumerate(texts):
        t = t or ""
        lines = [x for x in t.splitlines(keepends=True)] or [""]
        ids = encode(t)
        assert sum(r.n_tokens for r in got[d].values()) == pytest.approx(len(ids))
        assert [t[got[d][k].begin : got[d][k].stop] for k in sorted(got[d])] == lines
        assert {r.doc_tokens for r in got[d].values()} == {len(ids)}


def test_crossing_tokens_follow_the_rule():
    starts, stops = np.array([0, 3, 9]), np.array([3, 9, 10])
    begins, ends = np.array([0, 4, 5]), np.array([4, 5, 10])
    want = {"start": [2, 0, 1], "end": [1, 0, 2], "largest": [1, 0, 2], "split": [1 + 1 / 6, 1 / 6, 1 + 4 / 6]}
    for rule, counts in want.items():
        got, crossing = token_counts.attribute(starts, stops, begins, ends, rule)
        assert got.tolist() == pytest.approx(counts) and crossing.tolist() == [1, 1, 1]


def test_languages_of_pure_and_mixed_texts(spark):
    rng = random.Random(6)
    syllables = {"aa": "ba be bi bo bu".split(), "bb": "xyl xon xar xeu".split(), "cc": "mém nün ñoñ".split()}
    make = lambda k, n: " ".join("".join(rng.choices(syllables[k], k=3)) for _ in range(n))
    rows = [(i, make(k, 30), k) for i, k in enumerate(list(syllables) * 12)]
    rows += [(100, make("aa", 60) + " " + make("bb", 40), None), (101, "12 !?", None), (102, None, None), (103, "", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, F.col("doc_id") % 2 == 0).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:36])
    mixed = {x.lang: x.share for x in got[100].languages}
    assert set(mixed) == {"aa", "bb"} and 0.5 < mixed["aa"] < 0.72 and got[100].lang_pred == "aa"
    assert [(got[i].lang_pred, got[i].score) for i in (101, 102, 103)] == [("und", 0.0)] * 3


def test_toxicity_learns_a_lexicon(spark):
    rng = random.Random(8)
    bad = ["grolb", "snarf", "blech"]
    rows = []
    for i in range(600):
        words = prose(rng, 40).split()
        toxic = int(rng.random() < 0.3)
        for _ in range(4 * toxic):
            words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words), toxic))
    rows += [(1000, "you gr0lb you are a s.n.a.r.f blech", None), (1001, "", None), (1002, None, None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 3 != 1)
    assert {w.decode() for w in model.lexicon} >= set(bad)
    got = {r.doc_id: r.score for r in model.score(docs).collect()}
    held = [(got[i], t) for i, _, t in rows if t is not None and i % 3 == 1]
    assert np.mean([(s >= 0.7) == t for s, t in held]) > 0.95 and got[1000] >= 0.7 and got[1001] < 0.7 and got[1002] < 0.7
    disguised = toxicity.features(b"you gr0lb", model.lexicon)[toxicity.FEATURES.index("disguised")]
    assert disguised > 0
    kept = model.keep(docs, 0.7)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.7 for s in got.values())


def test_quality_attention_and_gradients(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 150) + (" #$%& " * 90 if i % 3 == 0 else "") + prose(rng, 150), int(i % 3 != 0)) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model, rate = quality.train(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in quality.score(docs, model, rate).collect()}
    held = [(got[i].score >= 0.3, bool(q)) for i, _, q in rows if i % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95 and len(got) == 242 and all(0 <= r.score <= 1 for r in got.values())
    net, x = quality.Attention(4, 3), np.random.default_rng(0).normal(size=(7, quality.WIDTH))
    starts, y = np.array([0, 3]), np.array([1.0, 0.0])
    loss = lambda: -np.mean(np.log(np.where(y == 1, s := net.forward(x, starts)["score"], 1 - s)))
    grads = net.gradients(net.forward(x, starts), starts, y)
    for k, g in grads.items():
        at = (0,) * net.p[k].ndim
        net.p[k][at] += 1e-6
        up = loss()
        net.p[k][at] -= 2e-6
        assert (up - loss()) / 2e-6 == pytest.approx(g[at], abs=1e-6)
        net.p[k][at] += 1e-6


def test_passages_hold_the_whole_text():
    for text in ("", "x" * 3000, "word " * 700, "é\n" * 900):
        assert b"".join(quality.passages(text.encode())) == text.encode()


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=/>{menu}</a></nav>
<div class="cookie-notice">We use cookies</div><div class="page"><h1>{title}</h1><p>Same intro on each page</p><p>{a}<p>{b} &amp; <i>more</i>
</div><div id="comments"><p>{c}</p></div><form><label>Mail</label></form><footer>&copy; all rights</footer></body></html>"""


def test_wrapper_induction(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(12):
        cells = {k: prose(rng, 30) for k in ("menu", "title", "a", "b", "c")}
        rows.append((i, "http://user@Site.example:80/x", PAGE.format(**cells)))
        want[i] = "\n".join([cells["title"], "Same intro on each page", cells["a"], cells["b"] + " & more"])
    rows += [(90, None, None), (91, "http://b.example", ""), (92, "http://b.example", "<p>alone &lt;x&gt;<table><tr><td>c1<td>c2"), (93, "ftp://z", "<!-- never closed")]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in want} == want
    assert (got[90], got[91], got[92], got[93]) == ("", "", "alone <x>\nc1\nc2", "")


def test_tree_matching_is_optimal():
    def size(pivot, page):
        return sum(k >= 0 for k in html_extract.align(pivot, page))

    def best(a, b):
        (an, _, ak), (bn, _, bk) = html_extract.tree(a), html_extract.tree(b)

        def match(i, j):
            if an[i] != bn[j]:
                return 0
            rows = [[0] * (len(bk[j]) + 1) for _ in range(len(ak[i]) + 1)]
            for x, p in enumerate(ak[i]):
                for y, q in enumerate(bk[j]):
                    rows[x + 1][y + 1] = max(rows[x][y + 1], rows[x + 1][y], rows[x][y] + match(p, q))
            return rows[-1][-1] + 1

        return match(0, 0)

    rng = random.Random(2)

    def grow(depth):
        return f"{rng.choice('abc')}({' '.join(grow(depth - 1) for _ in range(rng.randint(1, 3)))})" if depth else rng.choice("abc")

    for _ in range(60):
        a, b = f"r({grow(2)} {grow(1)})", f"r({grow(1)} {grow(2)})"
        assert size(a, b) == best(a, b)


def test_decontamination_finds_reworded_items(spark):
    rng = random.Random(5)
    spell = str.maketrans("0123456789", "abcdefghij")
    prose = lambda rng, n, words=300: plain_prose(rng, n, words).translate(spell)
    items = [
        (0, "If Anna has 12 red apples and gives 5 apples to Bob, how many apples does Anna keep at the end of the day?"),
        (1, prose(rng, 40, 5000)),
        (2, "too short"),
        (3, None),
        (4, " ".join(f"w {n}" for n in range(100, 130))),
    ]
    other = "If Carl has 70 red apples and gives 9 apples to Dora, how many apples does Carl keep at the end of the day?"
    torn = "If Carl has 70 red apples and gives 9 apples to Dora, how many apples does Emil keep at the end of the day?"
    texts = [
        f"{prose(rng, 30)} {items[0][1]} {prose(rng, 30)}", f"{prose(rng, 30)} {other}", torn, items[1][1].upper(), prose(rng, 400, 5000),
        f"{prose(rng, 9)}\n{items[1][1]}", "", None, " ".join(items[1][1].split()[:15]),
        " ".join(f"w {n}" for n in range(80)),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 5):
        got = {(r.doc_id, r.item_id): r.reworded for r in decontaminate.contaminated(documents(spark, texts), bench, block_tokens=block).collect()}
        assert got == {(0, 0): False, (1, 0): True, (3, 1): False, (5, 1): False}
    assert sorted(r.doc_id for r in decontaminate.clean(documents(spark, texts), bench).collect()) == [2, 4, 6, 7, 8, 9]


def test_decontamination_finds_short_and_dense_items(spark):
    items = ["What is 7*8?", "Compute 12 + 35 * 7 - 4", "What is 15% of 80?", "Who?", "???", "Anna Bob Carl Dora Emil Fritz Gerd 1 2 3", " "]
    texts = [f"some words before, {t.lower()} and after it" for t in items] + ["what is 7+8?", "What is 25% of 80?", "nothing here"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.reworded) for r in decontaminate.contaminated(documents(spark, texts), bench).collect()}
    assert got == {(n, n): (1.0, False) for n in range(6)}


def test_decontamination_over_shifted_diagonals(spark):
    items = ["Mary has 3 baskets of ripe pears and sells 2 of them to Paul before the market closes, so how many baskets does Mary take home?"]
    texts = [
        "Mary Ann has 3 1/2 baskets of ripe pears and sells 2 of them to Peter Paul before the market closes, so how many baskets does Mary Ann take home?",
        "Mary has 3 baskets of ripe pears and very quickly sells 2 of them to Paul before the market nearby finally closes, so how many baskets does Mary take home?",
        "Mary Ann has 3 1/2 baskets of ripe pears and sells 2 of them to Peter Paul before the market closes, so how many baskets does Lisa take home?",
        "take home the market closes, so how many pears and sells 2 of them to",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r.reworded for r in decontaminate.contaminated(documents(spark, texts), bench).collect()}
    assert got == {0: True, 1: False}


def test_oracle_free_queries_are_registered():
    from sqltally.llm.queries import QUERIES

    assert Counter(n.split("_")[0] for n in QUERIES) == Counter(f"op{n}" for n in range(1, 11))
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
