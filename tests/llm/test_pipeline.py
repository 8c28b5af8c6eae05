"""The pipeline's rows against each stage restated in plain Python."""

import random
import re

import public_tokenizers
import pytest
from test_operators import grouped, later_lines, plain_simhash, prose
from tokenizers import Tokenizer

import corpus_pipeline
from sqltally.llm import toxicity
from sqltally.llm.common import held_out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    passage = "\n".join(prose(rng, 20, 50_000) for _ in range(3))
    items = [prose(rng, 14, 50_000), "What is 17 plus 25 ?", "only"]
    texts = [prose(rng, rng.randint(5, 300), 50_000) for _ in range(60)]
    texts += [texts[3], texts[4] + " end", f"{texts[5]}\n{passage}", f"{texts[6]}\n{passage}\n{texts[7]}", "", None, " \n"]
    texts += [f"{prose(rng, 30, 50_000)} {items[0]} {prose(rng, 9, 50_000)}", f"{prose(rng, 8)} {items[1].upper()}"]
    texts += [" ".join(rng.choice(("you stupid vile idiot", "shut up you fool", prose(rng, 3))) for _ in range(20)) for _ in range(40)]
    texts += [prose(rng, 6000, 50_000)]
    ids = rng.sample(range(10_000), len(texts))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)]
    toxic = [(i, 1, int("you " in (t or ""))) for i, t in zip(ids, texts)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), items


def test_pipeline_equals_restated_stages(spark, folder):
    sf, items = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # toxicity: the operator's own scores decide; its scores are tested elsewhere
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), ~held_out("doc_id", 3, 1), "toxic")
    scored = {r.doc_id: r.score for r in model.score(docs).collect()}
    left = {r.doc_id: r.text for r in docs.collect() if scored[r.doc_id] < 0.7}
    assert 20 < len(scored) - len(left) <= 40
    # line dedup: later copies of runs of 50 words go, in the order of ids
    ids = sorted(left)
    gone, lines = later_lines([left[i] or "" for i in ids], 50)
    changed = {d for d, _ in gone}
    left = {i: "\n".join(x for k, x in enumerate(lines[n]) if (n, k) not in gone) if n in changed else left[i] for n, i in enumerate(ids)}
    assert changed
    # near copies: fingerprints of 4-word shingles that differ in 4 bits at most
    ids = sorted(left)
    roots = grouped([plain_simhash(left[i] or "", 4) for i in ids], 4)
    left = {i: left[i] for n, i in enumerate(ids) if roots[n] == n}
    assert len(left) < len(ids)
    # decontamination: items verbatim, whatever their case
    words = lambda t: [w.lower() for w in re.findall(r"[^\W\d_]+|\d+|[^\w\s]", t or "")]
    has = lambda t, item: any(t[k : k + len(item)] == item for k in range(len(t) - len(item) + 1))
    left = {i: t for i, t in left.items() if not any(has(words(t), words(item)) for item in items)}
    # packing: all ids of every document, gapless in sequences of 4096
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, sf).collect()
    sizes = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in left.items()}
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    want = {i: [(k, s, min(4096, n - s)) for k, s in enumerate(range(0, n, 4096))] for i, n in sizes.items()}
    assert {i: sorted(p) for i, p in pieces.items()} == want
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for cells in places.values():
        end = 0
        for offset, length in sorted(cells):
            assert offset == end
            end += length
        assert end <= 4096
