"""Every operator and stage on nulls, empty tables, repeated rows, extra columns and long texts."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sqltally.llm import decontaminate, fingerprints, html_extract, langid, line_dedup, packing, quality, simhash, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, fp string, score string, pos int, hash int, features string"
LONG = ("word%d " * 50 % tuple(range(50))) * 400
ROWS = [
    (1, "a b c\nd", "en", "s", 7), (1, "a b c\nd", "en", "s", 7), (1, "other text", None, None, None), (None, "no id", "en", "s", 5),
    (None, None, None, None, None), (2, None, "en", "s", 0), (3, "", "fr", "s", 0), (4, LONG, "en", "s", len(LONG)), (5, LONG, "en", "s", len(LONG)),
    (6, "\n\n \n", "en", "s", 4), (-7, "x" * 30_000, "en", "s", 30_000), (8, "\u0000 � 漢字 😀 ́", "en", "s", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "f", "s", 2, 3, "x") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, None, None), (None, 1, 1), (99, 1, 0), (4, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "a"), (None, None), (2, ""), (2, LONG[:200])], "item_id long, text string")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/x", "<p>t</p>")] * 2 + [(None, None, None), (2, "", "<div>" * 3000 + "deep"), (3, "http://a", "&#0; &bogus; <b"), (4, "http://a", "<p " * 500)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, pivot int")


def operators(docs, labels, bench):
    train = F.col("doc_id").isNotNull()
    return {
        "line_dedup": lambda d: line_dedup.without_later_copies(d),
        "toxicity": lambda d: toxicity.train(d, labels, train).score(d),
        "language": lambda d: langid.identify(d, train),
        "winnowing": lambda d: fingerprints.edited_fingerprints(d),
        "tokens": lambda d: token_counts.section_tokens(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).where("section = 0"),
        "packing": lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")).where("piece = 0"),
        "simhash": lambda d: simhash.near_duplicates(d),
        "quality": lambda d: quality.score(d, *quality.train(d, labels, train)),
    }


NAMES = ["line_dedup", "toxicity", "language", "winnowing", "tokens", "packing", "simhash", "quality"]


@pytest.mark.parametrize("name", NAMES)
def test_one_result_per_row(docs, labels, bench, name):
    got = operators(docs, labels, bench)[name](docs).collect()
    assert len(got) == len(ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, labels, bench, name):
    assert operators(docs, labels.limit(0), bench)[name](docs.limit(0)).collect() == []


def test_decontamination_edges(docs, bench):
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(4, 2), (5, 2)}
    assert decontaminate.contaminated(docs.limit(0), bench).collect() == []
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == []


def test_page_edges(pages):
    got = html_extract.main_text(pages).collect()
    assert len(got) == pages.count() and all(r.text is not None for r in got)
    assert html_extract.main_text(pages.limit(0)).collect() == []


def test_line_dedup_keeps_first_copy(docs):
    got = {r.doc_id: r.text for r in line_dedup.without_later_copies(docs).collect() if r.doc_id in (4, 5)}
    assert got == {4: LONG, 5: ""}


def test_stages_keep_the_columns(spark, docs, labels, bench, tmp_path):
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, df in (("documents", own), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, own.limit(0), str(tmp_path))
        assert found.collect() == []
        assert stage is corpus_pipeline.STAGES[-1][1] or found.columns == own.columns


def test_equal_rows_stay_one_document(docs):
    kept = simhash.keep_first(docs).select("doc_id", "text").collect()
    assert len(kept) == len(set(kept)) and sum(r.text == LONG for r in kept) == 1
