import difflib
import random

import pytest
from pyspark.sql import functions as F

from sqltally.operators import batching, catalog, mining, prep


def best_share(value, question):
    v, q = value.lower(), question.lower()
    sizes = [n for n in range(1, len(v) + 1) if any(v[i : i + n] in q for i in range(len(v) - n + 1))]
    return max(sizes, default=0) / len(v)


WORDS = ["red", "ring", "small", "widget", "Paris", "o'hare", "new york", "a", "id", "the", "cats", "12"]


def texts(seed, n, low, high):
    rng = random.Random(seed)
    return [rng.choice(["", " "]) + rng.choice([" ", ", "]).join(rng.choices(WORDS, k=rng.randint(low, high))) for _ in range(n)]


def test_match_values_equals_brute_force(spark):
    asked = texts(1, 25, 3, 12)
    stored = sorted({t.strip() for t in texts(2, 40, 1, 3)} | {"x", "Paris!", "smal ring", "é ring"})
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id long, question string")
    values = spark.createDataFrame([(i, "c", v) for i, v in enumerate(stored)], "value_id long, column string, value string")
    got = {(r.question_id, r.value_id): r.score for r in prep.match_values(questions, values, k=10_000).collect()}
    want = {
        (q, i): s for q, text in enumerate(asked) for i, v in enumerate(stored) if (s := best_share(v, text)) > 0.85
    }
    assert got == pytest.approx(want) and want


def linked(question, value, theta=0.85):
    """Plain restatement without any bound on the block: longest block, span, rejections, similarity."""
    text, low = question.strip(), value.strip().lower()
    m = difflib.SequenceMatcher(None, text.lower(), low, autojunk=False).find_longest_match()
    if not m.size:
        return 0.0
    bound = set(prep.SEPARATORS)
    if m.a and text[m.a] not in bound and text[m.a - 1] not in bound:
        return 0.0
    last = m.a + m.size - 1
    near = next((i for i in range(last, min(last + 4, len(text))) if text[i] in bound), None)
    if near is None and last + 4 <= len(text):
        return 0.0
    span = text[m.a : near].strip(prep.SEPARATORS)
    part, src = value.strip()[m.b : m.b + m.size].lower().strip(), span.lower()
    words = {low, part, src}
    if len(span) < 2 or part in ("", "id") or part.replace(",", "").isdigit() or words & prep.STOP_WORDS:
        return 0.0
    same = low.lstrip(prep.SEPARATORS)[:1] == src[:1]
    score = prep.indel_similarity(low, src) if same else 0.0
    if score < 1 and (words & prep.COMMON_WORDS or value.isupper()):
        return 0.0
    return score if score >= theta else 0.0


def test_fuzzy_link_equals_brute_force(spark):
    asked = texts(3, 25, 2, 10) + ["Is it the cat's widget?", "smal ring", "(red ring)"]
    stored = sorted({t.strip() for t in texts(4, 40, 1, 3)} | {"cat", "RED RING", "yes", "small rings"})
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id long, question string")
    values = spark.createDataFrame([(i, f"c{i}", v) for i, v in enumerate(stored)], "value_id long, column string, value string")
    for theta in (0.85, 0.81):
        got = {(r.question_id, r.value_id): r.score for r in prep.fuzzy_link(questions, values, theta).collect()}
        want = {(q, i): s for q, t in enumerate(asked) for i, v in enumerate(stored) if (s := linked(t, v, theta)) > 0}
        assert got == pytest.approx(want) and any(s < 1 for s in want.values())
    with pytest.raises(ValueError, match="theta"):
        prep.fuzzy_link(questions, values, 0.6)


def test_indel_similarity():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0] * (len(b) + 1)
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
        return 2 * row[-1] / (len(a) + len(b))

    rng = random.Random(9)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(1, 12))) for _ in range(2))
        assert prep.indel_similarity(a, b) == pytest.approx(slow(a, b))


def test_long_sequences_are_an_error_by_default(spark):
    df = spark.createDataFrame([(0, [1, 2, 3])], "id long, ids array<int>")
    with pytest.raises(Exception, match="longer than the limit"):
        prep.training_sequences(df, 2).collect()
    row = prep.training_sequences(df, 5, "left", pad_id=9).first()
    assert (row.ids, row.mask, row.position_ids) == ([9, 9, 1, 2, 3], [0, 0, 1, 1, 1], [0, 0, 0, 1, 2])
    row = prep.training_sequences(df, 5, "right", eos_id=2).first()
    assert (row.position_ids, row.eos_mask) == ([0, 1, 2, 2, 2], [1, 1, 0, 0, 0])
    back = prep.remove_padding(prep.training_sequences(df, 5, "left")).first()
    assert back.ids == [1, 2, 3]


def test_loss_mask_and_pair_masks(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5], [6])], "prompt_ids array<int>, response_ids array<int>, rejected_ids array<int>")
    assert prep.supervised_records(df, 7).first().loss_mask == [0, 0, 1, 1, 0, 0, 0]
    pair = prep.preference_pairs(df.withColumnRenamed("response_ids", "chosen_ids"), 6).first().pair
    assert [list(p) for p in pair] == [[[1, 2, 3, 4, 5, 0], [1, 1, 1, 1, 1, 0]], [[1, 2, 3, 6, 0, 0], [1, 1, 1, 1, 0, 0]]]


def test_split_needs_enough_rows(spark):
    df = spark.range(5).withColumnRenamed("id", "ordinal")
    with pytest.raises(Exception, match="fewer rows"):
        prep.split_by_position(df, 4, 2).collect()


def test_template_values_are_not_read_again(spark):
    df = spark.createDataFrame([("{b}", "x")], "a string, b string")
    text = prep.fill_template("<{a}|{b}|{c}>", {"a": F.col("a"), "b": F.col("b")})
    assert df.select(text.alias("t")).first().t == "<{b}|x|{c}>"


def test_key_groups_merge_across_later_edges(spark):
    edges = [("d", "fk", a, b) for a, b in [(1, 2), (5, 6), (6, 2), (9, 8), (30, 31), (31, 32), (32, 33), (33, 34)]]
    keys = spark.createDataFrame(edges, "db_id string, kind string, column_id long, ref_column_id long")
    got = {r.column_id: r.root_id for r in catalog.key_equivalence(keys).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8, 30: 30, 31: 30, 32: 30, 33: 30, 34: 30}


def test_training_columns_respect_keys_and_cap(spark):
    tables = {"t": spark.range(1).selectExpr(*[f"id AS c{i:03d}" for i in range(300)])}
    _, columns = catalog.build_catalog(spark, tables)
    keys = spark.createDataFrame([("db", "pk", 7, None)], "db_id string, kind string, column_id int, ref_column_id int")
    asked = spark.createDataFrame([(q, "db", "SELECT C299 FROM t") for q in range(20)], "question_id long, db_id string, sql string")
    shown = catalog.training_columns(asked, columns, keys, seed=1)
    got = shown.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("needed"), F.col("column_id"))).alias("must")
    ).collect()
    assert all(r.n <= 225 and {7, 300} <= set(r.must) for r in got)
    assert len({r.n for r in got}) > 3


def test_content_types(spark):
    df = spark.createDataFrame(
        [(str(2000 + i), f"{i % 2}", "Yes" if i % 2 else "No", f"{1 + i} May 2001", "x", f"{i}.5") for i in range(9)],
        "birth_year string, flag string, answer string, day string, note string, amount string",
    )
    kinds = {r.column_name: r.kind for r in catalog.infer_content_type(catalog.distinct_values({"t": df})).collect()}
    assert kinds == {"birth_year": "year", "flag": "boolean", "answer": "boolean", "day": "date", "note": "text", "amount": "number"}


@pytest.fixture(params=[10_000, 7])
def batch_rows(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(request.param))
    yield
    spark.conf.set(name, old)


@pytest.mark.parametrize("parts", [1, 6])
def test_lowest_values_hold_the_first_ones(spark, batch_rows, parts):
    rng = random.Random(7)
    cells = [(rng.choice([None, "", "b", "é" * 70]), "".join(rng.choices("abé ", k=rng.randint(1, 6))), None) for _ in range(400)]
    tables = {"t": spark.createDataFrame(cells, "few string, many string, none string").repartition(parts), "e": spark.createDataFrame([], "x string")}
    for blanks, pick in ((False, catalog.sample_values), (True, catalog.first_values)):
        for n in (1, 3, 6):
            low = catalog.lowest_values(tables, n, blanks)
            known = (v.where("value IS NOT NULL") for v in (low, catalog.distinct_values(tables)))
            got, want = (sorted((r.column_name, r["rank"], r.value) for r in pick(v, n).collect()) for v in known)
            assert got == want and got
            nulls = low.where("value IS NULL").select("column_name").collect()
            assert {r.column_name for r in nulls} == ({"few", "none"} if blanks else set())


def test_all_pairs_of_columns_equal_the_pairwise_operator(spark):
    rng = random.Random(8)
    cells = [(rng.choice([None, 1, 2, 3]), rng.randrange(6), rng.choice(["1", "2", "x"])) for _ in range(40)]
    tables = {"t": spark.createDataFrame(cells, "p int, q int, r string"), "u": spark.createDataFrame([(2,), (5,)], "p int")}
    got = {(r.a, r.b): (r.n_a, r.n_b, r.misses, r.contained) for r in catalog.columns_contained(catalog.distinct_values(tables)).collect()}
    names = ["t.p", "t.q", "t.r", "u.p"]
    for a, b in [(a, b) for a in names for b in names if a < b]:
        (ta, ca), (tb, cb) = a.split("."), b.split(".")
        assert got[a, b] == tuple(catalog.column_contained(tables[ta], ca, tables[tb], cb).first())
    assert len(got) == 6


def test_audit_reasons(spark):
    good = "Assistant: <think>t</think><answer>```sql\nSELECT 1\n```</answer>"
    cases = {
        good: None,
        good.replace("Assistant:", ""): "no header",
        good + "<think>": "tag count",
        "Assistant: <answer>```sql\nx\n```</answer><think>t</think>": "tag order",
        "Assistant: <think>t</think><answer>none</answer>": "no sql",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "response_id long, response string")
    got = {r.response_id: r.reason for r in mining.format_audit(df).collect()}
    assert got == dict(enumerate(cases.values()))


def test_batches_round_trip_and_checks(spark):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(12)], "ordinal long, x string")
    parts = batching.chunk(batching.repeat(df, 3), 4).groupBy("chunk").count().collect()
    assert sorted((r["chunk"], r["count"]) for r in parts) == [(0, 9), (1, 9), (2, 9), (3, 9)]
    with pytest.raises(Exception, match="does not divide"):
        batching.chunk(df, 5).collect()
    with pytest.raises(Exception, match="differ"):
        batching.column_union(df, df.withColumn("x", F.lit("?"))).collect()
    assert batching.unpad(batching.pad_to(df, 5)).count() == 12 and batching.pad_to(df, 5).count() == 15
    runs = batching.minibatches(df, 5, 2, seed=1).groupBy("epoch", "batch").count().collect()
    assert sorted((r.epoch, r.batch, r["count"]) for r in runs) == [(0, 0, 5), (0, 1, 5), (1, 0, 5), (1, 1, 5)]


def test_candidates_from_responses(spark):
    one, none = "x ```sql\nSELECT a\n``` y ```sql\nSELECT value -- c\n```", "no block"
    df = spark.createDataFrame([(0, [one, none, one])], "question_id long, responses array<string>")
    got = {r.sql: (r.n_samples, r.cand_id) for r in mining.mine_candidates(df).collect()}
    assert got == {"SELECT value": (2, 0), "Error SQL": (1, 1)}
    got = {r.sql for r in mining.mine_candidates(df, blank="SELECT", plug_value=True).collect()}
    assert got == {"SELECT 1", "SELECT"}


def test_lookup_counts_distinct_whole_values(spark):
    """Values that differ only behind the longest token stay apart; blanks, NULL and no tokens find nothing."""
    long = "ab" * 400
    values = [("c", v) for v in ("Abc", " abc ", "abd", long, long, long + "x", None, "")] + [("d", "abc")]
    cells = spark.createDataFrame(values, "column string, value string")
    tokens = spark.createDataFrame([("AB",), ("abc",), ("abc",), ("zz",), ("",), (None,)], "token string")
    found = {m: {(r.token, r.column): r.n_values for r in prep.lookup_values(tokens, cells, m).collect()} for m in ("prefix", "exact")}
    assert found["prefix"] == {("ab", "c"): 4, ("ab", "d"): 1, ("abc", "c"): 1, ("abc", "d"): 1}
    assert found["exact"] == {("abc", "c"): 1, ("abc", "d"): 1}
    assert all(prep.lookup_values(tokens.where("false"), cells, m).count() == 0 for m in ("prefix", "exact"))
