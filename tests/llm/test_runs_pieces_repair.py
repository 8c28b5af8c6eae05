"""Periodic runs, pieces and conversation repair against plain restatements."""

import hashlib
import itertools
import os
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sqltally.llm import periodic_runs, pieces, queries, repair

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WHITE = "[^\x20\x09-\x0d]+"


def all_runs(words, exponent=4, shortest=6):
    """Runs by definition: every start and period, extended as far as it goes, least period only."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        for s in range(len(words) - q):
            if s and words[s - 1] == words[s - 1 + q]:
                continue
            e = s + q
            while e < len(words) and words[e] == words[e - q]:
                e += 1
            if e - s >= max(shortest, exponent * q):
                found.setdefault((s, e - s), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_text(rng):
    kinds = rng.choice((1, 2, 3, 6))
    words = []
    while len(words) < rng.randrange(80):
        unit = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, 6))]
        words += unit * rng.choice((1, 1, 2, 4, 5, 7)) + unit[: rng.randrange(len(unit) + 1)]
    return words


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_definition(seed):
    rng = random.Random(seed)
    texts = [[w.encode() for w in periodic_text(rng)] for _ in range(30)]
    for exponent, shortest in ((4, 6), (3, 3), (5, 12)):
        assert periodic_runs.find_runs(texts, exponent, shortest) == [all_runs(t, exponent, shortest) for t in texts]


def test_runs_of_fibonacci_and_equal_words():
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    texts = [[w.encode() for w in t] for t in (b, ["x"] * 500, [], ["x"], ["x"] * 6)]
    assert periodic_runs.find_runs(texts, 3, 3) == [all_runs(t, 3, 3) for t in texts]


def test_runs_of_a_very_long_text_in_near_linear_work():
    words = [b"a"] * 60_000 + [b"b"] + [b"x", b"y", b"z"] * 20_000 + [b"%d" % (k % 6) if k % 6 else b"u%d" % k for k in range(60_000)]
    assert periodic_runs.find_runs([words]) == [[(0, 60_000, 1), (60_001, 60_000, 3)]]


def test_runs_query_equals_contract(spark, tmp_path):
    rng = random.Random(5)
    texts = [rng.choice(("", " \n", None)) if k % 9 == 0 else rng.choice((" ", "\n", "\t ", " ")).join(periodic_text(rng)) for k in range(400)]
    rows = list(enumerate(texts)) + [(None, "a a a a a a a"), (3, texts[3]), (3, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(str, queries.op11_periodic_runs(spark, str(tmp_path)).collect()))
    want = []
    for doc_id, text in rows:
        words = re.findall(WHITE, text or "")
        n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = all_runs(words)
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        shape = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        want.append((doc_id, len(runs), *shape, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got == sorted(f"Row({', '.join(f'{k}={v!r}' for k, v in zip(names, w))})" for w in want)
    assert sum(w[1] > 0 for w in want) > 100


ALPHABET = "abcdefgh  \n\tAB12.,'▁éüß漢字😀\u0000 �ﬁ½"


@pytest.mark.parametrize("seed", range(20))
def test_pieces_equal_library(seed):
    rng = random.Random(seed)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    known = pieces.Vocabulary(MODEL)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(60))) for _ in range(100)]
    texts += [" ".join(library.decode(rng.randrange(259, 32000)) for _ in range(12)) for _ in range(100)]
    texts += ["", " ", "   ", "▁", "▁ ▁", "a" * 500, "  lead", "trail  ", "the " * 300]
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert known.encode(text) == ids
        assert known.decode(ids) == library.decode(ids)


def test_pieces_of_any_ids_and_whole_texts_without_cuts():
    rng = random.Random(3)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    known = pieces.Vocabulary(MODEL)
    for _ in range(300):
        ids = [rng.choice((0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000))) for _ in range(rng.randrange(8))]
        assert known.decode(ids) == library.decode(ids), ids
    known.parts = re.compile(r"(?s:.+)")  # the agenda over whole texts
    for _ in range(100):
        text = "".join(rng.choices(ALPHABET, k=80))
        assert known.encode(text) == library.encode(text, add_eos=True)


def test_pieces_checked_part_by_part():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    known = pieces.Vocabulary(MODEL)
    texts = ["one two\nthree  four", "", "▁ five", "\n\n six\t", "seven"]
    for _ in range(2):  # the second time nothing is new
        assert known.agrees(texts, [known.encode(t) for t in texts]) == [True] * 5
    known["▁eight"] = (5,)
    known.fresh.append(("▁eight", (5,)))
    texts = ["one", "two eight", "seven"]
    assert known.agrees(texts, [known.encode(t) for t in texts]) == [True, False, True]
    known.simple = False
    ids = [library.encode(t, add_eos=True) for t in texts]
    assert known.agrees(texts, [ids[0], ids[1][:-1], ids[2]]) == [True, False, True]


def test_pieces_query(spark, tmp_path):
    rows = [(1, "Hello  world\nnext"), (1, "Hello  world\nnext"), (None, None), (2, ""), (3, "x" * 3_000_000 + " word" * 10), (4, "\u0000漢 😀")]
    spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, ids string, agrees int").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_pieces(spark, str(tmp_path)).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [library.encode(t or "", add_eos=True) for _, t in rows]
    want = [(d, len(i), sha(" ".join(map(str, i))), sha(library.decode(i)), True) for (d, _), i in zip(rows, ids)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def best_repair(rows):
    """(cost, audit, lines) over whole strings, one survivor a state."""
    fault = faults(rows)
    grown = {"u": "ua", "a": "u", "s": "u", "": "u"}
    follow = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    names = {"u": "user", "a": "assistant"}

    def keep(best, state, new):
        if state not in best or new[:2] < best[state][:2]:
            best[state] = new

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                nxt = "a" if state == "u" else "u"
                keep(best, nxt, (cost + 5, audit + "I", [*lines, names[nxt] + ":"]))
        return best

    best = inserted({"": (0, "", [])})
    for (role, text), f in zip(rows, fault):
        new = {}
        for state, (cost, audit, lines) in best.items():
            keep(new, state, (cost + 2, audit + "D", lines))
            if f in ("blank", "duplicate"):
                continue
            extra = 5 if f == "truncated" else 0
            if (state, role[:1]) in follow:
                keep(new, role[:1], (cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
            nxt = "a" if state == "u" else "u"
            keep(new, nxt, (cost + extra + 1, audit + "R", [*lines, f"{names[nxt]}:{text}"]))
        best = inserted(new)
    return min(best[s] for s in ("", "a") if s in best)


def every_repair(rows):
    """Least (cost, audit) over all edit strings with at most two insertions."""
    fault, found = faults(rows), []
    letters = "DKR"
    for edits in itertools.product(letters, repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            if sum(gaps) > 2:
                continue
            for roles in itertools.product("ua", repeat=edits.count("R") + sum(gaps)):
                names, initials, audit, cost, ok = iter(roles), "", "", 0, True
                for k in range(len(rows) + 1):
                    for _ in range(gaps[k]):
                        initials, audit, cost = initials + next(names), audit + "I", cost + 5
                    if k == len(rows):
                        break
                    if edits[k] == "D":
                        audit, cost = audit + "D", cost + 2
                        continue
                    ok &= fault[k] not in ("blank", "duplicate")
                    initials += next(names) if edits[k] == "R" else rows[k][0][:1]
                    audit, cost = audit + edits[k], cost + (edits[k] == "R") + 5 * (fault[k] == "truncated")
                if ok and re.fullmatch("(s?(ua)+)?", initials):
                    found.append((cost, audit))
    return min(found)


def random_rows(rng, size):
    return [(rng.choice(("user", "user", "assistant", "assistant", "system", "tool")), rng.choice(("a.", "b!", "c", "", " ", "d?", f"{rng.random()}.", f"{rng.random()}."))) for _ in range(size)]


def searched(rows):
    search = repair.Search()
    for (role, text), f in zip(rows, faults(rows)):
        search.row(role.encode(), text.encode(), f)
    return search


@pytest.mark.parametrize("seed", range(30))
def test_repair_equals_every_edit(seed):
    rng = random.Random(seed)
    rows = random_rows(rng, rng.randrange(5))
    assert best_repair(rows)[:2] == every_repair(rows)


@pytest.mark.parametrize("seed", range(60))
def test_search_equals_whole_strings(seed):
    rng = random.Random(seed)
    for _ in range(20):
        rows = random_rows(rng, rng.randrange(40))
        cost, audit, lines = best_repair(rows)
        assert searched(rows).finish() == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_search_holds_little_and_ties_cost_little():
    orderly = [(("user", "assistant")[k % 2], f"{k}.") for k in range(5000)]
    search = searched(orderly)
    assert search.most_held < 12
    assert search.finish()[:2] == (0, "K" * 5000)
    stuck = [("user", f"{k}.") for k in range(3000)]  # two ways that never meet: ties are not walked through
    assert searched(stuck).finish()[:2] == best_repair(stuck)[:2]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        fate = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def test_repair_query_equals_contract(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for conv in range(300):
        for turn in range(rng.randrange(1, 12)):
            if rng.random() < 0.9:
                role, text = random_rows(rng, 1)[0]
                rows.append((conv, turn * rng.choice((1, 1, 1, 3)) if rng.random() < 0 else turn, rng.choice((role, role, role, None)), rng.choice((text, text, text, None))))
        if rng.random() < 0.2:
            rows.append((conv, None, "user", "early."))
    rows += [(None, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(6)] + [(900, None, None, None)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copy int, shape string")
    table.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r) for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    after = damaged(rows)
    for conv in got:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        pairs = [r[2:] for r in mine]
        fault, turns = faults(pairs), [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = best_repair(pairs)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        counts = [fault.count(f) for f in ("blank", "duplicate", "truncated")]
        assert got[conv] == (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), conv


def test_repair_of_repeated_rows_and_empty_tables(spark):
    schema = "conv_id string, turn int, role string, text string"
    same = spark.createDataFrame([("c", 1, "user", "hi.")] * 3 + [("c", 2, "assistant", "yes.")], schema)
    (row,) = repair.repair(same).collect()
    assert (row.duplicate, row.audit, row.cost) == (2, "KDDK", 4)
    assert repair.repair(same.limit(0)).collect() == []
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.periodic_runs(docs).collect() == [] and pieces.encode_pieces(docs, MODEL).collect() == []
