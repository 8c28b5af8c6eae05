"""Windows found in documents against plain loops over every document and window."""

import random

import numpy as np
import pytest

from sqltally.llm import decontaminate as d

WORDS = "add the sum of train leaves at speed find total how many apples does have left".split()
VALUES = ["3", "4.5", "Mary", "Ann", "km", "hours", "$", "12", "Bob", "!", "?", ","]


def text(rng, n, extra=()):
    return " ".join(rng.choice([*WORDS, *VALUES, *extra]) for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("together", [1, 40, 200_000])
def test_document_windows_equal_loops(spark, seed, together, monkeypatch):
    rng = random.Random(seed)
    items = [text(rng, rng.choice((1, 2, 4, 9, 14))) for _ in range(12)]
    texts = [text(rng, rng.randrange(30), ["zebra", "Xylo", "\x00", "99"]) for _ in range(40)]
    texts += [f"zebra {rng.choice(items)} and {rng.choice(items)}" for _ in range(30)] + ["", " ", items[0]]
    width, literals = 6, 3
    words = frozenset(t.lower() for i in items for t in d.TOKEN.findall(i))
    wanted: dict = {}
    windows: dict = {}
    for item in items:
        tokens = d.TOKEN.findall(item)
        codes, raw = d.Codes().both(tokens)
        for is_raw, values in ((True, raw), (False, d.Template(tokens, codes).codes)):
            span = min(width, len(values))
            if not span:
                continue
            at, h = d.window_hashes(values, span, 0 if is_raw else min(literals, span))
            for i, x in zip(at.tolist(), h.tolist()):
                wanted.setdefault((is_raw, span), set()).add(x)
                windows.setdefault((is_raw, span), {})[tuple(values[i : i + span].tolist())] = x
    expected = set()
    for n, whole in enumerate(texts):
        tokens = d.TOKEN.findall(whole)
        codes, raw = d.Codes(words).both(tokens)
        template = d.Template(tokens, codes)
        for (is_raw, span), known in windows.items():
            values, seen = (raw if is_raw else template.codes).tolist(), set()
            for i in range(len(values) - span + 1):
                window = tuple(values[i : i + span])
                if window not in known or (is_raw and span < width and window in seen):
                    continue
                seen.add(window)
                before = sum(p < i for p in template.places.tolist()) if is_raw else int(template.starts[i])
                expected.add((n, is_raw, span, i, before, known[window], "" if is_raw else template.slots(i, span)))
    monkeypatch.setattr(d, "TOGETHER", together)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    hashes = {k: np.sort(np.array(list(v), np.int64)) for k, v in wanted.items()}
    got = d._document_hits(docs, "doc_id", "text", words, hashes, literals, width).drop("text_key").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected) > 30
