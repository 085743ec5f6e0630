"""Decontamination of items with short questions and answers, against the documented rule by brute force."""

import math
import random
from collections import Counter

from beaconframe.llm import decontamination

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ri", "so") for b in ("ben", "dor", "fal", "gim", "hut")]


def _held(part, text):
    part, text = part.split(), text.split()
    n = min(5, len(part))
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return len(grams(part) & grams(text)) / len(grams(part)) if part else 1.0


def test_short_questions_and_answers_against_brute_force(spark):
    rng = random.Random(11)
    draw = lambda n: " ".join(rng.choices(WORDS, k=n))
    # The item of 80 words makes the first window of a text 160 words long: it holds each of these texts whole.
    items = [(0, draw(80))] + [(i, f"{draw(q)}\n{draw(a)}") for i, (q, a) in enumerate([(10, 4), (12, 3), (9, 2), (14, 1), (4, 9), (3, 4), (2, 1), (10, 6)] * 2, 1)] + [(40, draw(3)), (41, draw(1)), (42, draw(10) + "\n" + draw(4))]
    docs = []
    for i, t in items[1:]:
        q, _, a = t.partition("\n")
        docs += [f"{draw(20)} {q} answer: {draw(8)} {a} {draw(20)}", f"{draw(20)} {q} answer: {draw(30)}", f"{draw(15)} {a} {draw(15)} {q}", f"{a} {draw(10)}", t, f"{draw(10)} {t}"]
        if len(a.split()) > 1:
            docs.append(f"{draw(9)} {q} answer: {' '.join(reversed(a.split()))} {draw(9)}")
    words = {j: t.split() for j, t in items}
    df, mean = Counter(w for ws in words.values() for w in set(ws)), sum(map(len, words.values())) / len(items)

    def gains(ws):
        return {t: math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t, c in Counter(ws).items()}

    want = set()
    for d, text in enumerate(docs):
        assert len(text.split()) <= 160
        for j, item in items:
            g = gains(words[j])
            if sum(v for t, v in g.items() if t in text.split()) < 0.5 * sum(g.values()):
                continue
            lines = item.split("\n")
            q, a = ("\n".join(lines[:-1]), lines[-1]) if len(lines) > 1 else (item, "")
            if min(_held(q, text), _held(a, text)) >= 0.8 or _held(item, text) >= 0.8:
                want.add((d, j))
    got = decontamination.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert (0, 1) in want and (1, 1) not in want


def test_clashing_columns_repeated_rows_and_a_very_long_text(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, f"x {item} y", 0.0, "a"), (1, f"x {item} y", 1.0, "b"), (2, "filler " * 200_000 + item, 0.0, "c"), (3, "", 0.0, None), (None, None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double, item_id string")
    items = spark.createDataFrame([(9, item, 1), (9, item, 2), (10, None, 3)], "item_id long, text string, doc_id int")
    got = decontamination.contaminated(df, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 9), (2, 9)]


def test_other_items_and_shards_never_change_an_item_s_rows(spark):
    rng = random.Random(3)
    draw = lambda n: " ".join(rng.choices(WORDS, k=n))
    q, a = draw(10), draw(10)
    item, long = (1, f"{q}\n{a}"), (2, " ".join(f"l{i}" for i in range(1000)))
    docs = [(1, f"{q} {'x ' * 400} {a}"), (2, f"{q} {'x ' * 90} {a}"), (3, f"{'y ' * 5000}{long[1]} z"), (4, f"{q} {a}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    more = [(i, f"{draw(8)}\n{draw(5)}") for i in range(10, 40)] + [(50, "same " * 40), (51, " ".join(["twice", "told"] * 30))]

    def rows(items, **how):
        found = decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string"), **how).collect()
        return {i: sorted(r["doc_id"] for r in found if r["item_id"] == i) for i in (1, 2)}

    alone = rows([item])[1]
    assert alone == [2, 4]
    assert rows([item, long]) == rows([item, long, *more]) == rows([item, long, *more], shard_words=60) == {1: alone, 2: [3]}


def test_step_of_an_item():
    assert [decontamination.step_of(n) for n in (1, 128, 129, 256, 257, 1000)] == [128, 128, 256, 256, 512, 1024]
