"""Toxicity, decontamination, surrogates, suffix tree and fixity on small cases, against brute force where there is one."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconframe.llm import decontamination, fixity, pii, suffix_tree, toxicity

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ri", "so") for b in ("ben", "dor", "fal", "gim", "hut")]


def _texts(n, seed, length=40):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=length)) for _ in range(n)]


def test_kernel_is_the_sum_over_common_subsequences():
    def phi(w):
        w, out = "\x02" + w, Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    def kernel(a, b):
        x, y = phi(a), phi(b)
        return sum(x[t] * y[t] for t in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    marks = toxicity.Landmarks(["idiot", "banana"], 2)
    words = ["idiot", "idi*ot", "iidioot", "bananas", "qqq"]
    at, k = marks.near(words)
    want = np.array([[kernel(w, m) for m in marks.words] for w in words])
    assert at.tolist() == np.flatnonzero(want.max(1) >= marks.floor).tolist()
    assert np.allclose(np.sqrt(k), want[at])


def test_toxicity_learns_and_tolerates_gaps(spark):
    texts = _texts(200, 1)
    rows = [(i, t + (" vexgrub" if i % 4 == 0 else ""), i % 4 == 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(i, int(x)) for i, _, x in rows], "doc_id long, toxic int"))
    more = spark.createDataFrame([(1, "kaben vexgrub lodor", 0), (2, "kaben vex-grub", 0), (3, "kaben v e x g r u b", 0), (4, "kaben lodor", 0), (5, "", 0), (6, None, 0), (None, "x " * 50_000, 0)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(more, model).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, None: 0}
    assert toxicity.keep_civil(more, model).count() == 4


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()] == [0]


@pytest.mark.parametrize("shard", [40, 10_000])
def test_decontamination_against_brute_force(spark, shard):
    items = [(i, t) for i, t in enumerate(_texts(12, 2, 24))] + [(50, _texts(1, 5, 20)[0] + "\n" + _texts(1, 6, 8)[0]), (60, None), (61, "")]
    docs = []
    for i, t in enumerate(_texts(40, 3, 150)):
        words = t.split()
        if i % 3 == 0:
            part = (items[i % 13][1]).split()
            if i % 2:
                part[3] = "changed"
            if i % 5 == 0:
                part = part[: len(part) // 2]
            words[70:70] = part
        docs.append((i, " ".join(words)))
    docs += [(None, items[0][1]), (99, None), (98, "")]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = set()
    for d, t in docs:
        have = grams((t or "").lower().split())
        for j, x in items:
            if x and len(grams(x.lower().split()) & have) >= 0.8 * len(grams(x.lower().split())):
                want.add((d, j))
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), shard_words=shard).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, items).count() == 0


def test_surrogates_keep_type_format_distinctness_and_coreference(spark):
    rng = random.Random(4)
    found = [f"10.{i}.{i * 2 % 256}.7" for i in range(60)] + [f"4{rng.randrange(10**15):015d}" for _ in range(60)] + [f"+1 ({200 + i}) 555-0{100 + i}" for i in range(60)] + [f"x{i}@mail.com" for i in range(60)] + ["123-45-6789", "Frau Lena Vogt", "Mr Vogt"]
    df = spark.createDataFrame([(i, f"a {e} b {e}.") for i, e in enumerate(found)] + [(900, None), (901, ""), (902, "plain " * 20_000)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.replace_pii(df, "key").collect()}
    new = []
    for i, e in enumerate(found):
        first, second = re.fullmatch(r"a (.*) b (.*)\.", out[i]["text"]).groups()
        assert first == second != e and out[i]["n_entities"] == 2
        if "@" not in e and not e[0].isalpha() and e.count(".") != 3:
            assert re.sub(r"\d", "9", first) == re.sub(r"\d", "9", e)
        new.append(first)
    assert len(set(new)) == len(found)
    assert new[-2].startswith("Frau ") and new[-2].split()[1].split("-")[0] in pii.GIVEN["latin", "female"]
    assert out[900]["text"] is None and out[901]["text"] == "" and out[902]["text"] == "plain " * 20_000


def test_surrogates_of_international_phones_without_separators(spark):
    found = {"+14155550123": "+1", "+442071838750": "+44", "+33 612345678": "+33", "+1415 5550123": "+1", "+14155550124": "+1", "+352621123456": "+352", "+2341": "+234", "+12345678901234567890": "+1"}
    out = pii.replace_pii(spark.createDataFrame([(e, f"call {e} now 000 000") for e in found], "e string, text string"), "key").collect()
    new = {r["e"]: re.fullmatch(r"call (.*) now 000 000", r["text"])[1] for r in out}
    assert all(r["n_entities"] == 1 for r in out) and len(set(new.values())) == len(found)
    for e, code in found.items():
        assert new[e].startswith(code) and re.sub(r"\d", "9", new[e]) == re.sub(r"\d", "9", e)
        assert new[e][len(code) :] != e[len(code) :]


def test_surrogates_of_full_and_short_names_agree(spark):
    texts = ["Frau Lena Vogt / Frau Vogt / Herr Vogt / Frau Lena Koch / Ms Lena Vogt / Herr Lena Vogt", "г-жа Анна Иванова / г-жа Иванова / г-жа Анна Петрова"]
    texts += [f"Frau {a.title()} {b.title()} / Mr {b.title()}" for a in WORDS for b in WORDS[:4]]
    out = {r["i"]: [x.split() for x in r["text"].split(" / ")] for r in pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "key").collect()}
    full, short, herr, koch, ms, male = out[0]
    assert full[2] == short[1] == herr[1] == ms[2] == male[2] != koch[2] and full[1] == koch[1] == ms[1] != male[1]
    assert full[1].split("-")[0] in pii.GIVEN["latin", "female"] and male[1].split("-")[0] in pii.GIVEN["latin", "male"]
    assert out[1][0][2] == out[1][1][1] != out[1][2][2] and out[1][0][1] == out[1][2][1]
    pairs = [out[i] for i in range(2, len(texts))]
    assert all(a[2] == b[1] for a, b in pairs) and len({tuple(a[1:]) for a, _ in pairs}) == len(WORDS) * 4 and len({a[2] for a, _ in pairs}) == 4


def test_untitled_repeats_of_a_name_and_apostrophes(spark):
    texts = ["Mr Hans Vogt met Hans Vogt and Mr Vogt, not Hans Vogtmann.", "Mr. O'Brien came. Ms Anna-Lena O'Hara left; Anna-Lena O'Hara waved."]
    a, b = (r["text"] for r in pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "key").orderBy("i").collect())
    given, family = re.fullmatch(r"Mr (\S+) (\S+) met \1 \2 and Mr \2, not Hans Vogtmann\.", a).groups()
    assert given != "Hans" and family != "Vogt" and "O'Brien" not in b and "O'Hara" not in b and "Anna" not in b


def test_no_number_maps_to_itself(spark):
    rng = random.Random(9)
    some = [f"+1 ({200 + i % 700}) 555-{i:04d}" for i in range(1500)] + [f"{rng.randrange(1000):03d}-{i % 100:02d}-{rng.randrange(10**4):04d}" for i in range(1500)]
    some += [f"4{rng.randrange(10**15):015d}" for _ in range(1500)] + [f"10.{i // 250}.{i % 250}.7" for i in range(1500)] + [f"+352{i}" for i in range(10, 100)]
    kinds = spark.createDataFrame([(e,) for e in dict.fromkeys(some)], "e string").select("e", pii.surrogate(F.col("e"), "key").alias("s"))
    told = kinds.agg(F.count_if(F.col("e") == F.col("s")), F.count("*"), F.count_distinct("s")).first()
    assert told[0] == 0 and told[1] == told[2]


def test_one_long_line_with_a_mail_and_empty_table(spark):
    line = spark.createDataFrame([("a" * 1_000_000 + " x@y.com", 7)], "text string, n_entities int")
    pii.replace_pii(spark.createDataFrame([("b@c.org",)], "text string"), "key").collect()
    began = time.time()
    row = pii.replace_pii(line, "key", width=pii.WIDTH).first()
    assert time.time() - began < 10 and row["n_entities"] == 1 and "x@y.com" not in row["text"] and row["text"].startswith("a" * 1_000_000)
    assert pii.replace_pii(line.limit(0), "key").count() == 0


def test_suffix_tree_base_and_sums(spark):
    texts = [(i, t) for i, t in enumerate(_texts(60, 7, 30))] + [(100, None), (101, "new words only")]
    got = {r["doc_id"]: r for r in suffix_tree.lm_scores(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    toks = {i: [*(t or "").lower().split(), None] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in toks}
    c = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0


def test_suffix_tree_learns_order(spark):
    rows = [(i, "red fox runs far away home " * 5) if i % 2 else (i, _texts(1, i)[0]) for i in range(80)]
    got = suffix_tree.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out and doc_id % 2 = 1").agg(F.min(F.col("score") - F.col("base_score"))).first()[0]
    assert got > 5


def test_fixity_finds_changed_missing_and_added(spark):
    left = [(i, f"r{i}") for i in range(5000)] + [(7, "twice"), (None, "x")]
    right = [(i, "bad" if i in (3, 4999) else t) for i, t in left if i != 4100] + [(9000, "new")]
    schema = "k long, p string"
    got = fixity.fixity_audit(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", "p").collect()
    assert sorted((r["record"], r["file"], r["status"]) for r in got) == [(3, 0, "changed"), (4100, 1, "missing"), (4999, 1, "changed"), (9000, 2, "added")]
