"""Nested reports, records of unlike form, envelopes, samples, the bounded ledger and the sample's draw against plain Python."""

import json
import random

import pytest
from pyspark.sql.types import StructType

from beaconframe.operators import incremental, reports, selection
from beaconframe.sources import envelopes, samples


def _differences(a, e, path="report"):
    """All differences, nothing below one of type, keys or length."""
    kind = lambda x: "array" if isinstance(x, list) else "object" if isinstance(x, dict) else "leaf"
    if kind(a) != kind(e):
        return [(path, "type")]
    if isinstance(e, list):
        return [(path, "length")] if len(a) != len(e) else [d for i, (x, y) in enumerate(zip(a, e, strict=True)) for d in _differences(x, y, f"{path}[{i}]")]
    if isinstance(e, dict):
        return [(path, "keys")] if a.keys() != e.keys() else [d for k in e for d in _differences(a[k], e[k], f"{path}.{k}")]
    return [] if a == e and type(a) is type(e) else [(path, "value")]


def _random_report(r, depth=0):
    if depth == 4 or r.random() < 0.3:
        return r.choice([None, True, 1, 2, "a", "b", 1.5, "", {}, []])
    if r.random() < 0.5:
        return [_random_report(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {k: _random_report(r, depth + 1) for k in r.sample("abcd", r.randint(0, 4))}


def _changed(r, x):
    if r.random() < 0.15:
        return _random_report(r, 3)
    if isinstance(x, list):
        return [_changed(r, y) for y in x]
    return {k: _changed(r, v) for k, v in x.items()} if isinstance(x, dict) else x


def test_differences_of_nested_reports(spark):
    r = random.Random(6)
    pairs = [(f"r{i}", a, _changed(r, a)) for i, a in enumerate(_random_report(r) for _ in range(80))]
    frame = lambda rows: spark.createDataFrame(rows, "id string, report string")
    actual = [(k, json.dumps(a)) for k, a, _ in pairs] + [("only", "{}"), ("broken", "{"), ("null", None)]
    expected = [(k, json.dumps(e)) for k, _, e in pairs] + [("gone", "[1]"), ("broken", "1")]
    got = sorted((x["key"], x["path"], x["difference"]) for x in reports.report_differences(frame(actual), frame(expected), "id", "report").collect())
    want = [(k, p, d) for k, a, e in pairs for p, d in _differences(a, e)] + [("only", "report", "unexpected"), ("gone", "report", "missing"), ("broken", "report", "missing")]
    assert got == sorted(want) and len(want) > 40
    assert reports.report_differences(frame([]), frame([]), "id", "report").count() == 0


def test_preview_of_records_of_unlike_form(spark):
    rows = [(0, '{"b": 1, "a": {"x": [1]}}'), (1, '{"c": null, "b": "text"}'), (2, None), (3, "no json"), (4, '{"d": true}')]
    cells, keys, total = reports.preview_records(spark.createDataFrame(rows, "n int, v string"), "v", "n", n=4, columns=3, most=4)
    assert keys == ["b", "a", "c"] and total == 5
    assert {r["n"]: r["cells"] for r in cells.collect()} == {0: {"b": "1", "a": '{"x"'}, 1: {"b": "text"}, 2: {}, 3: {}}


def test_envelopes_decide_filters_while_reading(spark, tmp_path, capsys):
    envelopes.register(spark)
    folder = tmp_path / "e"
    folder.mkdir()
    kind = "n long, id string, x double, ok boolean"
    read = lambda: spark.read.format("envelopes").schema(kind).load(str(folder))
    assert read().collect() == []
    (folder / "a.json").write_text(json.dumps({"columns": ["id", "n", "more"], "rows": [["a", 1, {}], ["b", "2", 0], ["c", "x", 0], ["d"]]}, indent=1) + "\n" + json.dumps({"columns": [], "rows": []}))
    (folder / "b.json").write_text(json.dumps({"columns": ["n", "x", "ok", "id"], "rows": [[5, "1.5", "true", "é"], [6, None, False, ""]]}))
    assert sorted(map(tuple, read().collect()), key=str) == sorted([(1, "a", None, None), (2, "b", None, None), (None, "c", None, None), (None, "d", None, None), (5, "é", 1.5, True), (6, None, None, False)], key=str)
    for where in ("n >= 2", "n > 1 and id <> 'b'", "id is null", "id in ('a', 'é')", "not (n = 1)", "n is not null and x < 2", "id like 'a%'", "n + 1 = 2", "n <=> 5"):
        df = read()
        assert sorted(map(tuple, df.where(where).collect()), key=str) == sorted(map(tuple, spark.createDataFrame(df.collect(), kind).where(where).collect()), key=str), where
    read().where("n >= 2 and id = 'b'").explain()
    told = capsys.readouterr().out
    print(told)
    (folder / "c.json").write_text("Error: no such dataset")
    with pytest.raises(Exception, match="no such dataset"):
        read().collect()


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_f31_envelopes_are_read_one_after_the_other(tmp_path, monkeypatch, piece):
    monkeypatch.setattr(envelopes, "PIECE", piece)
    kind = StructType().add("n", "long").add("t", "string")
    told = [{"columns": ["n", "t"], "rows": [[i * 10 + j, "é中" * j] for j in range(4)]} for i in range(300)]
    path = tmp_path / "many.json"
    path.write_text("\n " + "\n".join(json.dumps(x, ensure_ascii=i % 2 > 0) for i, x in enumerate(told)) + "  ")
    reader = envelopes.EnvelopeReader(str(path), kind)
    assert list(reader.read(reader.partitions()[0])) == [(n, t or None) for x in told for n, t in x["rows"]]
    path.write_text(json.dumps(told[0]) * 200 + '{"columns": [')
    rows = reader.read(reader.partitions()[0])
    assert next(rows) == (0, None)  # before the end of the file, which is broken, was read
    with pytest.raises(ValueError):
        list(rows)
    path.write_text("  \n Error: no such dataset ")
    with pytest.raises(ValueError, match="many.json: no such dataset$"):
        list(reader.read(reader.partitions()[0]))
    path.write_text("")
    assert list(reader.read(reader.partitions()[0])) == []


def test_samples_with_blank_and_broken_lines(spark, tmp_path):
    path = str(tmp_path / "s")
    samples.write_samples(spark.createDataFrame([("1", "t", None), ("2", 'q"\n', "治安")], "id string, title string, category string"), path)
    assert sorted((r["id"], r["title"], r["category"], r["notes"]) for r in samples.read_samples(spark, path).collect()) == [("1", "t", "", ""), ("2", 'q"\n', "治安", "")]
    (tmp_path / "s" / "more.txt").write_text('\n  \n{"id": "3"}\n{"id": \n')
    kept = samples.read_samples(spark, path, "keep").collect()
    assert {(r["id"], r["_broken"]) for r in kept if r["id"] in (None, "3")} == {("3", None), (None, '{"id": ')} and len(kept) == 4
    with pytest.raises(Exception, match="no JSON object"):
        samples.read_samples(spark, path).collect()


@pytest.mark.parametrize("budget,stretch", [(0, 4), (37, 4), (400, 4), (401, 3), (1500, 1000), (10**6, 7)])
def test_a_ledger_skips_what_does_not_fit_and_goes_on(spark, budget, stretch):
    r = random.Random(budget)
    rows = [("f" * r.choice([1, 2, 3, 30]) + str(i) + r.choice(["", '"', "é", "\n"]), r.randrange(9)) for i in range(60)]
    used, want = 0, []
    for f, t in sorted(rows, key=lambda x: (-x[1], x[0].encode())):
        n = len(json.dumps(f, ensure_ascii=False).encode()) + 8
        if used + n <= budget:
            used += n
            want.append((f, t))
    frame = lambda x: spark.createDataFrame(x, "fingerprint string, touch int")
    got = incremental.bound_ledger(frame(rows[:40] + [(rows[50][0], -1)]), frame(rows[40:] + [("", 99)]), budget, stretch=stretch)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def _drawn(text):
    h = 2166136261
    units = text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
    return (h * 1664525 + 1013904223) & 0xFFFFFFFF


def test_the_sample_s_draw(spark):
    r = random.Random(9)
    rows = [(n, f"id{n}" if n % 7 else "😀é", r.choice(["治安", " 治安 ", "反詐", "", None]), r.choice(["low", "high", " "])) for n in range(200)]
    got = selection.stratified_sample(spark.createDataFrame(rows, "n int, id string, category string, risk string"), 3, 123)
    cells = {}
    for n, i, c, k in rows:
        if (c or "").strip() and k.strip():
            cells.setdefault((c.strip(), k.strip()), []).append((n, i))
    want = []
    for (c, k), own in cells.items():
        scored = sorted((_drawn(f"123|{c}\0{k}|{i}|{at}"), i.encode(), at, n) for at, (n, i) in enumerate(own))
        want += [(n, pick) for pick, (*_, n) in enumerate(scored[:3], 1)]
    assert sorted((x["n"], x["pick"]) for x in got.collect()) == sorted(want)
