"""JSON arrays and quoted CSV read in ranges, against Spark's own one-task reader."""

import csv
import io
import json
import random

import pytest

from sparkwright.sources import readers as R
from sparkwright.sources import splitscan as S

TEXTS = ["plain", 'quote " in', "line\nbreak", "a,b;c", "{[}]", '}"}', "\\", 'back\\"slash', "\r\nboth\r\n", "é한\U0001f600", " lead", "", None,
         "[{", "}],[{", '"', '""', "\n\n", "x" * 700, "}" * 40, "tab\t", "\\u007d", "a}\n{b"]


def records(n, seed):
    rng = random.Random(seed)
    return [{"id": i, "text": rng.choice(TEXTS), "more": {"k": [rng.choice(TEXTS) or "z"], "d": [{"e": i}]} if i % 3 else None} for i in range(n)]


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df):
    return sorted(repr(r.asDict(True)) for r in df.collect())


@pytest.mark.parametrize("indent,seps", [(None, None), (2, None), (None, (" , ", " : "))])
def test_json_array(spark, small_ranges, tmp_path, indent, seps):
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(json.dumps(records(300, k), indent=indent, separators=seps, ensure_ascii=k == 0) + "\n" * k)
    path = str(tmp_path)
    got, want = R.read_json(spark, path), R.read_json(spark, path, split=False)
    assert got.schema == want.schema and rows(got) == rows(want)
    kept = S.split_records(spark, path, S.Elements)
    assert kept.rdd.getNumPartitions() > 20 and kept.count() == 600


def test_json_array_by_hand():
    texts = ['[]', '[ ]\n', '﻿[{"a":1}]', ' [\n{"a":"}"},\n{"a":{"b":[{}]}}\n]\n', '[{"a":"\\\\"},{"a":"\\"}{"}]']
    for text in texts:
        state, found, held = (False, 0), [], []
        for piece in text.split("}"):
            state = S.Elements.step(state, piece)
            held.append(piece)
            if S.at_end(state):
                found.append(S.Elements.record("}".join(held)))
                held = []
        S.Elements.check(state, "x")
        assert [json.loads(f) for f in found if f] == json.loads(text.lstrip("﻿"))


@pytest.mark.parametrize("text", ['[{"a":1}', '[{"a":1}, 5, {"a":2}]', '[{"a":1}] [{"a":2}]', '[{"a":"x}]', '[1, 2]'])
def test_broken_arrays_raise(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="array of records"):
        R.read_json(spark, str(tmp_path / "x.json"), schema="a int").collect()


def test_json_lines_and_single_object_stay(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a":{"b":1}}\n{"a":{"b":2}}\n')
    (tmp_path / "o.json").write_text('{\n "a": {"b": 3}\n}\n')
    assert [r.a.b for r in R.read_json(spark, str(tmp_path / "l.json")).orderBy("a.b").collect()] == [1, 2]
    assert [r.a.b for r in R.read_json(spark, str(tmp_path / "o.json")).collect()] == [3]


def to_csv(data, end):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(["id", 'te"xt\nname', "n"])
    for r in data:
        w.writerow([r["id"], r["text"], r["id"] / 4])
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("schema", [None, "id int, text string, n double"])
def test_quoted_csv(spark, small_ranges, tmp_path, end, schema):
    for k in range(2):
        data = to_csv(records(400, k), end)
        (tmp_path / f"{k}.csv").write_bytes(data.encode() if k else data.encode().rstrip())
    path = str(tmp_path)
    got, want = (R.read_csv(spark, path, schema=schema, multi_line=True, split=s) for s in (True, False))
    want = want.toDF(*[c.rstrip("\r") for c in want.columns])  # Spark's reader keeps it in the last name
    assert got.schema == want.schema and got.count() == 800
    assert rows(got) == rows(want)
    assert S.split_records(spark, path, S.Lines).rdd.getNumPartitions() > 20


def test_one_record_over_many_ranges(spark, small_ranges, tmp_path):
    body = "row\n" * 3000
    (tmp_path / "x.csv").write_text(f'a,b\n1,"{body}"\n2,"short\n"\n3,x\n')
    got = {r.a: r.b for r in R.read_csv(spark, str(tmp_path / "x.csv"), multi_line=True).collect()}
    assert got == {1: body, 2: "short\n", 3: "x"}
    (tmp_path / "y.json").write_text(json.dumps([{"a": 1, "b": "}" * 9000}, {"a": 2, "b": "{"}]))
    got = {r.a: r.b for r in R.read_json(spark, str(tmp_path / "y.json")).collect()}
    assert got == {1: "}" * 9000, 2: "{"}


def test_header_names_and_open_quote(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,,a,"b ""q"""\r\n1,2,3,4\r\n')
    got = R.read_csv(spark, str(tmp_path / "x.csv"), multi_line=True)
    assert got.columns == R.read_csv(spark, str(tmp_path / "x.csv"), multi_line=True, split=False).columns
    (tmp_path / "y.csv").write_text('a,b\n1,"open\n2,x\n')
    with pytest.raises(ValueError, match="not closed"):
        R.read_csv(spark, str(tmp_path / "y.csv"), multi_line=True)


def test_empty_files(spark, tmp_path):
    (tmp_path / "x.json").write_text("[]")
    assert R.read_json(spark, str(tmp_path / "x.json"), schema="a int").collect() == []
    (tmp_path / "x.csv").write_text("a,b\n")
    assert R.read_csv(spark, str(tmp_path / "x.csv"), schema="a int, b int", multi_line=True).collect() == []


def test_array_files_of_many_partitions(spark, small_ranges, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 9)], "id int, text string").repartition(5)
    path = str(tmp_path / "out.json")
    R.write_json_array(df, path)
    whole = [f for f in (tmp_path / "out.json").iterdir() if f.suffix == ".txt"]
    assert len(whole) == 5 and all(isinstance(json.loads(f.read_text()), list) for f in whole)
    assert rows(R.read_json(spark, path, schema=df.schema)) == rows(df)
    R.write_json_array(df.limit(0), path)
    assert R.read_json(spark, path, schema=df.schema).collect() == []
