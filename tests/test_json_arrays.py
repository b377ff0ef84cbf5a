"""JSON arrays read in many splits, against the standard library's parser."""

from __future__ import annotations

import json
import random

import pytest

from tabulon.sources import files
from tabulon.sources.json_arrays import json_records, schema_of


def _value(r: random.Random, depth: int = 0):
    kinds = [lambda: r.randint(-9, 10**12), lambda: r.random(), lambda: None, lambda: "".join(r.choice('ab}{"\\[],: \n\té漢') for _ in range(r.randint(0, 30)))]
    if depth < 3:
        kinds += [lambda: [_value(r, depth + 1) for _ in range(r.randint(0, 3))], lambda: {r.choice("kl}{\"\\"): _value(r, depth + 1) for _ in range(r.randint(0, 3))}]
    return r.choice(kinds)()


def _records(seed: int, n: int) -> list:
    r = random.Random(seed)
    return [{"id": i, "text": _value(r, 3), "more": _value(r)} for i in range(n)]


def _read(spark, path, split):
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, str(split))
    try:
        frame = json_records(spark, str(path))
        return frame.rdd.getNumPartitions(), [json.loads(r[0]) for r in frame.collect()]
    finally:
        spark.conf.set(key, old)


def _sorted(rows):
    return sorted(json.dumps(r, sort_keys=True) for r in rows)


@pytest.mark.parametrize("split", [37, 400, 1 << 20])
@pytest.mark.parametrize("layout", ["line", "indented", "lines"])
def test_any_split_gives_the_records_of_the_file(spark, tmp_path, split, layout):
    want = []
    for k in range(2):
        rows = _records(k, 60)
        want += rows
        dump = "\n".join(map(json.dumps, rows)) if layout == "lines" else json.dumps(rows, indent=1 if layout == "indented" else None, ensure_ascii=k == 0)
        (tmp_path / f"{k}.json").write_text(dump, encoding="utf-8")
    assert _sorted(_read(spark, tmp_path, split)[1]) == _sorted(want)


def test_one_file_is_many_tasks_and_a_long_record_crosses_them(spark, tmp_path):
    rows = [{"id": 0, "text": "x}{" * 5000}, {"id": 1, "inner": [{"a": {"b": i}} for i in range(2000)]}, *({"id": i} for i in range(2, 500))]
    path = tmp_path / "one.json"
    path.write_text(json.dumps(rows))
    splits = spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 10 * splits
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert _sorted(_read(spark, path, 3000)[1]) == _sorted(rows)


def test_empty_arrays_and_files_have_no_record(spark, tmp_path):
    for k, text in enumerate(["", "[]", " [ ]\n", "[{}]", '{"a": 1}']):
        (tmp_path / f"{k}.json").write_text(text)
    assert _sorted(_read(spark, tmp_path, 1 << 20)[1]) == _sorted([{}, {"a": 1}])


def test_types_are_inferred_over_all_records(spark, tmp_path):
    rows = [{"n": 1, "x": 1, "s": "a", "mixed": 1, "VOID": None, "o": {"p": [1, 2]}, "a b": True}, {"n": 2, "x": 2.5, "s": None, "mixed": "b", "o": {"p": [], "q": "z"}}]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(rows))
    got = files.import_json(spark, str(path))
    kinds = dict(got.dtypes)
    assert kinds == {"n": "bigint", "x": "double", "s": "string", "mixed": "string", "VOID": "string", "o": "struct<p:array<bigint>,q:string>", "a b": "boolean"}
    assert [(r["n"], r["x"], r["mixed"], r["o"]["q"]) for r in got.orderBy("n").collect()] == [(1, 1.0, "1", None), (2, 2.5, "b", "z")]
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(ValueError, match="no records"):
        schema_of(json_records(spark, str(tmp_path / "none.json")))
