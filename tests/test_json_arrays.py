import json
import os
import random

import pytest

from shelfspark.sources import files, json_arrays

TEXTS = ["plain", "", 'a "quoted" }{][,', "back\\slash", "ends in \\", '\\"', "\\\\", "brace } and , comma", "ünï\U0001f600", "line\nbreak", "[1, {", "tab\t"]


def _array(n, seed):
    rnd = random.Random(seed)
    return [{"id": i, "t": rnd.choice(TEXTS) + rnd.choice(TEXTS), "o": {"k": rnd.choice(TEXTS), "l": [rnd.randint(0, 9) for _ in range(rnd.randint(0, 3))]},
             "n": None if i % 5 == 0 else [{"x": rnd.choice(TEXTS)}]} for i in range(n)]


SCHEMA = "id long, t string, o struct<k: string, l: array<long>>, n array<struct<x: string>>"


def test_pieces_of_every_cut_give_the_elements():
    rows = _array(5, 1)
    text = json.dumps(rows, ensure_ascii=False)
    for cut in range(len(text) + 1):
        a, b = json_arrays.scan(text[:cut], 0), None
        assert a == json_arrays.scan(text[:cut], 0)
        b = json_arrays.scan(text[cut:], a.end)
        assert json_arrays.joined(a, b) == json_arrays.scan(text, 0)
        parts: dict[int, str] = {}
        for part, state in ((text[:cut], (0, 0, 0)), (text[cut:], (a.end, a.depth, a.commas.get(1, 0)))):
            for n, piece in json_arrays.pieces(part, *state):
                parts[n] = parts.get(n, "") + piece
        assert [json.loads(parts[n]) for n in sorted(parts)] == rows


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_one_large_array_is_read_by_many_tasks_in_file_order(spark, tmpdir_path, split):
    rows = _array(400, split)
    for name, some, indent in (("a", rows[:300], None), ("b", rows[300:], 2)):
        with open(os.path.join(tmpdir_path, f"{name}.json"), "w") as f:
            f.write("  " + json.dumps(some, ensure_ascii=False, indent=indent) + "\n")
    schema = spark.createDataFrame([], SCHEMA).schema
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        tasks = json_arrays._segments(spark, tmpdir_path).rdd.getNumPartitions()
        got = files.read_json_array(spark, tmpdir_path, schema, split=True).orderBy("row_no").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    size = sum(os.path.getsize(os.path.join(tmpdir_path, n)) for n in os.listdir(tmpdir_path))
    assert tasks >= min(size // split, 2)
    plain = [{**r.asDict(recursive=True)} for r in got]
    assert [r.pop("row_no") for r in plain] == list(range(1, 401))
    assert plain == rows


def test_small_arrays_and_absent_files(spark, tmpdir_path):
    schema = spark.createDataFrame([], "id long").schema
    for name, body in (("e.json", "[]"), ("s.json", ' [ ] \n'), ("o.json", '[{"id": 1}]'), ("t.json", '﻿[{"id": 2},\n{"id": 3}] trailing {"id": 4}')):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(body)
    got = files.read_json_array(spark, tmpdir_path, schema, split=True).orderBy("row_no").collect()
    assert [(r.row_no, r.id) for r in got] == [(1, 1), (2, 2), (3, 3)]
    assert files.read_json_array(spark, os.path.join(tmpdir_path, "none"), schema, split=True).collect() == []
