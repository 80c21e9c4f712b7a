"""Nested metadata against plain Python."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from paperloom.operators import metadata

KINDS = {bool: "BOOLEAN", int: "BIGINT", str: "STRING", type(None): "VOID", dict: "OBJECT", list: "ARRAY"}


def _value(r: random.Random, depth: int):
    kind = r.randrange(7 if depth else 4)
    if kind < 4:
        return [r.randrange(1000), r.choice(["", "für", 'quo"te\\', "x" * 300]), r.random() < 0.5, None][kind]
    if kind == 4:
        return [_value(r, depth - 1) for _ in range(r.randrange(4))]
    return {k: _value(r, depth - 1) for k in r.sample(["file_name", "word_count", "a b", "é", "tags"], r.randrange(5))}


def _walk(value, path, out):
    items = value.items() if isinstance(value, dict) else ((None, v) for v in value)
    for k, v in items:
        at = f"{path}[]" if k is None else f"{path}.{k}" if path else k
        out.append((at, KINDS[type(v)]))
        if isinstance(v, dict | list):
            _walk(v, at, out)


def test_census_of_any_depth(spark):
    r = random.Random(5)
    values = [_value(r, 5) for _ in range(200)]
    texts = [json.dumps(v) for v in values] + [None, "", "{broken", "7"]
    want: list = []
    for v in values:
        if isinstance(v, dict | list):
            _walk(v, "", want)
    got = metadata.key_census(spark.createDataFrame([(t,) for t in texts], "m string"), "m").collect()
    assert {x.path: (x.present, x.types) for x in got} == {p: (sum(q == p for q, _ in want), ",".join(sorted({t for q, t in want if q == p}))) for p in {p for p, _ in want}}
    assert all(len(s) <= 100 for x in got for s in x.samples)
    assert {x.group for x in got if x.key == "file_name"} == {"file"} and {x.group for x in got if x.key == "tags"} == {"other"}


def test_census_of_no_rows(spark):
    assert metadata.key_census(spark.createDataFrame([], "m string"), "m").count() == 0


def test_cleaning_cuts_values_and_keeps_keys(spark):
    long = "k" * 20
    given = {long: ["ab\0cdefgh", {"x": "é" * 9, "n": 12345678901234567890, "f": 1.5, "z": None}], "t": True}
    rows = [(json.dumps(given),), (None,), ("",), ("no json",), ("[" * 100_000,), ('"ab\\u0000cdefgh"',)]
    got = [x.c for x in spark.createDataFrame(rows, "m string").select(metadata.clean_json(F.col("m"), 5).alias("c")).collect()]
    assert json.loads(got[0]) == {long: ["abcde", {"x": "é" * 5, "n": 12345678901234567890, "f": 1.5, "z": None}], "t": True}
    assert got[1:5] == [None] * 4 and got[5] == '"abcde"'


def test_cleaning_holds_a_part_of_a_batch():
    """A batch's texts were all held as Python strings, before and after."""
    import tracemalloc

    import pyarrow as pa

    batch = pa.array([json.dumps({"n": i, "text": "x" * 5000}) for i in range(4000)] + [None, "no json", "[]"])
    tracemalloc.start()
    out = [(len(part), part[0].as_py()) for part in metadata._cleaner(1000)(iter([batch, batch.slice(0, 0)]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for n, _ in out) == len(batch) and json.loads(out[0][1]) == {"n": 0, "text": "x" * 1000}
    assert peak < 4 << 20, peak
