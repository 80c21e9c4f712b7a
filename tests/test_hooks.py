"""Hooks against their defaults and plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import registry
from paperloom.functions import query as Q
from paperloom.operators import hooks, validate


def test_scorer_sees_whole_batches_once_a_task(spark):
    def make():
        seen = []

        def model(queries, texts):
            assert 0 < len(queries) == len(texts) <= 7
            seen.extend(queries)
            return [float(len(seen) > 0) + {"bad": float("nan"), "inf": float("inf"), "big": 99.0, "low": -3.0}.get(t, len(t)) for t in texts]

        return model

    rows = [(i, "q", t) for i, t in enumerate(["bad", "inf", "big", "low", "four", None] * 5)] + [(99, None, "ab")]
    got = spark.createDataFrame(rows, "i int, q string, t string").coalesce(1).select("i", hooks.relevance(F.col("q"), F.col("t"), make, batch=7).alias("s")).collect()
    want = {"bad": 5.0, "inf": 5.0, "big": 10.0, "low": 0.0, "four": 5.0, None: 1.0, "ab": 3.0}
    assert {r.i: r.s for r in got} == {i: want[t] for i, _, t in rows}


def test_default_and_hook_score_alike(spark):
    rows = [("Blue van", "a BLUE car"), ("", "x"), (None, None), ("für Für FÜR x", "FÜR"), ("a\tb\n c", "abc")]
    df = spark.createDataFrame(rows, "q string, t string")
    got = df.select(hooks.relevance(F.col("q"), F.col("t")).alias("n"), hooks.relevance(F.col("q"), F.col("t"), hooks.word_scorer).alias("h")).collect()
    assert [r.n for r in got] == [r.h for r in got] == [5.0, 0.0, 0.0, 5.0, 10.0]


def test_first_sure_extractor_else_the_surest(spark):
    queries = ["tell me about John Nolan", "who is Mary", "", "  ", None, "plain words only", "where is John Nolan and Mary Ann Smith"]
    q = F.col("q")
    df = spark.createDataFrame([(x,) for x in queries], "q string").withColumn("o", hooks.extracted(q, "names", hooks.name_extractor, batch=2))
    rows = df.withColumn("r", hooks.rules(q)).withColumn("e", hooks.extraction(q, F.col("o"), F.col("r"))).collect()
    for x in rows:
        if not (x.q or "").strip():
            assert (x.e.entity, x.e.confidence, x.e.method) == ("", 0.0, "empty_query")
            continue
        found = [x.o, x.r]
        want = next((f for f in found if f.confidence > 0.7), max(found, key=lambda f: f.confidence))
        assert (x.e.entity, x.e.confidence, x.e.method) == (want.entity, want.confidence, want.method)
    by = {x.q: x for x in rows}
    assert by["tell me about John Nolan"].e.method == "names" and by["where is John Nolan and Mary Ann Smith"].o.alternatives == ["John Nolan"]


def test_registered_extraction_keeps_every_turn(spark, sf_dir):
    rows = registry.queries()["x03_extraction_hook"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
    for r in rows:
        assert r.method in ("names", "regex", "regex_fallback", "empty_query")
        assert r.method != "names" or (r.entity, r.confidence) == (r.outside, r.outside_confidence)
        assert r.outside_confidence <= 0.7 or r.method == "names"
        assert r.variants.split("|")[0] == r.entity


def test_reply_takes_the_last_of_each_line(spark):
    reply = "VALID: no\nnot VALID: yes\n VALID: yes \nINTENT: poetry\nCONFIDENCE: 1e-1\nREASON:  a: b \r"
    got, none = (r.v for r in spark.createDataFrame([(reply,), ("",)], "r string").select(Q.parsed_validation(F.col("r")).alias("v")).collect())
    assert tuple(got) == (True, "unknown", 0.1, "a: b") and tuple(none) == (False, "unknown", 0.5, "LLM validation completed")


def test_enriched_counts(spark):
    row = validate.enriched(spark.createDataFrame([("a b\n\n \n\nc",)], "text string"), F.lit("now")).first()
    assert (row.indexed_at, row.content_length, row.word_count, row.paragraph_count) == ("now", 9, 3, 2)
