from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperloom.functions import query as Q
from paperloom.functions import text as T
from paperloom.functions import vrn
from paperloom.operators import validate


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", list: "array<string>", bytes: "binary"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("query", "valid", "error", "clean"),
    [
        ("query    with   spaces", True, None, "query with spaces"),
        ("", False, "empty", ""),
        ("   ", False, "empty", ""),
        ("x" * 1001, False, "too_long", ""),
        ("x" * 1000, True, None, "x" * 1000),
        ("SELECT * FROM t", False, "sql_pattern", ""),
        ("drop it", False, "sql_pattern", ""),
        ("a UNION SELECT b", False, "sql_pattern", ""),
        ("a -- b", False, "sql_pattern", ""),
        ("<script>x</script>", False, "script_pattern", ""),
        ("javascript:go", False, "script_pattern", ""),
        ("onclick=go", False, "script_pattern", ""),
        ("<iframe", False, "script_pattern", ""),
        ("@@@@ab", False, "special_characters", ""),
        ("café", True, None, "café"),
    ],
)
def test_query_validation(spark, query, valid, error, clean):
    got = one(spark, Q.validate(F.col("q")), q=query)
    assert (got.is_valid, got.error, got.sanitized) == (valid, error, clean)


@pytest.mark.parametrize(("k", "value", "ok"), [(0, 1, False), (1, 1, True), (50, 50, True), (51, 50, False)])
def test_top_k_is_clamped(spark, k, value, ok):
    got = one(spark, Q.clamp_top_k(F.col("k")), k=k)
    assert (got.value, got.was_valid) == (value, ok)


@pytest.mark.parametrize(("t", "value", "ok"), [(-0.5, 0.0, False), (0.5, 0.5, True), (1.5, 1.0, False)])
def test_threshold_is_clamped(spark, t, value, ok):
    got = one(spark, Q.clamp_threshold(F.col("t")), t=t)
    assert (got.value, got.was_valid) == (value, ok)


@pytest.mark.parametrize(("query", "reason"), [("", "empty"), (" ", "empty"), ("a", "too_short"), ("!!!", "only_special"), ("car", None)])
def test_prechecks(spark, query, reason):
    assert one(spark, Q.precheck(F.col("q")), q=query) == reason


@pytest.mark.parametrize(
    ("query", "intent", "confidence"),
    [("asdfghjkl", "invalid", 0.80), ("insurance documents", "document_search", 0.75), ("John Nolan", "person_search", 0.85), ("find 231-D-54321", "vehicle_search", 0.95), ("the", "invalid", 0.95), ("when", "date_search", 0.70), ("blue sky today", "unknown", 0.5)],
)
def test_intents(spark, query, intent, confidence):
    got = one(spark, Q.intent(F.col("q")), q=query)
    assert (got.intent, got.confidence) == (intent, confidence)


def test_entities(spark):
    got = one(spark, Q.entity(F.col("q")), q="tell me about John Nolan")
    assert got.entity == "John Nolan" and got.method == "regex" and got.confidence > 0.8
    assert one(spark, Q.entity(F.col("q")), q="lower words only").method == "regex_fallback"
    assert one(spark, Q.variants(Q.entity(F.col("q")), F.col("q")), q="about Mary") == ["Mary", "about Mary"]
    assert one(spark, Q.validate_entity(F.col("e"), F.col("q")), e="find it", q="find it now").confidence == 0.1


def test_entity_searches_each_form_once(spark):
    plan = spark.range(1).select(Q.entity(F.concat("id", F.lit(" Ann Lee"))).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == len(Q.ENTITY_FORMS)


def test_borders_before_capitals(spark):
    text = "Ann saw éAbe, _Cy Lee-Ann and x Öl 5Bo (Di"
    assert one(spark, F.regexp_extract_all(F.col("q"), F.lit(T.bordered(r"\b[A-Z][a-z]+\b")), F.lit(0)), q=text) == ["Ann", "Lee", "Ann", "Di"]


def test_rewrites(spark):
    assert one(spark, Q.rewrites(F.col("q")), q="Tell me about Ann") == ["Tell me about Ann", "ann", "information about ann", "details about ann"]
    assert one(spark, Q.rewrites(F.col("q")), q="blue van") == ["blue van", "blue van information", "blue van details", "blue van documents"]
    assert one(spark, Q.rewrite_count_query(F.col("q")), q="how many cars") == "vehicle registration number insurance NCT VRN"
    assert one(spark, Q.rewrite_count_query(F.col("q")), q="all papers") == Q.COUNT_REWRITE
    assert one(spark, Q.listed_lines(F.col("t")), t='Queries:\n1. blue van papers\n- "red car tax"\nword\n') == ["blue van papers", "red car tax"]


@pytest.mark.parametrize(("query", "kind", "counts"), [("231-D-54321", "VRN", False), ("all vehicles", "Aggregation", True), ("how many cars", "Aggregation", True), ("show me papers", "Document", False), ("blue", None, False)])
def test_document_kinds(spark, query, kind, counts):
    assert one(spark, Q.document_kind(F.col("q")), q=query) == kind
    assert one(spark, Q.is_count_query(F.col("q")), q=query) == counts


def test_stop_words_and_acronyms(spark):
    got = one(spark, Q.without_stop_words(F.col("q")), q="The owner of it, please")
    assert (got.kept, got.removed) == ("owner please", ["The", "of", "it,"])
    assert one(spark, Q.needs_enhancement(F.col("q")), q="driveeer papers") is True
    assert one(spark, Q.needs_enhancement(F.col("q")), q="driver papers") is False
    assert one(spark, Q.expand_acronyms(F.col("q")), q="my NCT") == "my national car test"


def test_replies_are_parsed(spark):
    assert one(spark, Q.parsed_score(F.col("r")), r="Relevance: 7.5 of 10") == 7.5
    assert one(spark, Q.parsed_score(F.col("r")), r="none") == 5.0
    assert one(spark, Q.parsed_score(F.col("r")), r="99") == 10.0
    got = one(spark, Q.parsed_validation(F.col("r")), r="VALID: Yes\nINTENT: Vehicle_Search\nCONFIDENCE: 0.9\nREASON: fits")
    assert (got.is_valid, got.intent, got.confidence, got.reason) == (True, "vehicle_search", 0.9, "fits")
    assert one(spark, Q.parsed_validation(F.col("r")), r="VALID: no\nCONFIDENCE: x").confidence == 0.5


@pytest.mark.parametrize(("raw", "normal"), [("191D12345", "191-D-12345"), ("06 d 1234", "06-D-1234"), ("d12345", "D-12345"), ("191-D-12345", "191-D-12345"), ("other", "OTHER")])
def test_numbers_are_normalised(spark, raw, normal):
    assert one(spark, vrn.normalize(F.col("v")), v=raw) == normal


@pytest.mark.parametrize("text", ["12-05-2024", "2024-05-12", "123-456-7890"])
def test_dates_and_telephones_are_no_numbers(spark, text):
    assert one(spark, vrn.all_in_text(F.col("t")), t=text) == []
    assert one(spark, vrn.best_in_text(F.col("t")), t=text) is None


def test_numbers_in_text(spark):
    text = "old 06-zz-12 then 191-D-12345 and 191D777"
    assert one(spark, vrn.best_in_text(F.col("t")), t=text) == "191-D-12345"
    assert one(spark, vrn.all_in_text(F.col("t")), t=text) == ["191-D-12345", "06-ZZ-12", "191D777"]
    assert one(spark, vrn.first_in_text(F.col("t")), t="car d-77 and 06-D-12") == "06-D-12"
    assert one(spark, vrn.first_in_filename(F.col("t")), t="191-D-12345.pdf") == "191-D-12345"
    assert one(spark, vrn.is_partial_vrn(F.col("t")), t="231-D") is True


def test_word_borders(spark):
    assert one(spark, T.word_match(F.col("p"), F.col("t")), p="river", t="the driver") is False
    assert one(spark, T.word_match(F.col("p"), F.col("t")), p="River", t="river bank") is True
    assert one(spark, T.word_match(F.col("p"), F.col("t")), p="a.b", t="see axb") is False
    assert one(spark, T.occurrences(F.col("t"), F.col("p")), p="aa", t="aAaAa") == 2


@pytest.mark.parametrize(
    ("text", "reason"), [("", "empty"), ("  ", "empty"), ("short", "too_short"), ("x" * 60, "too_few_words"), ("12345 " * 20, "digits_only"), ("some words that are long enough to be a chunk of text", None)]
)
def test_chunk_reasons(spark, text, reason):
    assert one(spark, validate.chunk_reason(F.col("t")), t=text) == reason


def test_embedding_reasons(spark):
    reason = lambda t: one(spark, validate.embedding_reason(F.col("t")), t=t)
    assert [reason(t) for t in ("abc", "\x01" * 40, "!?" * 30, "one two", "one two three four")] == ["too_short", "unprintable", "few_letters", "too_short", None]


def test_text_functions(spark):
    assert one(spark, T.clean(F.col("t")), t="a\x00b\x1f\tc\n") == "ab\tc\n"
    assert one(spark, T.preview(F.col("t"), 3), t="abcdef") == "abc..."
    assert one(spark, T.output_path(F.col("p"), "out"), p="/in/a/b.pdf") == "out/in/a/b.md"
    assert one(spark, T.fill_images(F.col("t"), F.array(F.lit("X"))), t="a<!-- image -->b<!-- image -->c") == "aXb<!-- image -->c"
    assert one(spark, T.conversion_verdict(F.col("t")), t='```json [{"point": 1, "text": "x"}]```') == "extract_again"
    assert one(spark, T.is_iso_time(F.col("t")), t="2024-05-01T10:00:00") is True
    assert one(spark, T.quality_score(F.col("t")), t="") == 50.0
    got = one(spark, T.metrics(F.col("t")), t="a b\n\nc")
    assert tuple(got) == (6, 3, 3, 2)


def test_reasons_and_scores_keep_to_their_rules(spark):
    from paperloom.operators import retrieval

    reason = lambda t: one(spark, validate.embedding_reason(F.col("t")), t=t)
    assert reason("это обычный русский текст") is None and reason("这是 一段 中文 文本 在 这里 写") is None
    assert reason("a\tb\nc\rd e f g h") is None and reason("\x01\x02" * 40 + " a b") == "unprintable" and reason("!? " * 30 + "a b") == "few_letters"
    document = lambda t: one(spark, validate.document_reason(F.col("t")), t=t)
    assert document("w" * 30 + " " + "x" * 30 + " y") is None and document("w" * 60 + " y") == "too_few_words"
    assert document("  short  " + " " * 80) == "too_short" and document(" \n\t ") == "empty"
    score = lambda t: one(spark, T.quality_score(F.col("t")), t=t)
    sixty = " ".join(["wordword"] * 60)
    assert score(sixty) == 100.0 and score("could not " + sixty) == 85.0 and score(" ".join(["longerwords"] * 49)) == 90.0
    assert score(sixty + "\n- a\n* b\n- c") == 100.0 and score("failed " + sixty + "\n- a\n- b\n- c") == 90.0 and score("failed " + sixty + "\n- a\n* b\n- c") == 85.0
    clean = lambda t, q="who is the one we look for": tuple(one(spark, retrieval.cleaned_extraction(F.col("t"), F.lit(q)), t=t))
    assert clean("Name: John Nolan") == ("John Nolan", 0.9) and clean("answer= \"van 12\"") == ("van 12", 0.7)
    assert clean("John is") == ("John", 0.9) and clean("x") == ("x", 0.0) and clean("who that was") == ("who that was", 0.2)
    assert clean("a b c d e", "abc") == ("a b c d e", 0.1) and clean("one two three four") == ("one two three four", 0.5)


def test_word_borders_know_all_scripts(spark):
    assert not one(spark, Q.is_person_query(F.col("t")), t="find Enchö") and one(spark, Q.is_person_query(F.col("t")), t="find Ench, now")
    assert not one(spark, T.word_match(F.lit("f"), F.col("t")), t="für") and one(spark, T.word_match(F.lit("für"), F.col("t")), t="das ist für.")
