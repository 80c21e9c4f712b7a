from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom import registry
from paperloom.functions import query as Q
from paperloom.operators import chunking, evaluate, fusion, grams, keyword, lifecycle, retrieval, search, validate, vector
from paperloom.params import ChunkParams

CHUNKS = "chunk_id string, file_name string, chunk_index int, text string"


def test_texts_are_packed_once(spark):
    """Spark infers no filter that would pack the texts a second time, and sentences are counted once; texts without sentences have no row."""
    docs = spark.createDataFrame([(1, "A b. C d."), (2, "")], "doc_id long, text string")
    for rows, fold in ((chunking.packed_sentences(docs), r"\s+, -1"), (chunking.structure_chunks(docs), "aggregate(")):
        assert [r.doc_id for r in rows.select("doc_id", "total_chunks", "chunk_text").collect()] == [1]
        assert rows._jdf.queryExecution().optimizedPlan().toString().count(fold) == 1


def test_packed_sentences_cover_the_text(spark):
    r = random.Random(3)
    text = " ".join(" ".join("w" * r.randint(1, 5) for _ in range(r.randint(1, 30))) + "." for _ in range(60))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "one sentence only"), (4, "x " * 90 + ".")], "doc_id long, text string")
    params = ChunkParams(size=50, overlap=12)
    rows = chunking.packed_sentences(docs, params).orderBy("doc_id", "chunk_index").collect()
    parts = [x.chunk_text for x in rows if x.doc_id == 1]
    assert all(len(p.split()) <= 50 for p in parts)
    sentences = [s.strip() + "." for s in text.split(".") if s.strip()]
    assert all(any(s in p for p in parts) for s in sentences)
    assert all(sentences.index(a.split(". ")[0].rstrip(".") + ".") <= sentences.index(b.split(". ")[0].rstrip(".") + ".") for a, b in zip(parts, parts[1:]))
    assert not [x for x in rows if x.doc_id == 2] and len([x for x in rows if x.doc_id == 3]) == 1


def test_word_windows_overlap(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(100))))], "doc_id long, text string")
    rows = chunking.word_windows(docs, ChunkParams(size=40, overlap=10)).orderBy("chunk_index").collect()
    assert [(r.chunk_text.split()[0], r.chunk_text.split()[-1]) for r in rows] == [("0", "39"), ("30", "69"), ("60", "99")]


def test_structure_chunks_keep_headings(spark):
    text = "# Title\n\nfirst text here\n\n- item one\n- item two\n\n## Sub\n\n| a | b |\n\nlast words"
    rows = chunking.structure_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 50).orderBy("chunk_index").collect()
    assert [(r.parent_heading, r.chunk_type) for r in rows] == [("Title", "list"), ("Sub", "table")]
    assert rows[0].chunk_text.startswith("Title\nfirst text here")


def test_documents_without_chunks_fall_back(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    chunks = chunking.word_windows(docs.filter("doc_id = 1"))
    assert {r.doc_id for r in chunking.with_fallback(docs, chunks).collect()} == {1, 2}


def test_html_becomes_markdown(spark):
    html = "<html><script>x()</script><h2 class='a'>Head</h2><p>See <a href=\"u\">this</a> &amp; that</p><ul><li>one</li></ul></html>"
    got = spark.createDataFrame([(html,)], "h string").select(chunking.html_to_markdown(F.col("h")).alias("m")).first().m
    assert "## Head" in got and "[this](u) & that" in got and "- one" in got and "x()" not in got


def test_ocr_choice(spark):
    rows = [(1, 0, "primary", "p", 0.9), (1, 0, "other", "o", 0.95), (1, 1, "primary", "p", 0.2), (1, 1, "other", "o", 0.6), (2, 0, "other", "o", 0.1)]
    got = chunking.choose_ocr(spark.createDataFrame(rows, "doc_id long, image int, engine string, text string, confidence double"))
    assert {(r.doc_id, r.image): r.text for r in got.collect()} == {(1, 0): "p", (1, 1): "o", (2, 0): "o"}


def test_rejected_rows_have_reasons(spark):
    rows = spark.createDataFrame([("",), ("long enough text of more than five words in a row for a chunk",)], "text string")
    good, bad = validate.split_valid(rows, validate.chunk_reason(F.col("text")))
    assert good.count() == 1 and bad.first().reason == "empty"


def test_keyword_modes(spark):
    chunks = spark.createDataFrame([("a", "f", 0, "the driver sat"), ("b", "f", 1, "by the river bank"), ("c", "g", 0, "river river (x)"), ("d", None, 0, "river")], CHUNKS)
    queries = spark.createDataFrame([(1, "river"), (2, "(x)"), (3, "")], "query_id long, query string")
    token = {(r.query_id, r.chunk_id) for r in keyword.phrase_pairs(queries, chunks).collect()}
    assert token == {(1, "b"), (1, "c"), (2, "c")}
    inside = {(r.query_id, r.chunk_id) for r in keyword.phrase_pairs(queries.filter("query_id < 3"), chunks, "substring").collect()}
    assert inside == token | {(1, "a")} and {r.chunk_id for r in keyword.false_substrings(chunks, "rive", "river").collect()} == {"a", "b", "c", "d"}
    best = keyword.exact_search(queries, chunks, 1).filter("query_id = 1").first()
    assert (best.chunk_id, best.occurrences, round(best.score, 2)) == ("c", 2, 0.7)


@pytest.mark.parametrize("limit", [keyword.BROADCAST_CHARS, 0])
def test_substrings_agree_with_plain_search(spark, monkeypatch, limit):
    monkeypatch.setattr(keyword, "BROADCAST_CHARS", limit)
    r = random.Random(7)
    texts = ["".join(r.choice("ab é-.") for _ in range(r.randint(0, 30))) for _ in range(60)] + ["", "x", "Á b", "b" * 3000]
    asked = ["a", "é", "ab", "a b", "b a b", "-a-", ". ", "bbb", "aba", "", "Á", "zzz", " a b.", "abab"]
    chunks = spark.createDataFrame([(str(i), "f", i, t) for i, t in enumerate(texts)] + [("none", "f", 0, None)], CHUNKS)
    queries = spark.createDataFrame(list(enumerate(asked)) + [(99, None)], "query_id long, query string")
    got = [(r.query_id, r.chunk_id) for r in keyword.phrase_pairs(queries, chunks, "substring").collect()]
    assert sorted(got) == sorted((q, str(i)) for q, w in enumerate(asked) for i, t in enumerate(texts) if w and w.lower() in t.lower())
    found = {(r.query_id, r.chunk_id): (r.found, r.occurrences) for r in keyword.terms_search(spark.createDataFrame([(1, "bbb aba zzz")], queries.schema), chunks, 100).collect()}
    count = {i: [t.lower().count(w) for w in ("bbb", "aba", "zzz")] for i, t in enumerate(texts)}
    assert found == {(1, str(i)): (sum(map(bool, n)), sum(n)) for i, n in count.items() if any(n)}


def test_terms_are_found_inside_words(spark):
    """Accents, hyphens and full stops belong to a term; a term within a word counts; one that a query repeats counts each time."""
    chunks = spark.createDataFrame([("a", "f", 0, "Car 191-D-12345 was dafür"), ("b", "f", 1, "x191-d-123456, de. für für"), ("c", "g", 0, "191 D 12345 fur"), ("d", "g", 1, None), ("e", None, 0, "für")], CHUNKS)
    queries = spark.createDataFrame([(1, "191-D-12345"), (2, "für für"), (3, "the of in"), (4, "de."), (5, ""), (6, None)], "query_id long, query string")
    rows = {(r.query_id, r.chunk_id): (r["rank"], r.found, r.occurrences, round(r.score, 6)) for r in keyword.terms_search(queries, chunks).collect()}
    assert rows == {(1, "a"): (1, 1, 1, 0.6), (1, "b"): (2, 1, 1, 0.6), (2, "a"): (1, 2, 2, 0.6), (2, "b"): (2, 2, 4, 0.6), (4, "b"): (1, 1, 1, 0.6)}


@pytest.mark.parametrize("pairs", [grams.BROADCAST_PAIRS, 0])
def test_shortest_holders_agree_with_plain_search(spark, monkeypatch, tmp_path, pairs):
    """Strings whose grams are all there but not in a row need candidates beyond the first; the index is read back from its folder."""
    monkeypatch.setattr(grams, "BROADCAST_PAIRS", pairs)
    monkeypatch.setattr(grams, "BROADCAST_CHARS", pairs)
    r = random.Random(11)
    texts = ["".join(r.choice("abÉ-") for _ in range(r.randint(0, 60))) for _ in range(400)] + ["", None, "😀 abab", "ab"] + ["aab abb baa bab"] * 60 + ["x" * 200 + "aabbaabab"]
    chunks = spark.createDataFrame([(str(i), f"f{i % 3}", i, t) for i, t in enumerate(texts)], CHUNKS)
    grams.build(chunks, f"file://{tmp_path}/index")
    index = grams.load(spark, f"file://{tmp_path}/index")
    asked = ["aba", "aabbaabab", "é-é", "bbbb", "😀 a", "zzz", "abéab", "a" * 70]
    rows = grams.shortest_holding(index, spark.createDataFrame([(s,) for s in asked * 2], "string string"), 5).join(index.chunks, "ord").collect()
    got = {s: [x.chunk_id for x in sorted((x for x in rows if x.string == s), key=lambda x: x["rank"])] for s in asked}
    ranked = sorted((i for i, t in enumerate(texts) if t), key=lambda i: (len(texts[i]), f"f{i % 3}", i, str(i)))
    assert got == {s: [str(i) for i in ranked if s in texts[i].lower()][:5] for s in asked}
    n = index.postings.selectExpr("sum(n)").first()[0]
    assert n == sum(len({t.lower()[k : k + 3] for k in range(len(t) - 2)}) for t in texts if t)


def test_terms_make_up_the_shortfall(spark):
    chunks = spark.createDataFrame([(str(i), "f", i, f"blue van number {i}") for i in range(9)] + [("x", "g", 0, "blue van")], CHUNKS)
    queries = spark.createDataFrame([(1, "blue van number 3"), (2, "the green van")], "query_id long, query string")
    rows = keyword.keyword_search(queries, chunks, 4).collect()
    assert [r.match_type for r in rows if r.query_id == 1].count("exact_phrase") == 1
    assert len([r for r in rows if r.query_id == 1]) == 4 and len([r for r in rows if r.query_id == 2]) == 4
    assert len({(r.query_id, r.chunk_id) for r in rows}) == 8


def test_vector_variants_agree(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(200)] + [(500, [0.0] * 8), (501, None)]
    chunks = spark.createDataFrame(rows, "id long, vec array<float>")
    queries = chunks.filter("id % 40 = 0").select(F.col("id").alias("query_id"), "vec")
    fast = {(x.query_id, x["rank"]): x.id for x in vector.exact_top_k(queries, chunks, 5).collect()}
    plain = queries.withColumnRenamed("vec", "q").hint("broadcast").join(chunks.filter("vec IS NOT NULL")).select("query_id", "id", F.round(vector.cosine(F.col("q"), F.col("vec")), 12).alias("score"))
    assert fast == {(x.query_id, x["rank"]): x.id for x in vector.ranked(plain, 5).collect()}
    near = {(x.query_id, x.id) for x in vector.probe_top_k(queries, chunks, 5, cells=8, probes=6, rerank=20).collect()}
    exact = {(q, i) for (q, _), i in fast.items()}
    assert len(near & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("limit", [vector.BROADCAST_BYTES, 0])
def test_vector_blocks_of_any_kind(spark, monkeypatch, limit):
    """Odd lengths, null and non-finite components, ties and small blocks; beyond the broadcast bound blocks are dealt to the shards."""
    monkeypatch.setattr(vector, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(vector, "SHARD_BYTES", 700)
    monkeypatch.setattr(vector, "BLOCK_BYTES", 300)
    r = random.Random(4)
    rows = [(i, [float(r.randint(-1, 1)) for _ in range(3 if i % 4 else 5)]) for i in range(150)] + [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 0.0, 0.0]), (203, [])]
    table = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    got = {(x.query_id, x["rank"]): (x.id, x.score) for x in vector.exact_top_k(table.withColumnRenamed("id", "query_id"), table, 4).collect()}

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / n, 9) if n else 0.0

    for i, v in rows[:150]:
        best = sorted((-cos(v, w), j) for j, w in rows[:150] if len(w) == len(v))[:4]
        assert [(-s, j) for s, j in best] == [(round(got[i, k][1], 9), got[i, k][0]) for k in range(1, 5)]
    assert vector.exact_top_k(table.filter("id > 199").withColumnRenamed("id", "query_id"), table, 4).count() == 0


def test_sixty_thousand_queries(spark):
    rows = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(768)), lambda i: F.sin(F.col("id") * i)).alias("vec"))
    queries = spark.range(60_000).select(F.col("id").alias("query_id"), F.transform(F.sequence(F.lit(1), F.lit(768)), lambda i: F.sin((F.col("id") % 300) * i)).alias("vec"))
    found = vector.exact_top_k(queries, rows, 1)
    assert found.filter("query_id % 300 = id OR score > 0.999999999 OR query_id % 300 = 0").count() == 60_000


def test_embedding_hook(spark):
    rows = spark.createDataFrame([("a b",), ("",)], "text string")

    def embedder():
        return lambda texts: [[float(len(t))] for t in texts]

    assert [r.vec for r in vector.embed(rows, "text", embedder).collect()] == [[3.0], [0.0]]
    got = [r.vec for r in vector.embed(rows, "text", dim=8).collect()]
    assert math.isclose(sum(x * x for x in got[0]), 1.0) and sum(got[1]) == 0


def test_hashed_embedding_counts_words(spark):
    """Each word adds to one component what its hash says; a null text has no component; words are read once, not once a component."""
    rows = spark.createDataFrame([("b a B c",), (None,), ("",), ("c c",)], "text string")
    place = {r.w: r.p for r in spark.createDataFrame([("a",), ("b",), ("c",)], "w string").select("w", F.expr("pmod(xxhash64(w), 16)").alias("p")).collect()}
    got = [r.vec for r in vector.embed(rows, "text", dim=8).collect()]
    for words, vec in (("babc", got[0]), ("", got[2]), ("cc", got[3])):
        v = np.zeros(8)
        for w in words:
            v[place[w] % 8] += 1 if place[w] < 8 else -1
        assert vec == (v / (np.sqrt(v @ v) or 1)).tolist()
    assert got[1] == [None] * 8
    plan = vector.embed(rows, "text", dim=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan


def test_grams_of_any_letters_are_inverted():
    """Against a plain dictionary, with few letters and with so many that a gram and its text fit no one number; no order of whole texts is looked for."""
    r = random.Random(1)
    many = "".join(chr(0x4E00 + i) for i in range(20_000)) + "".join(chr(0x20000 + i) for i in range(40_000))
    for texts in (["abcab", "", "bca", "x"], ["".join(r.choice("aéß\U0001F600b") for _ in range(r.randrange(20))) for _ in range(500)], [many, *map(str, range(70_000))]):
        numbers = np.arange(len(texts)) * 3 + 16_000
        want = {}
        for n, t in zip(numbers.tolist(), texts, strict=True):
            for g in {t[i : i + 3] for i in range(len(t) - 2)}:
                want.setdefault((ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]), n >> grams.BLOCK_BITS), []).append(n & ((1 << grams.BLOCK_BITS) - 1))
        gram, block, places, n = grams.inverted(numbers, texts)
        got = {(g, b): np.cumsum(np.frombuffer(p, "<u2"), dtype=np.int64).tolist() for g, b, p in zip(gram.tolist(), block.tolist(), places, strict=True)}
        assert got == want and [len(got[k]) for k in zip(gram.tolist(), block.tolist(), strict=True)] == list(n) and sorted(got) == list(got)
    assert "argsort" not in grams.inverted.__code__.co_names


def test_written_shards_serve_several_searches(spark):
    rows = spark.range(50).select("id", F.array(F.sin("id"), F.cos("id")).alias("vec"))
    asked = rows.filter("id < 5").withColumnRenamed("id", "query_id")
    shards = vector.sharded(rows)
    for k in (1, 3):
        assert sorted(vector.exact_top_k(asked, None, k, shards=shards).collect()) == sorted(vector.exact_top_k(asked, rows, k).collect())


def candidates(spark, rows):
    schema = "query_id long, query string, chunk_id string, file_name string, chunk_index int, full_content string, similarity_score double, source_method string, match_type string, database_strategy string, query_occurrences int, n_metadata int, arrival_ord long"
    return spark.createDataFrame(rows, schema)


def row(chunk, score, method, text="some text", file="f", **more):
    d = {"query": "blue", "match_type": None, "database_strategy": None, "query_occurrences": 0, "n_metadata": 0, "arrival_ord": 0} | more
    return (1, d["query"], chunk, file, 0, text, score, method, d["match_type"], d["database_strategy"], d["query_occurrences"], d["n_metadata"], d["arrival_ord"])


def test_dedup_prefers_database_and_is_idempotent(spark):
    rows = candidates(spark, [row("a", 0.9, "llamaindex_vector"), row("b", 0.5, "database_hybrid"), row("c", 0.7, "hybrid", "other")])
    once = fusion.dedup_fused(rows)
    assert {r.chunk_id for r in once.collect()} == {"b", "c"}
    assert {r.chunk_id for r in fusion.dedup_fused(once).collect()} == {"b", "c"}
    assert {r.chunk_id for r in fusion.dedup_retrieved(rows).collect()} == {"b", "c"}


def test_hybrid_score_boosts_numbers(spark):
    text = "car 231-D-54321 " + "x" * 100
    rows = candidates(spark, [row("a", 0.5, "database_hybrid", text, query="231-D-54321"), row("b", 0.5, "llamaindex_vector", text, query="231-D"), row("c", 0.5, "llamaindex_vector", "short", query="blue")])
    got = {r.chunk_id: r.s for r in rows.select("chunk_id", fusion.hybrid_score(rows).alias("s")).collect()}
    assert got == pytest.approx({"a": 0.5 * 3 * 1.5 * 1.05, "b": 0.5 * 0.7 * 2 * 1.05, "c": 0.35})


def test_weighted_score(spark):
    rows = candidates(spark, [row("a", 0.5, "database_hybrid", "blue sky " + "y" * 100, match_type="exact_phrase", query_occurrences=2), row("b", 0.5, "spacy", "tiny")])
    score = fusion.weighted_score(F.lit(None).cast("string"), F.array(F.lit("blue"), F.lit("sky")))
    got = {r.chunk_id: r.s for r in rows.select("chunk_id", score.alias("s")).collect()}
    assert got == pytest.approx({"a": 0.5 * 1.4 * 1.2 * 1.3 * 1.2 * 1.1, "b": 0.5 * 0.8 * 0.8})


def test_reciprocal_rank_does_not_depend_on_order(spark):
    rows = [row("a", 0.9, "database_hybrid", "one"), row("b", 0.8, "database_hybrid", "two"), row("c", 0.95, "llamaindex_vector", "one"), row("d", 0.1, "llamaindex_vector", "three")]
    found = {r.key: r.rrf_score for r in fusion.reciprocal_rank(candidates(spark, rows)).collect()}
    # a result has the weight of its first row, for all its methods
    assert found["one"] == pytest.approx((1 / 61 + 1 / 61) * 1.4) and found["three"] == pytest.approx(0.7 / 62)
    assert found == {r.key: r.rrf_score for r in fusion.reciprocal_rank(candidates(spark, rows[::-1])).collect()}


def test_final_filter_and_gate(spark):
    rows = candidates(spark, [row(str(i), 0.9 - i / 10, "database_hybrid", str(i)) for i in range(8)]).withColumn("fused_score", F.col("similarity_score")).withColumn("is_person", F.lit(False)).withColumn("rank", F.col("chunk_id").cast("int") + 1)
    assert fusion.final_filter(rows).count() == 5
    assert fusion.rerank_gate(rows.filter("rank <= 2")).first().decision == "skip_few_files"
    scores = spark.createDataFrame([(1, "3", 9.0), (1, "0", 1.0)], "query_id long, chunk_id string, llm_score double")
    got = fusion.rerank(rows, scores).orderBy("rerank").collect()
    assert got[0].chunk_id == "3" and got[-1].chunk_id == "0" and not got[-1].is_relevant and got[1].llm_score == 5.0


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 4, True), (1, 7, True), (2, 3, True), (2, 1, False)], "query_id long, rank int, relevant boolean")
    queries = spark.createDataFrame([(1, 2), (2, 4), (3, 1)], "query_id long, min_relevant int")
    got = {r.query_id: (r.precision, r.recall, r.reciprocal_rank) for r in evaluate.metrics(ranked, queries).collect()}
    assert got == {1: (0.6, 1.0, 1.0), 2: (0.2, 0.25, 0.333333), 3: (0.0, 0.0, 0.0)}


def test_upsert_and_changes(spark):
    current = spark.createDataFrame([("a", "r", 1), ("b", "r", 1)], "chunk_id string, registry_id string, v int")
    incoming = spark.createDataFrame([("b", "r", 2), ("b", "r", 3), ("c", "r", 1), ("d", None, 1)], current.schema)
    merged, refused = lifecycle.upsert_chunks(current, incoming, [F.desc("v")])
    assert {(r.chunk_id, r.v) for r in merged.collect()} == {("a", 1), ("b", 3), ("c", 1)} and refused.count() == 1
    scan = spark.createDataFrame([("a", "h", 1, 1), ("b", None, 1, 1), ("n", "h", 1, 1)], "path string, hash string, size long, modified long")
    assert {r.change for r in lifecycle.change_set(scan, scan).collect()} == {"unchanged"}


def test_transitions_links_and_updates(spark):
    rows = spark.createDataFrame([(1, "processed", {"a": "1"}), (2, "uploaded", None)], "id long, status string, extracted map<string,string>")
    moved = lifecycle.transition(rows, spark.createDataFrame([(1, "assigned"), (2, "assigned")], "id long, to string"), lifecycle.DOCUMENT_MOVES)
    assert {(r.id, r.status, r.refused) for r in moved.collect()} == {(1, "assigned", False), (2, "uploaded", True)}
    change = spark.createDataFrame([(1, None, {"a": "2", "b": "3"}), (2, "x", {"c": "4"})], rows.schema)
    assert {r.id: (r.status, r.extracted) for r in lifecycle.sparse_update(rows, change).collect()} == {1: ("processed", {"a": "2", "b": "3"}), 2: ("x", {"c": "4"})}


def test_no_driver_side_rows_in_plans(spark, sf_dir):
    for name in ("r15_fuse", "r02_keyword_search", "l01_upsert"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "Python" not in plan, name


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_agree_with_their_sql(spark, sf_dir, duck, name):
    got, want = registry.queries()[name](spark, sf_dir), duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    columns = sorted(names)
    assert sorted(got.columns) == columns

    def plain(v):
        return None if v is None else repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    a = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    b = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in want.fetchall())
    assert a == b


def test_every_strategy_occurs_and_is_applied(spark, sf_dir):
    rows = registry.queries()["r15_fuse"](spark, sf_dir).collect()
    assert {r.strategy for r in rows} == {"single_result", "hybrid_person_priority", "hybrid_weighted_fusion", "database_priority", "vector_priority", "reciprocal_rank_fusion"}
    for q in {r.query_id for r in rows if r.strategy == "reciprocal_rank_fusion"}:
        scores = [r.score for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])]
        assert scores == sorted(scores, reverse=True) and all(s < 0.1 for s in scores)  # sums of 1 / (60 + rank)


CANDIDATE = "query_id long, query string, chunk_id string, file_name string, chunk_index int, full_content string, similarity_score double, source_method string, match_type string, database_strategy string, query_occurrences int, n_metadata int, arrival_ord long"


def test_reciprocal_ranks_merge_methods(spark):
    query = "count all rows that any of these many words give"
    make = lambda i, file, text, score, method: (1, query, str(i), file, 0, text, score, method, None, None, 0, 0, i)
    rows = [make(1, "a", "x" * 120, 0.9, "hybrid"), make(2, "b", "y", 0.8, "hybrid"), make(3, "a", "x" * 100 + "z", 0.5, "fallback"), make(4, "c", "w", 0.1, "fallback")]
    got = fusion.fuse(spark.createDataFrame(rows, CANDIDATE)).orderBy("rank").collect()
    assert [r.file_name for r in got] == ["a", "b"]  # c is under half the first similarity
    w = fusion.METHOD_WEIGHTS["hybrid"]  # of the row that came first, also for the other method
    assert math.isclose(got[0].fused_score, (w / 61 + w / 61) * 1.2, rel_tol=1e-6)
    assert math.isclose(got[1].fused_score, w / 62, rel_tol=1e-6)


def test_rows_of_one_result_share_its_best_rank(spark):
    make = lambda i, text, score, method: (1, "q", str(i), "a", 0, text, score, method, None, None, 0, 0, i)
    rows = [make(1, "x", 0.2, "spacy"), make(2, "y", 0.9, "hybrid"), make(3, "x", 0.8, "hybrid"), make(4, "x", 0.1, "hybrid")]
    got = {r.key: (round(r.rrf_score, 9), r.methods) for r in fusion.reciprocal_rank(spark.createDataFrame(rows, CANDIDATE)).collect()}
    assert got == {"x": (round(0.8 * (1 / 61 + 2 / 62) * 1.2, 9), 2), "y": (round(1.1 / 61, 9), 1)}


def test_entity_and_terms_weigh_in_fusion(spark):
    rows = [(1, "plain words", str(i), f"f{i}", 0, text, 0.5, method, None, None, 0, 0, i) for i, (text, method) in enumerate([("holds nolan and van", "database_hybrid"), ("other text", "database_hybrid"), ("more text here", "llamaindex_vector")])]
    table = spark.createDataFrame(rows, CANDIDATE)
    without = {r.chunk_id: r.fused_score for r in fusion.fuse(table).collect()}
    with_both = {r.chunk_id: r.fused_score for r in fusion.fuse(table, entity=F.lit("nolan"), terms=F.array(F.lit("van"), F.lit("nolan"))).collect()}
    assert with_both["0"] > without["0"] * 1.2 and with_both["1"] == without["1"]


def test_recall_of_the_registered_probe_search(spark):
    near, exact = ({(r.query_id, r.id) for r in registry.queries()[n](spark, "/root/testdata/sf0.01").collect()} for n in ("v03_cell_probe", "v02_exact_cosine"))
    assert all(q != i for q, i in near)
    assert len(near & exact) >= 0.9 * len(exact)


def test_recall_with_a_tenth_of_the_rows_scored(spark):
    """At 0.1 the registered query scores 100 of 2,000 rows a query exactly."""
    near, exact = ({(r.query_id, r.id) for r in registry.queries()[n](spark, "/root/testdata/sf0.1").collect()} for n in ("v03_cell_probe", "v02_exact_cosine"))
    assert len(near & exact) >= 0.9 * len(exact), len(near & exact) / len(exact)


def test_search_from_text_to_response_against_brute_force(spark):
    """Plain Python goes through the stages on the same rows: which chunks each search finds, dedup, strategy, order and filter of database queries."""
    r = random.Random(21)
    words = "blue van river John Nolan insurance für 191-D-12345 of the test".split()
    texts = {f"c{i}": " ".join(r.choice(words) for _ in range(r.randint(1, 40))) for i in range(120)} | {"t0": "who is John Nolan", "t1": "John Nolan"}
    chunks = spark.createDataFrame([(c, f"f{i % 7}", i, t) for i, (c, t) in enumerate(texts.items())] + [("n", "f0", 999, None)], CHUNKS)
    asked = {1: "blue van", 2: "John Nolan", 3: "für 191-D-12345", 4: "nowhere", 5: "", 6: "DROP TABLE x", 7: "tell me about John Nolan"}
    found = search.search(spark.createDataFrame(list(asked.items()), "query_id long, query string"), chunks)
    planned = {x.query_id: x for x in found.planned.collect()}
    assert set(planned) == {1, 2, 3, 4, 7}
    hits = found.hits.collect()
    rank = {c: k for k, c in enumerate(sorted(texts, key=lambda c: (len(texts[c]), f"f{list(texts).index(c) % 7}", list(texts).index(c))))}
    stop = set(Q.SEARCH_STOP_WORDS)
    by_word = {}
    for q, p in planned.items():
        low = p.query.lower()
        exact = sorted((c for c in texts if low in texts[c].lower()), key=rank.get)[:20]
        terms = [t for t in low.split() if len(t) > 2 and t not in stop]
        loose = sorted((c for c in texts if c not in exact and any(t in texts[c].lower() for t in terms)), key=rank.get)[: 20 - len(exact)]
        by_word[q] = set(exact) | set(loose)
        assert {h.chunk_id for h in hits if h.query_id == q and h.source_method == "database_hybrid"} == by_word[q]
    assert not by_word[4] and any(h.query_id == 4 for h in hits)  # the wider second search
    done = {q for q, p in planned.items() if p.strategy == "database_priority" and len(by_word[q]) >= 10}
    assert done and not any(h.query_id in done and h.source_method != "database_hybrid" for h in hits)
    fused = found.fused.collect()
    for q in planned:
        own = sorted((x for x in fused if x.query_id == q), key=lambda x: x["rank"])
        mine = [h for h in hits if h.query_id == q]
        assert len({x.full_content[:200] for x in own}) == len(own) and {x.chunk_id for x in own} <= {h.chunk_id for h in mine}
        assert [x["rank"] for x in own] == list(range(1, len(own) + 1))
        for x in own:  # of equal texts a database row stays
            same = [h for h in mine if h.full_content[:200] == x.full_content[:200]]
            assert x.source_method == "database_hybrid" or all(h.source_method != "database_hybrid" for h in same)
    shown = search.responses(found).collect()
    assert all(x["rank"] <= planned[x.query_id].top_k for x in shown if x.query_id not in (3, 7))
    kind = {(x.query_id, x["rank"]): x for x in fused}
    for x in shown:  # an exact phrase is shown at 0.95, anything else at its similarity
        row = kind[x.query_id, x["rank"]]
        assert x.display_score == pytest.approx(0.95 if row.match_type == "exact_phrase" else min(1.0, max(0.0, row.similarity_score)), abs=1e-6)
    measured = {x.query_id: x for x in search.measured(found).collect()}
    for q in planned:
        own = sorted((x for x in fused if x.query_id == q), key=lambda x: x["rank"])
        good = [planned[q].query.lower() in x.full_content.lower() for x in own]
        assert measured[q].precision == pytest.approx(sum(good[:5]) / 5) and measured[q].reciprocal_rank == pytest.approx(round(1 / (good.index(True) + 1), 6) if any(good) else 0)


def test_lifecycle_steps(spark):
    chunks = spark.createDataFrame([(1, "a", "p1"), (1, "b", "p1"), (2, "c", "p2"), (None, "d", None)], "doc_id long, chunk_id string, path string")
    registry_ = spark.createDataFrame([(1, "processed", "x"), (3, "failed", "y")], "id long, status string, path string")
    merged, refused = lifecycle.merge_registry(chunks, registry_)
    assert sorted(r.chunk_id for r in merged.collect()) == ["a", "b"] and sorted(r.chunk_id for r in refused.collect()) == ["c", "d"]
    assert {r.chunk_id: r.registry_id for r in lifecycle.inherit_registry(chunks, registry_).collect()} == {"a": "1", "b": "1", "c": None, "d": None}
    scan, manifest = spark.createDataFrame([("p1",)], "path string"), spark.createDataFrame([("p1",), ("p2",)], "path string")
    state, left, gone = lifecycle.remove_deleted(scan, manifest, chunks)
    assert [r.path for r in state.collect()] == ["p1"] and sorted(r.chunk_id for r in left.collect()) == ["a", "b", "d"] and [r.path for r in gone.collect()] == ["p2"]
    assert [r.id for r in lifecycle.extraction_picks(registry_).collect()] == [1]
    assert [r.id for r in lifecycle.extraction_picks(registry_, spark.createDataFrame([(3,)], "id long")).collect()] == [3]


def test_vectors_fit_for_an_index(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [1.0, float("nan")])]
    good, bad = vector.fit_for_index(spark.createDataFrame(rows, "id long, vec array<double>"), 2)
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.reason for r in bad.collect()} == {2: "null_vector", 3: "wrong_dimension", 4: "not_finite", 5: "not_finite"}


def test_chunk_types_are_counted_as_listed(spark, sf_dir):
    want = Counter((r.doc_id, r.chunk_type) for r in registry.queries()["c02_structure_chunks"](spark, sf_dir).collect())
    assert {(r.doc_id, r.chunk_type): r.n for r in registry.queries()["a42_chunk_types"](spark, sf_dir).collect()} == want


def test_strategy_search_reaches_every_chunk(spark, sf_dir):
    from paperloom.plans import inputs

    planned = {r.query_id: r for r in retrieval.plan(inputs.search_queries(spark, sf_dir)).collect()}
    chunks = inputs.chunks(spark, sf_dir).filter("text <> ''").withColumn("id", F.shiftleft("doc_id", 24) + F.col("chunk_index"))
    held = vector.embed(chunks, "text", dim=64).select("id", "vec").collect()
    matrix = np.array([r.vec for r in held], dtype=float)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    asked = {r.query_id: np.array(r.vec, dtype=float) for r in vector.embed(spark.createDataFrame([(i, p.query) for i, p in planned.items()], "query_id long, query string"), "query", dim=64).collect()}
    got, by_word = {}, Counter()
    for r in registry.queries()["r05_strategy_search"](spark, sf_dir).collect():
        if r.source_method == "vector_search":
            got.setdefault(r.query_id, []).append(r.score)
        else:
            by_word[r.query_id] += 1
    assert any(i & 0xFFFFFF for i in (r.id for r in held)) and got
    for i, p in planned.items():
        scores = np.sort(matrix @ asked[i] / np.linalg.norm(asked[i]))[::-1]
        want = [s for s in scores[: min(50, p.top_k)] if s >= p.threshold]
        if p.strategy == "database_priority" and by_word[i] >= retrieval.ENOUGH_DATABASE_HITS:
            want = []
        elif not want and not by_word[i]:
            want = [s for s in scores[: min(50, 2 * p.top_k)] if s >= 0]
        assert np.allclose(sorted(got.get(i, []), reverse=True), want, atol=2e-6)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_posting_lists_of_frequent_grams_are_counted_one_by_one():
    """All lists of a batch were laid side by side as numbers of eight bytes and sorted."""
    import tracemalloc

    import pyarrow as pa

    from paperloom.operators import grams

    full = np.r_[0, np.ones((1 << grams.BLOCK_BITS) - 1, int)].astype("<u2").tobytes()  # every chunk of the block
    half = np.r_[0, np.full((1 << grams.BLOCK_BITS - 1) - 1, 2)].astype("<u2").tobytes()  # every other one
    rows = [(f"s{i // 100:02}", 0 if i % 100 < 50 else 3, 50, half if i % 50 == 49 else full) for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["string", "block", "n_grams", "places"])
    tracemalloc.start()
    got = 0
    for part in grams._common(iter([batch.slice(0, 333), batch.slice(333)])):
        assert (part.column("ord").to_numpy() % 2 == 0).all()
        got += part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == 20 << grams.BLOCK_BITS - 1
    assert peak < 16 << 20, peak


def test_texts_are_inverted_some_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from paperloom.operators import grams

    texts = ["x" * n for n in (5, 0, 3 << 20, 1 << 20, 1 << 20, 7)] + [None]
    parts = list(grams.slices(iter([pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["ord", "text"])]), 1))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4], [5, 6]]


def test_few_shards_lie_in_a_file(spark, monkeypatch):
    """Spark decodes up to 4,096 rows of a file at once, and a task wrote all of its shards, some MB each, to one."""
    monkeypatch.setattr(vector, "SHARD_BYTES", 8 << 10)
    monkeypatch.setattr(vector, "FILE_BYTES", 32 << 10)
    rows = spark.range(0, 4000, 1, 1).select("id", F.array(*(F.sin(F.col("id") * k) for k in range(1, 9))).alias("vec"))
    shards = vector.sharded(rows)
    held = [r.n for r in shards.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 32 and max(held) <= 4
    index = vector.coded_index(rows, 8, cells=2)
    assert index.shards.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 4
    asked = rows.filter("id % 500 = 0").withColumnRenamed("id", "query_id")
    assert {r.query_id: r.id for r in vector.exact_top_k(asked, None, 1, shards=shards).collect()} == {i: i for i in range(0, 4000, 500)}
