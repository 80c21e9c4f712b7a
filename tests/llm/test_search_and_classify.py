from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import decontaminate, kdtree, langid, warc
from paperloom.llm.common import shared_dir
from paperloom.llm.queries import ORACLE_SQL, QUERIES


def brute_top(vectors, queries, k):
    rows = {}
    for i, v in vectors:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(64 * float(x))) for x in v]
        rows[i] = min(rows.get(i, q), q)
    out = set()
    for i, q in rows.items():
        if i in queries:
            scores = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j) for j, p in rows.items() if j != i and len(p) == len(q))
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])}
    return out


def test_kd_tree_search_is_exact(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(600, 6)) / 3
    vectors = [(i, list(map(float, v))) for i, v in enumerate(base)]
    vectors += [(1000 + i, [0.5] * 6) for i in range(150)]  # one common vector
    vectors += [(-20, [0.1] * 6), (2000, [0.0] * 6), (2001, None), (2002, [None] * 6), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (None, [1.0] * 6)]
    vectors += [(2020, [1e12, -1e12, 3.0, 1e11, 0.0, 1.0]), (2040, [1.0, 2.0]), (2041, [0.5, 1.0]), (2060, []), (40, [9.0] * 6)]
    table = spark.createDataFrame([(i, v, 7) for i, v in vectors], "vec_id long, embedding array<double>, score int")
    queries = {i for i, _ in vectors if i is not None and i % 20 == 0}
    got = kdtree.top_k(table, F.col("vec_id") % 20 == 0, 20, shard_rows=200)
    assert {tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(vectors, queries, 20)


def test_kd_tree_boxes_are_tight():
    points = np.random.default_rng(2).integers(-50, 50, (1000, 4))
    tree = kdtree.build_tree(np.arange(1000), points, 64)
    assert sorted(tree["ids"]) == list(range(1000))
    leaves = []
    for n, (a, b) in enumerate(zip(tree["start"].tolist(), tree["end"].tolist(), strict=True)):
        assert (tree["points"][a:b].min(axis=0) == tree["low"][n]).all() and (tree["points"][a:b].max(axis=0) == tree["high"][n]).all()
        assert tree["first"][n] == tree["ids"][a:b].min()
        if (c := int(tree["child"][n])) < 0:
            assert b - a <= 64
            leaves += range(a, b)
        else:
            assert (tree["start"][c], tree["end"][c], tree["end"][c + 1]) == (a, tree["start"][c + 1], b)
    assert sorted(leaves) == list(range(1000))


def test_traversal_passes_over_most_of_the_tree():
    r = np.random.default_rng(4)
    points, queries = r.integers(-500, 500, (20_000, 3)), r.integers(-500, 500, (40, 3))
    tree, none = kdtree.build_tree(np.arange(20_000), points), np.full((40, 10), kdtree.NONE, np.int64)
    ids, scores, formed = kdtree.search(tree, np.arange(40) + 10**6, queries, 10, none, none)
    assert formed < 0.2 * 40 * 20_000
    full = queries @ points.T
    for i in range(40):
        order = np.lexsort((np.arange(20_000), -full[i]))[:10]
        assert ids[i].tolist() == order.tolist() and scores[i].tolist() == full[i][order].tolist()
    again = kdtree.search(tree, np.arange(40) + 10**6, queries, 10, np.full_like(none, 10**7), np.repeat(full.max(axis=1)[:, None] + 1, 10, axis=1))
    assert again[2] < formed  # the kth scores of another shard prune


def test_kd_tree_of_nothing(spark):
    assert kdtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


PAGES = [
    (5, "http://b.example.com/x", "<p>one</p>"), (3, "http://a.example.com/y?q=1", "<p>one</p>"), (9, None, None), (7, "no url", ""), (8, "http://b.example.com/x", "WARC/1.1\r\n\r\nWARC-Type: fake\r\n\r\n"),
    (None, "http://x", "lost"), (11, "http://a.example.com/y?q=1\r\nInjected: 1", "é\r\n\r\n"), (12, "http://a.example.com", "x" * 50_000), (12, "http://a.example.com", "x" * 50_000),
]


@pytest.mark.parametrize("file_bytes", [1, 700, 64 << 20])
def test_archives_are_read_back(spark, monkeypatch, file_bytes):
    monkeypatch.setattr(warc, "RANGE_ROWS", 3)
    pages = [*PAGES, (None, "http://y", "<p>one</p>"), (None, "http://z", "lost"), (20, "http://long.example.com", "é" * 3_000_000)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in pages], "page_id long, url string, html string, sha string, archive int")
    path = shared_dir(spark)
    warc.write_archives(table, path, file_bytes=file_bytes)
    rows = warc.capture_index(spark, path).collect()
    assert len(rows) == len(pages)
    first = {}
    for i, _, html in sorted((r for r in pages if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", i)
    want = []
    for i, _, html in pages:
        raw, one = (html or "").encode(), first.get(html or "")
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((i, len(raw), digest, *(("response", None) if one is None or one == i else ("revisit", one))))
    by = lambda r: (r[0] is not None, r[0] or 0, *r[1:3])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=by) == sorted(want, key=by)
    keys = [(r.url_key, r.capture_ts, r.page_id is not None, r.page_id or 0) for r in rows]
    assert keys == sorted(keys)
    for r in rows:  # any record is found by its offset and length alone
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            record = zlib.decompress(f.read(r.length), 31)
        assert f"WARC-Record-ID: <urn:page:{'null' if r.page_id is None else r.page_id}>".encode() in record
        with gzip.open(r.file.removeprefix("file:")) as f:
            assert record in f.read()
    assert len({r.file for r in rows}) >= (len(rows) if file_bytes == 1 else 1)
    empty = shared_dir(spark)
    warc.write_archives(table.limit(0), empty)
    assert warc.capture_index(spark, empty).count() == 0


@pytest.mark.parametrize("k", range(7))
def test_loser_tree_merges(k):
    r = random.Random(k)
    runs = [sorted((r.randint(0, 20),) for _ in range(r.randint(0, 9))) for _ in range(k)]
    assert [key for _, key in warc.LoserTree([iter(x) for x in runs])] == sorted(x for run in runs for x in run)


def test_language_of_held_out_documents(spark, sf_dir):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = langid.op9_langid(spark, sf_dir).collect()
    assert len(rows) == len(truth)
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(truth[r.doc_id].lang == r.lang_pred for r in out) >= 0.95 * len(out)


def plain_bayes(train, text):
    """Multinomial naive Bayes over the same hashed n-grams, counted one by one."""

    def grams(t):
        t = "  " + "".join(c if c.isalpha() else " " for c in t.lower())
        out = []
        for k in (2, 3):
            for i in range(len(t)):
                h = sum(ord((t + "    ")[i + j]) * int(langid._MULTIPLIERS[j]) for j in range(k)) % 2**32
                out.append(((h * 0x9E3779B1 + k) % 2**32) >> (32 - langid.HASH_BITS))
        return out

    scores = {}
    for lang in sorted({x for _, x in train}):
        own = [t or "" for t, x in train if x == lang]
        counts = Counter(g for t in own for g in grams(t))
        total = sum(counts.values()) + langid.ALPHA * 2**langid.HASH_BITS
        scores[lang] = math.log(len(own) / len(train)) + sum(math.log((counts[g] + langid.ALPHA) / total) for g in grams(text))
    top = max(scores.values())
    best = min(x for x, s in scores.items() if s == top)
    return best, 1 / sum(math.exp(s - top) for s in scores.values())


@pytest.mark.parametrize("languages", [256, 2, 1])
def test_languages_are_those_of_plain_naive_bayes(spark, docs, monkeypatch, languages):
    monkeypatch.setattr(langid, "PASS_LANGUAGES", languages)
    train = [("the cat sat on the mat", "en"), ("a dog and the cat", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien é", "fr"), ("el gato y el perro", "es"), (None, "es"), ("gatto", "it")]
    table = spark.createDataFrame(train, "text string, lang string")
    texts = ["the dog", "die Hunde", "le", "perro gato", "zzz", "É chat", "Katze cat gatto", "a1b2", "the cat"]
    got = {r.doc_id: r for r in langid.predict(docs(list(enumerate(texts))), langid.fit(table)).collect()}
    for i, text in enumerate(texts):
        lang, score = plain_bayes(train, text)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-3, text
    assert langid.predict(docs([]), langid.fit(table)).count() == 0
    assert "_top" not in got[0].asDict()


def test_language_of_odd_texts(spark, docs):
    train = docs([(i, "the cat and the dog went home") for i in range(5)]).unionByName(docs([(i, "der Hund und die Katze gehen nach Hause") for i in range(5)]).withColumn("lang", F.lit("de")))
    train = train.unionByName(docs([(9, "unlabelled")]).withColumn("lang", F.lit(None).cast("string")))
    model = langid.fit(train)
    assert model[0] == ["de", "en"]
    texts = [None, "", "123 !?", "die Katze und der Hund", "THE DOG", "x" * 200_000]
    table = docs(list(enumerate(texts))).withColumn("score", F.lit("clash"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(table, model).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0)] * 3
    assert got[3][0] == "de" and got[4][0] == "en" and got[5][0] in ("de", "en")
    none = langid.fit(docs([]))
    assert {r.lang_pred for r in langid.predict(table, none).collect()} == {"und"}


def words(text):
    import re

    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("broadcast", [32 << 20, -1])
def test_contamination_is_brute_force_s(spark, docs, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "Ünïcode", "ß9"]
    items = [(1, " ".join(r.choice(vocabulary) for _ in range(30))), (2, "Short item, of five words"), (3, None), (4, "!!!"), (5, "the the the the"), (10, "Short item, of five words"), (None, "no id item here")]
    long = items[0][1]
    texts = [None, "", "...", long, long.upper().replace(" ", ", "), " ".join(long.split()[3:16]), " ".join(long.split()[3:15]), "x y z " * 50 + "SHORT ITEM of FIVE words", "the the the the the the", "no id item here", " lead " + long + " tail " + "pad " * 900]
    texts += [" ".join(r.choice(vocabulary) for _ in range(60)) for _ in range(10)]
    table = docs([*enumerate(texts), (3, "repeated id"), (None, long)]).selectExpr("*", "1 AS row", "'c' AS term", "2 AS words")
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, wid int, term int")
    got = decontaminate.contamination(table, bench).collect()
    assert len(got) == len(texts) + 2
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    for row in got:
        if row.doc_id == 3:
            continue
        w = words(long if row.doc_id is None else texts[row.doc_id])
        hit, found = set(), set()
        for win, owners in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= owners
        found = sorted(str(i) for i in found if i is not None)
        assert (row.n_words, row.n_hit, row.n_items) == (len(w), len(hit), len(found))
        assert row.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert row.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert sorted(r.n_words for r in got if r.doc_id == 3) == [2, 30]


def test_contamination_without_items_or_documents(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs([(1, "a b")]), none).collect()[0].n_words == 2
    assert decontaminate.contamination(docs([]), none).count() == 0


def test_proximity_takes_any_order(spark, docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    table = docs([(1, "gamma then beta then alpha"), (2, "alpha beta gamma"), (3, "alpha " + "x " * 40 + "beta gamma")])
    _, anchors, index = decontaminate.index_for(table, bench, 3, slop=4)
    ids = {r["row"]: r.doc_id for r in index.collect()}
    assert {ids[r["row"]] for r in decontaminate.proximity_hits(index, anchors).collect()} == {1, 2}
    assert {ids[r["row"]] for r in decontaminate.phrase_hits(index, anchors).collect()} == {2}


def test_decontamination_runs_no_python(spark, sf_dir):
    plan = decontaminate.op5_decontaminate(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_agree_with_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    want = con.execute(ORACLE_SQL[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(map(str, (tuple(r[i] for i in order) for r in want.fetchall()))) == sorted(map(str, (tuple(r) for r in got.select(*columns).collect())))
