from __future__ import annotations

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from paperloom.llm import langid, lexicon
from test_dedup import cut, fingerprint, prose, reachable
from test_search_and_classify import words


def stages(spark, docs, sf_dir):
    out = []
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf_dir)
        out.append(docs)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    return out


def test_stages_on_the_smallest_tables(spark, sf_dir):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    first, second, third, fourth, last = stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    kept = {r.doc_id: r.text for r in first.collect()}
    found = {r.doc_id: r for r in langid.op9_langid(spark, sf_dir).collect()}
    assert set(kept) == {i for i in rows if found[i].lang_pred != "und" and found[i].score >= 0.5}
    prints = {i: fingerprint(t) for i, t in kept.items()}
    ids = sorted(prints)
    root = reachable(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    unique = {i: kept[i] for i in ids if root[i] == i}
    assert {r.doc_id: r.text for r in second.collect()} == unique
    pieces = {i: (raw, spans) for i, (raw, spans) in cut([(i, i, t) for i, t in unique.items()]).items()}
    whole = {i: raw.decode("utf-8", "ignore") if spans else unique[i] for i, (raw, spans) in pieces.items()}
    whole = {i: t for i, t in whole.items() if not pieces[i][1] or t.strip(" ")}
    got = {r.doc_id: r for r in third.collect()}
    assert {i: r.text for i, r in got.items()} == whole
    assert all(r.n_chars == len(r.text) for i, r in got.items() if pieces[i][1])
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()

    def clean(text):
        w, hit = words(text), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        return not hit or 20 * len(hit) < len(w)

    left = {i: t for i, t in whole.items() if clean(t)}
    assert {r.doc_id: r.text for r in fourth.collect()} == left
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    final = {r.doc_id: r for r in last.collect()}
    assert set(final) == set(left)
    for i, t in left.items():
        ids_ = tokenizer.encode(t, add_special_tokens=False).ids
        assert (final[i].n_tokens, final[i].ids_sha256) == (len(ids_), hashlib.sha256(" ".join(map(str, ids_)).encode()).hexdigest())


def test_stages_on_odd_documents(spark, docs, sf_dir):
    same = prose(80, 77)
    rows = [(1, None), (2, ""), (3, "123"), (4, same), (4, same), (5, same), (None, prose(50, 3)), (None, None), (6, prose(90, 4)), (7, prose(40, 5) + " " + same)]
    out = stages(spark, docs(rows).selectExpr("*", "1 AS score", "2 AS kept"), sf_dir)
    assert [d.columns == list(corpus_pipeline.COLUMNS) for d in out[:4]] == [True] * 4
    # rows 1 to 3 have no letters; 4 stays once for 4 and 5; the row without an id stays
    assert sorted((r.doc_id for r in out[1].collect()), key=str) == [4, 6, 7, None]
    text = {r.doc_id: r.text for r in out[2].collect()}
    assert same not in text[7] and text[4] == same
    assert out[4].count() == 4


def test_stages_of_nothing(spark, docs, sf_dir):
    assert stages(spark, docs([]), sf_dir)[-1].count() == 0


def test_the_lexicon_changes_no_result(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    table = docs([(i, prose(30, i)) for i in range(5)])
    plain = lexicon.round_trip(table, path, lexicon.compile_lexicon({})).collect()
    assert sorted(plain) == sorted(lexicon.round_trip(table, path).collect())
