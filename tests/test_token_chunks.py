"""Chunks bounded in tokens, against the tokenizer itself, the native chunker and a plain fold."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom import registry
from paperloom.operators import chunking
from paperloom.operators import token_chunks as tc
from paperloom.params import ChunkParams


@pytest.fixture(scope="module")
def byte_bpe():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return tc.tokenizer_counter(path), tc.tokenizer_counter(path)()


def _texts():
    r = random.Random(8)
    words = "The van für Straße 191-D-12345 naïve, don't e.g. ¿qué? 中文 😀 a\tb x\ny insurance".split(" ")
    out = [" ".join(r.choice(words) + r.choice(["", "", ". ", "!\n", "\n\n"]) for _ in range(r.randrange(1, 300))) for _ in range(40)]
    return out + ["", " \n ", "z" * 3000, "中" * 900, "word " * 500, "😀" * 300, "One. Two. Three."]


def test_no_chunk_has_more_tokens_and_no_text_is_lost(spark, byte_bpe):
    make, count = byte_bpe
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id int, text string")
    rows = tc.token_sentences(docs, make, ChunkParams(size=40, overlap=0)).orderBy("doc_id", "chunk_index").collect()
    assert max(count([x.chunk_text for x in rows])) <= 40
    assert all(c <= x.tokens <= 40 for x, c in zip(rows, count([x.chunk_text for x in rows]), strict=True))
    for i, text in enumerate(texts):
        assert "".join("".join(x.chunk_text.split()) for x in rows if x.doc_id == i) == "".join(text.split())
    assert {x.doc_id for x in rows}.isdisjoint({99, texts.index(""), texts.index(" \n ")})


def _fold(parts, size, overlap):
    """(first, last) of each chunk, from the rule: fill up, then step back over the parts that fit the overlap unless the next would not fit."""
    out, at, first = [], 0, 0
    while at < len(parts):
        while at < len(parts) and (at == first or sum(parts[first : at + 1]) <= size):
            at += 1
        out.append((first, at))
        back = at
        while back > first and sum(parts[back - 1 : at]) <= overlap:
            back -= 1
        first = back if at < len(parts) and sum(parts[back : at + 1]) <= size else at
    return out


def test_fold_with_overlap(spark, byte_bpe):
    make, count = byte_bpe
    r = random.Random(4)
    lists = [[" ".join(r.choice(["alpha", "Straße", "x1"]) for _ in range(r.randrange(1, 12))) + "." for _ in range(r.randrange(1, 60))] for _ in range(30)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lists)], "doc_id int, text string")
    for hook, size_of in ((make, lambda s: max(count([s, " " + s]))), (tc.word_counter, lambda s: len(s.split()))):
        got = tc.token_sentences(docs, hook, ChunkParams(size=50, overlap=20)).orderBy("doc_id", "chunk_index").collect()
        for i, parts in enumerate(lists):
            want = [" ".join(parts[a:b]) for a, b in _fold([size_of(s) for s in parts], 50, 20)]
            assert [x.chunk_text for x in got if x.doc_id == i] == want
    # the hook that counts words and the native chunker agree
    native = chunking.packed_sentences(docs, ChunkParams(size=50, overlap=20)).select("doc_id", "chunk_index", "total_chunks", "chunk_text")
    hook = tc.token_sentences(docs, tc.word_counter, ChunkParams(size=50, overlap=20)).select(native.columns)
    assert native.exceptAll(hook).isEmpty() and hook.exceptAll(native).isEmpty()


def test_blocks_are_cut_and_neighbours_merged(spark, byte_bpe):
    make, count = byte_bpe
    body = "# One\n\nshort a\n\n- item\n\n" + "long word " * 60 + "\n\nshort b\n\nshort c\n\n## Two\n\n| t |\n\n# Empty\n\n# " + "heading " * 40 + "\n\nunder it"
    docs = spark.createDataFrame([(1, body), (2, None), (3, ""), (4, "plain")], "doc_id int, text string")
    rows = tc.token_blocks(docs, make, 40).orderBy("doc_id", "chunk_index").collect()
    assert max(count([x.chunk_text for x in rows])) <= 40 and all(c <= x.tokens for x, c in zip(rows, count([x.chunk_text for x in rows]), strict=True))
    of = lambda h: [x for x in rows if x.doc_id == 1 and (x.parent_heading or "").startswith(h)]
    assert of("One")[0].chunk_text.startswith("One\nshort a\n\n- item") and of("One")[0].chunk_type == "list"
    assert of("One")[-1].chunk_text.endswith("short b\n\nshort c") and len(of("One")) > 3
    assert [(x.chunk_text, x.chunk_type) for x in of("Two")] == [("Two\n| t |", "table")]
    assert not of("Empty") and [x.chunk_text for x in of("heading")] == ["under it"]
    assert [(x.chunk_text, x.parent_heading) for x in rows if x.doc_id == 4] == [("plain", None)]
    assert re.sub(r"\s+|One\n|Two\n", "", "".join(x.chunk_text for x in of("One"))).count("longword") == 60


class _Looked(dict):
    """A memo that may be looked up but not walked."""

    def keys(self):
        raise AssertionError("the whole memo is walked")

    __iter__ = keys


def test_a_text_looks_up_its_own_words_alone():
    """Every text walked the whole memo, so a task's time grew with the square of its words."""
    calls = []

    def count(texts):
        calls.append(len(texts))
        return [len(t.split()) for t in texts]

    sizes = tc._Sizes(count)
    sizes.spaced = _Looked()
    assert sizes(["a b c", "c d"], " ") == [3, 2] and sizes(["d a", ""], " ") == [2, 0]
    assert calls == [8]


@pytest.mark.parametrize("chunker", [tc.token_sentences, tc.token_blocks])
def test_texts_are_packed_once(spark, chunker):
    plan = chunker(spark.createDataFrame([(1, "a. b.")], "doc_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1, plan


def test_registered_chunks_hold_every_word(spark, sf_dir):
    words = registry.queries()["c01_token_sentences"](spark, sf_dir)
    assert words.filter("tokens > 512").isEmpty()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.length(F.trim("text")) > 0).select("doc_id").distinct()
    assert words.select("doc_id").distinct().count() == docs.count()
    assert registry.queries()["c02_token_blocks"](spark, sf_dir).filter("tokens > 256").isEmpty()
