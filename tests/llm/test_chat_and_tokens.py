from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import bitpack, chat, lexicon, pieces
from paperloom.llm.common import shared_dir

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "plain words", "x" * 30_000, "two  spaces\n\nand\tlines ", "naïve café ÀÉÎ ß ²³ ½ İI", "日本語 テスト ١٢٣", "é combining   nbsp",
    "<|endoftext|> inside <|startoftext|>", "it's we'll I'D don't 'em", "a_b __c__ 1234 5.6%", "\x00\x1f control", "emoji 👩‍👩‍👧 done", "ſ ŉ ĸ ŀ",
]


@given(st.text(alphabet="<|turndobyse/>[INST]SYim_endoftxar␛lb \n", max_size=60))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_leaves_no_mark(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)


def test_mask_is_found_by_binary_search():
    offsets = np.array([[0, 2], [2, 4], [4, 6], [6, 9], [9, 10]])
    assert chat.token_mask(offsets, [(2, 4), (6, 9)]).tolist() == [False, True, False, True, False]
    assert not chat.token_mask(offsets, []).any()


@pytest.mark.parametrize("piece_chars", [1 << 20, 40])
def test_conversations_are_read_back(spark, piece_chars):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", said), (1, 2, "assistant", "  é👍\n"), (2, 0, None, None), (None, 0, "assistant", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, None, "user", "first")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i} <|turn|> ␛") for i in range(30)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    found = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table, BYTE, piece_chars=piece_chars)).collect()}
    assert len(found) == 5
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        got = found[conv]
        assert got.n_turns == len(turns)
        assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


chats, chat_library = chat.ChatEncoder(BYTE), chat.chat_encoder(BYTE)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "rôle"]), st.text(alphabet=" \n\ta'sSé.,1_<|😀²</s>[INST]", max_size=25)), max_size=4))
@settings(max_examples=400, deadline=None)
def test_rendered_conversations_are_encoded_as_the_library_does(turns):
    formatted, _ = chat.render(turns)
    got, want = chats(formatted), chat_library.encode(formatted, add_special_tokens=False)
    assert got[:, 0].tolist() == want.ids
    assert [tuple(x) for x in got[:, 1:].tolist()] == want.offsets


def test_a_hot_conversation_and_a_long_turn_span_tasks(spark):
    rows = [(9, i, ("user", "assistant")[i % 2], f"turn {i} said") for i in range(3000)] + [(i, 0, "assistant", "x") for i in range(10, 200)] + [(5, 0, "assistant", "long words " * 150_000)]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, part int")
    done = chat.format_conversations(table, BYTE, piece_chars=2000).cache()
    assert done.filter("conv_id = 9").select("part").distinct().count() > 1
    found = {r.conv_id: r for r in chat.read_back(done).collect()}
    assert len(found) == 192
    loss = "".join(f"turn {i} said" for i in range(1, 3000, 2))
    assert (found[9].n_turns, found[9].loss_chars, found[9].loss_sha256) == (3000, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert found[5].loss_chars == len("long words " * 150_000)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(empty, BYTE)).count() == 0


@given(st.lists(st.lists(st.integers(0, 4999), max_size=50), max_size=8), st.integers(2, 9))
@settings(max_examples=100, deadline=None)
def test_segments_round_trip(documents, block):
    arrays = [np.array(d, np.uint32) for d in documents]
    segment = bitpack.Segment(bitpack.pack(arrays, 5000, block))
    assert segment.width == 13
    assert [segment[i].tolist() for i in range(len(segment))] == documents
    whole = [x for d in documents for x in d]
    assert segment.slice(0, len(whole)).tolist() == whole
    if len(whole) > 3:
        assert segment.slice(2, len(whole) - 1).tolist() == whole[2:-1]


def test_an_id_beyond_the_vocabulary_is_refused():
    with pytest.raises(ValueError):
        bitpack.pack([np.array([9], np.uint32)], 8)


def test_byte_bpe_files_hold_the_library_s_ids(spark, docs):
    table = docs(list(enumerate(TEXTS))[::-1])
    path = shared_dir(spark)
    bitpack.write_tokens(table.withColumn("part", table.doc_id), path, BYTE, end_id=0)
    found = {r.doc_id: r for r in bitpack.document_digests(bitpack.read_tokens(spark, path)).collect()}
    tokenizer, start = Tokenizer.from_file(BYTE), 0
    for i, text in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), text
        start += len(ids)


encoder, library = bitpack.Encoder(BYTE), Tokenizer.from_file(BYTE)


@given(st.text(alphabet=" \n\ta'sSé.,1_<|😀²", max_size=30))
@settings(max_examples=600, deadline=None)
def test_texts_are_encoded_as_the_library_does(text):
    assert np.frombuffer(encoder(text), encoder.kind).tolist() == library.encode(text, add_special_tokens=False).ids


def test_very_long_texts_and_no_texts(spark, docs):
    texts = ["x" * 50_000, "word " * 60_000, "line\n" * 30_000, "a  b\n\n\nc\td " * 5_000]
    path = shared_dir(spark)
    bitpack.write_tokens(docs(list(enumerate(texts))), path, BYTE, end_id=0)
    found = {r.doc_id: r for r in bitpack.document_digests(bitpack.read_tokens(spark, path)).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (found[i].n_tokens, found[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    path = shared_dir(spark)
    bitpack.write_tokens(docs([]), path, BYTE, end_id=0)
    assert bitpack.document_digests(bitpack.read_tokens(spark, path)).count() == 0


def test_word_bpe_is_the_library_s(spark, docs):
    table = docs([*enumerate(TEXTS), (None, "no id"), (3, "plain words")])
    tokenizer = Tokenizer.from_file(WORD)
    rows = lexicon.round_trip(table, WORD).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert r.token_ids == ids
        assert r.decoded == tokenizer.decode(ids, skip_special_tokens=False)


@given(st.dictionaries(st.text(alphabet="abcé", min_size=1, max_size=6), st.lists(st.integers(0, 99), min_size=1, max_size=3), max_size=60))
@settings(max_examples=60, deadline=None)
def test_lexicon_finds_its_words_and_no_others(entries):
    words = lexicon.Lexicon(lexicon.compile_lexicon(entries))
    assert all(words.find(w.encode()) == ids for w, ids in entries.items())
    assert all(words.find(w.encode()) is None for w in ("zz", "abca" * 3, "") if w not in entries)


def test_suffixes_are_shared():
    tails = {f"{a}nation": [1] for a in "abcdefgh"}
    first = np.frombuffer(lexicon.compile_lexicon(tails)[:4], "<u4")[0]
    assert first // 4 - 1 < 12  # states: far fewer than 8 x 7


def test_plain_texts_are_told_from_others():
    assert pieces.plain("naïve – text") and not pieces.plain("日本") and not pieces.plain("<|x|>") and not pieces.plain("x²")
