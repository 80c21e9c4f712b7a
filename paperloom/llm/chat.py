"""Operator 1: chat formatting with offset-aligned loss masks.

A whole conversation is rendered once and encoded once with offsets; the sorted
spans of assistant turns are intersected with the token spans by binary search.
Turn marks are special tokens of the encoding, so no token crosses a span's
border, and texts can't hold a mark: control strings inside are escaped.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces
from .common import materialize, table

#: Marks of the template.  Inside texts each of these strings, and the escape itself, is escaped.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|done|>"
#: Control strings of this and of other common templates.
CONTROL = (TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
ESCAPE = "␛"  # symbol for escape
#: Characters that begin a control string, or the escape: each is written as the escape and a letter.
LETTERS = {ESCAPE: "e", "<": "l", "[": "b"}
_ESCAPED = re.compile("|".join(re.escape(c) for c in CONTROL) + "|" + ESCAPE)
_UNESCAPED = re.compile(ESCAPE + "([" + "".join(LETTERS.values()) + "])")
_MARKS = re.compile("(" + "|".join(re.escape(m) for m in (TURN, BODY, END)) + ")")
_BACK = {v: k for k, v in LETTERS.items()}
#: Characters of rendered text after which a conversation goes on in a further piece, at a turn's start.
PIECE_CHARS = 1 << 20


def escape(text: str) -> str:
    """Replace the first character of every control string by the escape and a letter; the escape itself likewise."""
    return _ESCAPED.sub(lambda m: ESCAPE + LETTERS[m[0][0]] + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(lambda m: _BACK[m[1]], text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of the trained turns' texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        if role == trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from a formatted conversation."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        role, _, text = piece.removeprefix(TURN).partition(BODY)
        turns.append((unescape(role), unescape(text)))
    return turns


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for each token (start, end) inside one of the sorted, disjoint spans."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool)
    starts, ends = np.array(spans).T
    k = np.searchsorted(starts, offsets[:, 0], side="right") - 1
    return (k >= 0) & (offsets[:, 1] <= ends[np.maximum(k, 0)])


def masked_runs(offsets: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """[start, end) of the text under the mask, a row for each run of adjoining tokens; tokens that share a character count once."""
    own = offsets[mask]
    if not len(own):
        return np.zeros((0, 2), np.int64)
    ends = np.maximum.accumulate(own[:, 1])
    new = np.concatenate([[True], own[1:, 0] > ends[:-1]])
    return np.stack([own[new, 0], ends[np.append(np.flatnonzero(new)[1:] - 1, len(own) - 1)]], axis=1)


def chat_encoder(path: str):
    """Tokenizer of ``path`` with the template's marks as special tokens."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.add_special_tokens([TURN, BODY, END])
    return tokenizer


@functools.cache
def encoder_of(path: str) -> ChatEncoder:
    """The encoder of a tokenizer file, one for all tasks of a worker process."""
    return ChatEncoder(path)


class ChatEncoder:
    """Encodes rendered conversations with offsets, as ``chat_encoder``'s tokenizer does; a piece met before comes from a memo."""

    def __init__(self, path: str):
        self.tokenizer = chat_encoder(path)
        self.marks = {m: array("i", (self.tokenizer.token_to_id(m), 0, len(m))).tobytes() for m in (TURN, BODY, END)}
        tokenize, letters = self.tokenizer.model.tokenize, pieces.byte_alphabet()

        def encode(piece: str) -> bytes:
            """(id, start, end) of each token, in characters of the piece."""
            raw, out, at = piece.encode(), array("i"), 0
            # the character of each byte: a token that holds part of a character covers it
            char = range(len(raw)) if piece.isascii() else [i for i, c in enumerate(piece) for _ in c.encode()]
            for t in tokenize(raw.decode("latin-1").translate(letters)):
                end = at + len(t.value)
                out.extend((t.id, char[at], char[end - 1] + 1))
                at = end
            return out.tobytes()

        self.memo = pieces.Memo(encode, 150_000)

    def __call__(self, formatted: str) -> np.ndarray:
        """(id, start, end) of every token of a rendered conversation."""
        cut, values = [], []
        for part in _MARKS.split(formatted):
            if part in self.marks:
                cut.append(part)
                values.append(self.marks[part])
            elif pieces.plain(part):
                own = pieces.BYTE_LEVEL.findall(part)
                cut += own
                values += map(self.memo.__getitem__, own)
            else:
                found = self.tokenizer.encode(part, add_special_tokens=False)
                cut.append(part)
                values.append(np.column_stack([np.array(found.ids, np.int32), np.array(found.offsets, np.int32).reshape(-1, 2)]).tobytes())
        rows = np.frombuffer(b"".join(values), np.int32).reshape(-1, 3).copy()
        if cut:
            rows[:, 1:] += np.repeat(np.cumsum([0, *map(len, cut[:-1])], dtype=np.int32), [len(v) // 12 for v in values])[:, None]
        return rows


FORMATTED = "conv_id long, part int, piece int, n_turns int, formatted string, spans array<array<int>>, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.int32()))]


def format_conversations(
    rows: DataFrame,
    tokenizer_path: str,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """Formatted text, token ids with offsets, and loss mask of each conversation, in one or more pieces.

    Turns are ordered by turn (null first), then role and text; a null role or
    text is empty; repeated rows are turns of their own; a null conversation id
    is a conversation; an empty table gives no row; other columns are left out, whatever their names.
    Rows are dealt by ranges of that order, so a conversation of any share of all rows spans tasks.  It is cut between turns, where the
    marks isolate the encoding anyway, after ``piece_chars`` characters and where its range ends;
    ``part`` and ``piece`` order its pieces.  A turn is never cut.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer_path), TaskContext.get().partitionId()
        names = [x.split()[0] for x in FORMATTED.split(", ")]
        held, turns, chars, piece, began = None, [], 0, 0, False

        def whole() -> tuple:
            formatted, spans = render(turns)
            tokens = encoder(formatted)
            return held, part, piece, len(turns), formatted, [list(s) for s in spans], tokens, token_mask(tokens[:, 1:], spans)

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            *columns, tokens, masks = zip(*done, strict=True)
            ends = pa.array(np.cumsum([0, *map(len, masks)]), pa.int32())
            joined, mask = np.concatenate(tokens), np.concatenate(masks)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x))) for x in (*joined.T, mask)]
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)), *lists], names)

        for batch in batches:
            out, size = [], 0
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                role, text = role.as_py(), text.as_py()
                if began and conv != held:
                    out.append(whole())
                    turns, chars, piece = [], 0, 0
                elif began and chars >= piece_chars:
                    out.append(whole())
                    turns, chars, piece = [], 0, piece + 1
                held, began = conv, True
                turns.append((role, text))
                chars += len(text)
                size += len(text)
                if size >= piece_chars and out:
                    yield batch_of(out)
                    out, size = [], 0
            if out:
                yield batch_of(out)
        if began:
            yield batch_of([whole()])

    chosen = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"),
        F.col(turn_col).alias("turn"),
    ).withColumn("head", F.substring("text", 1, 32))
    dealt = chosen.repartitionByRange("conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(encode, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation from what ``format_conversations`` gave: turns parsed out of the text, loss text from mask and offsets.

    The pieces of a conversation adjoin in one task, in order, and are digested one by one: a digest is
    sequential, so this, unlike the formatting, takes one task a conversation, which holds one piece at a time.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, masks = (batch.column(n) for n in ("token_starts", "token_ends", "loss_mask"))
            runs = []
            for i in range(batch.num_rows):
                a, b = starts[i].values.to_numpy(), ends[i].values.to_numpy()
                runs.append(masked_runs(np.column_stack([a, b]), masks[i].values.to_numpy(zero_copy_only=False).astype(bool)).ravel().tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(runs, pa.list_(pa.int32()))], ["conv_id", "part", "piece", "formatted", "runs"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def closed() -> tuple:
            conv, n, turns, chars, loss, size = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            out = []
            for conv, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text, runs = text.as_py(), runs.as_py()
                if state is None or conv != state[0]:
                    if state:
                        out.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for a, b in zip(runs[::2], runs[1::2], strict=True):
                    said = unescape(text[a:b])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if out:
                yield batch_of(out)
        if state:
            yield batch_of([closed()])

    columns = formatted.select("conv_id", "part", "piece", "formatted", "token_starts", "token_ends", "loss_mask")
    marked = columns.mapInArrow(mark, "conv_id long, part int, piece int, formatted string, runs array<int>")
    dealt = marked.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").select("conv_id", "formatted", "runs")
    return dealt.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(materialize(format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json"))))


def _sql_escape(c: str) -> str:
    out = f"replace({c}, '{ESCAPE}', '{ESCAPE}e')"
    for x in CONTROL:
        out = f"replace({out}, '{x}', '{ESCAPE}{LETTERS[x[0]]}{x[1:]}')"
    return out


ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_sql_escape("role")}) + length({_sql_escape("text")}) + {len(TURN + BODY + END)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
