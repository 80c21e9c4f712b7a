"""Operator 13: prefix trie of conversations as a Z-fast trie.

A turn is the MD5 of its role and text; a prefix is named by its depth and two
64-bit polynomials over its turns, so the names of all prefixes of a piece of a conversation
come from one running sum.  Each task puts the conversations of its range into a Z-fast trie:
compacted nodes are hashed at their two-fattest depth, a conversation's exit node is found by fat
binary search over these handles, and the node is split there.  The edges are then expanded
to a row for each depth, and rows of equal prefixes of different tasks are summed.

Nothing is collected by conversation or by node: conversations are dealt by ranges of turns
and cut into pieces, whose places and prefix sums are carried over as scalars.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .passages import powers

#: Turns of a piece; turns of the pieces that a task's trie holds before its nodes are given out.
PIECE, HELD = 4096, 1 << 18
#: Conversations of a block share the head of its first one: ids are blocked by this number, and the head has less than ``HEADS`` turns.
BLOCK, HEADS = 100, 6
#: Ids that are joined to one string before they are digested.
PACK = 4096
_BASE = int(powers(2)[0][1])
_MASK = (1 << 64) - 1
KEY = ["depth", "p0", "p1"]


def head_turns(conv: int) -> int:
    """Turns that conversation ``conv`` takes from its block's first one."""
    return zlib.crc32(str(conv).encode()) % HEADS


def fattest(a: int, b: int) -> int:
    """The number in (a, b] that is divisible by the highest power of two."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class Piece:
    """A stretch of a conversation: names of its prefixes of depth ``start`` to ``end``, and the code points of its turns."""

    __slots__ = ("conv", "fid", "start", "end", "names", "sums", "chars")

    def __init__(self, conv: int, fid: int, start: int, sums: np.ndarray, chars: np.ndarray):
        self.conv, self.fid, self.start, self.end = conv, fid, start, start + len(chars)
        self.sums, self.chars = sums, chars
        self.names = list(zip(sums[0].tolist(), sums[1].tolist(), strict=True))

    def name(self, depth: int) -> tuple[int, int]:
        return self.names[depth - self.start]


class ZFastTrie:
    """Compacted trie of pieces; those that start at the same prefix share a root.

    Node x stands for the depths (low[x], extent[x]] of the piece rep[x].  ``count`` and ``first`` are
    the pieces that end at its extent, and the least (conversation, piece) of them.
    """

    def __init__(self):
        self.low, self.extent, self.rep, self.parent, self.count, self.first = [], [], [], [], [], []
        self.handles: dict[tuple, int] = {}
        self.kids: dict[tuple, int] = {}
        self.roots: dict[tuple, int] = {}
        self.turns = 0

    def _node(self, low: int, extent: int, rep: Piece, parent: int) -> int:
        for field, value in zip((self.low, self.extent, self.rep, self.parent, self.count, self.first), (low, extent, rep, parent, 0, None), strict=True):
            field.append(value)
        return len(self.low) - 1

    def _common(self, x: int, piece: Piece, low: int) -> int:
        """Depth, from ``low`` on, down to which ``piece`` runs along node ``x``: equal prefixes are equal at all smaller depths."""
        rep = self.rep[x]
        return low + bisect_left(range(low + 1, min(self.extent[x], piece.end) + 1), True, key=lambda d: rep.name(d) != piece.name(d))

    def locate(self, root: int, piece: Piece) -> tuple[int, int]:
        """(exit node, depth) of a piece by fat binary search: the node in or at whose end it leaves the trie."""
        at, low, high = root, piece.start, piece.end
        while low < high:
            f = fattest(low, high)
            x = self.handles.get((root, f, piece.name(f)))
            if x is None:
                high = f - 1
            elif self.extent[x] <= piece.end and self.rep[x].name(self.extent[x]) == piece.name(self.extent[x]):
                at, low = x, self.extent[x]
            else:
                return x, self._common(x, piece, f)
        if low < piece.end and (x := self.kids.get((at, piece.name(low + 1)))) is not None:
            return x, self._common(x, piece, low + 1)
        return at, low

    def _split(self, root: int, x: int, depth: int) -> int:
        """Cut node ``x`` at ``depth``; the new upper node takes its place."""
        low, extent, rep = self.low[x], self.extent[x], self.rep[x]
        upper = self._node(low, depth, rep, self.parent[x])
        self.kids[self.parent[x], rep.name(low + 1)] = upper
        self.kids[upper, rep.name(depth + 1)] = x
        self.low[x], self.parent[x] = depth, upper
        for node, (a, b) in ((upper, (low, depth)), (x, (depth, extent))):
            f = fattest(a, b)
            self.handles[root, f, rep.name(f)] = node
        return upper

    def insert(self, pieces: list[Piece]) -> None:
        for piece in pieces:
            key = (piece.start, piece.name(piece.start))
            root = self.roots.get(key)
            if root is None:
                root = self.roots[key] = self._node(piece.start, piece.start, piece, -1)
            at, depth = self.locate(root, piece)
            if depth < self.extent[at]:
                at = self._split(root, at, depth)
            if depth < piece.end:
                leaf = self._node(depth, piece.end, piece, at)
                self.kids[at, piece.name(depth + 1)] = leaf
                f = fattest(depth, piece.end)
                self.handles[root, f, piece.name(f)] = leaf
                at = leaf
            self.count[at] += 1
            own = (piece.conv, piece.fid)
            self.first[at] = own if self.first[at] is None else min(own, self.first[at])
            self.turns += piece.end - piece.start + 1

    def expanded(self) -> pa.RecordBatch:
        """A row for each depth of each node's edge, with the pieces that run through it."""
        count, first = list(self.count), list(self.first)
        for x in sorted(range(len(count)), key=self.extent.__getitem__, reverse=True):
            up = self.parent[x]
            if up >= 0:
                count[up] += count[x]
                first[up] = first[x] if first[up] is None else min(first[up], first[x])
        nodes = [x for x in range(len(count)) if self.parent[x] >= 0]
        lengths = [self.extent[x] - self.low[x] for x in nodes]
        cut = lambda take: np.concatenate([np.zeros(0, np.int64), *(take(self.rep[x], self.low[x] - self.rep[x].start, self.extent[x] - self.rep[x].start) for x in nodes)])
        many = lambda values: np.repeat(np.array(values, np.int64), lengths)
        depth = np.concatenate([np.zeros(0, np.int64), *(np.arange(self.low[x] + 1, self.extent[x] + 1) for x in nodes)])
        columns = [depth]
        columns += [cut(lambda r, a, b, k=k: r.sums[k][a + 1 : b + 1].view(np.int64)) for k in (0, 1)]
        columns += [cut(lambda r, a, b, k=k: r.sums[k][a:b].view(np.int64)) for k in (0, 1)]
        columns += [cut(lambda r, a, b: r.chars[a:b]), many([first[x][0] for x in nodes]), many([first[x][1] for x in nodes]), many([count[x] for x in nodes])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _EXPANDED_NAMES)


_EXPANDED = "depth long, p0 long, p1 long, q0 long, q1 long, chars long, conv_id long, fid long, n long"
_EXPANDED_NAMES = [x.split()[0] for x in _EXPANDED.split(", ")]
_PIECES = "fid long, conv_id long, opens boolean, base_n int, own_n int, sums binary, heads binary, turns binary, chars binary"


def _rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, section, turn, t, chars): a mark of each conversation, the turns it takes from its block's first one, and all its own, those it drops too."""
    by_turn = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "t")
    heads = rows.filter(F.col("conv_id") % BLOCK == 0).withColumn("place", F.row_number().over(by_turn)).filter(F.col("place") < HEADS)
    convs = rows.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    asked = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("_block"), h.alias("_h"))
    taken = asked.join(heads.withColumnRenamed("conv_id", "_block").hint("merge"), "_block").filter(F.col("place") <= F.col("_h"))
    mark = convs.select("conv_id", F.lit(-1).alias("section"), F.lit(0).cast("long").alias("turn"), F.unhex(F.lit("00" * 16)).alias("t"), F.lit(0).cast("long").alias("chars"))
    base = taken.select("conv_id", F.lit(0).alias("section"), F.col("place").cast("long").alias("turn"), "t", "chars")
    return mark.unionByName(base).unionByName(rows.select("conv_id", F.lit(1).alias("section"), "turn", "t", "chars"))


def _poly(turns: np.ndarray) -> np.ndarray:
    """Running polynomials of (n, 2) turn numbers, from 0 to all of them: shape (2, n + 1)."""
    out = np.zeros((2, len(turns) + 1), np.uint64)
    np.cumsum(turns.T * powers(len(turns) + 1)[0][: len(turns)], axis=1, out=out[:, 1:])
    return out


def _cut(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the sorted turns of a task: each of one conversation and of at most ``piece`` turns."""
    task, names = TaskContext.get().partitionId() << 32, [x.split()[0] for x in _PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    made, held = 0, None  # held: conversation, sections, turns, chars

    def closed(conv: int, section: np.ndarray, turns: np.ndarray, chars: np.ndarray) -> tuple:
        nonlocal made
        said = section >= 0
        base_n, turns, chars = int((section == 0).sum()), turns[said], chars[said]
        sums = np.concatenate([_poly(turns[:base_n])[:, -1], _poly(turns[base_n:])[:, -1]])
        made += 1
        return task + made - 1, conv, bool(len(section) > len(turns)), base_n, len(turns) - base_n, sums.tobytes(), turns[base_n : base_n + HEADS - 1].tobytes(), turns.tobytes(), chars.tobytes()

    for batch in batches:
        if not batch.num_rows:
            continue
        conv, section, chars = (batch.column(k).to_numpy() for k in (0, 1, 3))
        turns = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, 2)
        edge = np.flatnonzero(np.diff(conv)) + 1
        rows = []
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(conv)], strict=True):
            own = (int(conv[a]), section[a:b], turns[a:b], chars[a:b])
            if held and held[0] == own[0]:
                own = (own[0], *(np.concatenate(x) for x in zip(held[1:], own[1:], strict=True)))
            elif held:
                rows.append(closed(*held))
            while len(own[1]) > piece:
                rows.append(closed(own[0], *(x[:piece] for x in own[1:])))
                own = (own[0], *(x[piece:] for x in own[1:]))
            held = own
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(closed(*held), kinds, strict=True)], names)


_CARRIED = "fid long, start long, c0 long, c1 long, skip int, last boolean"


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece, in order: the depth and polynomials before it, own turns it drops, and whether it is its conversation's last."""
    names, kinds = [x.split()[0] for x in _CARRIED.split(", ")], [*[pa.int64()] * 4, pa.int32(), pa.bool_()]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    conv, before, depth, h, total, waiting = None, 0, 0, 0, [0, 0], None
    for batch in batches:
        rows = []
        for c, fid, base_n, own_n, sums, heads in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if waiting:
                rows.append((*waiting, c != conv))
            if c != conv:
                conv, before, depth, h, total = c, 0, 0, head_turns(c), [0, 0]
            skip = min(own_n, max(0, h - before))
            waiting = (fid, depth, signed(total[0]), signed(total[1]), skip)
            parts, first = np.frombuffer(sums, np.uint64).tolist(), np.frombuffer(heads, np.uint64).reshape(-1, 2)[:skip]
            gone = _poly(first)[:, -1].tolist()
            to_base, to_own = pow(_BASE, depth, 1 << 64), pow(_BASE, depth + base_n - skip, 1 << 64)
            total = [(total[k] + to_base * parts[k] + to_own * (parts[2 + k] - gone[k])) & _MASK for k in (0, 1)]
            before += own_n
            depth += base_n + own_n - skip
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*waiting, True), kinds, strict=True)], names)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[Piece, bool, bool]]:
    """(piece, whether it opens its conversation, whether it is the last one) of placed rows."""
    get = {n: batch.column(n).to_pylist() for n in ("fid", "conv_id", "opens", "base_n", "start", "c0", "c1", "skip", "last", "turns", "chars")}
    for i in range(batch.num_rows):
        base_n, skip, start = get["base_n"][i], get["skip"][i], get["start"][i]
        turns, chars = np.frombuffer(get["turns"][i], np.uint64).reshape(-1, 2), np.frombuffer(get["chars"][i], np.int64)
        if skip:
            turns, chars = (np.concatenate([x[:base_n], x[base_n + skip :]]) for x in (turns, chars))
        sums = _poly(turns) * np.uint64(pow(_BASE, start, 1 << 64)) + np.array([[get["c0"][i] & _MASK], [get["c1"][i] & _MASK]], np.uint64)
        yield Piece(get["conv_id"][i], get["fid"][i], start, sums, chars), get["opens"][i], get["last"][i]


def _tries(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Expanded nodes of the task's tries, each of about ``held`` turns, and a row for the root."""
    trie, opened, least = ZFastTrie(), 0, None
    for batch in batches:
        own, size = [], 0
        for piece, opens, _ in _pieces(batch):
            own.append(piece)
            size += piece.end - piece.start + 1
            if opens:
                opened += 1
                least = min(least or (piece.conv, piece.fid), (piece.conv, piece.fid))
            if trie.turns + size > held:
                trie.insert(own)
                yield trie.expanded()
                trie, own, size = ZFastTrie(), [], 0
        trie.insert(own)
    yield trie.expanded()
    if opened:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (0, 0, 0, 0, 0, 0, *least, opened)], _EXPANDED_NAMES)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix at which each conversation ends."""
    for batch in batches:
        rows = [(p.end, *(int(p.sums[k, -1].view(np.int64)) for k in (0, 1)), p.conv) for p, _, last in _pieces(batch) if last]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [*KEY, "conv_id"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted (prefix, id) rows as comma-joined strings of up to ``PACK`` ids."""
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        ids = batch.column(3).to_numpy()
        edge = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
        rows = []
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)], strict=True):
            for at in range(a, b, PACK):
                own = ids[at : min(b, at + PACK)].tolist()
                rows.append((*keys[:, a].tolist(), own[0], ",".join(map(str, own))))
        if rows:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:4]), pa.array([r[4] for r in rows])], [*KEY, "conv_id", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of all ids of each prefix from its sorted strings."""
    held, state = None, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])

    for batch in batches:
        rows = []
        for *key, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if key == held:
                state.update(f",{ids}".encode())
                continue
            if held:
                rows.append((*held, state.hexdigest()))
            held, state = key, hashlib.sha256(ids.encode())
        if rows:
            yield batch_of(rows)
    if held:
        yield batch_of([(*held, state.hexdigest())])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each prefix of a piece, what the nodes of its conversation at this depth and below add to it."""
    names = [*KEY, "n_leaves", "saved_tokens"]
    for batch in batches:
        later = [batch.column(n).to_pylist() for n in ("later_leaves", "later_saved")]
        out: list[np.ndarray] = []
        for i, (piece, opens, _) in enumerate(_pieces(batch)):
            first = 0 if opens else 1  # depth 0 belongs to the piece that opens the conversation
            depth = np.arange(piece.start + first, piece.end + 1)
            if not len(depth):
                continue
            values = np.zeros((2, len(depth)), np.int64)
            own = batch.column("owned")[i]
            if own.is_valid and len(own.values):
                at = own.values.field("depth").to_numpy() - depth[0]
                values[0, at] = own.values.field("leaf").to_numpy()
                values[1, at] = own.values.field("saved").to_numpy()
            values = np.cumsum(values[:, ::-1], axis=1)[:, ::-1] + np.array([[later[0][i]], [later[1][i]]])
            rows = np.concatenate([depth[None], piece.sums[:, first:].view(np.int64), values])
            out.append(rows[:, (values != 0).any(axis=0)])
        if out:
            rows = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r)) for r in rows], names)


def prefix_trie(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = PIECE, held: int = HELD) -> DataFrame:
    """Every node of the trie of rebuilt conversations, a row each.

    A conversation c is rebuilt: the first h turns of the first one of its block (c - c % 100), h = crc32(c) % 6, then its own after its first h.
    Turns are ordered by turn (null first), then by MD5 of role and text; a null role or text is empty; repeated rows are turns of their own.
    Rows without a conversation id take no part; a conversation without rebuilt turns ends at the root; an empty table gives no row.
    Other columns are left out, whatever their names; texts of any length are read once, by the JVM, and travel as hashes and lengths.
    Columns: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Two prefixes are one node if depth and two 64-bit polynomials of MD5 halves agree: N prefixes are confused with a chance of N * N / 2 ** 129.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turn_key = F.unhex(F.md5(F.concat(F.md5(role.cast("binary")), text).cast("binary")))
    turns = rows.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), turn_key.alias("t"), F.length(text).cast("long").alias("chars")
    )
    turns = materialize(turns)
    order = ["conv_id", "section", "turn", "t"]
    dealt = _rebuilt(turns).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "section", "t", "chars")
    cut = materialize(dealt.mapInArrow(lambda batches: _cut(batches, piece), _PIECES))
    scalars = cut.select("conv_id", "fid", "base_n", "own_n", "sums", "heads").repartition("conv_id").sortWithinPartitions("conv_id", "fid")
    carried = scalars.mapInArrow(_carry, _CARRIED)
    placed = cut.drop("own_n", "sums", "heads").join(carried.hint("merge"), "fid")
    placed = materialize(placed.repartitionByRange("conv_id", "fid").sortWithinPartitions("conv_id", "fid"))

    found = placed.mapInArrow(lambda batches: _tries(batches, held), _EXPANDED)
    nodes = found.groupBy(*KEY).agg(
        F.min(F.struct("conv_id", "fid")).alias("own"), F.sum("n").alias("n_convs"), F.max("chars").alias("chars"), F.max("q0").alias("q0"), F.max("q1").alias("q1")
    )
    nodes = materialize(nodes)
    # a node counts one for its parent; both meet in one grouping
    up = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("q0").alias("p0"), F.col("q1").alias("p1"), F.lit(1).cast("long").alias("n_children"))
    both = nodes.unionByName(up, allowMissingColumns=True).groupBy(*KEY)
    named = both.agg(*(F.max(c).alias(c) for c in ("own", "n_convs", "chars", "q0", "q1")), F.coalesce(F.sum("n_children"), F.lit(0)).cast("long").alias("n_children"))
    named = materialize(named.select("*", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")))

    # at most one node for each depth of a piece, so at most PIECE + 1 of them
    owned = named.select(F.col("own.fid").alias("fid"), "depth", "leaf", "saved").groupBy("fid")
    owned = owned.agg(F.collect_list(F.struct("depth", "leaf", "saved")).alias("owned"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    valued = placed.join(owned.hint("merge"), "fid", "left")
    after = Window.partitionBy("conv_id").orderBy(F.desc("fid")).rowsBetween(Window.unboundedPreceding, -1)
    totals = valued.select("conv_id", "fid", F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
    later = totals.select("fid", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"later_{c}") for c in ("leaves", "saved")))
    below = valued.drop("leaves", "saved").join(later.hint("merge"), "fid").mapInArrow(_sums, "depth long, p0 long, p1 long, n_leaves long, saved_tokens long")

    ended = placed.filter("last").mapInArrow(_ends, "depth long, p0 long, p1 long, conv_id long")
    packed = ended.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_packed, "depth long, p0 long, p1 long, conv_id long, ids string")
    ends = packed.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").select(*KEY, "ids").mapInArrow(_digests, "depth long, p0 long, p1 long, ends_sha256 string")

    whole = named.drop("leaf", "saved", "chars").unionByName(below, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True).groupBy(*KEY)
    whole = whole.agg(
        F.max("own.conv_id").alias("conv_id"), *(F.max(c).alias(c) for c in ("n_convs", "n_children", "q0", "q1")), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256")
    )
    whole = materialize(whole)
    # the root has as many children as there are first turns: its id is a constant, and no join key
    root = whole.filter("depth = 0").select("conv_id").first()
    parents = whole.filter("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("p0").alias("q0"), F.col("p1").alias("q1"), F.col("conv_id").alias("parent_conv_id"))
    joined = whole.join(parents.hint("merge"), ["depth", "q0", "q1"], "left")
    parent = F.when(F.col("depth") == 1, F.lit(root.conv_id if root else None).cast("long")).otherwise(F.col("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


_CRC = "list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS UBIGINT))), lambda s, b: list_reduce(list_prepend(xor(s, b), [CAST(i AS UBIGINT) FOR i IN range(8)]), lambda u, v: xor(u >> 1, CAST(3988292384 AS UBIGINT) * (u & 1))))"
ORACLE_SQL = f"""
WITH o AS (
  SELECT conv_id, turn_key, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, turn_key) AS i
  FROM (SELECT conv_id, turn, md5(md5(coalesce(role, '')) || coalesce(text, '')) AS turn_key, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL)
),
c AS (SELECT conv_id, CAST(xor({_CRC.format("conv_id")}, 4294967295) % {HEADS} AS INTEGER) AS h FROM (SELECT DISTINCT conv_id FROM o)),
rebuilt AS (
  SELECT c.conv_id, 0 AS section, o.i, turn_key, chars FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % {BLOCK} AND o.i <= c.h
  UNION ALL SELECT c.conv_id, 1, o.i, turn_key, chars FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h
),
placed AS (SELECT conv_id, row_number() OVER w AS depth, md5(array_to_string(list(turn_key) OVER w, '')) AS name, chars FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY section, i)),
paths AS (SELECT conv_id, CAST(depth AS BIGINT) AS depth, name, chars FROM placed UNION ALL SELECT conv_id, 0, 'root', 0 FROM c),
lasts AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY 1),
nodes AS (SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM paths GROUP BY ALL),
parents AS (SELECT DISTINCT b.depth, b.name, a.name AS up FROM paths b JOIN paths a ON a.conv_id = b.conv_id AND a.depth = b.depth - 1),
children AS (SELECT depth - 1 AS depth, up AS name, count(*) AS n FROM parents GROUP BY ALL),
pairs AS (SELECT DISTINCT a.depth, a.name, b.depth AS e, b.name AS below FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT p.depth, p.name, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
         FROM pairs p JOIN nodes n ON n.depth = p.e AND n.name = p.below LEFT JOIN children k ON k.depth = p.e AND k.name = p.below GROUP BY ALL),
ends AS (SELECT depth, name, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS h FROM paths JOIN lasts USING (conv_id, depth) GROUP BY ALL)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s USING (depth, name) LEFT JOIN children k USING (depth, name) LEFT JOIN ends e USING (depth, name)
LEFT JOIN parents p ON p.depth = n.depth AND p.name = n.name LEFT JOIN nodes u ON u.depth = p.depth - 1 AND u.name = p.up
"""
