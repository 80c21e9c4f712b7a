"""Operator 3: near-duplicate passages by compact windows.

Elements are word shingles.  Under each of ``HASHES`` hash functions, the Cartesian
tree over a text's hashes gives compact windows (l, c, r): every subsequence
that starts in [l, c] and ends in [c, r] has its min-hash at c, so one row stands for
all of them.  Windows wide enough for a passage that share a min-hash with another
document are paired with the heads of their group, the pairs of all hash
functions are joined by interval, and places that ``MATCHES`` functions cover
are verified on the shingles themselves.  Then every pair of a group whose documents
these links leave apart is verified too, but for places that share too few shingles
with all such documents to be similar to any.

Texts stay in a bucketed table of blocks; what travels are min-hashes, windows and
the shingles of candidate passages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shuffles_freed, table
from .components import components
from .simhash import shingle_slices
from .substrings import PART_BYTES, _batch, write_blocks

SHINGLE = 5
#: Words of the shortest passage, least Jaccard similarity of its shingles.
WORDS, SIMILARITY = 50, 0.8
#: Hash functions, and how many must agree at a place before it is verified.  At similarity 0.8 three of eight agree in 99.9 % of cases.
HASHES, MATCHES = 8, 3
#: Rows of a min-hash group that are paired, all with all, at a time: a larger group is dealt over tasks by pairs of such slices.
TILE = 512
#: Pairs of windows of two documents up to which they are joined by interval; beyond it all of their places are one candidate region.
HITS = 1 << 22
#: Bytes of packed window pairs that are shuffled at a time, at least and as a share of the texts' bytes: beyond it the document pairs are dealt to rounds.
ROUND_BYTES, ROUND_SHARE = 64 << 20, 0.5
#: Candidate regions are widened to multiples of this many shingles, so that few differ.
GRID = 64
_POSITION = np.uint64((1 << 24) - 1)
_MIX = [np.uint64(k) for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15)]


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the hash's base and of its inverse, modulo 2 ** 64.  Kept by the process."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def slice_hashes(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices, each from two places of one running sum over the buffer."""
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    x = (total[starts + lengths] - total[starts]) * down[starts]
    x ^= lengths.astype(np.uint64) * _MIX[2]
    x ^= x >> np.uint64(31)
    x *= _MIX[0]
    return x ^ (x >> np.uint64(29))


def shingles(data: np.ndarray, ends: np.ndarray, chunk: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document) of all shingles of lower-cased texts, some texts at a time, whose working arrays are many times their size and stay in the processor's cache."""
    hashes, docs, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], 0
    while at < len(ends):
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + chunk, side="right")))
        buf, starts, lengths, doc = shingle_slices(data[base : ends[to - 1]], ends[at:to] - base, SHINGLE)
        hashes.append(slice_hashes(buf, starts, lengths))
        docs.append((doc + at).astype(np.int32))
        at = to
    return np.concatenate(hashes), np.concatenate(docs)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes under function ``k``."""
    x = (h ^ np.uint64((k + 1) * int(_MIX[2]) % 2**64)) * _MIX[0]
    x ^= x >> np.uint64(32)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(29))


def wide_starts(n: int, doc_starts: np.ndarray, width: int) -> np.ndarray:
    """Whether ``width`` places of one document start at each place."""
    change = np.zeros(n + 1, np.int8)
    ends = np.append(doc_starts[1:], n)
    long = ends - doc_starts >= width
    change[doc_starts[long]] = 1
    change[(ends - width + 1)[long]] -= 1
    return np.cumsum(change[:-1], dtype=np.int8) > 0


def window_minima(h: np.ndarray, k: int, valid: np.ndarray, width: int, segment: int = 1 << 16) -> np.ndarray:
    """Places that under function ``k`` are the least (by upper 40 bits, then leftmost) of ``width`` neighbours from a valid start: the compact windows of that width or more.

    Segments are small enough for the processor's cache.
    """
    found = [np.zeros(0, np.int64)]
    for s in range(0, len(h), segment):
        at = np.flatnonzero(valid[s : s + segment])
        if not len(at):
            continue
        n = int(at[-1]) + width
        low = mixed(h[s : s + n], k)
        low &= ~_POSITION
        low |= np.arange(n, dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        rest = width - span
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        places = (low[at] & _POSITION).astype(np.int64)
        found.append(places[np.diff(places, prepend=-1) != 0] + s)
    places = np.concatenate(found)  # a window's least place never lies before that of the window to its left
    return places[np.diff(places, prepend=-1) != 0]


def cartesian_bounds(places: np.ndarray, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(l, r) of each place of a block: up to the nearest smaller value of its document [start, end) on either side.

    These are the borders of the node's subtree in the document's Cartesian tree.  Parents are found for all
    nodes at once: a pointer to a neighbour that isn't smaller jumps to where that neighbour's own pointer leads.
    Any smaller value that bounds a wide window is the least of a wide window itself, so the chosen places suffice.
    """
    n = len(places)
    out = []
    for step in (-1, 1):
        to = np.arange(n) + step
        edge = np.flatnonzero(starts[:-1] != starts[1:]) if n else np.zeros(0, np.int64)
        to[edge if step > 0 else edge + 1] = -1  # beyond the document
        if n:
            to[-1 if step > 0 else 0] = -1
        todo = np.arange(n)
        while len(todo := todo[(to[todo] >= 0) & (values[to[todo]] > values[todo])]):
            to[todo] = to[to[todo]]
        out.append(to)
    left, right = out
    return np.where(left >= 0, places[left] + 1, starts), np.where(right >= 0, places[right] - 1, ends - 1)


def _block_text(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c: batch.column(c)[i].as_py()
    return np.frombuffer(get("data"), np.uint8), np.frombuffer(get("ends"), np.int64), np.frombuffer(get("ids"), np.int64)


def first_of_kind(h: np.ndarray, places: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    """The first of all places of a document whose ``width`` shingles around are the same, as those of a line that it repeats are."""
    up, down = powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    low, high = np.maximum(0, places - width // 2), np.minimum(len(h), places + width - width // 2)
    sign = (total[high] - total[low]) * down[low]
    order = np.lexsort((places, sign, docs))
    new = (np.diff(sign[order], prepend=~sign[order[:1]]) != 0) | (np.diff(docs[order], prepend=-1) != 0)
    return np.sort(order[new])


class Minima:
    """Min-hashes of a block: for each hash function the places of its wide compact windows."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, width: int):
        self.h, self.doc = shingles(data, ends)
        self.doc_starts = np.flatnonzero(np.diff(self.doc, prepend=-1))
        valid = wide_starts(len(self.h), self.doc_starts, width)
        self.places = [window_minima(self.h, k, valid, width) for k in range(HASHES)]
        self.values = [mixed(self.h[at], k) for k, at in enumerate(self.places)]

    def messages(self, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, distinct values, whether several documents have them) for each part that has any."""
        values, docs = np.concatenate(self.values), self.doc[np.concatenate(self.places)]
        part = (values & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
        order = np.lexsort((values, part))
        values, docs, part = values[order], docs[order], part[order]
        head = np.flatnonzero(np.diff(values, prepend=~values[:1]))
        if not len(head):
            return
        many = np.minimum.reduceat(docs, head) < np.maximum.reduceat(docs, head)
        values, part = values[head], part[head].astype(np.int64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
            yield int(part[a]), values[a:b], many[a:b]


def pair_up(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (first, other) of rows that share a value: each with the head of its group and with the first of those that also share the shingle
    before or after.

    A head is the row of smallest document, so a passage's many copies meet one document, whatever the hash function.
    These pairs connect most of what belongs together at a cost in proportion to the rows; ``tiles`` gives all that they leave apart.
    """
    first, other = [], []
    for side in ("after", "before", None):
        keys = (rows["id"], rows[side], rows["value"]) if side else (rows["id"], rows["value"])
        order = np.lexsort(keys)
        new = np.diff(rows["value"][order], prepend=~rows["value"][order[:1]]) != 0
        if side:
            inner = new | (np.diff(rows[side][order], prepend=rows[side][order[:1]]) != 0)
        else:
            inner = new
        heads = order[np.flatnonzero(inner)][np.cumsum(inner) - 1]
        first.append(heads)
        other.append(order)
        if side:  # heads of a value's contexts are chained, so the contexts stay connected
            at = np.flatnonzero(inner)
            link = ~new[at[1:]]
            first.append(order[at[:-1][link]])
            other.append(order[at[1:][link]])
    a, b = np.concatenate(first), np.concatenate(other)
    swap = rows["id"][a] > rows["id"][b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    keep = rows["id"][a] != rows["id"][b]
    code = np.unique(a[keep] * len(order) + b[keep])
    return code // len(order), code % len(order)


def tiles(value: np.ndarray, root: np.ndarray, size: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, other rows): slices whose pairs of one value and two roots are all such pairs, each once.  No other rows: the pairs are among the rows.

    Groups of a single root have none.  Small groups share a slice; a large one is cut, and each two of its slices meet.
    """
    order = np.lexsort((root, value))
    if not len(order):
        return
    none = order[:0]
    starts = np.flatnonzero(np.diff(value[order], prepend=~value[order[:1]]))
    ends = np.append(starts[1:], len(order))
    apart = root[order[starts]] != root[order[ends - 1]]
    held, n = [], 0
    for a, b in zip(starts[apart].tolist(), ends[apart].tolist(), strict=True):
        if b - a > size:
            cuts = [order[x : min(b, x + size)] for x in range(a, b, size)]
            for i, own in enumerate(cuts):
                if root[own[0]] != root[own[-1]]:
                    yield own, none
                for other in cuts[i + 1 :]:
                    if root[own[0]] != root[other[-1]]:
                        yield own, other
            continue
        held.append(order[a:b])
        n += b - a
        if n >= 8 * size:
            yield np.concatenate(held), none
            held, n = [], 0
    if held:
        yield np.concatenate(held), none


def tile_pairs(value: np.ndarray, root: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one value and two roots: of the first ``n`` rows with the others, or among themselves if they are all.  The rows are those of a tile, in its order."""
    if n < len(value):
        a, b = np.nonzero(root[:n, None] != root[None, n:])
        yield a, b + n
        return
    step = 1
    while step < n and len(at := np.flatnonzero(value[step:] == value[: n - step])):
        at = at[root[at] != root[at + step]]
        yield at, at + step
        step += 1


def members(rows: dict[str, np.ndarray], own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(order, starts, lengths, how many are of the first ``own`` rows): a tile's rows by value, root and document, and where those of one value and document lie."""
    later = np.arange(len(rows["value"])) >= own
    keys = (later, rows["value"], rows["root"], rows["id"], rows["block"], rows["place"])
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in keys])
    starts = np.flatnonzero(new)
    return order, starts, np.diff(np.append(starts, len(order))), int(np.count_nonzero(~later[order[starts]]))


def member_pairs(rows: dict[str, np.ndarray], own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, lengths, x, y): the members of a tile, and the pairs of them that share a value and have two roots, smaller id first.

    A pair stands for all pairs of its members' rows, of which there may be very many where a text goes on repeating itself.
    """
    order, starts, lengths, first = members(rows, own)
    head = order[starts]
    found = list(tile_pairs(rows["value"][head], rows["root"][head], first))
    x, y = (np.concatenate([np.zeros(0, np.int64), *part]) for part in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    ids = rows["id"][head]
    x, y = x[keep := ids[x] != ids[y]], y[keep]
    swap = ids[x] > ids[y]
    return order, starts, lengths, np.where(swap, y, x), np.where(swap, x, y)


def pack_windows(table_: np.ndarray) -> bytes:
    """Rows of 4-byte numbers; of more than some rows compressed differences."""
    if len(table_) <= 32:
        return b"\0" + table_.tobytes()
    return b"\1" + zlib.compress(np.diff(table_.T, axis=1, prepend=np.int32(0)).astype("<i4").tobytes(), 1)


def unpack_windows(raw: bytes, n_columns: int) -> np.ndarray:
    if raw[0] == 0:
        return np.frombuffer(raw, "<i4", offset=1).reshape(-1, n_columns).T.astype(np.int64)
    return np.cumsum(np.frombuffer(zlib.decompress(raw[1:]), "<i4").reshape(n_columns, -1), axis=1, dtype=np.int64)


def bundles(rows: dict[str, np.ndarray], order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple]:
    """(ids, blocks, places, bits of the hash functions, windows, other windows) of each pair of documents: its pairs of members are numbered, and windows of one number are paired all with all."""
    head = order[starts]
    keys = [rows[n][head][side] for n in ("id", "block", "place") for side in (x, y)]
    by_pair = np.lexsort((y, x, *keys[::-1]))
    x, y, keys = x[by_pair], y[by_pair], [k[by_pair] for k in keys]
    new = np.ones(len(x), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    cuts = np.flatnonzero(new)
    number = np.arange(len(x)) - (cuts[np.cumsum(new) - 1] if len(x) else 0)

    def flat(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, number of the pair of each, end of each pair's rows)."""
        n = lengths[side]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(starts[side], n)
        return order[at], np.repeat(number, n), ends

    (a, na, a_ends), (b, nb, b_ends) = flat(x), flat(y)
    a_table = np.stack([na, *(rows[n][a] for n in ("k", "l", "c", "r"))], axis=1).astype("<i4")
    b_table = np.stack([nb, rows["c"][b]], axis=1).astype("<i4")
    kinds = np.bitwise_or.reduceat(1 << rows["k"][head[x]].astype(np.int64), cuts) if len(x) else cuts
    last = [*(cuts[1:] - 1).tolist(), len(x) - 1]
    keys = [k[cuts].tolist() for k in keys]
    a_from = b_from = 0
    for *key, bits, a_to, b_to in zip(*keys, kinds.tolist(), a_ends[last].tolist() if len(x) else [], b_ends[last].tolist() if len(x) else [], strict=True):
        yield (*key, bits, pack_windows(a_table[a_from:a_to]), pack_windows(b_table[b_from:b_to]))
        a_from, b_from = a_to, b_to


def deepest(k: np.ndarray, l: np.ndarray, r: np.ndarray) -> int:
    """How many hash functions' windows [l, r] lie over one place, at the most."""
    if not len(k):
        return 0
    order = np.lexsort((l, k))
    base = k[order] << 40  # one function's windows after the other's, so what overlaps is merged for all at once
    low, reach = l[order] + base, np.maximum.accumulate(r[order] + base)
    new = np.concatenate([[True], low[1:] > reach[:-1]])
    end = np.append(new[1:], True)
    at = np.concatenate([low[new] - base[new], reach[end] - base[end] + 1])
    change = np.repeat([1, -1], len(at) // 2)
    return int(np.cumsum(change[np.lexsort((change, at))]).max())


def candidate_regions(windows: list[tuple[bytes, bytes]], width: int, matches: int) -> list[tuple[int, int, int, int]]:
    """Candidate regions of a document pair from its bundles of windows; these aren't joined where no place has windows of enough hash functions."""
    a, b, number = [], [], 0
    for own, others in windows:
        own, others = unpack_windows(own, 5), unpack_windows(others, 2)
        own[0] += number
        others[0] += number
        number = int(own[0, -1]) + 1
        a.append(own)
        b.append(others)
    (n, k, l, c, r), (n2, c2) = np.concatenate(a, axis=1), np.concatenate(b, axis=1)
    counts = np.bincount(n2, minlength=number)
    hits = counts[n]
    if hits.sum() > 64 and deepest(k, l, r) < matches:
        return []
    if hits.sum() > HITS:
        return [_region(c, c2, width)]
    starts = np.cumsum(counts) - counts
    i = np.repeat(np.arange(len(n)), hits)
    j = np.argsort(n2, kind="stable")[np.arange(len(i)) - np.repeat(np.cumsum(hits) - hits, hits) + starts[n[i]]]
    return covered(k[i], l[i], c[i], r[i], c2[j], width, matches)


def _region(c: np.ndarray, c2: np.ndarray, width: int) -> tuple[int, int, int, int]:
    return int(c.min()) - 2 * width, int(c.max()) + 2 * width + 1, int(c2.min()) - 2 * width, int(c2.max()) + 2 * width + 1


def covered(k: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray, c2: np.ndarray, width: int, matches: int) -> list[tuple[int, int, int, int]]:
    """Candidate regions of a document pair from its window pairs (k, l, c, r, c').

    Rows on close diagonals and near each other form a run; a run is a candidate where
    windows of ``matches`` hash functions lie over one place.
    """
    order = np.lexsort((k, c2, c))
    k, l, c, r, c2 = (x[order] for x in (k, l, c, r, c2))
    place, diagonal, out, todo = c.tolist(), (c2 - c).tolist(), [], list(range(len(c)))
    while todo:
        base, last, picked, rest = diagonal[todo[0]], place[todo[0]], [], []
        for n, i in enumerate(todo):
            if place[i] - last > 2 * width:
                rest += todo[n:]
                break
            if abs(diagonal[i] - base) <= width // 2:
                picked.append(i)
                base, last = diagonal[i], place[i]
            else:
                rest.append(i)
        if len(picked) >= matches and deepest(k[picked], l[picked], r[picked]) >= matches:
            out.append(_region(c[picked], c2[picked], width))
        todo = rest
    return out


def densest(match: np.ndarray, penalty: float) -> tuple[int, int]:
    """[start, end) of the stretch with the highest sum, a match counting 1 and a miss ``-penalty``."""
    total = np.concatenate([[0.0], np.cumsum(np.where(match, 1.0, -penalty))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end


def longest(match: np.ndarray, penalty: float) -> tuple[int, int]:
    """[start, end) of the longest stretch whose sum isn't negative, a match counting 1 and a miss ``-penalty``."""
    total = np.concatenate([[0.0], np.cumsum(np.where(match, 1.0, -penalty))])
    low = np.minimum.accumulate(total)  # falls, so the first start as low as an end is found by bisection
    start = np.searchsorted(-low, -(total + 1e-9), side="left")
    end = int(np.argmax(np.arange(len(total)) - start))
    return int(start[end]), end


def jaccard_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two stretches' distinct shingles."""
    x, y = np.unique(a), np.unique(b)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / max(1, len(x) + len(y) - common)


def coded_jaccard(a: np.ndarray, b: np.ndarray, n_values: int) -> float:
    """``jaccard_of`` for numbers below ``n_values``, without sorting."""
    x, y = np.zeros(n_values, bool), np.zeros(n_values, bool)
    x[a], y[b] = True, True
    common = np.count_nonzero(x & y)
    return common / max(1, np.count_nonzero(x) + np.count_nonzero(y) - common)


def repeats(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the same value before, or -1; place of it after, or the length) of each value."""
    order = np.argsort(a, kind="stable")
    same = a[order[1:]] == a[order[:-1]]
    before, after = np.full(len(a), -1), np.full(len(a), len(a))
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def long_stretches(weights: np.ndarray, width: int) -> list[tuple[int, int]]:
    """[start, end) of the zones that hold every stretch of at least ``width`` places with a sum of 0 or more."""
    total = np.concatenate([[0.0], np.cumsum(weights)])
    if len(weights) < width:
        return []
    best_from = np.maximum.accumulate(total[::-1])[::-1]  # falls, so the last end as high as a start is found by bisection
    starts = np.flatnonzero(best_from[width:] >= total[: len(total) - width] - 1e-9)
    if not len(starts):
        return []
    ends = len(total) - np.searchsorted(best_from[::-1], total[starts] - 1e-9, side="left") - 1
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] >= reach[:-1]])
    return list(zip(starts[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)].tolist(), strict=True))


def weighed(match: np.ndarray, before: np.ndarray, hit: float, miss: float) -> np.ndarray:
    """Upper bounds of what each place adds to a sum over distinct shingles: a miss that was met before may add nothing."""
    return np.where(match, hit, np.where(before >= 0, 0.0, -miss))


def searched(ca: np.ndarray, cb: np.ndarray, width: int, similarity: float) -> tuple[int, int, int, int] | None:
    """Stretches of ``width`` or more with that similarity, wherever there are any, of texts whose shingles are numbered.

    For stretches A and B, common - s * (B's distinct misses) >= s * (distinct of A) says that they are similar.
    Rectangles of A's (start, end) are halved as long as the best B for all that any A of the rectangle
    may hold reaches what the least A of it needs; what can't is passed over with all its stretches.
    """
    n_values = int(max(ca.max(), cb.max())) + 1
    in_a, in_b = within(ca, cb, n_values), within(cb, ca, n_values)
    (before_a, _), (before_b, _) = repeats(ca), repeats(cb)
    share = 2 * similarity / (1 + similarity)
    # each of the two is matched by ``similarity``, and one by ``share``
    if not any(long_stretches(weighed(m, x, 1 - share, share), width) for m, x in ((in_a, before_a), (in_b, before_b))):
        return None
    zones = long_stretches(weighed(in_b, before_b, 1 - similarity, similarity), width)
    if not zones:
        return None
    for z, z_end in long_stretches(weighed(in_a, before_a, 1 - similarity, similarity), width):
        part = ca[z:z_end]
        for k0, k1 in long_stretches(weighed(within(cb, part, n_values), before_b, 1 - similarity, similarity), width):
            if found := _pair_in(part, cb[k0:k1], n_values, width, similarity):
                return z + found[0], z + found[1], k0 + found[2], k0 + found[3]
    return None


def within(of: np.ndarray, among: np.ndarray, n_values: int) -> np.ndarray:
    """Whether each number is one of ``among``."""
    flag = np.zeros(n_values, bool)
    flag[among] = True
    return flag[of]


def _pair_in(a: np.ndarray, b: np.ndarray, n_values: int, width: int, similarity: float) -> tuple[int, int, int, int] | None:
    """Like ``searched``, for one zone of each text."""
    before_a, before_b = repeats(a)[0], repeats(b)[0]
    first, last = np.full(n_values, len(a)), np.full(n_values, -1)
    last[a] = np.arange(len(a))
    first[a[::-1]] = np.arange(len(a))[::-1]
    first, last = first[b], last[b]  # where b's shingles are in a
    once = not ((before_a >= 0).any() or (before_b >= 0).any())
    in_b, at = within(a, b, n_values), np.arange(len(a))
    common = np.concatenate([[0], np.cumsum(in_b)])
    miss = np.where(before_b < 0, -similarity, 0.0)
    stack = [np.array([[0, len(a) - width, width, len(a)]])]
    while stack:
        r = stack.pop()
        i0, i1, e0, e1 = r[:, 0], np.minimum(r[:, 1], r[:, 3] - width), np.maximum(r[:, 2], r[:, 0] + width), r[:, 3]
        ok = (i1 >= i0) & (e1 >= e0)
        i0, i1, e0, e1 = i0[ok], i1[ok], e0[ok], e1[ok]
        if once:
            least, most = np.maximum(width, e0 - i1), common[e1] - common[i0]
        else:  # distinct shingles of what every A of a rectangle holds, common ones of what any holds
            least = ((at >= i1[:, None]) & (at < e0[:, None]) & (before_a < i1[:, None])).sum(axis=1)
            most = (in_b & (at >= i0[:, None]) & (at < e1[:, None]) & (before_a < i0[:, None])).sum(axis=1)
        ok = most >= similarity * least - 1e-9
        i0, i1, e0, e1, need = i0[ok], i1[ok], e0[ok], e1[ok], similarity * least[ok] - 1e-9
        if not len(i0):
            continue
        total = np.zeros((len(i0), len(b) + 1))
        np.cumsum(np.where((last >= i0[:, None]) & (first < e1[:, None]), 1.0, miss), axis=1, out=total[:, 1:])
        gain = (total[:, width:] - np.minimum.accumulate(total[:, : len(b) + 1 - width], axis=1)).max(axis=1)
        keep = gain >= need
        i0, i1, e0, e1, total, need = i0[keep], i1[keep], e0[keep], e1[keep], total[keep], need[keep]
        one = (i0 == i1) & (e0 == e1)
        good = np.ones(len(i0), bool)
        for row in range(len(i0)) if not once else np.flatnonzero(one).tolist():
            i, e = int(i0[row]), int(e1[row])
            if once:
                end = width + int(np.argmax(total[row, width:] - np.minimum.accumulate(total[row, : len(b) + 1 - width])))
                k = int(np.argmin(total[row, : end + 1 - width]))
            else:  # there are repeats, so the sums were but bounds
                top, k, end = best_stretch(within(b, a[i:e], n_values), before_b, width, similarity)
                good[row] = top >= need[row]
            if one[row] and good[row] and coded_jaccard(a[i:e], b[k:end], n_values) >= similarity:
                return i, e, k, end
        i0, i1, e0, e1 = (x[good & ~one] for x in (i0, i1, e0, e1))
        if len(i0):
            by_start = i1 - i0 >= e1 - e0
            mid_i, mid_e = (i0 + i1) // 2, (e0 + e1) // 2
            low = np.stack([i0, np.where(by_start, mid_i, i1), e0, np.where(by_start, e1, mid_e)], axis=1)
            high = np.stack([np.where(by_start, mid_i + 1, i0), i1, np.where(by_start, e0, mid_e + 1), e1], axis=1)
            halves, size = np.concatenate([low, high]), 128 if once else 16
            stack += [halves[x : x + size] for x in range(0, len(halves), size)]
    return None


def best_stretch(match: np.ndarray, before: np.ndarray, width: int, similarity: float) -> tuple[float, int, int]:
    """(sum, start, end) of the stretch of ``width`` or more with the highest sum over its distinct shingles, a match counting 1 and a miss ``-similarity``."""
    n = len(match)
    weight, at, best = np.where(match, np.float32(1), np.float32(-similarity)), np.arange(n), (-np.inf, 0, 0)
    rows = max(1, (1 << 18) // n)
    for s in range(0, n - width + 1, rows):
        k = np.arange(s, min(n - width + 1, s + rows))[:, None]
        sums = np.cumsum(np.where((before < k) & (at >= k), weight, np.float32(0)), axis=1)[:, width - 1 :]
        sums[at[width - 1 :] < k + width - 1] = -np.inf
        row, end = divmod(int(np.argmax(sums)), sums.shape[1])
        if sums[row, end] > best[0]:
            best = float(sums[row, end]) + 1e-4, s + row, end + width
    return best


def verify(a: np.ndarray, b: np.ndarray, width: int, similarity: float) -> tuple[int, int, int, int, float] | None:
    """Common stretches of two regions' shingles that are long and similar enough, if there are any: (start, end, start', end', Jaccard).

    The longest or the densest ones where they will do, else whichever a search finds.
    """
    if min(len(a), len(b)) < width:
        return None
    values, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca, cb, n = code[: len(a)], code[len(a) :], len(values)
    everywhere = within(ca, cb, n)
    if everywhere.sum() < similarity * width * (1 if n == len(a) + len(b) - everywhere.sum() else 0):
        return None
    share = 2 * similarity / (1 + similarity)
    penalty = share / (1 - share) if share < 1 else float(len(a) + len(b) + 1)
    for pick in (longest, densest):
        # both stretches are found in turn until neither changes
        sa, ea = pick(everywhere, penalty)
        seen = None
        for _ in range(6):
            sb, eb = pick(within(cb, ca[sa:ea], n), penalty)
            if min(ea - sa, eb - sb) >= width and (jaccard := coded_jaccard(ca[sa:ea], cb[sb:eb], n)) >= similarity:
                return sa, ea, sb, eb, jaccard
            if eb == sb or (sa, ea, sb, eb) == seen:
                break
            seen = (sa, ea, sb, eb)
            sa, ea = pick(within(ca, cb[sb:eb], n), penalty)
    if found := searched(ca, cb, width, similarity):
        sa, ea, sb, eb = found
        return sa, ea, sb, eb, coded_jaccard(ca[sa:ea], cb[sb:eb], n)
    return None


def rooted(ids: np.ndarray, known: list[dict] | None) -> np.ndarray:
    """The root of each id: itself, unless ``known`` names another."""
    if not known:
        return ids
    node, root = np.array(sorted((x["node"], x["root"]) for x in known), np.int64).T
    at = np.minimum(np.searchsorted(node, ids), len(node) - 1)
    return np.where(node[at] == ids, root[at], ids)


def around(h: np.ndarray, places: np.ndarray, reach: int) -> list[tuple[int, np.ndarray]]:
    """(start, shingles) of a text's pieces up to ``reach`` from any of the places."""
    places = np.unique(places)
    cuts = np.flatnonzero(np.diff(places) > 2 * reach) + 1
    starts = [(max(0, int(x[0]) - reach), int(x[-1]) + reach + 1) for x in np.split(places, cuts) if len(x)]
    return [(a, h[a:b]) for a, b in starts]


def zones(piece: np.ndarray, common: np.ndarray, width: int, similarity: float) -> list[tuple[int, int]]:
    """[start, end) of what holds every stretch of ``width`` or more that may be similar to one with only ``common`` shingles (sorted) of it: by an upper bound, so no link is lost."""
    if len(piece) < width or not len(common):
        return []
    match = common[np.minimum(np.searchsorted(common, piece), len(common) - 1)] == piece
    return long_stretches(weighed(match, repeats(piece)[0], 1 - similarity, similarity), width)


def passage_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a_id, b_id, a_start, a_end, b_start, b_end, similarity) between documents, a_id < b_id, ends exclusive, in words.

    An exact copy is linked, whole, to the document of smallest id with its text and to no other
    (starts 0, ends null, similarity 1).  Other links connect the documents that
    hold a near-duplicate passage of ``words`` words or more.  Two documents of a group of equal min-hashes are compared unless
    other links connect them already, so copies of a passage are linked to few others, not each to each.  A null text is an empty one, so it is a copy of any other empty
    text.  Rows without an id have no links; texts of too few words only those of copies.
    """
    spark = docs.sparkSession
    width = words - SHINGLE + 1
    blocks, _ = write_blocks(docs.filter(F.col(id_col).isNotNull()).select(id_col, text_col), id_col, text_col)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = blocks.agg(F.sum("size")).first()[0] or 0
    parts = max(tasks, -(-size // PART_BYTES))
    columns = ["block", "ids", "ends", "data"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "block", "doubles", "many", "digests", "ids", "at"]
        for batch in batches:
            for i in range(batch.num_rows):
                data, ends, ids = _block_text(batch, i)
                block = batch.column("block")[i].as_py()
                starts = [0, *ends[:-1].tolist()]
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(starts, ends.tolist(), strict=True)), "<u8").reshape(-1, 2)
                of_part: dict[int, list[bytes]] = {}
                to = (digests[:, 0] % np.uint64(parts)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
                    of_part[int(to[own[0]])] = [b"", b"", digests[own].tobytes(), ids[own].tobytes(), own.astype("<u4").tobytes()]
                for p, values, many in Minima(data, ends, width).messages(parts):
                    of_part.setdefault(p, [b""] * 5)[:2] = [values.tobytes(), np.packbits(many).tobytes()]
                rows = [(p, block, *x) for p, x in of_part.items()]
                yield _batch(names, rows, [pa.int32(), pa.int64(), *[pa.binary()] * 5])

    def answer(group: pa.Table) -> pa.Table:
        parse = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in group.column(c)]
        values = parse("doubles", np.uint64)
        sizes = [len(v) for v in values]
        many = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n).astype(bool) for x, n in zip(group.column("many"), sizes, strict=True)])
        distinct, inverse, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        shared = counts > 1  # a block sends a value once
        np.logical_or.at(shared, inverse, many)
        back = [v[x].tobytes() for v, x in zip(values, np.split(shared[inverse], np.cumsum(sizes)[:-1]), strict=True)]
        digests, ids = np.concatenate(parse("digests", "<u8")).reshape(-1, 2), np.concatenate(parse("ids", np.int64))
        order = np.lexsort((ids, digests[:, 1], digests[:, 0]))
        d = digests[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]).any(axis=1)])[: len(order)]
        first = np.empty(len(ids), np.int64)
        if len(ids):
            first[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        cuts = np.cumsum([len(x.as_py()) // 8 for x in group.column("ids")])
        return pa.table(
            {
                "block": group.column("block"),
                "part": group.column("part"),
                "shared": pa.array(back, pa.binary()),
                "at": group.column("at"),
                "first": pa.array([first[a:b].tobytes() for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], pa.binary()),
            }
        )

    sent = blocks.select(*columns).mapInArrow(send, "part int, block long, doubles binary, many binary, digests binary, ids binary, at binary")
    answers = sent.repartition(parts, "part").groupBy("part").applyInArrow(answer, "block long, part int, shared binary, at binary, first binary")
    answers = materialize(answers.groupBy("block").agg(F.collect_list(F.struct("shared", "at", "first")).alias("answers")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, ends, ids = _block_text(batch, i)
                block, found = batch.column("block")[i].as_py(), batch.column("answers")[i].as_py() or []
                copies = np.zeros(len(ids), bool)
                for a in found:
                    at, first = np.frombuffer(a["at"], "<u4"), np.frombuffer(a["first"], np.int64)
                    copies[at] = first < ids[at]
                m = Minima(data, ends, width)
                shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(a["shared"], np.uint64) for a in found)]))
                limits = np.append(m.doc_starts, len(m.h))
                out: dict[str, list] = {n: [] for n in ("value", "doc", "l", "c", "r", "k", "before", "after")}
                for k in range(HASHES):
                    places, values = m.places[k], m.values[k]
                    at = np.searchsorted(shared, values)
                    good = (shared[np.minimum(at, len(shared) - 1)] == values) & ~copies[m.doc[places]] if len(shared) else np.zeros(len(values), bool)
                    own = np.flatnonzero(good)
                    own = own[first_of_kind(m.h, places[own], m.doc[places[own]], width)]
                    if not len(own):
                        continue
                    which = np.searchsorted(m.doc_starts, places, side="right") - 1
                    start, end = limits[which], limits[which + 1]
                    left, right = cartesian_bounds(places, values, start, end)
                    c, start, end = places[own], start[own], end[own]
                    out["value"].append(values[own])
                    out["doc"].append(m.doc[c])
                    out["l"].append(left[own] - start)
                    out["r"].append(right[own] - start)
                    out["c"].append(c - start)
                    out["k"].append(np.full(len(own), k))
                    out["before"].append(np.where(c - SHINGLE >= start, m.h[np.maximum(c - SHINGLE, 0)], np.uint64(0)))
                    out["after"].append(np.where(c + SHINGLE < end, m.h[np.minimum(c + SHINGLE, len(m.h) - 1)], np.uint64(0)))
                if not out["value"]:
                    continue
                o = {n: np.concatenate(v) for n, v in out.items()}
                o |= {"place": o["doc"], "id": ids[o["doc"]]}
                yield _batch(["block", *kept], [(block, *(o[n].astype(t).tobytes() for n, t in kept.items()))], [pa.int64(), *[pa.binary()] * len(kept)])

    kept = {"value": "<u8", "id": "<i8", "place": "<i4", "l": "<i4", "c": "<i4", "r": "<i4", "k": "u1", "before": "<u4", "after": "<u4"}
    binary = lambda names: ", ".join(f"{n} binary" for n in names)
    answered = blocks.select(*columns).join(answers.hint("shuffle_hash"), "block", "left")
    found = materialize(answered.mapInArrow(windows, f"block long, {binary(kept)}"))
    held = kept | {"block": "<i8", "root": "<i8"}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of a block by part of their values, each with its document's root."""
        for batch in batches:
            for i in range(batch.num_rows):
                o = {n: np.frombuffer(batch.column(n)[i].as_py(), t) for n, t in kept.items()}
                if (keep := batch.column("keep")[i].as_py()) is not None:
                    low, high = np.frombuffer(keep, "<i8").reshape(-1, 2).T
                    at = (o["place"].astype(np.int64) << 32) + o["c"]
                    zone = np.searchsorted(low, at, side="right") - 1
                    own = (zone >= 0) & (at < high[zone])
                    o = {n: x[own] for n, x in o.items()}
                if not len(o["id"]):
                    continue
                o["block"], o["root"] = np.full(len(o["id"]), batch.column("block")[i].as_py(), np.int64), rooted(o["id"], batch.column("roots")[i].as_py())
                to = ((o["value"] & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                rows = [(int(to[w[0]]), *(o[n][w].tobytes() for n in held)) for w in np.split(order, np.flatnonzero(np.diff(to[order])) + 1)]
                yield _batch(["part", *held], rows, [pa.int32(), *[pa.binary()] * len(held)])

    ends_of = ["a_id", "b_id", "a_block", "b_block", "a_doc", "b_doc"]
    pair_schema = "a_id long, b_id long, a_block long, b_block long, a_doc int, b_doc int, kinds int, a_windows binary, b_windows binary"
    pair_names, pair_kinds = [x.split()[0] for x in pair_schema.split(", ")], [*[pa.int64()] * 4, *[pa.int32()] * 3, *[pa.binary()] * 2]

    def pair(group: pa.Table) -> pa.Table:
        g = {n: np.frombuffer(b"".join(x.as_py() for x in group.column(n)), t) for n, t in held.items()}
        each = np.arange(len(g["id"]))
        return pa.Table.from_batches([_batch(pair_names, list(bundles(g, each, each, np.ones_like(each), *pair_up(g))), pair_kinds)])

    def divided(group: pa.Table) -> pa.Table:
        """Documents and places of the windows whose values several roots have, by block."""
        g = {n: np.frombuffer(b"".join(x.as_py() for x in group.column(n)), held[n]) for n in ("value", "root", "block", "place", "c")}
        order = np.lexsort((g["root"], g["value"]))
        starts = np.flatnonzero(np.diff(g["value"][order], prepend=~g["value"][order[:1]]))
        ends = np.append(starts[1:], len(order))
        several = np.repeat(g["root"][order[starts]] != g["root"][order[ends - 1]], ends - starts)
        own = np.unique(np.stack([g[n][order[several]].astype(np.int64) for n in ("block", "place", "c")]), axis=1)
        rows = [(int(x[0, 0]), x[1].astype("<i4").tobytes(), x[2].astype("<i4").tobytes()) for x in np.split(own, np.flatnonzero(np.diff(own[0])) + 1, axis=1) if x.size]
        return pa.Table.from_batches([_batch(["block", "docs", "places"], rows, [pa.int64(), pa.binary(), pa.binary()])])

    def pieces(batch: pa.RecordBatch, i: int) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
        """(document, its shingles that a comparison may reach) of a block's documents that other roots' windows meet."""
        data, ends, _ = _block_text(batch, i)
        asked = batch.column("asked")[i].as_py()
        of, at = (np.concatenate([np.frombuffer(a[n], "<i4") for a in asked]) for n in ("docs", "places"))
        order = np.argsort(of, kind="stable")
        of, at = of[order], at[order]
        own, cuts = np.unique(of, return_index=True)
        h = wanted(data, ends, own.tolist())
        for d, places in zip(own.tolist(), np.split(at, cuts[1:]), strict=True):
            yield d, around(h[d], places, 2 * width + GRID)

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                of, root = [], []
                for d, found_ in pieces(batch, i):
                    of += [x for _, x in found_]
                    root.append(np.full(sum(len(x) for _, x in found_), ids[d], np.int64))
                h, root = np.concatenate(of), rooted(np.concatenate(root), batch.column("roots")[i].as_py())
                to = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((root, h, to))
                h, root, to = h[order], root[order], to[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (root[1:] != root[:-1])])[: len(h)]
                h, root, to = h[new], root[new], to[new]
                rows = [(int(to[w[0]]), batch.column("block")[i].as_py(), h[w].tobytes(), root[w].tobytes()) for w in np.split(np.arange(len(h)), np.flatnonzero(np.diff(to)) + 1) if len(w)]
                yield _batch(["part", "block", "shingles", "roots"], rows, [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    def meet(group: pa.Table) -> pa.Table:
        """Of each block's shingles those that several roots have."""
        own = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")]
        h, root = np.concatenate(own), np.frombuffer(b"".join(x.as_py() for x in group.column("roots")), np.int64)
        order = np.lexsort((root, h))
        starts = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]))
        ends = np.append(starts[1:], len(h))
        common = h[order[starts[root[order[starts]] != root[order[ends - 1]]]]]
        return pa.table({"block": group.column("block"), "common": pa.array([np.intersect1d(x, common).tobytes() for x in own], pa.binary())})

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                common = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in batch.column("common")[i].as_py()]))
                keep = [((d << 32) + start + a, (d << 32) + start + b) for d, found_ in pieces(batch, i) for start, x in found_ for a, b in zones(x, common, width, similarity)]
                if keep:
                    yield _batch(["block", "keep"], [(batch.column("block")[i].as_py(), np.array(keep, "<i8").tobytes())], [pa.int64(), pa.binary()])

    def tile(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(group))
        g = {n: np.frombuffer(b"".join(x.as_py() for x in whole.column(n)), t) for n, t in held.items()}
        for x, y in tiles(g["value"], g["root"]):
            own = {n: g[n][np.concatenate([x, y])] for n in held}
            _, _, lengths, i, j = member_pairs(own, len(x))
            if len(i):  # what a pair takes: its keys, and some bytes for each window of a long list
                size = int(len(i) * 100 + (np.minimum(lengths[i] + lengths[j], 1 << 24) * 4).sum())
                rows = [(len(x), size, *(c.tobytes() for c in own.values()))]
                yield _batch(["own", "pair_bytes", *held], rows, [pa.int32(), pa.int64(), *[pa.binary()] * len(held)])

    def pair_tiles(turn: int, rounds: int):
        """Pairs of windows of the tiles' document pairs, of one turn of all rounds."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    g = {n: np.frombuffer(batch.column(n)[i].as_py(), t) for n, t in held.items()}
                    order, starts, lengths, x, y = member_pairs(g, batch.column("own")[i].as_py())
                    if rounds > 1:
                        ids = g["id"][order[starts]].astype(np.uint64)
                        own = mixed(ids[x] ^ mixed(ids[y], 0), 1) % np.uint64(rounds) == np.uint64(turn)
                        x, y = x[own], y[own]
                    rows = []
                    for row in bundles(g, order, starts, lengths, x, y):
                        rows.append(row)
                        if len(rows) == 4096:
                            yield _batch(pair_names, rows, pair_kinds)
                            rows = []
                    if rows:
                        yield _batch(pair_names, rows, pair_kinds)

        return run

    region_schema = "a_id long, b_id long, a_block long, b_block long, a_doc int, b_doc int, a_lo int, a_hi int, b_lo int, b_hi int"

    def join_intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Regions of document pairs, whose bundles are neighbours and may go on from the batch before."""
        names = [*ends_of, "a_lo", "a_hi", "b_lo", "b_hi"]
        head, own, kinds = None, [], 0

        def regions_of() -> list[tuple]:
            # the first document's region is asked for once by all that share it
            found_ = candidate_regions(own, width, MATCHES) if kinds.bit_count() >= MATCHES else []
            return [(*head, max(0, lo) // GRID * GRID, -(-hi // GRID) * GRID, max(0, lo2), hi2) for lo, hi, lo2, hi2 in found_]

        for batch in batches:
            rows = []
            for *key, bits, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != head:
                    rows += regions_of()
                    head, own, kinds = key, [], 0
                own.append((a, b))
                kinds |= bits
            yield _batch(names, rows, [*[pa.int64()] * 4, *[pa.int32()] * 6])
        yield _batch(names, regions_of(), [*[pa.int64()] * 4, *[pa.int32()] * 6])

    def wanted(data: np.ndarray, ends: np.ndarray, docs_: list[int]) -> dict[int, np.ndarray]:
        """Shingles of some of a block's documents."""
        starts = np.concatenate([[0], ends[:-1]])
        parts_ = [data[starts[d] : ends[d]] for d in docs_]
        h, doc = shingles(np.concatenate(parts_), np.cumsum([len(p) for p in parts_]))
        cuts = np.searchsorted(doc, np.arange(len(docs_) + 1))
        return {d: h[cuts[j] : cuts[j + 1]] for j, d in enumerate(docs_)}

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a_block", "a_doc", "a_lo", "a_hi", "content"]
        for batch in batches:
            for i in range(batch.num_rows):
                data, ends, _ = _block_text(batch, i)
                asked, block = batch.column("asked")[i].as_py(), batch.column("block")[i].as_py()
                h = wanted(data, ends, sorted({a["a_doc"] for a in asked}))
                rows = [(block, a["a_doc"], a["a_lo"], a["a_hi"], h[a["a_doc"]][a["a_lo"] : a["a_hi"]].tobytes()) for a in asked]
                yield _batch(names, rows, [pa.int64(), *[pa.int32()] * 3, pa.binary()])

    names, kinds = ["a_id", "b_id", "a_start", "a_end", "b_start", "b_end", "similarity"], [*[pa.int64()] * 6, pa.float64()]
    link_schema = "a_id long, b_id long, a_start long, a_end long, b_start long, b_end long, similarity double"

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, rows = np.frombuffer(batch.column("ids")[i].as_py(), np.int64), []
                for a in batch.column("answers")[i].as_py():
                    for at, first in zip(np.frombuffer(a["at"], "<u4").tolist(), np.frombuffer(a["first"], np.int64).tolist(), strict=True):
                        if first < ids[at]:
                            rows.append((first, int(ids[at]), 0, None, 0, None, 1.0))
                yield _batch(names, rows, kinds)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, ends, _ = _block_text(batch, i)
                rows = []
                jobs = batch.column("jobs")[i].as_py()
                h = wanted(data, ends, sorted({m["b_doc"] for j in jobs for m in j["members"]}))
                for j in jobs:
                    a, more = np.frombuffer(j["content"], np.uint64), SHINGLE - 1
                    for m in j["members"]:
                        if ok := verify(a, h[m["b_doc"]][m["b_lo"] : m["b_hi"]], width, similarity):
                            sa, ea, sb, eb, jaccard = ok
                            rows.append((m["a_id"], m["b_id"], j["a_lo"] + sa, j["a_lo"] + ea + more, m["b_lo"] + sb, m["b_lo"] + eb + more, jaccard))
                yield _batch(names, rows, kinds)

    def regions_of(pairs: DataFrame) -> DataFrame:
        """Candidate regions among pairs of windows; a document pair's bundles are read as a stream, so nothing is held for all pairs."""
        dealt = pairs.repartition(*ends_of).sortWithinPartitions(*ends_of)
        return materialize(dealt.mapInArrow(join_intervals, region_schema))

    def verified(regions: DataFrame) -> DataFrame:
        """Links among the regions of document pairs."""
        key = ["a_block", "a_doc", "a_lo", "a_hi"]
        asked = regions.select(*key).distinct().groupBy(F.col("a_block").alias("block")).agg(F.collect_list(F.struct("a_doc", "a_lo", "a_hi")).alias("asked"))
        contents = blocks.select(*columns).join(asked.hint("shuffle_hash"), "block")
        contents = materialize(contents.mapInArrow(fetch, "a_block long, a_doc int, a_lo int, a_hi int, content binary"))
        # a region goes once to each block that compares it, however many documents there do
        members = materialize(regions.groupBy(*key, "b_block").agg(F.collect_list(F.struct("a_id", "b_id", "b_doc", "b_lo", "b_hi")).alias("members")))
        filled = materialize(members.join(contents.hint("merge"), key))
        jobs = filled.groupBy(F.col("b_block").alias("block")).agg(F.collect_list(F.struct("a_lo", "content", "members")).alias("jobs"))
        full = blocks.select(*columns).join(jobs.hint("shuffle_hash"), "block")
        return materialize(full.mapInArrow(check, link_schema))

    def parted(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(deal, f"part int, {binary(held)}").repartition(parts, "part").groupBy("part")

    unknown, every = F.lit(None).cast("array<struct<node: long, root: long>>").alias("roots"), F.lit(None).cast("binary").alias("keep")
    regions = regions_of(parted(found.select("*", unknown, every)).applyInArrow(pair, pair_schema))
    links = verified(regions)
    # what those links connect needs no other; every pair of a group that they leave apart is compared
    joined = components(links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    placed = regions.select(F.col("a_block").alias("block"), F.col("a_id").alias("node")).union(regions.select("b_block", "b_id")).distinct()
    roots = materialize(placed.join(materialize(joined).hint("merge"), "node").groupBy("block").agg(F.collect_list(F.struct("node", "root")).alias("roots")))
    known = found.join(roots.hint("shuffle_hash"), "block", "left")
    # but for windows whose least shingle is in no stretch that can be similar to any, as in a line that many have: too few shingles there are in documents of other roots
    met = parted(known.select("*", every)).applyInArrow(divided, "block long, docs binary, places binary")
    met = materialize(met.groupBy("block").agg(F.collect_list(F.struct("docs", "places")).alias("asked")))
    open_ = blocks.select(*columns).join(met.hint("shuffle_hash"), "block")
    offered = open_.join(roots.hint("shuffle_hash"), "block", "left").mapInArrow(offer, "part int, block long, shingles binary, roots binary")
    common = offered.repartition(parts, "part").groupBy("part").applyInArrow(meet, "block long, common binary")
    common = materialize(common.groupBy("block").agg(F.collect_list("common").alias("common")))
    kept_zones = materialize(open_.join(common.hint("shuffle_hash"), "block").mapInArrow(promising, "block long, keep binary"))
    apart = materialize(parted(known.join(kept_zones.hint("shuffle_hash"), "block")).applyInArrow(tile, f"own int, pair_bytes long, {binary(held)}"))
    # pairs grow with the square of a group: what is shuffled at a time stays in proportion to the texts
    rounds = max(1, -(-(apart.agg(F.sum("pair_bytes")).first()[0] or 0) // max(ROUND_BYTES, int(ROUND_SHARE * size))))
    turns = [regions_of(apart.drop("pair_bytes").repartition(parts).mapInArrow(pair_tiles(turn, rounds), pair_schema)) for turn in range(rounds)]
    rest = verified(reduce(DataFrame.union, turns))
    same = blocks.select("block", "ids").join(answers.hint("shuffle_hash"), "block").mapInArrow(copies, link_schema)
    return links.union(rest).union(same)


def passage_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest id reachable over links of passages or copies), n_links of every row.

    n_links counts the documents that ``passage_links`` links it with: 0 if it is alone in its class, else enough to connect it, not each to each.  A row without an id has a null class; rows of one id share a class.
    """
    with shuffles_freed(docs.sparkSession):
        links = materialize(passage_links(docs, id_col, text_col, words, similarity).select("a_id", "b_id").filter("a_id <> b_id").distinct())
        roots = components(links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
        ends = links.select(F.col("a_id").alias("node"), "b_id").union(links.select("b_id", "a_id"))
        counts = ends.groupBy("node").agg(F.count("*").alias("n_links"))
        known = materialize(counts.join(roots.hint("merge"), "node"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    joined = ids.join(known.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_classes(table(spark, sf_dir, "documents"))
