from __future__ import annotations

import hashlib
import os
import random
from functools import reduce

import numpy as np
import pytest
import xxhash

from paperloom.llm import passages, simhash, substrings
from paperloom.llm.components import components

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def reachable(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 230)] + [(1, 1), (3, 2), (2, 3), (2, 4)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = reachable({x for p in links for x in p}, links)
    assert found == {k: v for k, v in want.items() if k != 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    if not grams:
        return 0
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


ODD = [None, "", "  \n\t", "One", "one TWO", "É é x ñ", "a  b\r\nc", " lead and trail ", "x" * 500 + " y z", "日本 語 の", "same same same same same same"]


def test_simhash_groups_are_brute_force_s(spark, docs):
    base = prose(300, 1).split()
    texts = [*ODD, *(prose(40, s) for s in range(20)), *(" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, 300, 12)), prose(30, 3), prose(30, 3)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    table = docs([*rows, (None, "without id"), (4, None)]).selectExpr("*", "1 AS fp", "2 AS root")
    got = [r for r in simhash.near_groups(table).collect()]
    assert len(got) == len(rows) + 2
    prints = {i: fingerprint(t) for i, t in rows}
    prints[4] = 0 if rows[1][1] == "" else prints[4]
    ids = sorted(prints)
    linked = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = reachable(ids, linked)
    for r in got:
        if r.doc_id is not None and r.doc_id != 4:
            assert r.fingerprint == f"{prints[r.doc_id]:016x}", r
            assert r.component_id == want[r.doc_id]
        if r.doc_id is None:
            assert r.component_id is None
    assert len({want[i] for i in ids}) < len(ids) - 10


def test_simhash_of_nothing(spark, docs):
    assert simhash.near_groups(docs([])).count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_tiles_connect_all_close_pairs(same):
    r = np.random.default_rng(3)
    a = r.integers(0, 2**63, 400, dtype=np.uint64)
    a[200:] = a[:200] ^ (np.uint64(1) << r.integers(0, 63, 200, dtype=np.uint64))
    a[300:] = a[0] ^ np.uint64(1) ^ (np.uint64(1) << r.integers(5, 40, 100, dtype=np.uint64))  # a dense group
    a = np.unique(a)
    b = a if same else np.unique(a[::2] ^ np.uint64(6))
    x, y = simhash.tile_links(a, b)
    nodes = {int(v) for v in (*a, *b)}
    near = {(int(p), int(q)) for p in a for q in b if p != q and int(p ^ q).bit_count() <= 3}
    got, want = reachable(nodes, zip(map(int, x), map(int, y), strict=True)), reachable(nodes, near)
    assert all(got[p] == got[q] for p, q in near)
    assert len(set(got.values())) == len(set(want.values()))


def test_tiles_by_cells_agree(monkeypatch):
    r = np.random.default_rng(4)
    a = np.unique(np.concatenate([r.integers(0, 2**63, 2500, dtype=np.uint64)] * 2) ^ np.repeat(np.array([0, 5], np.uint64), 2500))
    assert len(a) ** 2 > 1 << 22  # goes by cells
    x, y = simhash.tile_links(a, a)
    nodes = set(map(int, a))
    near = [(int(a[i]), int(a[j])) for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3), strict=True) if i < j]
    assert reachable(nodes, zip(map(int, x), map(int, y), strict=True)).keys() == nodes
    got, want = reachable(nodes, zip(map(int, x), map(int, y), strict=True)), reachable(nodes, near)
    assert len(set(got.values())) == len(set(want.values())) and all(got[p] == got[q] for p, q in near)


def test_many_tiles(spark, docs):
    texts = [prose(12, s % 37) for s in range(150)]
    prints = simhash.fingerprints(docs(list(enumerate(texts)))).select("fp").distinct()
    few = {tuple(sorted((r.a, r.b))) for r in simhash.near_links(prints, tile=4).collect()}
    one = {tuple(sorted((r.a, r.b))) for r in simhash.near_links(prints).collect()}
    nodes = {x for p in few | one for x in p}
    assert {k: v for k, v in reachable(nodes, few).items()}.keys() == reachable(nodes, one).keys()
    assert len(set(reachable(nodes, few).values())) == len(set(reachable(nodes, one).values()))


def cut(rows):
    seen, out = set(), {}
    groups = {}
    for key, i, text in rows:
        groups.setdefault(2**63 - 1 if i is None else i, []).append((key, (text or "").encode()))
    for i in sorted(groups):
        fresh = set()
        for key, b in groups[i]:
            gone = np.zeros(len(b), bool)
            own = [b[k : k + 50] for k in range(len(b) - 49)]
            for k, s in enumerate(own):
                if s in seen:
                    gone[k : k + 50] = True
            fresh |= set(own)
            edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2).tolist()
            out[key] = (np.frombuffer(b, np.uint8)[~gone].tobytes(), edges)
        seen |= fresh
    return out


@pytest.mark.parametrize(("block", "hot"), [(500, 4096), (8 << 20, 4096), (500, 1), (8 << 20, 1), (2000, 6)])
def test_repeats_are_cut_as_by_brute_force(spark, monkeypatch, block, hot):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "HOT_CONTENTS", hot)
    shared, line = prose(30, 9), "license line that many documents carry along, word for word, to their very end."
    texts = [None, "", "short", "x" * 49, "x" * 50, "x" * 400, "ab" * 300, line, line, "é" * 60, "é" * 61, shared, shared[:200], "z" + shared[20:150] + "q"]
    for s in range(25):
        own = prose(60, 100 + s)
        k = rng.randint(0, len(own))
        texts.append(own[:k] + line + own[k:] + (shared[s : s + 49 + s] if s % 3 else ""))
    texts += [texts[-1], texts[-2] + " more", prose(60, 100)]
    rows = [(n, (n * 7) % 41 if n % 10 else None, t) for n, t in enumerate(texts)]
    table = spark.createDataFrame([(i, t, n) for n, i, t in rows], "doc_id long, text string, block long")
    got = {r["block"]: (bytes(r.kept), r.spans) for r in substrings.deduplicate(table).collect()}
    want = cut(rows)
    assert got.keys() == want.keys()
    for n in want:
        assert got[n] == want[n], (n, texts[n])


@pytest.mark.parametrize("block", [500, 8 << 20])
def test_repeats_within_a_document_are_cut_each_time(spark, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    rows, r = [], random.Random(21)
    for n in range(12):
        p = prose(40, 500 + n)[: r.randint(50, 140)]
        piece = prose(12, 600 + n) + p + prose(12, 700 + n)
        rows += [(4 * n, 2 * n, prose(20, 800 + n) + p + prose(20, 900 + n)), (4 * n + 1, 2 * n + 1, f"{piece} {prose(9, n)} {piece}")]
        rows += [(4 * n + 2, 2 * n + 1, piece + " and more"), (4 * n + 3, 90 + n, piece)]  # a row of the same id, and one of a larger
    table = spark.createDataFrame([(i, t, n) for n, i, t in rows], "doc_id long, text string, block long")
    got = {x["block"]: (bytes(x.kept), x.spans) for x in substrings.deduplicate(table).collect()}
    want = cut(rows)
    assert got == want
    assert all(len(want[4 * n + 1][1]) == 2 for n in range(12))


def test_longest_previous_factors_are_brute_force_s():
    r = random.Random(6)
    for letters in ("ab", "abcdefgh"):
        texts = ["".join(r.choice(letters) for _ in range(r.randint(50, 90))) for _ in range(14)]
        texts += [texts[0][5:60], texts[3], "a" * 55, "a" * 60]
        places = [(d, k) for d, t in enumerate(texts) for k in range(len(t) - 49)]
        base = np.cumsum([0, *map(len, texts)])
        doc = np.array([(d * 5) % 9 for d, _ in places])  # some documents of one id
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        lanes = substrings.window_lanes(data, np.array([base[d] + k for d, k in places]))
        got = substrings.previous_factors(lanes, doc)
        own = [texts[d][k : k + 50] for d, k in places]
        for i, w in enumerate(own):
            want = max((len(os.path.commonprefix([w, x])) for j, x in enumerate(own) if doc[j] < doc[i]), default=0)
            assert got[i] == want
        least = substrings.previous_factors(lanes, doc, 50)
        assert ((least >= 50) == (got >= 50)).all()
    none = [np.zeros(0, np.uint64)] * 7
    assert len(substrings.previous_factors(none, np.zeros(0, np.int64))) == 0


def test_no_table_is_left_in_the_catalog(spark, docs):
    substrings.deduplicate(docs([(1, prose(40, 1)), (2, prose(40, 1))])).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


def test_anchors_over_segments(monkeypatch):
    data = np.frombuffer((prose(400, 2)).encode(), np.uint8)
    ends = np.array([700, len(data)])
    whole = substrings.anchors(data, ends)
    monkeypatch.setattr(substrings, "SEGMENT", 300)
    parts = substrings.anchors(data, ends)

    def windows(a):
        return {(int(p), int(c)) for c, x, y in zip(a["c"], a["p1"], a["p2"], strict=True) for p in range(x, y + 1)}

    assert windows(whole) == windows(parts)
    assert {p for p, _ in windows(whole)} == {*range(0, 651), *range(700, len(data) - 49)}


def test_no_documents_to_cut(spark, docs):
    assert substrings.deduplicate(docs([])).count() == 0


def test_cartesian_bounds_are_the_nearest_smaller():
    r = random.Random(1)
    for documents in ([60], [1, 30, 7, 22], [2, 2]):
        values = r.sample(range(1000), sum(documents))
        limits = [sum(documents[:i]) for i in range(len(documents) + 1)]
        starts, ends = (np.repeat(x, documents) for x in (limits[:-1], limits[1:]))
        left, right = passages.cartesian_bounds(np.arange(len(values)), np.array(values), starts, ends)
        for i, v in enumerate(values):
            assert left[i] == max([j + 1 for j in range(starts[i], i) if values[j] < v], default=starts[i])
            assert right[i] == min([j - 1 for j in range(i + 1, ends[i]) if values[j] < v], default=ends[i] - 1)
    none = np.zeros(0, np.int64)
    assert [len(x) for x in passages.cartesian_bounds(none, none, none, none)] == [0, 0]


def test_window_minima_are_the_minima_of_windows():
    h = np.random.default_rng(2).integers(0, 2**63, 500, dtype=np.uint64)
    v = passages.mixed(h, 3)
    starts = np.array([0, 180, 190])
    want = set()
    for a, b in ((0, 180), (180, 190), (190, 500)):
        want |= {p + int(np.argmin(v[p : p + 20])) for p in range(a, b - 19)}
    assert set(passages.window_minima(h, 3, passages.wide_starts(500, starts, 20), 20, 64).tolist()) == want


def test_passages_link_their_documents(spark, docs):
    passage, other = prose(70, 11), prose(90, 12)
    edited = other.split()
    edited[30] = "changed"
    rows = [(i, prose(80, 200 + i) + " " + passage + " " + prose(40, 300 + i)) for i in range(10, 30)]  # one passage in many documents
    rows += [(40, prose(60, 41) + " " + other), (41, " ".join(edited) + " " + prose(50, 42)), (50, prose(100, 50)), (51, prose(100, 50)), (52, prose(100, 50))]
    rows += [(i, prose(120, 400 + i)) for i in range(60, 80)]  # nothing in common
    rows += [(90, None), (91, ""), (92, "few words"), (93, passage[:100])]
    table = docs([*rows, (None, passage)])
    got = {r.doc_id: r for r in passages.passage_classes(table).collect()}
    assert len(got) == len(rows) + 1
    assert {got[i].class_id for i in range(10, 30)} == {10}
    assert got[40].class_id == got[41].class_id == 40
    assert {got[i].class_id for i in (50, 51, 52)} == {50}
    assert {i: (got[i].class_id, got[i].n_links) for i in (*range(60, 80), 92, 93)} == {i: (i, 0) for i in (*range(60, 80), 92, 93)}
    assert got[91].class_id == got[90].class_id == 90  # a null text is an empty one
    assert got[None].class_id is None
    links = passages.passage_links(table).collect()
    found = next(x for x in links if (x.a_id, x.b_id) == (40, 41))
    assert found.similarity >= 0.8 and found.a_start >= 55 and found.a_end - found.a_start >= 50
    assert len(links) < 200  # not all pairs of the twenty copies of a passage, nor near it


def similar_stretches(a, b, width, similarity):
    """Whether any two stretches are long and similar enough, by trying all."""
    cuts = [[set(x[i:j]) for i in range(len(x)) for j in range(i + width, len(x) + 1)] for x in (a.tolist(), b.tolist())]
    return any(len(x & y) / len(x | y) >= similarity for x in cuts[0] for y in cuts[1])


def test_an_edit_anywhere_keeps_a_passage():
    width = passages.WORDS - passages.SHINGLE + 1
    for words in range(50, 101):
        n, lost = words - passages.SHINGLE + 1, []
        for at in range(words):
            a, b = np.arange(1000, 1000 + n, dtype=np.uint64), np.arange(1000, 1000 + n, dtype=np.uint64)
            b[max(0, at - passages.SHINGLE + 1) : at + 1] += np.uint64(10**6)
            a, b = np.concatenate([np.arange(20, dtype=np.uint64), a]), np.concatenate([b, np.arange(30, 70, dtype=np.uint64)])
            whole = passages.jaccard_of(a[20:], b[:n]) >= passages.SIMILARITY
            found = passages.verify(a, b, width, passages.SIMILARITY)
            if found:
                sa, ea, sb, eb, jaccard = found
                assert min(ea - sa, eb - sb) >= width and jaccard == passages.jaccard_of(a[sa:ea], b[sb:eb]) >= passages.SIMILARITY
            elif whole:
                lost.append(at)
        assert not lost, (words, lost)


def test_verified_as_by_brute_force():
    r, yes = random.Random(8), 0
    for turn in range(600):
        letters = r.choice((3, 8, 40))
        a = [r.randrange(letters) for _ in range(r.randint(4, 15))]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 2)] = [r.randrange(letters) + (50 if r.random() < 0.5 else 0) for _ in range(r.randint(0, 2))]
        k = r.randint(0, len(b)) if turn % 3 == 0 else 0
        a, b = np.array(a, np.uint64), np.array(b[k:] + b[:k], np.uint64)
        want = similar_stretches(a, b, 6, 0.75)
        assert (passages.verify(a, b, 6, 0.75) is not None) == want, (a, b)
        yes += want
    assert 100 < yes < 500


def members(h, width, size):
    """All stretches of ``width`` or more, as rows over the numbered shingles."""
    n, out = len(h), []
    for i in range(n):
        for j in range(i + width, n + 1):
            row = np.zeros(size, np.float32)
            row[h[i:j]] = 1
            out.append(row)
    return np.array(out).reshape(-1, size)


def test_recall_of_planted_passages_against_brute_force(spark, docs):
    r, rows, true = random.Random(33), [], set()
    width = passages.WORDS - passages.SHINGLE + 1
    for n in range(90):
        p = prose(r.randint(50, 68), 5000 + n).split()
        q = list(p)
        for _ in range(n % 4):  # changed, left out or put in
            at = r.randrange(len(q))
            q[at : at + r.randint(0, 1)] = [f"edit{n}"] * r.randint(0, 1)
        rows += [(2 * n, f"{prose(30, 6000 + n)} {' '.join(p)} {prose(20, 6100 + n)}"), (2 * n + 1, f"{prose(25, 6200 + n)} {' '.join(q)}")]
        a, b = ([" ".join(w[i : i + 5]) for i in range(len(w) - 4)] for w in (p, q))
        number = {x: i for i, x in enumerate(sorted({*a, *b}))}
        a, b = (np.array([number[x] for x in w]) for w in (a, b))
        size = int(max(a.max(), b.max())) + 1
        x, y = (members(w, width, size) for w in (a, b))
        common = x @ y.T
        if len(x) and len(y) and (common / (x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :] - common)).max() >= passages.SIMILARITY - 1e-6:
            true.add((2 * n, 2 * n + 1))
    found = {(x.a_id, x.b_id) for x in passages.passage_links(docs(rows)).collect()}
    assert len(true) > 50
    assert len(found & true) / len(true) >= 0.98, true - found
    assert all(b == a + 1 for a, b in found)


def similar_stretches(p, q, width):
    """Whether two word lists hold stretches of ``width`` or more shingles at the least similarity, by trying all of them."""
    a, b = ([" ".join(w[i : i + 5]) for i in range(len(w) - 4)] for w in (p, q))
    number = {x: i for i, x in enumerate(sorted({*a, *b}))}
    x, y = (members(np.array([number[v] for v in w], int), width, max(1, len(number))) for w in (a, b))
    if not len(x) or not len(y):
        return False
    common = x @ y.T
    return (common / (x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :] - common)).max() >= passages.SIMILARITY - 1e-6


@pytest.mark.parametrize("decoys", [[(0, 42), (6, 48), (12, 54)], [(k, k + 42) for k in range(0, 13, 2)] * 2])
def test_copies_meet_past_holders_of_parts(spark, docs, decoys):
    """Two documents hold a passage whole; others of smaller id hold parts below the threshold."""
    rows, groups = [], 100
    for g in range(groups):
        p = prose(54, 20_000 + g).split()
        parts = [" ".join(p[a:b]) for a, b in decoys] + [" ".join(p)] * 2
        rows += [(100 * g + i, f"{prose(30, 30_000 + 100 * g + i)} {x} {prose(20, 60_000 + 100 * g + i)}") for i, x in enumerate(parts)]
    got = {r.doc_id: r.class_id for r in passages.passage_classes(docs(rows)).collect()}
    n = len(decoys)
    assert sum(got[100 * g + n] == got[100 * g + n + 1] for g in range(groups)) == groups


def test_classes_of_drifting_families_against_brute_force(spark, docs):
    """Passages drift from member to member, so a class hangs together by some pairs alone; ids are dealt at random."""
    r, rows, true = random.Random(8), [], []
    width = passages.WORDS - passages.SHINGLE + 1
    ids = r.sample(range(10_000), 240)
    for family in range(20):
        p, own = prose(58, 40_000 + family).split(), []
        for _ in range(12):
            own.append((ids.pop(), list(p)))
            p[r.randrange(len(p))] = f"edit{r.random()}"
        rows += [(i, f"{prose(30, 41_000 + i)} {' '.join(w)} {prose(25, 52_000 + i)}") for i, w in own]
        true += [(i, j) for i, p in own for j, q in own if i < j and similar_stretches(p, q, width)]
    want = reachable([i for i, _ in rows], true)
    got = {x.doc_id: x.class_id for x in passages.passage_classes(docs(rows)).collect()}
    pairs = [(i, j) for i in want for j in want if i < j and want[i] == want[j]]
    assert len(true) > 300 and len(pairs) > len(true)
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.97 * len(pairs)
    assert all(want[i] == want[j] for i in got for j in got if got[i] == got[j])


@pytest.mark.parametrize("size", [3, 512])
def test_tiles_hold_each_pair_apart_once(size):
    r = np.random.default_rng(4)
    for n in (0, 1, 7, 60, 400):
        value, root = r.integers(0, max(1, n // 12), n).astype(np.uint64), r.integers(0, 4, n)
        got = []
        for own, other in passages.tiles(value, root, size):
            rows = np.concatenate([own, other])
            got += [tuple(sorted((int(rows[a]), int(rows[b])))) for x, y in passages.tile_pairs(value[rows], root[rows], len(own)) for a, b in zip(x, y, strict=True)]
        want = [(a, b) for a in range(n) for b in range(a + 1, n) if value[a] == value[b] and root[a] != root[b]]
        assert sorted(got) == want


def test_no_similar_stretch_is_passed_over():
    r, yes, no = random.Random(12), 0, 0
    for turn in range(400):
        letters = r.choice((3, 8, 40))
        a = [r.randrange(letters) for _ in range(r.randint(4, 14))]
        b = [x if r.random() < 0.8 else 100 + r.randrange(9) for x in a] if turn % 2 else [r.randrange(2 * letters) for _ in range(12)]
        cuts = [[(i, j) for i in range(len(x)) for j in range(i + 6, len(x) + 1)] for x in (a, b)]
        sets = [[set(x[i:j]) for i, j in c] for x, c in zip((a, b), cuts, strict=True)]
        similar = [c for c, x in zip(cuts[0], sets[0], strict=True) if any(len(x & y) / len(x | y) >= 0.75 for y in sets[1])]
        held = passages.zones(np.array(a, np.uint64), np.unique(np.array(b, np.uint64)), 6, 0.75)
        assert all(any(x <= i and j <= y for x, y in held) for i, j in similar), (a, b)
        yes, no = yes + bool(similar), no + (not held)
    assert yes > 50 and no > 50
    pieces = passages.around(np.arange(100), np.array([3, 40, 41, 90]), 10)
    assert [(a, x.tolist()) for a, x in pieces] == [(0, list(range(14))), (30, list(range(30, 52))), (80, list(range(80, 100)))]


def test_a_large_group_loses_no_link(spark, docs):
    """Two documents hold a passage whole, far from each other among many that hold parts below the threshold."""
    rows, n = [], 60
    for g in range(3):
        p = prose(54, 70_000 + g).split()
        for i in range(n):
            a = (0, 6, 12)[i % 3]
            x = p if i in (17, 50) else p[a : a + 42]
            rows.append((100 * g + i, f"{prose(30, 80_000 + 100 * g + i)} {' '.join(x)} {prose(20, 90_000 + 100 * g + i)}"))
    got = {r.doc_id: (r.class_id, r.n_links) for r in passages.passage_classes(docs(rows)).collect()}
    assert got == {i: (i - i % 100 + 17, 1) if i % 100 in (17, 50) else (i, 0) for i, _ in rows}


def test_odd_passages(spark, docs):
    """Very long texts, ties in ids, and columns of the operator's own names."""
    long, passage = prose(60_000, 70), prose(60, 71)
    rows = [(1, f"{long} {passage}"), (2, f"{passage} {prose(30, 72)}"), (2, prose(80, 73)), (5, "same line here " * 20_000), (6, "same line here " * 30), (7, None)]
    table = docs(rows).selectExpr("*", "1 AS block", "2 AS part", "3 AS class_id", "'x' AS value")
    got = [(r.doc_id, r.class_id) for r in passages.passage_classes(table).collect()]
    assert sorted(got) == [(1, 1), (2, 1), (2, 1), (5, 5), (6, 5), (7, 7)]


def test_passages_of_nothing(spark, docs):
    assert passages.passage_classes(docs([])).count() == 0


def test_kept_hash_of_query(spark, sf_dir):
    got = {r.doc_id: r for r in substrings.op8_substring_dedup(spark, sf_dir).collect()}
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = cut([(r.doc_id, r.doc_id, r.text) for r in table])
    for i, (kept, spans) in want.items():
        assert (got[i].kept_sha256, got[i].n_spans) == (hashlib.sha256(kept).hexdigest(), len(spans))
        assert got[i].n_bytes - got[i].n_removed == len(kept)


def test_pairs_of_windows_take_room_by_windows_not_by_their_product():
    """Two documents that go on repeating themselves have a value at many places each, and each pair of places was a row."""
    def rows(n):
        doc = np.repeat([0, 1], n)
        c = np.tile(np.arange(n) * 3 % 7 + np.arange(n) * 5, 2)
        names = {"value": np.zeros(2 * n, np.uint64), "id": doc, "root": doc, "block": doc, "place": doc, "k": np.zeros(2 * n, np.uint8), "l": c, "c": c, "r": c + 4}
        return {k: x.astype(np.int64) if k != "value" else x for k, x in names.items()}

    sizes = []
    for n in (200, 1600):
        g = rows(n)
        order, starts, lengths, x, y = passages.member_pairs(g, len(g["id"]))
        made = list(passages.bundles(g, order, starts, lengths, x, y))
        assert len(made) == 1 and made[0][:7] == (0, 1, 0, 1, 0, 1, 1)
        sizes.append(sum(len(v) for v in made[0][7:]))
        a, b = passages.unpack_windows(made[0][7], 5), passages.unpack_windows(made[0][8], 2)
        assert (a[2] == np.sort(g["c"][:n])).all() or sorted(a[3].tolist()) == sorted(g["c"][:n].tolist())
        assert sorted(b[1].tolist()) == sorted(g["c"][n:].tolist())
    assert sizes[1] <= 10 * sizes[0]


def test_bundles_hold_every_pair_of_windows_apart():
    r = np.random.default_rng(9)
    for n in (1, 8, 60, 300):
        g = {"value": r.integers(0, max(1, n // 12), n).astype(np.uint64), "id": r.integers(0, 9, n)}
        g |= {"root": g["id"] // 2, "block": g["id"] % 3, "place": g["id"], "k": (g["value"] % np.uint64(8)).astype(np.uint8), "c": np.arange(n), "l": np.arange(n), "r": np.arange(n)}
        got = []
        for own, other in passages.tiles(g["value"], g["root"], 16):
            part = {k: x[np.concatenate([own, other])] for k, x in g.items()}
            for a_id, b_id, *_, bits, a, b in passages.bundles(part, *passages.member_pairs(part, len(own))):
                a, b = passages.unpack_windows(a, 5), passages.unpack_windows(b, 2)
                assert a_id < b_id and bits == np.bitwise_or.reduce(1 << a[1])
                got += [(int(a[3][i]), int(b[1][j])) for i, j in zip(*np.nonzero(a[0][:, None] == b[0][None]), strict=True)]
        want = [(i, j) for i in range(n) for j in range(n) if g["value"][i] == g["value"][j] and g["root"][i] != g["root"][j] and g["id"][i] < g["id"][j]]
        assert sorted(got) == sorted(want)


def test_rounds_give_the_links_of_one(spark, docs, monkeypatch):
    words = prose(60, 77).split()
    rows = [(i, f"{prose(40, 900 + i)} {' '.join(w if j != 5 + i % 40 else f'edit{i}' for j, w in enumerate(words))} {prose(30, 300 + i)}") for i in range(8)]
    rows += [(20 + i, f"{prose(50, 700 + i)} {' '.join(words[:46])} {prose(40, 800 + i)}") for i in range(3)]  # too short to be linked, but with values of the others
    classes = lambda: sorted((x.doc_id, x.class_id) for x in passages.passage_classes(docs(rows)).collect())
    want, turns = classes(), []
    monkeypatch.setattr(passages, "ROUND_BYTES", 2000)
    monkeypatch.setattr(passages, "ROUND_SHARE", 0)
    monkeypatch.setattr(passages, "reduce", lambda f, x: turns.append(len(x)) or reduce(f, x))
    assert classes() == want and {c for i, c in want if i < 8} == {0}
    assert len(turns) == 1 and 1 < turns[0] < 40
