from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import fim, quality, trie

CONV = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    """Nodes of the rebuilt conversations' prefix trie, by the contract's words."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            key = hashlib.md5((hashlib.md5((role or "").encode()).hexdigest() + (text or "")).encode()).digest()
            own[conv].append(((turn is not None, turn or 0), key, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: t[:2])
    members, ends = defaultdict(set), defaultdict(list)
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 6
        block = conv - int(np.fmod(conv, 100))
        path = [t[2:] for t in own.get(block, [])[:h]] + [t[2:] for t in own[conv][h:]]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(conv)
        ends[tuple(path)].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[c] for c in below) if below else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[c] for c in below)
    return {
        (min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n in members
    }


def nodes_of(spark, rows):
    return {tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, CONV)).collect()}


def made_conversations(seed, convs=60, longest=9):
    r = random.Random(seed)
    rows = []
    for conv in r.sample(range(350), convs):
        for turn in range(r.randint(1, longest)):
            rows.append((conv, turn, r.choice(["user", "assistant"]), r.choice(["a", "bé", "", "ccc"])))
    return rows


def test_trie_agrees_with_brute_force(spark):
    rows = made_conversations(1)
    rows += [(300, None, None, None), (300, None, None, None), (300, 0, "user", "x" * 100_000), (-7, 0, "user", "a"), (None, 0, "user", "lost"), (150, 0, "user", "a"), (150, 0, "user", "b")]
    assert nodes_of(spark, rows) == brute_trie(rows)


def test_hot_conversations_span_pieces(spark):
    """One conversation holds a third of all turns, many are equal, and pieces are cut small, so every carry is used."""
    rows = made_conversations(2, 20)
    rows += [(200, t, "user", "t" * (t % 3)) for t in range(150)] + [(207, t, "user", "t" * (t % 3)) for t in range(153)]
    rows += [(c, t, "user", f"same {t}") for c in range(400, 440) for t in range(6)]
    table = spark.createDataFrame(rows, CONV).repartition(3)
    assert {tuple(r) for r in trie.prefix_trie(table, piece=7, held=40).collect()} == brute_trie(rows)


def placed(pieces):
    import pyarrow as pa

    names = ("fid", "conv_id", "opens", "base_n", "start", "c0", "c1", "skip", "last", "turns", "chars")
    return pa.RecordBatch.from_arrays([pa.array([p[n] for p in pieces]) for n in names], list(names))


@pytest.mark.parametrize("seed", range(6))
def test_fat_binary_search_finds_every_exit(seed):
    """Counts at all depths are those of a plain dictionary of prefixes, with prefixes, equal pieces and splits anywhere."""
    r = random.Random(seed)
    made, want = [], defaultdict(lambda: [0, 10**9])
    for fid in range(200):
        turns = [r.choice([1, 1, 1, 2]) for _ in range(r.randint(0, 40))]
        sums = trie._poly(np.array([(t, 7 * t + 1) for t in turns], np.uint64).reshape(-1, 2))
        made.append(trie.Piece(fid, fid, 0, sums, np.array(turns, np.int64)))
        for d in range(1, len(turns) + 1):
            want[tuple(turns[:d])][0] += 1
            want[tuple(turns[:d])][1] = min(want[tuple(turns[:d])][1], fid)
    t = trie.ZFastTrie()
    t.insert(made)
    rows = t.expanded().to_pylist()
    assert len(rows) == len(want)
    assert sorted((x["depth"], x["n"], x["conv_id"]) for x in rows) == sorted((len(k), *v) for k, v in want.items())
    for x, low, high in zip(range(len(t.low)), t.low, t.extent, strict=True):
        if t.parent[x] >= 0:
            assert t.handles[0, trie.fattest(low, high), t.rep[x].name(trie.fattest(low, high))] == x


def test_carry_joins_pieces_anywhere():
    """Cutting conversations at other places, heads and dropped turns included, changes no prefix's name."""
    import pyarrow as pa

    names = []
    for cut in (1, 2, 3, 50):
        rng, found, pieces = random.Random(9), {}, []
        for conv in range(40):
            h = trie.head_turns(conv)
            base, own = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(min(h, rng.randint(0, 5)))], [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(rng.randint(0, 9))]
            both = [(0, t) for t in base] + [(1, t) for t in own]
            for at in range(0, max(1, len(both)), cut):
                part = both[at : at + cut]
                b, o = (np.array([t for s, t in part if s == k], np.uint64).reshape(-1, 2) for k in (0, 1))
                sums = np.concatenate([trie._poly(b)[:, -1], trie._poly(o)[:, -1]])
                pieces.append({"conv_id": conv, "fid": len(pieces), "opens": at == 0, "base_n": len(b), "own_n": len(o), "sums": sums.tobytes(), "heads": o[:5].tobytes(), "turns": np.concatenate([b, o]).tobytes(), "chars": np.ones(len(part), np.int64).tobytes()})
        scalars = pa.RecordBatch.from_arrays([pa.array([p[n] for p in pieces]) for n in ("conv_id", "fid", "base_n", "own_n", "sums", "heads")], ["conv_id", "fid", "base_n", "own_n", "sums", "heads"])
        carried = {x["fid"]: x for b in trie._carry(iter([scalars.slice(0, 30), scalars.slice(30)])) for x in b.to_pylist()}
        for piece, opens, last in trie._pieces(placed([p | carried[p["fid"]] for p in pieces])):
            for d in range(piece.start, piece.end + 1):
                found[piece.conv, d] = piece.name(d)
        names.append(found)
    assert all(n == names[0] for n in names)


def test_empty_trie(spark):
    table = spark.createDataFrame([], CONV + ", depth int, parent_conv_id string")
    assert trie.prefix_trie(table).collect() == []


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_agrees_with_brute_force(spark, docs):
    r = random.Random(4)
    texts = [None, "", "\n", "\n\n\n", "no line end", "é\nü\n漢字\n", "has <P> inside", "cut <\nS> mark", "<" * 40 + "\n" + "S>", "ends with <\n", "a\r\nb\r\n", "x" * 300_000 + "\n" + "y" * 10]
    texts += ["".join(r.choice(["a", "b ", "é", "\n", "<", "P", ">"]) for _ in range(r.randint(1, 3000))) for _ in range(120)]
    shared = "".join(r.choice("abcdef \n") for _ in range(20_000))
    texts += [shared[i:] for i in range(0, 2000, 97)] + [shared] * 3
    rows = list(enumerate(texts)) + [(None, "no id\nat all"), (3, "again\n")]
    table = docs(rows).withColumn("form", F.lit("clash"))
    made = fim.fill_in_middle(table)
    assert made.columns.count("form") == 1 and "lang" in made.columns
    got = sorted((str(x.doc_id), x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in made.collect())
    assert got == sorted((str(i), *brute_fim(i, t)) for i, t in rows)
    back = made.select("text", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all((x.text or "") == x.back for x in back)
    assert fim.fill_in_middle(table.limit(0)).count() == 0


def test_chunks_depend_on_content_alone():
    r = np.random.default_rng(1)
    passage = r.integers(97, 123, 50_000, np.uint8)
    ends = [set(fim.borders(np.concatenate([r.integers(97, 123, k, np.uint8), passage])) - k) for k in (0, 13, 4099)]
    inside = [{e for e in x if e > fim.ROLL} for x in ends]
    assert len(inside[0]) > 20 and all(inside[0] == {e for e in x if e > fim.ROLL} for x in inside[1:])
    data = r.integers(0, 256, 500, np.uint8)
    plain = [sum((int(data[i - j]) + 1) * pow(fim._FACTOR, j, 1 << 32) for j in range(fim.ROLL) if i >= j) % (1 << 32) for i in range(500)]
    assert fim.rolling(data).tolist() == plain


def test_rates_decide_forms(spark, docs):
    table = docs([(i, f"line {i}\nmore\n") for i in range(200)])
    none = fim.fill_in_middle(table, rate=0)
    assert {x.form for x in none.collect()} == {"plain"}
    assert {x.form for x in fim.fill_in_middle(table, spm_rate=100).collect()} == {"spm"}


def test_word_statistics():
    raws = [b"", b"The The the cat.\nA|B $$$ 12\n", "É été\n\n".encode(), b" \n ", b"one"]
    got = {n: v for n, v in zip(quality.NAMES, quality.statistics(raws).T.tolist(), strict=True)}
    assert all(v[0] == 0 for v in got.values())
    assert got["log_words"] == pytest.approx(np.log1p([0, 7, 2, 0, 1]).tolist())
    assert got["log_lines"] == pytest.approx(np.log1p([0, 2, 1, 2, 1]).tolist())
    assert got["repeated_words"][1] == pytest.approx(1 / 6) and got["distinct_words"][1] == pytest.approx(6 / 7)
    assert got["top_word"][1] == pytest.approx(2 / 7) and got["line_end"][2] == pytest.approx(2 / 10)
    alone = np.concatenate([quality.statistics([r]) for r in raws])
    assert np.allclose(alone, quality.statistics(raws))  # neighbours in a batch don't matter


def test_isotonic_is_the_best_rising_fit():
    r = np.random.default_rng(3)
    x = np.sort(r.normal(size=60))
    y, w = r.integers(0, 5, 60).astype(float), np.full(60, 5)
    sums, chances = quality.isotonic(x, y, w)
    assert (np.diff(chances) > 0).all() and (np.diff(sums) > 0).all()
    # least squares over rising sequences has the max-min form
    rate = y / w
    best = [max(min(rate[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(sorted({round(v, 9) for v in best}), np.round(chances, 9))


def test_cosines_approximate_the_kernel(spark):
    r = np.random.default_rng(0)
    n = len(quality.NAMES)
    x = r.normal(size=(30, n)) * 0.7
    big = quality.Model(np.zeros(n), np.ones(n), r.standard_normal((n, 20_000)) / quality.WIDTH, r.uniform(0, 2 * np.pi, 20_000), np.zeros(1), np.zeros(1), np.zeros(1))
    z = big.cosines(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2 / quality.WIDTH**2)
    assert np.abs(z @ z.T - want).max() < 0.05


def test_equations_are_those_of_all_rows(spark):
    r = np.random.default_rng(2)
    n = len(quality.NAMES)
    rows = [([float(v) for v in r.normal(size=n)], float(r.integers(0, 2))) for _ in range(300)]
    table = spark.createDataFrame(rows, "stats array<float>, y double").repartition(7)
    model = quality.fit(table, table)
    z = np.column_stack([model.cosines(np.array([x for x, _ in rows], np.float32).astype(float)), [y for _, y in rows]])
    assert np.allclose(quality.normal_equations(table, model), z.T @ z)
    penalty = quality.PENALTY * 300 * np.diag([*[1.0] * quality.FEATURES, 0.0])
    assert np.allclose((z[:, :-1].T @ z[:, :-1] + penalty) @ model.weights, z[:, :-1].T @ z[:, -1], atol=1e-6)


def test_quality_of_held_out_documents(spark, sf_dir):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = quality.score_documents(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in found)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in found)
    truth = {x.doc_id: x.quality for x in labels.collect()}
    judged = [(x.predicted, truth[x.doc_id]) for x in found if x.held_out and x.doc_id in truth]
    assert sum(a == b for a, b in judged) >= 0.97 * len(judged)
    # a held-out label is never learnt: changing them all changes no score
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {x.doc_id: x.score for x in quality.score_documents(docs, flipped).collect()}
    assert all(abs(again[x.doc_id] - x.score) < 1e-6 for x in found)


def test_odd_documents_are_scored(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (4, 0), (None, 1)], "doc_id long, quality int")
    table = docs([(1, "good text here"), (2, None), (3, ""), (4, "x " * 100_000), (4, "x"), (None, "none")]).withColumn("score", F.lit("clash"))
    got = quality.score_documents(table, labels).collect()
    assert len(got) == 6 and all(0 <= x.score <= 1 for x in got)
    assert {x.score for x in quality.score_documents(table, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(table.limit(0), labels).count() == 0
    assert quality.with_statistics(table).columns == ["doc_id", "lang", "source", "n_chars", "score", "stats"]


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_prefix_trie"])
def test_agreement_with_sql(spark, sf_dir, name):
    from paperloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir), con.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(*columns).collect())
