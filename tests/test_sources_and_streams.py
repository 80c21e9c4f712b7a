from __future__ import annotations

import datetime as dt
import json
import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from paperloom import registry, storage
from paperloom.sources import files, tree
from paperloom.sources.bucket_table import BucketTable
from paperloom.streaming import ingest


def test_markdown_scan_and_sidecars(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "TEMP").mkdir()
    (tmp_path / "a/x.md").write_text("text of x")
    (tmp_path / "a/empty.md").write_text(" ")
    (tmp_path / "a/bad.md").write_bytes(b"caf\xe9 ok")
    (tmp_path / "TEMP/y.md").write_text("left out")
    (tmp_path / "a/x.json").write_text(json.dumps({"author": "Ann", "word_count": 3}))
    rows = {r.file_name: r for r in files.scan_markdown(spark, str(tmp_path)).collect()}
    assert set(rows) == {"x.md", "empty.md", "bad.md"}
    assert rows["empty.md"].reason == "empty_file" and rows["bad.md"].text == "caf� ok" and rows["x.md"].reason is None
    merged = files.with_sidecars(files.scan_markdown(spark, str(tmp_path)).withColumn("word_count", F.lit(9)), files.read_sidecars(spark, str(tmp_path)))
    got = {r.file_name: (r.author, r.word_count) for r in merged.collect()}
    assert got == {"x.md": ("Ann", 3), "empty.md": (None, 9), "bad.md": (None, 9)}


def test_raw_scan(spark, tmp_path):
    for name, size in (("a.pdf", 10), ("b.xyz", 10), ("c.txt", 0), ("d.html", 500)):
        (tmp_path / name).write_bytes(b"x" * size)
    rows = {files_name(r.path): r.verdict for r in files.scan_raw(spark, str(tmp_path), max_bytes=100).collect()}
    assert rows == {"a.pdf": "pending", "b.xyz": "unsupported", "d.html": "too_large"}
    assert {(r.format, r.files) for r in files.format_counts(files.scan_raw(spark, str(tmp_path))).collect()} == {("pdf", 1), ("xyz", 1), ("html", 1)}


def files_name(path):
    return path.rsplit("/", 1)[1]


def test_numbered_folders(spark):
    scan = spark.createDataFrame([(f"/r/{p}/f.md",) for p in ("2023/10", "2023/9", "2023/9", "2024/_x", "other/1")], "path string")
    assert [(r.year, r.number, r.files) for r in files.numbered_folders(scan).collect()] == [("2023", "9", 2), ("2023", "10", 1)]


def test_log_blocks(spark, tmp_path):
    (tmp_path / "log.txt").write_text("2024-05-01 10:00:00 ERROR\nbody one\n---\nno stamp\n---\n2024-05-02 10:00:00 warning\nbody two\n")
    rows = files.read_log_blocks(spark, str(tmp_path / "log.txt")).orderBy("ts").collect()
    assert [(r.kind, r.body) for r in rows] == [("error", "body one"), ("warning", "body two")]
    assert files.read_log_blocks(spark, str(tmp_path / "log.txt"), since="2024-05-02 00:00:00").count() == 1


def test_run_metrics_and_repair(spark):
    lines = spark.createDataFrame([(1, "Files: 12"), (1, "chunks: 3.5 total"), (2, "Files: 4")], "run long, line string")
    assert {tuple(r) for r in files.run_metrics(lines, ["files", "chunks"]).collect()} == {(1, 12.0, 3.5), (2, 4.0, None)}
    row = spark.createDataFrame([(b"caf\xe9",), ("café".encode(),)], "b binary").select(files.repaired(F.col("b")).alias("t")).collect()
    assert [r.t for r in row] == ["café", "café"]


def test_versions_and_exports(spark, tmp_path):
    rows = spark.range(3)
    path = files.write_version(rows, str(tmp_path / "t"), 1)
    assert spark.read.parquet(path).count() == 3
    files.export_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_stream_of_documents_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"word{i}{j}" for j in range(30))) for i in range(6)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    versions = []

    def current():
        return spark.read.parquet(versions[-1]) if versions else None

    def write(rows, n):
        versions.append(files.write_version(rows, str(tmp_path / "out"), n))

    q = ingest.ingest(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "check"), current, write)
    q.awaitTermination(60)
    want = {tuple(r) for r in ingest.prepare(docs).collect()}
    assert {tuple(r) for r in current().collect()} == want
    q = ingest.ingest(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "check"), current, write)  # nothing new
    q.awaitTermination(60)
    assert len(versions) == 1


def files_of(table, bucket):
    return sorted(p.name for p in pathlib.Path(table.manifest()[bucket].removeprefix("file://")).glob("*.parquet"))


def test_bucket_table_rewrites_touched_buckets_alone(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", i, "old") for i in range(60)], "k string, n long, text string")
    table = BucketTable(spark, f"file://{tmp_path}/t", rows.schema, "k", 8)
    assert table.read().count() == 0 and table.upsert(rows, [F.desc("n")]) == 0
    before = {b: (p, files_of(table, b)) for b, p in table.manifest().items()}
    fresh = spark.createDataFrame([("k3", 1, "a"), ("k3", 2, "b"), ("new", 1, "c"), (None, 1, "lost")], rows.schema)
    assert table.upsert(fresh, [F.desc("n")]) == 1
    touched = {r.b for r in fresh.filter("k IS NOT NULL").select(table.bucket().alias("b")).collect()}
    after = {b: (p, files_of(table, b)) for b, p in table.manifest().items()}
    assert 0 < len(touched) < 8 and {b for b in after if after[b] != before.get(b)} == touched
    want = {f"k{i}": (i, "old") for i in range(60)} | {"k3": (2, "b"), "new": (1, "c")}
    assert {r.k: (r.n, r.text) for r in table.read().collect()} == want and table.read().count() == 61
    assert {r.text for r in table.read(version=0).collect()} == {"old"}  # older versions stay readable
    assert table.upsert(fresh.withColumn("text", F.lit("again")), [F.desc("n")], version=1) == 1  # committed already
    assert {r.k: (r.n, r.text) for r in table.read().collect()} == want
    table.delete(spark.createDataFrame([("k3",), ("k5",), ("absent",)], "k string"))
    assert {r.k for r in table.read().collect()} == set(want) - {"k3", "k5"} and table.versions() == [0, 1, 2]


def test_a_failed_change_leaves_the_table(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(9)], "k string, n long")
    table = BucketTable(spark, f"file://{tmp_path}/t", rows.schema, "k", 4)
    table.upsert(rows, [F.desc("n")])
    # data of a next version, and a manifest without its mark, as a lost driver leaves them
    rows.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"file://{tmp_path}/t/data/v=00000001")
    (tmp_path / "t/manifest/v=00000001").mkdir()
    assert table.versions() == [0] and table.read().count() == 9
    assert table.upsert(spark.createDataFrame([("k1", 100)], rows.schema), [F.desc("n")]) == 1
    assert {r.k: r.n for r in table.read().collect()} == {f"k{i}": i for i in range(9)} | {"k1": 100}


def test_stream_into_a_bucket_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"word{i}{j}" for j in range(30))) for i in range(6)], "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    table = BucketTable(spark, f"file://{tmp_path}/t", ingest.prepare(docs).schema, "chunk_id", 4)
    run = lambda: ingest.ingest_into(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "check"), table).awaitTermination(60)
    run()
    assert {tuple(r) for r in table.read().collect()} == {tuple(r) for r in ingest.prepare(docs).collect()}
    changed = docs.filter("doc_id = 2").withColumn("text", F.regexp_replace("text", "word", "term"))
    changed.write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()  # nothing new
    assert {tuple(r) for r in table.read().collect()} == {tuple(r) for r in ingest.prepare(docs.filter("doc_id <> 2").unionByName(changed)).collect()}
    assert table.versions() == [0, 1]


def test_first_uploads_outlive_restarts(spark, tmp_path):
    schema = "id long, file_hash string, uploaded_at long"
    at = lambda name: f"file://{tmp_path}/{name}"
    run = lambda: ingest.run_uploads(spark, at("in"), spark.createDataFrame([], schema).schema, at("sink"), at("check"))
    kept = lambda: sorted((r.id, r.file_hash or "") for r in spark.read.schema("id long, file_hash string").parquet(at("sink")).collect())
    spark.createDataFrame([(5, "a", 1), (1, "a", 2), (7, "b", 9), (6, "b", 9), (8, None, 1), (9, None, 1)], schema).repartition(3).write.parquet(at("in"))
    run()
    assert kept() == [(5, "a"), (6, "b"), (8, ""), (9, "")]
    spark.createDataFrame([(0, "a", 0), (10, "c", 0), (11, "c", None)], schema).write.mode("append").parquet(at("in"))
    run()
    run()  # nothing new
    assert kept() == [(5, "a"), (6, "b"), (8, ""), (9, ""), (11, "c")]


def test_bucket_table_as_a_dictionary(spark, tmp_path, monkeypatch):
    """Changes at random against a plain dictionary; incoming rows are written before the table only where held rows must join them."""
    steps = []
    monkeypatch.setattr("paperloom.sources.bucket_table.written", lambda rows: steps.append(1) or storage.written(rows))
    schema, r, want = "k string, v long", random.Random(3), {}
    table = BucketTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], schema).schema, "k", 8)
    for turn, n in enumerate((60, 20, 3, 0, 40)):
        rows = [(r.choice([None, *(f"k{i}" for i in range(50))]), r.randrange(1000)) for _ in range(n)]
        batch = spark.createDataFrame(rows, schema)
        if turn == 2:
            table.delete(batch)
            want = {k: v for k, v in want.items() if k not in {k for k, _ in rows}}
        else:
            table.upsert(batch, [F.desc("v")])
            best = {}
            for k, v in rows:
                if k is not None:
                    best[k] = max(v, best.get(k, 0))
            want |= best
        assert len(steps) == turn
        assert {x.k: x.v for x in table.read().collect()} == want and table.read().count() == len(want)


def test_first_uploads_of_many_contents(spark, tmp_path):
    """Contents cost no call of Python each; copies over several batches, null hashes and null times are told as by a plain loop."""
    r, schema, seen, want = random.Random(5), "id long, file_hash string, uploaded_at long", set(), []
    at = lambda name: f"file://{tmp_path}/{name}"
    for turn in range(3):
        rows = [(turn * 1000 + i, r.choice([None, *(f"h{k}" for k in range(400))]), r.choice([None, 1, 2, 3])) for i in range(300)]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(at("in"))
        ingest.run_uploads(spark, at("in"), spark.createDataFrame([], schema).schema, at("sink"), at("check"))
        for i, h, _ in sorted(rows, key=lambda x: (-1 if x[2] is None else x[2], x[0])):
            if h is None or h not in seen:
                want.append((i, h or ""))
                seen.add(h)
    assert sorted((x.id, x.file_hash or "") for x in spark.read.schema("id long, file_hash string").parquet(at("sink")).collect()) == sorted(want)
    stream = ingest.counted_uploads(spark.readStream.schema(schema).parquet(at("in")))
    plan = stream._jdf.queryExecution().logical().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_upload_dedupe_and_windows_on_streams(spark, tmp_path):
    at = dt.datetime(2024, 5, 1, 10, 0)
    rows = [(at + dt.timedelta(minutes=m), h, e) for m, h, e in ((0, "a", "x"), (1, "a", "x"), (2, "b", "y"), (70, "c", "x"))]
    table = spark.createDataFrame(rows, "ts timestamp, file_hash string, event_type string")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("b",)], "file_hash string")
    for name, df, mode in (("uploads", ingest.new_uploads(stream, known), "append"), ("rates", ingest.error_rates(stream), "update")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.file_hash for r in spark.table("uploads").collect()) == ["a", "c"]
    batch = {tuple(r) for r in ingest.error_rates(table).collect()}
    assert {tuple(r) for r in spark.table("rates").collect()} >= batch


def test_tree_sink_and_its_scans(spark, tmp_path):
    """Texts, sidecars and totals are written once, however often; a root with a scheme hides no folder; new folders of a stream are read alone."""
    root = f"file://{tmp_path}/tmp/tree"  # a blacklisted name above the root doesn't count
    rows = [("2024/1", "a.md", "für\nall", '{"author": "Ann"}'), ("2024/1", "b.md", None, None), ("Cache/x", "c.md", "left out", None), ("2024/2", "d.md", " ", None)]
    schema = "folder string, file_name string, text string, metadata string"
    for _ in range(2):
        tree.write_tree(spark.createDataFrame(rows, schema), root)
    assert json.loads((tmp_path / "tmp/tree/_SUCCESS").read_text()) == {"files": 4, "sidecars": 1, "size": 17}
    found = sorted(p.name for p in (tmp_path / "tmp/tree").rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    assert found == ["_SUCCESS", "a.json", "a.md", "b.md", "c.md", "d.md"]
    scan = {r.file_name: (r.text, r.reason) for r in files.scan_markdown(spark, f"{root}/markdown").collect()}
    assert scan == {"a.md": ("für\nall", None), "d.md": (" ", "empty_file")}

    def run():
        stream = files.stream_markdown(spark, f"{root}/markdown", files_a_batch=1).select("file_name", "text")
        stream.writeStream.format("parquet").option("path", f"{root}/sink").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.file_name for r in spark.read.parquet(f"{root}/sink").collect())

    assert run() == ["a.md", "d.md"]
    tree.write_tree(spark.createDataFrame([("2025/1", "e.md", "new", None)], schema), root)
    assert run() == ["a.md", "d.md", "e.md"]
    with pytest.raises(ValueError, match="metadata"):
        tree.DocumentTree({"path": root}).writer(spark.createDataFrame([], "folder string, file_name string, text string").schema, False)


def _most_tasks(spark, group):
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds]
    return max(s.numTasks for s in stages if s)


def test_stream_of_small_files_takes_few_tasks(spark, sf_dir):
    """A batch of the 200 files was listed with a task for each."""
    runs = []

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            runs.append(str(event.runId))

        def onQueryProgress(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    listener = Listener()
    spark.streams.addListener(listener)
    try:
        rows = registry.queries()["t01_markdown_stream"](spark, sf_dir)
        while not runs:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert _most_tasks(spark, runs[0]) <= 64
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text <> ''").count()
    assert spark.conf.get("spark.sql.files.openCostInBytes").lower() in ("4194304", "4194304b", "4mb")


@pytest.mark.parametrize("name", ["s01_markdown_scan", "s02_raw_scan", "s04_sidecars", "s05_numbered_folders", "s06_pending_files"])
def test_scans_of_small_files_take_few_tasks(spark, sf_dir, name):
    """Scans of the 200 files read 32 a task: a task for each core will do."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        registry.queries()[name](spark, sf_dir).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert _most_tasks(spark, name) <= spark.sparkContext.defaultParallelism


def _numbered_tree(root, folders, files_each=4):
    for folder in folders:
        (root / folder).mkdir(parents=True, exist_ok=True)
        for i in range(files_each):
            (root / folder / f"doc_{i}.md").write_text(f"{folder} {i}")


def test_large_trees_are_read_a_list_of_folders_at_a_time(spark, tmp_path):
    """The driver kept all files of a tree at once."""
    root = tmp_path / "tree"
    _numbered_tree(root, ["2000/1", "2000/2", "2000/3", "2001/1", "a [1], {b}", "_hidden", ".cache", "2001/_x", "k=1"])
    (root / "beside.md").write_text("beside folders")
    (root / "_SUCCESS").write_text("left out")
    for top in (str(root), f"file://{root}"):
        lists = files.parts(spark, top, 8)
        assert len(lists) >= 4 and files.parts(spark, top) == [[top]]
        scan = lambda paths=None: files.scan_markdown(spark, top, paths=paths)
        want = sorted((r.path, r.text) for r in scan().collect())
        each = [scan(part).collect() for part in lists]
        assert sorted((r.path, r.text) for rows in each for r in rows) == want and len(want) == 25
        assert all(len(rows) <= 8 for rows in each)
        assert sorted((r.path, r.text) for r in files.scanned(spark, top, scan, most=8).collect()) == want
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scanned(spark, str(tmp_path / "none"), lambda part: files.scan_markdown(spark, str(tmp_path / "none"), paths=part))


def test_streams_of_lists_give_each_file_once(spark, tmp_path):
    """Runs that find new files, in old folders and new ones, add these alone."""
    root, out, mark = tmp_path / "tree", str(tmp_path / "out"), str(tmp_path / "mark")
    stream = lambda path: files.stream_markdown(spark, str(root), path=path).select("text")
    run = lambda: sorted(r.text for r in files.streamed(spark, str(root), stream, out, mark, most=8).collect())
    want = lambda: sorted(p.read_text() for p in root.rglob("*.md"))
    _numbered_tree(root, ["2000/1", "2000/2", "2000/3", "2001/1", "x, {y}"])
    assert run() == want() and len(want()) == 20 and len(list((tmp_path / "mark").glob("[0-9]*"))) >= 3
    _numbered_tree(root, ["2000/4", "2002/1"])
    (root / "2000/1/late.md").write_text("late")
    (root / "beside.md").write_text("beside")
    assert run() == want()
    assert run() == want()
