"""Registry, incremental indexing, fleet, logs: joins and reports between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluate, lifecycle
from ..registry import read, register
from ..sources.bucket_table import BucketTable
from ..storage import shared_dir
from ..sources import files
from ..streaming.ingest import error_rates
from . import inputs as I
from .inputs import AS_OF, CHUNKS, REGISTRY, VEHICLES

R = f"WITH {REGISTRY}"
RC = f"WITH {REGISTRY}, {CHUNKS}"
RV = f"WITH {REGISTRY}, {VEHICLES}"
E = "WITH ev AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type, value, user_id, props FROM events)"


@register("j01_registry_chunks", f"{RC} SELECT id, status, coalesce(n, 0) AS chunks FROM registry LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.doc_id = id")
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks are counted before the join, so one row for each document is joined."""
    n = I.chunks(spark, sf_dir).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("chunks"))
    return I.registry_rows(spark, sf_dir).select("id", "status").join(n.hint("merge"), "id", "left").fillna(0, ["chunks"])


@register("j02_with_chunks", f"{RC} SELECT id FROM registry WHERE id IN (SELECT doc_id FROM chunks WHERE length(text) > 500)")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = I.chunks(spark, sf_dir).filter(F.length("text") > 500).select(F.col("doc_id").alias("id"))
    return I.registry_rows(spark, sf_dir).select("id").join(long.hint("merge"), "id", "left_semi")


_SCAN = """
scan AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'C:\\Docs\\D_' || doc_id || '.md' ELSE 'docs/d_' || doc_id || '.md' END AS path, 'd_' || doc_id || '.md' AS file_name, sha256(text) AS hash, n_chars AS size, doc_id % 9 AS modified FROM documents),
held AS (SELECT doc_id, 'c:/docs/d_' || doc_id || '.md' AS file_path, CASE WHEN doc_id % 3 = 0 THEN 'd_' || doc_id || '.md' ELSE 'x' END AS file_name,
         CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'other' ELSE sha256(text) END AS hash, CASE WHEN doc_id % 14 = 0 THEN 0 ELSE n_chars END AS size, doc_id % 9 AS modified FROM documents WHERE doc_id % 11 <> 0)
"""


def _scan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = read(spark, sf_dir, "documents").withColumn("h", F.sha2(F.encode("text", "UTF-8"), 256))
    n = F.col("doc_id")
    name = F.concat(F.lit("d_"), n, F.lit(".md"))
    scan = d.select("doc_id", F.when(n % 2 == 0, F.concat(F.lit("C:\\Docs\\D_"), n, F.lit(".md"))).otherwise(F.concat(F.lit("docs/"), name)).alias("path"), name.alias("file_name"), F.col("h").alias("hash"), F.col("n_chars").alias("size"), (n % 9).alias("modified"))
    held = d.filter(n % 11 != 0).select(
        "doc_id", F.concat(F.lit("c:/docs/"), name).alias("file_path"), F.when(n % 3 == 0, name).otherwise("x").alias("file_name"),
        F.when(n % 7 == 0, F.lit(None)).when(n % 5 == 0, "other").otherwise(F.col("h")).alias("hash"), F.when(n % 14 == 0, 0).otherwise(F.col("n_chars")).alias("size"), (n % 9).alias("modified"),
    )
    return scan, held


@register("j03_missing_files", f"WITH {_SCAN} SELECT path FROM scan WHERE lower(replace(path, '\\', '/')) NOT IN (SELECT file_path FROM held) AND file_name NOT IN (SELECT file_name FROM held)")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, held = _scan(spark, sf_dir)
    return lifecycle.missing_in_index(scan, held).select("path")


@register("j04_orphans", f"WITH {_SCAN} SELECT doc_id FROM held WHERE file_path NOT IN (SELECT lower(replace(path, '\\', '/')) FROM scan)")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, held = _scan(spark, sf_dir)
    return lifecycle.orphans(held, scan.select(lifecycle.normal_path(F.col("path")).alias("file_path"))).select("doc_id")


@register(
    "l02_change_set",
    f"WITH {_SCAN} SELECT coalesce(s.file_name, h.k) AS path, CASE WHEN h.k IS NULL THEN 'new' WHEN s.file_name IS NULL THEN 'deleted' WHEN CASE WHEN s.hash IS NOT NULL AND h.hash IS NOT NULL THEN s.hash = h.hash "
    "ELSE s.size IS NOT DISTINCT FROM h.size AND s.modified IS NOT DISTINCT FROM h.modified END THEN 'unchanged' ELSE 'modified' END AS change FROM scan s FULL OUTER JOIN (SELECT 'd_' || doc_id || '.md' AS k, * FROM held) h ON s.file_name = h.k",
)
def l02(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, held = _scan(spark, sf_dir)
    name = F.concat(F.lit("d_"), "doc_id", F.lit(".md"))
    return lifecycle.change_set(scan.select(F.col("file_name").alias("path"), "hash", "size", "modified"), held.select(name.alias("path"), "hash", "size", "modified"))


@register("l03_index_plan", f"WITH {_SCAN}, p AS (SELECT CASE WHEN h.doc_id IS NULL THEN 'index' WHEN h.hash IS NULL OR h.hash <> s.hash THEN 'delete_then_index' ELSE 'skip' END AS action FROM scan s LEFT JOIN held h ON s.doc_id = h.doc_id) SELECT action, count(*) AS n FROM p GROUP BY 1")
def l03(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, held = _scan(spark, sf_dir)
    plan = lifecycle.index_plan(scan.select(F.col("doc_id").alias("path"), "hash"), held.select(F.col("doc_id").alias("path"), "hash"))
    return plan.groupBy("action").agg(F.count("*").alias("n"))


@register("l01_upsert", f"{RC}, inc AS (SELECT chunk_id, reverse(text) AS text, row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_index) AS o FROM chunks WHERE doc_id % 3 = 0) SELECT chunk_id, sha256(text) AS hash FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM inc) UNION ALL SELECT chunk_id, sha256(text) FROM inc WHERE o = 1")
def l01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The committed table after two versions: all chunks, then those of some documents with other texts."""
    rows = I.chunks(spark, sf_dir).select("chunk_id", "doc_id", "text")
    table = BucketTable(spark, shared_dir(spark), rows.schema, "chunk_id", 16)
    table.upsert(rows, [F.desc("doc_id")])
    table.upsert(rows.filter("doc_id % 3 = 0").withColumn("text", F.reverse("text")), [F.desc("doc_id")])
    return table.read().select("chunk_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"))


@register(
    "l09_upload_actions",
    f"""{R}, inc AS (SELECT 'doc_' || (doc_id % 900) || '.md' AS file_name, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE text || 'x' END) AS file_hash, doc_id FROM documents WHERE doc_id % 10 < 4),
u AS (SELECT file_name || ':' || doc_id AS file_name, file_name AS plain, file_hash FROM inc), f AS (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY file_name) AS o FROM u)
SELECT file_name, CASE WHEN h.file_hash IS NOT NULL OR o > 1 THEN 'duplicate' ELSE 'insert' END AS action FROM f LEFT JOIN (SELECT DISTINCT file_hash FROM registry) h ON h.file_hash = f.file_hash""",
)
def l09(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    inc = read(spark, sf_dir, "documents").filter(n % 10 < 4).select(
        F.concat(F.lit("doc_"), n % 900, F.lit(".md:"), n).alias("file_name"), F.sha2(F.encode(F.when(n % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x"))), "UTF-8"), 256).alias("file_hash")
    )
    return lifecycle.upload_actions(inc, I.registry_rows(spark, sf_dir)).select("file_name", "action")


@register("j15_same_content", f"{R} SELECT file_hash, count(*) AS n, min(id) AS first_id FROM registry GROUP BY 1 HAVING count(*) > 1")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.registry_rows(spark, sf_dir).groupBy("file_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


@register("w05_newest_by_name", f"{R} SELECT original_filename, max(id) AS id, arg_max(status, uploaded_at) AS status FROM registry GROUP BY 1")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.newest_by(I.registry_rows(spark, sf_dir).select("id", "original_filename", "status", "uploaded_at"), "original_filename", "uploaded_at").select("original_filename", "id", "status")


@register("p17_unassigned", f"{R} SELECT id, status, uploaded_at FROM registry WHERE vehicle_id IS NULL AND status = 'processed' ORDER BY uploaded_at DESC, id LIMIT 100")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.registry_rows(spark, sf_dir).filter("vehicle_id IS NULL AND status = 'processed'")
    return rows.select("id", "status", "uploaded_at").orderBy(F.desc("uploaded_at"), "id").limit(100)


@register("p20_normal_paths", f"WITH {_SCAN} SELECT doc_id, lower(replace(path, '\\', '/')) AS path FROM scan")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir)[0].select("doc_id", lifecycle.normal_path(F.col("path")).alias("path"))


@register("a19_duplicate_names", f"{R} SELECT original_filename, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY uploaded_at, id) AS ids, string_agg(status, ',' ORDER BY uploaded_at, id) AS statuses FROM registry GROUP BY 1 HAVING count(*) > 1")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("uploaded_at", "id", "status")))
    out = I.registry_rows(spark, sf_dir).groupBy("original_filename").agg(F.count("*").alias("n"), rows.alias("r")).filter("n > 1")
    return out.select("original_filename", "n", F.array_join(F.transform("r", lambda x: x["id"].cast("string")), ",").alias("ids"), F.array_join(F.transform("r", lambda x: x["status"]), ",").alias("statuses"))


@register("a20_registry_statistics", f"{R} SELECT status, document_type, count(*) AS n, count(vehicle_id) AS assigned FROM registry GROUP BY ALL")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.registry_rows(spark, sf_dir).groupBy("status", "document_type").agg(F.count("*").alias("n"), F.count("vehicle_id").alias("assigned"))


_EXPIRY = ("insurance_expiry", "tax_expiry", "nct_expiry")


@register(
    "a21_fleet_statistics",
    f"WITH {VEHICLES} SELECT status, count(*) AS n, " + ", ".join(f"count(*) FILTER ({c} BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30) AS soon_{c}, count(*) FILTER ({c} < DATE '{AS_OF}') AS past_{c}" for c in _EXPIRY) + " FROM vehicles GROUP BY 1",
)
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit(AS_OF).cast("date")
    measures = [m for c in _EXPIRY for m in (F.count_if(F.col(c).between(day, F.date_add(day, 30))).alias(f"soon_{c}"), F.count_if(F.col(c) < day).alias(f"past_{c}"))]
    return I.vehicles(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), *measures)


@register("f25_expiry_indicators", f"WITH {VEHICLES} SELECT id, CAST(nct_expiry - DATE '{AS_OF}' AS INTEGER) AS nct_days, coalesce(nct_expiry < DATE '{AS_OF}', false) AS nct_expired, CAST(tax_expiry - DATE '{AS_OF}' AS INTEGER) AS tax_days, tax_expiry < DATE '{AS_OF}' AS tax_expired FROM vehicles")
def f25(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit(AS_OF).cast("date")
    left = lambda c: F.date_diff(F.col(c), day)
    return I.vehicles(spark, sf_dir).select("id", left("nct_expiry").alias("nct_days"), F.coalesce(left("nct_expiry") < 0, F.lit(False)).alias("nct_expired"), left("tax_expiry").alias("tax_days"), (left("tax_expiry") < 0).alias("tax_expired"))


@register("j05_vrn_groups", f"{RV}, g AS (SELECT upper(vrn) AS vrn, count(*) AS documents FROM registry WHERE vrn IS NOT NULL GROUP BY 1) SELECT g.vrn, documents, v.vehicle_id FROM g LEFT JOIN (SELECT upper(registration_number) AS vrn, min(id) AS vehicle_id FROM vehicles GROUP BY 1) v ON g.vrn = v.vrn")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.group_by_vrn(I.registry_rows(spark, sf_dir), I.vehicles(spark, sf_dir))


@register("l13_inbox_summary", f"{RV}, g AS (SELECT upper(vrn) AS vrn, count(*) AS documents FROM registry WHERE vrn IS NOT NULL GROUP BY 1), j AS (SELECT g.*, v.vehicle_id FROM g LEFT JOIN (SELECT upper(registration_number) AS vrn, min(id) AS vehicle_id FROM vehicles GROUP BY 1) v ON g.vrn = v.vrn) SELECT count(*) AS groups, CAST(sum(documents) AS BIGINT) AS documents, count(*) FILTER (vehicle_id IS NULL) AS to_create FROM j")
def l13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j05(spark, sf_dir).agg(F.count("*").alias("groups"), F.sum("documents").alias("documents"), F.count_if(F.col("vehicle_id").isNull()).alias("to_create"))


@register(
    "j06_vehicle_documents",
    "SELECT o_orderkey AS id, count(l_orderkey) AS documents, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("documents"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(lines, "id", "left").fillna(0, ["documents", "quantity"])


@register("j09_link_outcomes", f"{RV}, q AS (SELECT id * 2 AS document_id, CASE WHEN id % 3 = 0 THEN (id * 2) % 50 ELSE id + 1 END AS vehicle_id FROM registry) SELECT document_id, q.vehicle_id, CASE WHEN r.id IS NULL THEN 'no_document' WHEN v.id IS NULL THEN 'no_vehicle' WHEN r.vehicle_id IS NULL THEN 'linked' WHEN r.vehicle_id = q.vehicle_id THEN 'already_linked' ELSE 'linked_elsewhere' END AS outcome FROM q LEFT JOIN registry r ON r.id = document_id LEFT JOIN vehicles v ON v.id = q.vehicle_id")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = I.registry_rows(spark, sf_dir), F.col("id")
    asked = rows.select((n * 2).alias("document_id"), F.when(n % 3 == 0, (n * 2) % 50).otherwise(n + 1).alias("vehicle_id"))
    return lifecycle.link_outcomes(asked, rows, I.vehicles(spark, sf_dir))


_MOVABLE = "status IN ('processed', 'pending_assignment', 'unassigned')"


@register("l11_transitions", f"{R} SELECT id, CASE WHEN id % 2 = 0 AND {_MOVABLE} THEN 'assigned' ELSE status END AS status, id % 2 = 0 AND NOT {_MOVABLE} AS refused FROM registry")
def l11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.registry_rows(spark, sf_dir).select("id", "status")
    return lifecycle.transition(rows, rows.filter("id % 2 = 0").select("id", F.lit("assigned").alias("to")), lifecycle.DOCUMENT_MOVES)


@register("l08_cascade_delete", f"{RC} SELECT 'registry' AS part, count(*) AS n FROM registry WHERE id % 5 <> 0 UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE doc_id % 5 <> 0")
def l08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.registry_rows(spark, sf_dir)
    left, chunks = lifecycle.cascade_delete(rows, I.chunks(spark, sf_dir).withColumn("registry_id", F.col("doc_id")), rows.filter("id % 5 = 0").select("id"))
    return left.agg(F.lit("registry").alias("part"), F.count("*").alias("n")).union(chunks.agg(F.lit("chunks"), F.count("*")))


@register("l15_insert_unique", f"WITH {VEHICLES}, k AS (SELECT id, upper(registration_number) || '-' || (CASE WHEN id % 6 = 1 THEN 0 ELSE id % 3 END) AS r FROM vehicles), o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY id) AS o FROM k WHERE id % 3 = 1) SELECT id FROM o WHERE o = 1 AND r NOT IN (SELECT r FROM k WHERE id % 3 = 0)")
def l15(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    key = F.concat(F.upper("registration_number"), F.lit("-"), F.when(n % 6 == 1, 0).otherwise(n % 3))
    rows = I.vehicles(spark, sf_dir).select("id", key.alias("r"))
    return lifecycle.insert_unique(rows.filter("id % 3 = 0"), rows.filter("id % 3 = 1"), ["r"])[0].select("id")


@register("l22_mark_indexed", f"{RC} SELECT id, CASE WHEN id IN (SELECT doc_id FROM chunks WHERE length(text) > 500) THEN 'processed' ELSE status END AS status FROM registry")
def l22(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = I.chunks(spark, sf_dir).filter(F.length("text") > 500).select(F.col("doc_id").alias("registry_id"))
    return lifecycle.mark_indexed(I.registry_rows(spark, sf_dir).select("id", "status"), long)


@register("l20_retry_set", f"{R} SELECT id FROM registry WHERE status = 'failed'")
def l20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.registry_rows(spark, sf_dir).filter("status = 'failed'").select("id")


@register("l21_sparse_update", f"{R} SELECT id, CASE WHEN id % 4 = 1 THEN 'reviewed' ELSE status END AS status, size FROM registry")
def l21(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.registry_rows(spark, sf_dir).select("id", "status", "size")
    return lifecycle.sparse_update(rows, rows.select("id", F.when(F.col("id") % 4 == 1, "reviewed").alias("status"), F.lit(None).cast("long").alias("size")))


@register("a45_manifest_statistics", f"WITH {_SCAN} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, min(modified) AS oldest, max(modified) AS newest FROM scan")
def a45(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir)[0].agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("modified").alias("oldest"), F.max("modified").alias("newest"))


@register("f52_missing_causes", "SELECT CASE WHEN n_chars = 0 THEN 'EMPTY' WHEN n_chars > 8000 THEN 'TOO_LARGE' WHEN lang NOT IN ('en', 'fr') THEN 'UNSUPPORTED' ELSE 'PIPELINE_FAILURE' END AS cause, count(*) AS n FROM documents GROUP BY 1")
def f52(spark: SparkSession, sf_dir: str) -> DataFrame:
    cause = lifecycle.missing_cause(F.col("n_chars"), F.col("lang"), ["en", "fr"], 8000)
    return read(spark, sf_dir, "documents").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@register("e07_field_coverage", f"WITH {CHUNKS} SELECT file_name, field, bool_or(contains(lower(text), value)) AS found FROM chunks, (VALUES ('a', 'the'), ('b', 'der')) AS f(field, value) GROUP BY ALL")
def e07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.field_coverage(I.chunks(spark, sf_dir), {"a": "the", "b": "der"})


@register("e08_expected_documents", f"WITH {CHUNKS} SELECT coalesce(a.lang, b.lang) AS lang, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found, coalesce(found, 0) - coalesce(expected, 0) AS delta FROM (SELECT lang, count(*) AS expected FROM documents GROUP BY 1) a FULL OUTER JOIN (SELECT file_type AS lang, count(DISTINCT doc_id) AS found FROM chunks WHERE length(text) > 200 GROUP BY 1) b ON a.lang = b.lang")
def e08(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.chunks(spark, sf_dir).filter(F.length("text") > 200).groupBy(F.col("file_type").alias("lang")).agg(F.countDistinct("doc_id").alias("found"))
    return evaluate.compare_counts(found, read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("expected")), "lang")


@register("a38_error_counts", f"{E} SELECT event_type, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM ev GROUP BY 1")
def a38(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@register("t03_error_windows", f"{E} SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM ev GROUP BY ALL")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = error_rates(read(spark, sf_dir, "events"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@register("s11_log_kinds", "SELECT CASE WHEN contains(lower(text), 'critical') OR contains(lower(text), 'fatal') THEN 'critical' WHEN contains(lower(text), 'modulenotfound') OR contains(lower(text), 'importerror') THEN 'dependency' WHEN contains(lower(text), 'error') OR contains(lower(text), 'failed') THEN 'error' WHEN contains(lower(text), 'warning') THEN 'warning' ELSE 'info' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(files.log_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@register("s12_run_metrics", f"{E} SELECT user_id AS run, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view FROM (SELECT user_id, event_type, round(value, 4) AS value FROM ev) GROUP BY 1")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.format_string("%s: %.6f", "event_type", F.round("value", 4)).alias("line"))
    return files.run_metrics(rows, ["click", "view"])


@register(
    "l17_retention",
    """WITH t AS (SELECT event_id AS task_id, CAST(ts AS TIMESTAMP) AS ended, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'completed' END AS state FROM events),
a AS (SELECT *, (floor(epoch((SELECT max(ended) FROM t))) - floor(epoch(ended))) / 3600 AS age FROM t WHERE ended IS NOT NULL)
SELECT task_id, state FROM (SELECT task_id, state FROM a WHERE age <= CASE WHEN state = 'completed' THEN 24 ELSE 72 END ORDER BY ended DESC, task_id LIMIT 100)
UNION ALL SELECT task_id, state FROM t WHERE ended IS NULL""",
)
def l17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.col("ts").alias("finished_at"), F.when(F.pmod("event_id", F.lit(3)) == 0, "failed").otherwise("completed").alias("state"))
    latest = rows.agg(F.max("finished_at").alias("as_of"))
    joined = rows.join(F.broadcast(latest))  # one row
    return lifecycle.retained(joined, F.col("as_of")).select("task_id", "state")


@register("a33_key_census", "SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def a33(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.explode(F.json_object_keys("props"))
    return read(spark, sf_dir, "events").select(keys.alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@register("p01_json_field", "SELECT json_extract_string(props, '$.' || (json_keys(props))[1]) IS NOT NULL AS has_first, count(*) AS n FROM events GROUP BY 1")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    first = F.col("m")[F.json_object_keys("props")[0]]
    return rows.groupBy(first.isNotNull().alias("has_first")).agg(F.count("*").alias("n"))


@register("a23_recent_activity", f"{E} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM ev GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(5)


@register("o08_task_history", f"{E}, w AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM ev) SELECT event_id, CAST(date_diff('second', before, ts) AS BIGINT) AS seconds FROM w WHERE before IS NOT NULL ORDER BY ts DESC, event_id LIMIT 50")
def o08(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = read(spark, sf_dir, "events").withColumn("before", before).filter("before IS NOT NULL")
    gap = F.unix_timestamp("ts") - F.unix_timestamp("before")
    return rows.select("event_id", gap.alias("seconds"), "ts").orderBy(F.desc("ts"), "event_id").limit(50).drop("ts")


@register("a28_snapshot_sets", f"{R} SELECT document_type, count(DISTINCT vrn) AS vrns, count(DISTINCT vehicle_id) AS vehicles, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM registry GROUP BY 1")
def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.registry_rows(spark, sf_dir).groupBy("document_type").agg(F.countDistinct("vrn").alias("vrns"), F.countDistinct("vehicle_id").alias("vehicles"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"))


@register("a35_document_text", f"WITH {CHUNKS} SELECT doc_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS hash FROM chunks GROUP BY 1")
def a35(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"])
    rows = I.chunks(spark, sf_dir).groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("text"))
    return rows.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"))
