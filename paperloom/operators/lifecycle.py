"""Registry, upsert, incremental plans and state transitions, each from tables to a new table.

Nothing is updated in place: an operator returns the next version of a table, and
``sinks.write_version`` swaps it in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Allowed moves between states.
STORAGE_MOVES = {"pending": ("processing",), "processing": ("processed", "failed"), "processed": ("indexed", "processing"), "failed": ("pending", "processing"), "indexed": ("processing",)}
DOCUMENT_MOVES = {
    "uploaded": ("pending_ocr", "processed", "failed"),
    "pending_ocr": ("processed", "failed"),
    "processed": ("pending_assignment", "unassigned", "assigned"),
    "pending_assignment": ("assigned", "unassigned"),
    "unassigned": ("assigned", "pending_assignment"),
    "assigned": ("unassigned",),
    "failed": ("uploaded",),
}


def normal_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def latest(rows: DataFrame, key: str, newest: list[Column]) -> DataFrame:
    """Of the rows of each key the first by ``newest``."""
    order = Window.partitionBy(key).orderBy(*newest)
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def upsert(current: DataFrame, incoming: DataFrame, key: str, newest: list[Column]) -> DataFrame:
    """Rows of both by key, incoming before current; of incoming rows of one key the first by ``newest``.

    Two anti/aggregate steps instead of a window over all rows: only the incoming rows are ranked.  A table that is to be changed
    in place is kept as a ``BucketTable``, which reads and writes no more than the buckets of the incoming keys.
    """
    fresh = latest(incoming, key, newest)
    return current.join(fresh.select(key).hint("merge"), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_chunks(current: DataFrame, incoming: DataFrame, newest: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(next chunk table, rows refused for want of a registry id)."""
    good = incoming.filter("registry_id IS NOT NULL")
    return upsert(current, good, "chunk_id", newest), incoming.filter("registry_id IS NULL")


def change_set(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and change (new, modified, unchanged, deleted): by hash where both have one, else by size and time."""
    a, b = scan.alias("a"), manifest.alias("b")
    same = F.when(F.col("a.hash").isNotNull() & F.col("b.hash").isNotNull(), F.col("a.hash") == F.col("b.hash")).otherwise(F.col("a.size").eqNullSafe(F.col("b.size")) & F.col("a.modified").eqNullSafe(F.col("b.modified")))
    change = F.when(F.col("b.path").isNull(), "new").when(F.col("a.path").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return a.join(b.hint("merge"), F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), change.alias("change"))


def index_plan(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, action) by the stored original hash: index, skip, or delete_then_index (also where no hash is stored)."""
    known = stored.select("path", F.col("hash").alias("stored_hash"), F.lit(True).alias("known"))
    action = F.when(F.col("known").isNull(), "index").when(F.col("stored_hash").isNull() | F.col("hash").isNull() | (F.col("stored_hash") != F.col("hash")), "delete_then_index").otherwise("skip")
    return docs.join(known.hint("merge"), "path", "left").select("path", action.alias("action"))


def already_converted(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs with an output that is newer."""
    return inputs.join(outputs.select(F.col("path").alias("out_path"), F.col("modified").alias("out_modified")).hint("merge"), "out_path").filter(F.col("out_modified") > F.col("modified"))


def missing_in_index(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files that the index has neither by normalised path nor by name: two anti joins in sequence, never one on either key."""
    by_path = files.withColumn("_p", normal_path(F.col("path"))).join(indexed.select(normal_path(F.col("file_path")).alias("_p")).distinct().hint("merge"), "_p", "left_anti")
    return by_path.join(indexed.select("file_name").distinct().hint("merge"), "file_name", "left_anti").drop("_p")


def orphans(chunks: DataFrame, keep: DataFrame) -> DataFrame:
    """Chunks whose path isn't kept; a null path is an orphan."""
    return chunks.join(keep.select("file_path").distinct().hint("merge"), "file_path", "left_anti")


def missing_cause(size: Column, extension: Column, supported: list[str], max_bytes: int = 50 << 20) -> Column:
    return F.when(size == 0, "EMPTY").when(size > max_bytes, "TOO_LARGE").when(~F.lower(extension).isin(*supported), "UNSUPPORTED").otherwise("PIPELINE_FAILURE")


def delete_by(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks left after deleting by document id: a UUID is a registry id, anything else an original path."""
    uuid = F.regexp_like(F.col("document_id"), F.lit("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"))
    left = chunks.join(ids.filter(uuid).select(F.col("document_id").alias("registry_id")).hint("merge"), "registry_id", "left_anti")
    return left.join(ids.filter(~uuid).select(F.col("document_id").alias("original_path")).hint("merge"), "original_path", "left_anti")


def cascade_delete(registry: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return registry.join(ids.hint("merge"), "id", "left_anti"), chunks.join(ids.withColumnRenamed("id", "registry_id").hint("merge"), "registry_id", "left_anti")


def upload_actions(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """file_name, action: duplicate (same content is there), replace (same name, other content), or insert.

    Equal contents within the upload count once: the first by name is judged, the others are duplicates.
    """
    hashes = registry.groupBy(F.col("file_hash").alias("h")).agg(F.min("id").alias("same_content"))
    names = registry.groupBy(F.col("original_filename").alias("n")).agg(F.max("id").alias("same_name"))
    first = F.row_number().over(Window.partitionBy("file_hash").orderBy("file_name")) == 1
    marked = incoming.withColumn("_first", first)
    joined = marked.join(hashes.hint("merge"), F.col("file_hash") == F.col("h"), "left").join(names.hint("merge"), F.col("file_name") == F.col("n"), "left")
    action = F.when(F.col("same_content").isNotNull() | ~F.col("_first"), "duplicate").when(F.col("same_name").isNotNull(), "replace").otherwise("insert")
    return joined.select("file_name", "file_hash", action.alias("action"), F.coalesce("same_content", "same_name").alias("matched_id"))


def with_registry_id(docs: DataFrame, registry: DataFrame, path_col: str = "path") -> DataFrame:
    """``docs`` with the registry id of their normalised path; a miss gets an id made from the path's hash."""
    known = registry.groupBy(normal_path(F.col("markdown_file_path")).alias("_p")).agg(F.max_by("id", "uploaded_at").alias("_id"))
    made = F.sha2(normal_path(F.col(path_col)), 256)
    uuid = F.concat_ws("-", *(F.substring(made, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    joined = docs.withColumn("_p", normal_path(F.col(path_col))).join(known.hint("merge"), "_p", "left")
    return joined.select(*docs.columns, F.coalesce("_id", uuid).alias("registry_id"), F.col("_id").isNull().alias("is_new"))


def transition(rows: DataFrame, changes: DataFrame, moves: dict[str, tuple[str, ...]], column: str = "status") -> DataFrame:
    """``rows`` with the asked states (id, to) applied where the move is allowed; ``refused`` marks the others."""
    allowed = F.create_map(*(x for a, b in moves.items() for x in (F.lit(a), F.array(*map(F.lit, b)))))
    joined = rows.join(changes.select("id", F.col("to").alias("_to")).hint("merge"), "id", "left")
    ok = F.coalesce(F.array_contains(allowed[F.col(column)], F.col("_to")), F.lit(False))
    refused = F.col("_to").isNotNull() & ~ok
    return joined.withColumn("refused", refused).withColumn(column, F.when(ok, F.col("_to")).otherwise(F.col(column))).drop("_to")


def sparse_update(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Only what a change supplies (not null) replaces; maps are merged, the change winning."""
    shared = [c for c in changes.columns if c in rows.columns and c != key]
    joined = rows.join(changes.select(key, *(F.col(c).alias(f"_{c}") for c in shared)).hint("merge"), key, "left")
    kinds = dict(rows.dtypes)

    def merged(c: str) -> Column:
        if c not in shared:
            return F.col(c)
        if kinds[c].startswith("map"):
            old = F.map_filter(F.col(c), lambda k, _: ~F.coalesce(F.map_contains_key(F.col(f"_{c}"), k), F.lit(False)))
            return F.coalesce(F.map_concat(old, F.col(f"_{c}")), F.col(c), F.col(f"_{c}")).alias(c)
        return F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)

    return joined.select(*(merged(c) for c in rows.columns))


def link_outcomes(requests: DataFrame, registry: DataFrame, vehicles: DataFrame) -> DataFrame:
    """document_id, vehicle_id, outcome of each asked link: linked, already_linked, linked_elsewhere, no_document, no_vehicle."""
    r = registry.select(F.col("id").alias("document_id"), F.col("vehicle_id").alias("held"), F.lit(True).alias("doc"))
    v = vehicles.select(F.col("id").alias("vehicle_id"), F.lit(True).alias("veh"))
    outcome = F.when(F.col("doc").isNull(), "no_document").when(F.col("veh").isNull(), "no_vehicle").when(F.col("held").isNull(), "linked").when(F.col("held") == F.col("vehicle_id"), "already_linked").otherwise("linked_elsewhere")
    return requests.join(r.hint("merge"), "document_id", "left").join(v.hint("merge"), "vehicle_id", "left").select("document_id", "vehicle_id", outcome.alias("outcome"))


def insert_unique(current: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, refused rows): a row whose non-null key is there, or earlier in the batch, is refused."""
    marked = incoming
    for k in keys:
        there = current.filter(F.col(k).isNotNull()).select(k, F.lit(True).alias(f"_has_{k}")).distinct()
        first = F.row_number().over(Window.partitionBy(k).orderBy(*incoming.columns)) > 1
        marked = marked.join(there.hint("merge"), k, "left").withColumn(f"_bad_{k}", F.col(k).isNotNull() & (F.coalesce(f"_has_{k}", F.lit(False)) | first)).drop(f"_has_{k}")
    bad = F.lit(False)
    for k in keys:
        bad = bad | F.col(f"_bad_{k}")
    names = incoming.columns
    return marked.filter(~bad).select(*names), marked.filter(bad).select(*names)


def retained(tasks: DataFrame, as_of: Column, completed_hours: int = 24, failed_hours: int = 72, newest: int = 100) -> DataFrame:
    """Tasks that stay: running ones, and finished ones within their hours among the ``newest`` finished.

    The newest come from a top-k, so no window orders all tasks.
    """
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("finished_at")) / 3600
    done = F.col("finished_at").isNotNull()
    young = F.when(F.col("state") == "completed", age <= completed_hours).otherwise(age <= failed_hours)
    finished = tasks.filter(done & young).orderBy(F.desc("finished_at"), "task_id").limit(newest)
    return tasks.filter(~done).unionByName(finished)


def mark_indexed(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    ids = chunks.select(F.col("registry_id").alias("id")).distinct().withColumn("_has", F.lit(True))
    joined = registry.join(ids.hint("merge"), "id", "left")
    return joined.withColumn("status", F.when(F.col("_has"), "processed").otherwise(F.col("status"))).drop("_has")


def newest_by(rows: DataFrame, key: str, when: str, id_col: str = "id") -> DataFrame:
    """Of each key the newest row, as struct columns; ``max_by`` combines before the shuffle, unlike a window."""
    rest = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(when, id_col)).alias("_r"))
    return picked.select(key, "_r.*")


def group_by_vrn(registry: DataFrame, vehicles: DataFrame) -> DataFrame:
    """vrn, documents, and the vehicle of that number in any case (null: to be created)."""
    groups = registry.filter("vrn IS NOT NULL").groupBy(F.upper("vrn").alias("vrn")).agg(F.count("*").alias("documents"))
    known = vehicles.groupBy(F.upper("registration_number").alias("vrn")).agg(F.min("id").alias("vehicle_id"))
    return groups.join(known.hint("merge"), "vrn", "left")


def new_entries(docs: DataFrame) -> DataFrame:
    """Registry rows to add, from ``with_registry_id``: one for each new id."""
    return docs.filter("is_new").select(F.col("registry_id").alias("id"), F.col("path").alias("markdown_file_path")).dropDuplicates(["id"])


def apply_links(registry: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``registry`` with the links whose outcome is ``linked``; those documents become assigned.  Of several vehicles for a document the smallest id wins."""
    new = outcomes.filter("outcome = 'linked'").groupBy(F.col("document_id").alias("id")).agg(F.min("vehicle_id").alias("_v"))
    joined = registry.join(new.hint("merge"), "id", "left")
    return joined.withColumn("status", F.when(F.col("_v").isNotNull(), "assigned").otherwise(F.col("status"))).withColumn("vehicle_id", F.coalesce("_v", "vehicle_id")).drop("_v")


def unlink(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """The link becomes null and the document unassigned."""
    joined = registry.join(ids.select("id").distinct().withColumn("_u", F.lit(True)).hint("merge"), "id", "left")
    return joined.withColumn("vehicle_id", F.when(F.col("_u").isNull(), F.col("vehicle_id"))).withColumn("status", F.when(F.col("_u"), "unassigned").otherwise(F.col("status"))).drop("_u")


def reindexed(chunks: DataFrame, files: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks after deleting those of ``files`` and adding ``fresh`` ones."""
    return chunks.join(files.select("file_name").distinct().hint("merge"), "file_name", "left_anti").unionByName(fresh, allowMissingColumns=True)


def key_sets(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Which keys of two map columns are in one alone or in both."""
    x, y = F.map_keys(a), F.map_keys(b)
    return rows.select(F.array_sort(F.array_except(x, y)).alias("only_a"), F.array_sort(F.array_except(y, x)).alias("only_b"), F.array_sort(F.array_intersect(x, y)).alias("both"))


def inherit_registry(chunks: DataFrame, registry: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Chunks with the registry id of their document, null where it has none."""
    own = registry.select(F.col("id").alias(doc_col), F.col("id").cast("string").alias("registry_id"))
    return chunks.join(own.hint("merge"), doc_col, "left")


def merge_registry(chunks: DataFrame, registry: DataFrame, doc_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(chunks with their registry row's other columns, chunks refused for want of a registry row)."""
    own = registry.withColumnRenamed("id", doc_col)
    clash = [c for c in own.columns if c in chunks.columns and c != doc_col]
    return chunks.join(own.drop(*clash).hint("merge"), doc_col), chunks.join(own.select(doc_col).hint("merge"), doc_col, "left_anti")


def remove_deleted(scan: DataFrame, manifest: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next manifest, next chunks, removed paths): what the scan no longer has leaves both state and index."""
    gone = manifest.join(scan.select("path").distinct().hint("merge"), "path", "left_anti").select("path").distinct()
    return manifest.join(gone.hint("merge"), "path", "left_anti"), chunks.join(gone.hint("merge"), "path", "left_anti"), gone


def extraction_picks(registry: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Documents whose identifiers are to be extracted: the given ids, else all processed ones."""
    return registry.filter("status = 'processed'") if ids is None else registry.join(ids.select("id").distinct().hint("merge"), "id", "left_semi")
