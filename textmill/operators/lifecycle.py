"""The incremental life of an index: classification, state, issues, retries and roots.

States: path, revision, status, updated_at, source_modified_time, source_size, failure_count,
retry_after, owner (run id), started_at. All are joins and column rules over whole tables.

What empties an index or a part of it takes and gives its four tables together: files (path, file_id, extension),
chunks (file_id), state (path) and issues (path). Source files are never touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import scalar
from textmill.sources import formats

QUARANTINE_AT = 3
# Settings that make up an index's scope, and the time of its last full scan.
SCOPE = ("index_roots", "index_root", "excluded_paths", "paused_index_roots", "file_exclusion_patterns")
RECONCILED = "last_successful_reconcile_at"
GRACE_SECONDS = 5.0


def deferred(now: float) -> Column:
    """An unchanged failed file waits for its time, one set aside by hand until it changes; listing columns
    are modified_time, size, revision_now, the state's are prefixed s_."""
    same = (F.col("s_revision") >= F.col("revision_now")) & (F.col("s_modified") == F.col("modified_time")) & (F.col("s_size") == F.col("size"))
    waits = F.col("s_status").isin(*scalar.MANUAL) | (F.col("s_status").isin(*scalar.FAILURES) & (F.lit(now) < F.col("s_retry_after")))
    return F.coalesce(same & waits, F.lit(False))


def unchanged() -> Column:
    """Same time and size as indexed, an extractor not older than now's, and a status that its chunks bear out."""
    same = (F.col("i_modified") == F.col("modified_time")) & (F.col("i_size") == F.col("size")) & (F.coalesce("s_revision", F.lit(0)) >= F.col("revision_now"))
    whole = F.when(F.col("s_status") == "INDEXED", F.col("has_chunk")).when(F.col("s_status").isin("NO_TEXT", "OCR_REQUIRED"), ~F.col("has_chunk")).otherwise(F.lit(False))
    return F.coalesce(same & whole, F.lit(False))


def beside_state(listing: DataFrame, indexed: DataFrame, state: DataFrame, chunks: DataFrame, how: str = "full_outer") -> DataFrame:
    """Listing rows next to what the index and its state hold of the same path."""
    i = indexed.select("path", "file_id", F.col("modified_time").alias("i_modified"), F.col("size").alias("i_size"))
    i = with_chunk_flag(i, chunks)
    s = state.select("path", F.col("revision").alias("s_revision"), F.col("status").alias("s_status"), F.col("source_modified_time").alias("s_modified"), F.col("source_size").alias("s_size"), F.col("retry_after").alias("s_retry_after"))
    seen = listing.select("path", "modified_time", "size", formats.revision(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("revision_now"))
    return seen.join(i, "path", how).join(s, "path", "left").withColumn("has_chunk", F.coalesce("has_chunk", F.lit(False)))


def with_chunk_flag(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """files with has_chunk: whether any chunk of the file is stored."""
    some = chunks.select("file_id").distinct().withColumn("has_chunk", F.lit(True))
    return files.join(some, "file_id", "left").withColumn("has_chunk", F.coalesce("has_chunk", F.lit(False)))


def classify(listing: DataFrame, indexed: DataFrame, state: DataFrame, chunks: DataFrame, now: float, most: int = 200 << 20) -> DataFrame:
    """(path, action): new, changed, unchanged, deferred, oversize, or missing for what is no longer listed."""
    found = beside_state(listing, indexed, state, chunks)
    action = F.when(F.col("size").isNull(), "missing").when(F.col("size") > most, "oversize").when(deferred(now), "deferred").when(unchanged(), "unchanged").when(F.col("file_id").isNull(), "new").otherwise("changed")
    return found.select("path", action.alias("action"))


def update_precise(listing: DataFrame, indexed: DataFrame, state: DataFrame, chunks: DataFrame, paths: DataFrame, most: int = 200 << 20) -> DataFrame:
    """As classify, for the given paths only; back-off does not hold, a path that is gone is missing."""
    found = beside_state(listing, indexed, state, chunks).join(paths, "path", "left_semi")
    action = F.when(F.col("size").isNull(), "missing").when(F.col("size") > most, "oversize").when(unchanged(), "unchanged").when(F.col("file_id").isNull(), "new").otherwise("changed")
    return found.select("path", action.alias("action"))


def in_scope(root: str) -> Column:
    """Paths below a root as a range, which Parquet's statistics can skip by."""
    return (F.col("path") >= root + "/") & (F.col("path") < root + "0")


def missing_under(indexed: DataFrame, seen: DataFrame, root: str) -> DataFrame:
    return indexed.where(formats.under(F.col("path"), F.lit(root))).join(seen, "path", "left_anti")


def record_failures(failed: DataFrame, state: DataFrame, now: float) -> DataFrame:
    """New state rows of failed files (path, error_code, modified_time, size): the count goes on while the source
    and the extractor are the same."""
    previous = state.select("path", F.col("revision").alias("r"), F.col("status").alias("s"), F.col("source_modified_time").alias("m"), F.col("source_size").alias("z"), F.col("failure_count").alias("c"))
    rev = formats.revision(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    same = F.col("s").isin("FAILED", "TIMEOUT", "EXTRACTING", *scalar.MANUAL) & (F.col("r") == rev) & (F.col("m") == F.col("modified_time")) & (F.col("z") == F.col("size"))
    out = failed.join(previous, "path", "left").withColumns({"revision": rev, "status": scalar.status_of_error("error_code")})
    out = out.withColumn("failure_count", F.when(F.coalesce(same, F.lit(False)), F.col("c") + 1).otherwise(1))
    wait = F.when(F.col("status").isin(*scalar.MANUAL), 0.0).otherwise(F.lit(now) + scalar.retry_delay("status", "failure_count"))
    return out.select("path", "revision", "status", F.lit(now).alias("updated_at"), F.col("modified_time").alias("source_modified_time"), F.col("size").alias("source_size"), "failure_count", wait.alias("retry_after"))


def recover(state: DataFrame, alive: DataFrame, now: float) -> DataFrame:
    """States left EXTRACTING by a run that is gone (or without a run and old) are INTERRUPTED, the third time QUARANTINED."""
    living = alive.select(F.col("owner"), F.lit(True).alias("lives"))
    out = state.join(living, "owner", "left")
    old = F.lit(now) - F.coalesce("started_at", "updated_at", F.lit(0.0)) > GRACE_SECONDS
    left = (F.col("status") == "EXTRACTING") & F.when(F.col("owner").isNull(), old).otherwise(F.col("lives").isNull())
    tries = F.coalesce("failure_count", F.lit(0)) + 1
    return out.where(left).select("path", F.when(tries >= QUARANTINE_AT, "QUARANTINED").otherwise("INTERRUPTED").alias("status"), tries.alias("failure_count"))


Tables = dict[str, DataFrame]


def _without(tables: Tables, gone: Column, gone_issue: Column) -> Tables:
    """The tables without the files that a condition over files names, and without issues of another."""
    files = tables["files"].where(gone).select("path", "file_id")
    return {
        "files": tables["files"].where(~gone),
        "chunks": tables["chunks"].join(files.select("file_id"), "file_id", "left_anti"),
        "state": tables["state"].join(files.select("path"), "path", "left_anti"),
        "issues": tables["issues"].where(~gone_issue),
    }


def purge_root(tables: Tables, root: str) -> Tables:
    """Nothing below the root is left, issues of files that were never indexed included."""
    below = formats.under(F.col("path"), F.lit(root))
    return _without(tables, below, below)


def disable_formats(tables: Tables, enabled: tuple[str, ...]) -> Tables:
    """Files of formats that are not enabled go, whatever their root; issues only where the format is a known one."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    off = sorted(set(formats.FORMATS) - set(enabled))
    return _without(tables, ~F.lower("extension").isin(*enabled), extension.isin(*off))


def clear(tables: Tables, settings: DataFrame) -> tuple[Tables, DataFrame]:
    """All tables empty; of the settings (key, value) only the time of the last scan goes."""
    return {name: t.where(F.lit(False)) for name, t in tables.items()}, settings.where(F.col("key") != RECONCILED)


def reset(tables: Tables, settings: DataFrame) -> tuple[Tables, DataFrame]:
    """As clear, and the scope goes too; other preferences stay."""
    empty, rest = clear(tables, settings)
    return empty, rest.where(~F.col("key").isin(*SCOPE))


def guard_sources(extracted: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """extracted: path, modified_time and size as they were when reading began. Those that a later listing shows
    unchanged may be published; the others (changed or gone meanwhile) come back as PENDING states."""
    now = listing.select("path", F.col("modified_time").alias("_time"), F.col("size").alias("_size"))
    beside = extracted.join(now, "path", "left")
    same = F.coalesce((F.col("_time") == F.col("modified_time")) & (F.col("_size") == F.col("size")), F.lit(False))
    return beside.where(same).select(*extracted.columns), beside.where(~same).select("path", F.lit("PENDING").alias("status"))


def cancel(state: DataFrame, issues: DataFrame, paths: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """A stopped job: the given paths that are EXTRACTING are PENDING again, without a failure or a wait, and their
    issues go. States of other paths and other statuses stay as they are."""
    asked = paths.select("path").distinct().withColumn("_asked", F.lit(True))
    beside = state.join(asked, "path", "left")
    hit = F.col("_asked").isNotNull() & (F.col("status") == "EXTRACTING")
    new = {"status": F.lit("PENDING"), "updated_at": F.lit(now), "retry_after": F.lit(0.0), "owner": F.lit(None).cast("string"), "started_at": F.lit(None).cast("double")}
    out = beside.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in state.columns])
    return out, issues.join(beside.where(hit).select("path"), "path", "left_anti")


def health(tables: Tables, settings: DataFrame) -> DataFrame:
    """One row: files, their bytes, roots by state, issues and the last full scan, out of the tables and settings."""
    held = F.map_from_entries(F.collect_list(F.struct("key", "value")))
    lists = lambda key: F.coalesce(F.from_json(F.element_at("s", key), "array<string>"), F.array().cast("array<string>"))
    roots = settings.agg(held.alias("s")).select(lists("index_roots").alias("roots"), lists("paused_index_roots").alias("paused"), F.element_at("s", RECONCILED).cast("double").alias("last_reconcile"))
    counted = roots_state(roots).select(F.size("active").alias("active_roots"), F.size("paused").alias("paused_roots"))
    files = tables["files"].agg(F.count("*").alias("indexed_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("storage_bytes"))
    # one row each
    out = files.crossJoin(F.broadcast(tables["issues"].agg(F.count("*").alias("issue_count")))).crossJoin(F.broadcast(counted)).crossJoin(F.broadcast(roots.select("last_reconcile")))
    return out.withColumn("total_roots", F.col("active_roots") + F.col("paused_roots"))


def upsert(old: DataFrame, new: DataFrame, key: str = "path", at: str = "updated_at") -> DataFrame:
    """The last row of each key by its time; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    fields = [c for c in old.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(at, "_new")).alias("v"))
    return last.select(key, *[F.col(f"v.{c}").alias(c) for c in fields])


def replace_documents(chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks with all those of the changed files replaced by the new ones."""
    return chunks.join(changed.select("file_id").distinct(), "file_id", "left_anti").unionByName(changed)


def prune_issues(issues: DataFrame, existing: DataFrame, root: str) -> DataFrame:
    """Issues without those under the root whose file is gone; a denied file may look gone, so those stay."""
    stale = issues.where(formats.under(F.col("path"), F.lit(root)) & ~F.col("error_code").isin("permission_denied", "os_error")).join(existing, "path", "left_anti")
    return issues.join(stale.select("path"), "path", "left_anti")


def containing_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths with the most specific of `roots` (root) that holds them, or null."""
    parts = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    found = paths.select("path", F.explode(parents).alias("root")).join(roots, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(found, "path", "left")


def retry_plan(issues: DataFrame, roots: DataFrame) -> DataFrame:
    """(kind, path): file for a precise retry, rescan for a root, skipped outside active roots. Files
    under a root that is rescanned anyway are left out."""
    placed = containing_root(issues.select("path").distinct(), roots)
    known = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*formats.FORMATS)
    kind = F.when(F.col("root").isNull(), "skipped").when(known, "file").otherwise("rescan")
    planned = placed.withColumn("kind", kind)
    rescans = planned.where("kind = 'rescan'").select("root").distinct()
    files = planned.where("kind = 'file'").select("path")
    covered = containing_root(files, rescans).where("root IS NOT NULL").select("path")
    return (
        files.join(covered, "path", "left_anti").select(F.lit("file").alias("kind"), "path")
        .unionByName(rescans.select(F.lit("rescan").alias("kind"), F.col("root").alias("path")))
        .unionByName(planned.where("kind = 'skipped'").select("kind", "path"))
    )


def roots_state(settings: DataFrame) -> DataFrame:
    """roots and configured pauses (arrays) as paused and active roots, in the roots' order."""
    paused = F.array_intersect("roots", "paused")
    return settings.select(paused.alias("paused"), F.array_except("roots", paused).alias("active"))


def record_history(states: DataFrame, most: int = 20) -> DataFrame:
    """states (query, extension, sort_mode, at): each once, latest first, at most `most`. One short list."""
    keys = ["query", "extension", "sort_mode"]
    latest = states.groupBy(*keys).agg(F.max("at").alias("at"))
    top = latest.orderBy(F.col("at").desc(), *keys).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("at").desc(), *keys)))


def index_stats(actions: DataFrame) -> DataFrame:
    """Counters of one scan."""
    count = lambda *names: F.count_if(F.col("action").isin(*names))
    return actions.agg(count("new", "changed", "unchanged", "deferred", "oversize").alias("scanned"), count("new", "changed").alias("to_index"), count("unchanged").alias("unchanged"), count("deferred", "oversize").alias("skipped"), count("missing").alias("removed"))
