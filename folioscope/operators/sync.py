"""Change detection and sync decisions over tables of mappings, states and revisions.

All decisions are equi-joins on the document key; contents are hashed where they are read, so only short
columns are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators.ranks import ranked


def with_hash(docs: DataFrame) -> DataFrame:
    """doc_id and sha, the SHA-256 of content."""
    return docs.select("doc_id", F.sha2("content", 256).alias("sha"))


def sync_action(mappings: DataFrame, state: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """doc_id, local, action of every mapping.

    error (no remote version), first-sync (no state), up-to-date, fast-forward (remote changed), local-only (local
    changed) or merged (both). Versions are compared for equality only; a local file that is absent is no change.
    """
    s = state.select("doc_id", "local_hash", F.col("remote_version").alias("seen"), F.lit(True).alias("known"))
    df = mappings.join(s, "doc_id", "left").join(local.select("doc_id", "sha"), "doc_id", "left").join(remote.select("doc_id", "version"), "doc_id", "left")
    remote_changed = ~F.col("version").eqNullSafe(F.col("seen"))
    local_changed = F.col("sha").isNotNull() & (F.col("sha") != F.col("local_hash"))
    action = (
        F.when(F.col("version").isNull(), "error").when(F.col("known").isNull(), "first-sync").when(~remote_changed & ~local_changed, "up-to-date")
        .when(~local_changed, "fast-forward").when(~remote_changed, "local-only").otherwise("merged")
    )
    return df.select("doc_id", "local", action.alias("action"))


def section_sync_action(theirs: DataFrame, state: DataFrame, local: DataFrame) -> DataFrame:
    """doc_id, filename, action of every pulled section; here the remote side changed if its hash is not the base hash."""
    t = theirs.select("doc_id", "filename", F.col("sha").alias("their_sha"))
    s = state.select("doc_id", "filename", "base_hash", "local_hash", F.lit(True).alias("known"))
    df = t.join(s, ["doc_id", "filename"], "left").join(local.select("doc_id", "filename", "sha"), ["doc_id", "filename"], "left")
    remote_changed = F.col("their_sha") != F.col("base_hash")
    local_changed = F.col("sha").isNotNull() & (F.col("sha") != F.col("local_hash"))
    action = F.when(F.col("known").isNull(), "first-sync").when(~remote_changed & ~local_changed, "up-to-date").when(~local_changed, "fast-forward").when(~remote_changed, "local-only").otherwise("merged")
    return df.select("doc_id", "filename", action.alias("action"))


def section_rollup(sections: DataFrame) -> DataFrame:
    """A document's action from those of its sections: merged, first-sync if all written are new, fast-forward, up-to-date."""
    written = F.col("action").isin("first-sync", "fast-forward", "merged")
    counts = sections.groupBy("doc_id").agg(F.count_if(F.col("action") == "merged").alias("merged"), F.count_if(written).alias("written"), F.count_if(F.col("action") == "first-sync").alias("new"))
    action = F.when(F.col("merged") > 0, "merged").when((F.col("written") > 0) & (F.col("written") == F.col("new")), "first-sync").when(F.col("written") > 0, "fast-forward").otherwise("up-to-date")
    return counts.select("doc_id", action.alias("action"), "written")


def run_summary(actions: DataFrame, run: str) -> DataFrame:
    """success, conflict, error and skipped totals of each run; an unknown status counts as an error."""
    status = F.when(F.col("status").isin("success", "conflict", "skipped"), F.col("status")).otherwise("error")
    return actions.groupBy(run).agg(*[F.count_if(status == s).alias(s) for s in ("success", "conflict", "error", "skipped")])


def state_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old rows without a successor, and the new rows with status ok or warning."""
    accepted = new.where(F.col("status").isin("ok", "warning")).drop("status")
    return old.join(accepted.select(key), key, "left_anti").unionByName(accepted)


def new_blobs(contents: DataFrame, store: DataFrame) -> DataFrame:
    """sha and content of what a write-once store lacks, each once."""
    rows = contents.select(F.sha2("content", 256).alias("sha"), "content")
    return rows.join(store.select("sha"), "sha", "left_anti").dropDuplicates(["sha"])


def read_blobs(keys: DataFrame, store: DataFrame) -> DataFrame:
    """keys with the content of their sha, empty where the store has none."""
    return keys.join(store, "sha", "left").withColumn("content", F.coalesce("content", F.lit("")))


def select_mappings(mappings: DataFrame, files: DataFrame) -> DataFrame:
    """file and the first mapping (by order) that is the file itself, or is sectioned and holds it.

    A sectioned mapping is found by each of the file's parent folders, so the join has an equality to hash on.
    """
    parts = F.split("file", "/")
    parents = files.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("local"))
    found = parents.join(mappings, "local").where((F.col("local") == F.col("file")) | F.col("sectioned"))
    first = found.groupBy("file").agg(F.min(F.struct("doc_id", "local", "direction")).alias("m"))
    return first.select("file", "m.*")


def section_renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sections with one heading id and another filename: renumbered if the slug is the same, else renamed.

    Blank ids match nothing; of several sections with one id the last counts.
    """
    last = lambda m, p: m.where("heading_id <> ''").groupBy("doc_id", "heading_id").agg(F.max_by(F.struct("slug", "filename"), "pos").alias(p))
    both = last(old, "o").join(last(new, "n"), ["doc_id", "heading_id"]).where("o.filename <> n.filename")
    return both.select("doc_id", "heading_id", F.col("o.filename").alias("old_name"), F.col("n.filename").alias("new_name"), F.when(F.col("o.slug") == F.col("n.slug"), "renumbered").otherwise("renamed").alias("kind"))


def orphan_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old sections whose heading id is blank or not in the new manifest."""
    known = new.where("heading_id <> ''").select("doc_id", "heading_id").distinct()
    return old.join(known, ["doc_id", "heading_id"], "left_anti").select("doc_id", "pos", "heading_id", "filename")


def section_set_diff(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """doc_id, filename, status: added (not in the manifest), deleted (not present) or kept."""
    m, p = (x.select("doc_id", "filename").distinct().withColumn(k, F.lit(True)) for x, k in ((manifest, "m"), (present, "p")))
    return m.join(p, ["doc_id", "filename"], "full").select("doc_id", "filename", F.when(F.col("m").isNull(), "added").when(F.col("p").isNull(), "deleted").otherwise("kept").alias("status"))


def push_order(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Place of each present file: manifest order first, then files that the manifest lacks, by name."""
    m = manifest.groupBy("doc_id", "filename").agg(F.min("pos").alias("mpos"))
    df = present.select("doc_id", "filename").distinct().join(m, ["doc_id", "filename"], "left")
    return df.select("doc_id", "filename", F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("mpos").asc_nulls_last(), "filename")).alias("place"))


def file_moves(tracked: DataFrame, current: DataFrame) -> DataFrame:
    """Tracked paths (status not deleted) that are no longer there: renamed to an untracked path of the same base name, else deleted.

    One new path takes one old path; both sides are dealt in order of path. Ranks are counted by ranges of paths, so that a base
    name that most files share is in no one task.
    """
    name = F.element_at(F.split("path", "/"), -1)
    gone = tracked.where("status <> 'deleted'").join(current.select("path"), "path", "left_anti").select("path", name.alias("name"))
    fresh = current.select("path").distinct().join(tracked.select("path"), "path", "left_anti").select(F.col("path").alias("new_path"), name.alias("name"))
    gone, fresh = ranked(gone, ["name"], ["path"]), ranked(fresh, ["name"], ["new_path"])
    return gone.join(fresh, ["name", "k"], "left").select("path", "new_path", F.when(F.col("new_path").isNull(), "deleted").otherwise("renamed").alias("change"))


def tracked_path_diff(tracked: DataFrame, current: DataFrame) -> DataFrame:
    return tracked.select("path").exceptAll(current.select("path")).distinct()


def apply_resolutions(conflicts: DataFrame, choices: DataFrame) -> DataFrame:
    """doc_id, status, content by each choice: remote, local (backup, else base) or merged (refused while markers remain).

    A choice for a document that is not tracked is an error.
    """
    df = choices.join(conflicts, "doc_id", "left")
    marked = F.col("merged").rlike("(?m)^<<<<<<< ")
    status = F.when(F.col("merged").isNull(), "error").when((F.col("strategy") == "merged") & marked, "rejected").otherwise("resolved")
    content = F.when(status != "resolved", None).when(F.col("strategy") == "remote", F.col("remote")).when(F.col("strategy") == "local", F.coalesce("backup", F.nullif("base", F.lit("")))).otherwise(F.col("merged"))
    return df.select("doc_id", "strategy", status.alias("status"), content.alias("content"))


def mapping_violations(mappings: DataFrame) -> DataFrame:
    """One row for each rule that a mapping breaks."""
    level = F.col("split_level")
    rules = [
        F.when(level.isNotNull() & ~level.rlike("^HEADING_[1-6]$"), "split_level"),
        F.when(F.col("sectioned") & level.isNull(), "sectioned_without_level"),
        F.when(~F.col("sectioned") & level.isNotNull(), "level_without_sectioned"),
        F.when(F.col("sectioned") & (F.col("backend") == "b2"), "backend_lacks_sections"),
        F.when(F.col("local").startswith("/"), "absolute_path"),
        F.when(F.concat(F.lit("/"), F.col("local"), F.lit("/")).contains("/../"), "escapes_folder"),
    ]
    return mappings.select("doc_id", F.explode(F.array_compact(F.array(*rules))).alias("violation"))


def quote_violations(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, violation: a block is a quote exactly if its quote depth is above 0; null counts as no quote, and as depth 0."""
    quote, depth = F.coalesce("is_blockquote", F.lit(False)), F.coalesce("quote_depth", F.lit(0))
    return blocks.where(quote != (depth > 0)).select("doc_id", "pos", F.when(quote, "quote_without_depth").otherwise("depth_without_quote").alias("violation"))
