"""Snapshot differences: which files of which repositories changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators.ranking import spread_row_number

# Status letters of a change set.
ADDED, MODIFIED, DELETED, RENAMED = "A", "M", "D", "R"


def signatures(files: DataFrame) -> DataFrame:
    """``(repo_id, path, hash)``; only this narrow table is ever shuffled for a diff.

    A file without content is there, too, and has an empty hash.
    """
    return files.select("repo_id", "path", F.coalesce(F.sha2(F.col("content"), 256), F.lit("")).alias("hash"))


def diff_signatures(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes ``(repo_id, path, status, old_path)`` from one signature table to the next.

    A rename is an added file with the content of a deleted one. Several copies
    of one content are paired one to one in a fixed order.
    """
    old = before.select("repo_id", "path", F.col("hash").alias("old_hash"))
    new = after.select("repo_id", "path", F.col("hash").alias("new_hash"))
    both = old.join(new, ["repo_id", "path"], "full_outer").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    kind = F.when(F.col("old_hash").isNull(), ADDED).when(F.col("new_hash").isNull(), DELETED).otherwise(MODIFIED)
    sides = both.select("repo_id", "path", kind.alias("kind"), F.coalesce("new_hash", "old_hash").alias("hash"))
    # The n-th added and the n-th deleted copy of a content meet in one group of two.
    numbered = spread_row_number(sides, ["repo_id", "hash", "kind"], "path")

    def path_of(letter: str) -> Column:
        return F.max(F.when(F.col("kind") == letter, F.col("path")))

    pairs = numbered.groupBy("repo_id", "hash", (F.col("kind") == MODIFIED).alias("_changed"), "nth").agg(
        path_of(MODIFIED).alias("_modified"), path_of(ADDED).alias("_added"), path_of(DELETED).alias("_deleted")
    )
    status = (
        F.when(F.col("_changed"), MODIFIED)
        .when(F.col("_deleted").isNull(), ADDED)
        .when(F.col("_added").isNull(), DELETED)
        .otherwise(RENAMED)
    )
    return pairs.select(
        "repo_id",
        F.coalesce("_modified", "_added", "_deleted").alias("path"),
        status.alias("status"),
        F.when(F.col("_added").isNotNull(), F.col("_deleted")).alias("old_path"),
    )


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    return diff_signatures(signatures(before), signatures(after))


def summary(changes: DataFrame) -> DataFrame:
    """Counts per repository; nothing to do only where all four are zero."""
    def n(letter: str, name: str) -> Column:
        return F.count_if(F.col("status") == letter).alias(name)

    return changes.groupBy("repo_id").agg(
        n(ADDED, "added"), n(MODIFIED, "modified"), n(DELETED, "deleted"), n(RENAMED, "renamed")
    )


def has_changes(counts: DataFrame) -> DataFrame:
    total = F.col("added") + F.col("modified") + F.col("deleted") + F.col("renamed")
    return counts.withColumn("has_changes", total > 0)


def to_process(changes: DataFrame) -> DataFrame:
    """Paths whose new content has to be read: added, modified and the new side of renames."""
    return changes.where(F.col("status") != DELETED).select("repo_id", "path", "status")


def removed_paths(changes: DataFrame) -> DataFrame:
    """Paths whose stored rows have to go: deleted, modified and the old side of renames."""
    return (
        changes.withColumn("path", F.when(F.col("status") == RENAMED, F.col("old_path")).otherwise(F.col("path")))
        .where(F.col("status") != ADDED)
        .select("repo_id", "path")
    )


def apply_deletes(stored: DataFrame, changes: DataFrame, path: str = "file_path") -> DataFrame:
    """Stored rows without those of removed or replaced files."""
    gone = removed_paths(changes).withColumnRenamed("path", path)
    return stored.join(gone, ["repo_id", path], "left_anti")


def parse_name_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """Text lines ``status TAB path [TAB new path]`` as a change set; other codes are ignored."""
    parts = F.split(F.col(line), "\t")
    letter = F.substring(parts[0], 1, 1)
    renamed = F.coalesce(F.nullif(F.try_element_at(parts, F.lit(3)), F.lit("")), parts[1])
    return (
        lines.where(F.size(parts) >= 2)
        .where(letter.isin(ADDED, MODIFIED, DELETED, RENAMED))
        .select(
            *[c for c in lines.columns if c != line],
            F.when(letter == RENAMED, renamed).otherwise(parts[1]).alias("path"),
            letter.alias("status"),
            F.when(letter == RENAMED, parts[1]).alias("old_path"),
        )
    )


def parse_listing(listings: DataFrame, listing: str = "listing") -> DataFrame:
    """One row per non-empty line of a file listing."""
    rest = [c for c in listings.columns if c != listing]
    return listings.select(*rest, F.explode(text.split_lines(F.col(listing))).alias("path"))
