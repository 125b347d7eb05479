"""Ingestion: requests, and corpus snapshots into searchable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle import schemas
from corpuscle.functions import meta, moment, url, validate
from corpuscle.functions import path as P
from corpuscle.operators import embed as E
from corpuscle.operators import keysets, snapshots, tables
from corpuscle.operators.ranking import attach
from corpuscle.operators.chunking import blocks, prose
from corpuscle.operators.chunking.languages import EXTENSIONS
from corpuscle.session import written
from corpuscle.sources.store import Table

# What an ingestion request gets where it names nothing.
DEFAULT_REF = "main"
DEFAULT_USER = "system"


def requests(raw: DataFrame, now: Column) -> DataFrame:
    """Validated ingestion requests with defaults, a repository id and a queueing time."""
    derived = url.repo_id(F.col("repo_url"))
    errors = F.concat(
        validate.ingest_request(
            F.col("repo_url"), F.col("ref"), F.col("token"), F.col("user_id"), F.col("repo_id"), F.col("meta")
        ),
        F.array_compact(
            F.array(
                F.when(F.coalesce("repo_id", derived).isNull(), F.lit("repoIdFromUrl")),
                F.when(~url.is_git_url(F.col("repo_url")), F.lit("gitUrl")),
            )
        ),
    )
    return raw.withColumns(
        {
            "errors": errors,
            "repo_id": F.coalesce("repo_id", derived),
            "ref": F.coalesce("ref", F.lit(DEFAULT_REF)),
            "user_id": F.coalesce(F.nullif("user_id", F.lit("")), F.lit(DEFAULT_USER)),
            "meta": F.coalesce("meta", F.lit("{}")),
            "queued_at": moment.iso8601(now),
            "status": F.lit("queued"),
        }
    ).drop("token")


class Corpus:
    """The stored tables of a corpus under one root folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        def table(name: str, schema: str, key: list[str]) -> Table:
            return Table(spark, f"{root}/{name}", schema, key, buckets)

        self.spark = spark
        self.signatures = table("signatures", schemas.SIGNATURES, ["repo_id", "path"])
        self.parents = table("parents", schemas.PARENTS, ["repo_id", "id"])
        self.chunks = table("chunks", schemas.CHUNKS, ["repo_id", "file_path"])
        self.states = table("states", schemas.REPO_STATES, ["repo_url"])
        self.commits = table("commits", schemas.COMMITS, ["stream"])


def repo_states(requested: DataFrame, states: DataFrame) -> DataFrame:
    """State of each requested repository; a new one gets an id from its URL and no snapshot."""
    known = requested.select("repo_url", "repo_id").join(states, "repo_url", "left")
    return known.select(
        F.coalesce("id", "repo_id", F.substring(F.sha2("repo_url", 256), 1, 26)).alias("id"),
        "repo_url",
        F.coalesce("local_path", F.concat(F.lit("repos/"), "repo_id")).alias("local_path"),
        "last_processed_snapshot",
    )


def commit_states(states: DataFrame, done: DataFrame) -> DataFrame:
    """States with the snapshot ``(repo_url, snapshot)`` that was read before processing began."""
    return states.join(done, "repo_url", "left").select(
        "id", "repo_url", "local_path", F.coalesce("snapshot", "last_processed_snapshot").alias("last_processed_snapshot")
    )


def chunk_files(files: DataFrame, prose_too: bool = False) -> DataFrame:
    """Chunks ``(repo_id, file_path, id, ...)`` of files ``(repo_id, path, content)``.

    Files in no known language give no chunks, unless prose is asked for; then
    they, and Markdown, are cut into paragraphs.
    """
    wanted = ["repo_id", "file_path", "id", "name", "chunk_type", "chunk_index", "content", "start_line", "end_line"]
    files = files.select("repo_id", "path", "content")
    if not prose_too:
        return blocks.code_chunks(files).select(*wanted)
    code = P.extname_lower(F.col("path")).isin([e for l, es in EXTENSIONS.items() if l != "markdown" for e in es])
    return (
        blocks.code_chunks(files.where(code)).select(*wanted)
        .unionByName(prose.paragraphs(tables.clean(files.where(~code)), "path").select(*wanted))
    )


def chunk_records(chunks: DataFrame, user_meta: DataFrame | None, now: Column, dim: int = E.DIMENSIONS) -> DataFrame:
    """Chunks with vectors and metadata; user metadata ``(repo_id, user_id, meta)`` are per repository."""
    if user_meta is None:
        owned = chunks.withColumns({"user_id": F.lit(None).cast("string"), "meta": F.lit(None).cast("string")})
    else:
        owned = attach(chunks, user_meta.select("repo_id", "user_id", "meta"), "repo_id", "file_path")
    kept = meta.sanitize(meta.variant_map(F.col("meta")))
    records = owned.withColumns(
        {
            "category": F.lit("repository"),
            "repository_id": F.col("repo_id"),
            "workspace_id": F.lit("workspace"),
            "user_id": F.coalesce("user_id", F.lit(DEFAULT_USER)),
            "timestamp": moment.iso8601(now),
            "file_type": P.file_type(F.col("file_path")),
            "parent_id": F.col("file_path"),
            "function_name": F.col("name"),
            "meta": F.transform_values(kept, lambda _, v: F.to_json(v)),
        }
    )
    return E.embed(records, "content", "vector", dim)


def parent_records(files: DataFrame, user_meta: DataFrame | None) -> DataFrame:
    rows = tables.parent_rows(files.select("repo_id", F.col("path").alias("id"), "content"))
    if user_meta is None:
        return rows.withColumn("meta", F.expr("cast(map() as map<string,string>)"))
    kept = meta.sanitize(meta.variant_map(F.col("meta")))
    return attach(rows, user_meta.select("repo_id", "meta"), "repo_id", "id").withColumn(
        "meta", F.transform_values(kept, lambda _, v: F.to_json(v))
    )


def _store(corpus: Corpus, files: DataFrame, touched: DataFrame, now: Column, user_meta: DataFrame | None, prose_too: bool) -> None:
    """Parents and chunks of the touched files become those of ``files``.

    A file's parent and chunks have the file's bucket, so contents are laid out by it once, and the larger records are not moved.
    """
    files = written(corpus.chunks.dealt(files, "repo_id", "path"), "files", "zstd")
    corpus.parents.replace(parent_records(files, user_meta), touched.withColumnRenamed("path", "id"), dealt=True)
    records = chunk_records(chunk_files(files, prose_too), user_meta, now)
    corpus.chunks.replace(records, touched.withColumnRenamed("path", "file_path"), dealt=True)


def run(
    corpus: Corpus,
    snapshot: DataFrame,
    now: Column,
    user_meta: DataFrame | None = None,
    prose_too: bool = False,
    partial: bool = False,
    repos: DataFrame | None = None,
) -> DataFrame:
    """Bring the corpus up to a snapshot ``(repo_id, path, content)`` of its repositories.

    File contents are read once to sign them; after that only changed files are
    chunked and embedded. Signatures are written last, so a
    run that fails is done again as a whole, and doing it twice changes nothing.
    A ``partial`` snapshot only adds and modifies. ``repos`` names the processed
    repositories ``(repo_id)``; one of them without a file in the snapshot is emptied.
    Without it, they are those of the snapshot. Returns the change set.
    """
    after = written(snapshots.signatures(snapshot), "signatures")
    before = corpus.signatures.read()
    scope = after.select("path", "repo_id") if partial else after.select("repo_id")
    if repos is not None and not partial:
        scope = scope.unionByName(repos.select("repo_id"))
    before = before.join(scope.distinct(), scope.columns, "left_semi")
    found = snapshots.diff_signatures(before, after)
    changes = written(found.join(after, ["repo_id", "path"], "left"), "changes")
    if changes.isEmpty():
        return changes.drop("hash")

    todo = snapshots.to_process(changes)
    files = keysets.within(snapshot, todo, ["repo_id", "path"], after).where(~P.is_binary_path(F.col("path")))
    touched = snapshots.removed_paths(changes).unionByName(todo.select("repo_id", "path"))

    _store(corpus, files, touched, now, user_meta, prose_too)
    corpus.signatures.replace(changes.where("status <> 'D'").select("repo_id", "path", "hash"), touched)
    return changes.drop("hash")


def apply_changes(corpus: Corpus, changed: DataFrame, now: Column, user_meta: DataFrame | None = None, prose_too: bool = False) -> None:
    """Bring single files up to date: ``repo_id, path, deleted, content``, a path once.

    Files whose content is what is stored are left alone. Signatures are written last, as in :func:`run`.
    """
    removed = changed.where("deleted").select("repo_id", "path")
    after = snapshots.signatures(changed.where("not deleted").select("repo_id", "path", "content"))
    same = after.join(corpus.signatures.read(), ["repo_id", "path", "hash"], "left_semi").select("repo_id", "path")
    fresh = written(after.join(same, ["repo_id", "path"], "left_anti").select("repo_id", "path", "hash"), "fresh")
    touched = written(fresh.select("repo_id", "path").unionByName(removed), "touched")
    files = keysets.within(changed.select("repo_id", "path", "content"), fresh, ["repo_id", "path"])
    files = files.where(~P.is_binary_path(F.col("path")))
    _store(corpus, files, touched, now, user_meta, prose_too)
    corpus.signatures.replace(fresh, touched)
