"""Table reads, changes, audits and snapshot differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.operators import quality as Q
from corpuscle.operators import snapshots as D
from corpuscle.operators import tables as T
from corpuscle.operators.chunking import prose
from corpuscle.plans import testbed as TB
from corpuscle.plans.registry import query

_IDS = "label IN (3, 7)"


@query(
    "get_documents",
    f"""WITH {TB.VECTORS_SQL} SELECT id, repo_id, coalesce(CASE WHEN id % 2 = 0 THEN content END, '') AS content
    FROM chunks_vec WHERE id IN (SELECT vec_id + 5 FROM embeddings WHERE {_IDS})""",
)
def get_documents(spark, sf):
    table = TB.vectors(spark, sf).select("id", "repo_id", F.when(F.col("id") % 2 == 0, F.col("content")).alias("content"))
    ids = TB.table(spark, sf, "embeddings").where(_IDS).select((F.col("vec_id") + 5).alias("id"))
    return T.get_documents(table, ids)


@query(
    "get_document",
    f"WITH {TB.VECTORS_SQL} SELECT id, repo_id, coalesce(content, '') AS content FROM chunks_vec WHERE id = 42",
)
def get_document(spark, sf):
    return T.get_document(TB.vectors(spark, sf).select("id", "repo_id", "content"), 42)


@query(
    "get_parents",
    f"""WITH {TB.VECTORS_SQL}, {TB.PARENTS_SQL} SELECT id, repo_id, content FROM parents p
    WHERE EXISTS (SELECT 1 FROM chunks_vec c WHERE c.team = 'backend' AND c.parent_id = p.id AND c.repo_id = p.repo_id)""",
)
def get_parents(spark, sf):
    wanted = TB.vectors(spark, sf).where("team = 'backend'").select("repo_id", F.col("parent_id").alias("id"))
    return T.get_parents(TB.parents(spark, sf).select("id", "repo_id", "content"), wanted)


_PARAGRAPHS_SQL = """
split_lines AS (
  SELECT source AS repo_id, concat(source, '/', doc_id, '.md') AS file_path, lang,
         unnest(string_split(text, chr(10))) AS content,
         generate_subscripts(string_split(text, chr(10)), 1) AS line
  FROM documents),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY line) - 1 AS nr
  FROM split_lines WHERE NOT regexp_full_match(content, '[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]*')),
chunks AS (
  SELECT repo_id, lang, concat(file_path, ':anonymous:paragraph:L', line) AS id, file_path, 'anonymous' AS name,
         'paragraph' AS chunk_type, CAST(nr AS INTEGER) AS chunk_index, content,
         CAST(line AS INTEGER) AS start_line, CAST(line AS INTEGER) AS end_line
  FROM kept)"""


def _paragraphs(spark, sf):
    return prose.paragraphs(TB.parents(spark, sf).drop("doc_id"))


@query("paragraph_chunks", f"WITH {_PARAGRAPHS_SQL} SELECT * FROM chunks")
def paragraph_chunks(spark, sf):
    return _paragraphs(spark, sf)


@query(
    "chunk_index",
    f"""WITH {_PARAGRAPHS_SQL} SELECT repo_id, file_path, count(*) AS chunks, CAST(min(chunk_index) AS INTEGER) AS first,
    CAST(max(chunk_index) AS INTEGER) AS last FROM chunks GROUP BY ALL""",
)
def chunk_index(spark, sf):
    return _paragraphs(spark, sf).groupBy("repo_id", "file_path").agg(
        F.count(F.lit(1)).alias("chunks"), F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last")
    )


@query(
    "chunk_ids_and_names",
    f"""WITH {_PARAGRAPHS_SQL} SELECT id, coalesce(nullif(split_part(id, ':', 2), ''), 'anonymous') AS name,
    substr(content, 1, 100) AS preview FROM chunks""",
)
def chunk_ids_and_names(spark, sf):
    chunks = _paragraphs(spark, sf)
    return chunks.select("id", prose.name_from_id(F.col("id")).alias("name"), F.substring("content", 1, 100).alias("preview"))


@query("chunks_by_file", f"WITH {_PARAGRAPHS_SQL} SELECT * FROM chunks WHERE repo_id = 'src3' AND file_path = 'src3/3.md'")
def chunks_by_file(spark, sf):
    return T.chunks_by_file(_paragraphs(spark, sf), "src3", "src3/3.md")


@query(
    "chunk_counts",
    f"""WITH {_PARAGRAPHS_SQL.replace("kept AS", "unused AS").split("chunks AS")[0]} every AS (
      SELECT repo_id, file_path, concat(file_path, ':', line % 40) AS id, content FROM split_lines)
    SELECT repo_id, file_path, CAST(count(*) AS BIGINT) AS extracted,
      CAST(count(*) FILTER (WHERE trim(content) <> '') AS BIGINT) AS valid,
      CAST(count(*) FILTER (WHERE trim(content) = '') AS BIGINT) AS dropped,
      count(DISTINCT id) AS unique_ids, CAST(sum(length(content)) AS BIGINT) AS chars
    FROM every GROUP BY ALL""",
)
def chunk_counts(spark, sf):
    lines = TB.parents(spark, sf).select(
        "repo_id", F.col("id").alias("file_path"), F.posexplode(F.split("content", "\n")).alias("pos", "content")
    )
    ids = F.concat("file_path", F.lit(":"), (F.col("pos") + 1) % 40)
    return Q.chunk_counts(lines.select("repo_id", "file_path", ids.alias("id"), "content"))


_BASE = "lang <> 'fr'"


@query(
    "upsert_merge",
    f"""WITH {TB.PARENTS_SQL}, base AS (SELECT id, repo_id, content FROM parents WHERE {_BASE}),
    new AS (SELECT id, CASE WHEN doc_id % 50 = 0 THEN 'no-repo' ELSE repo_id END AS repo_id,
            regexp_replace(concat(content, chr(1), '!'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS content
            FROM parents WHERE lang <> 'en')
    SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.id = b.id AND n.repo_id = b.repo_id)
    UNION ALL SELECT * FROM new""",
)
def upsert_merge(spark, sf):
    docs = TB.parents(spark, sf)
    new = docs.where("lang <> 'en'").select(
        "id",
        F.when(F.col("doc_id") % 50 != 0, F.col("repo_id")).alias("repo_id"),
        F.concat("content", F.lit("\x01!")).alias("content"),
    )
    new = T.parent_rows(new.unionByName(new))
    new = T.first_per_key(new, ["repo_id", "id"], [F.col("content")])
    return T.upsert(docs.where(_BASE).select("id", "repo_id", "content"), new, ["repo_id", "id"])


@query(
    "delete_ids",
    f"WITH {TB.VECTORS_SQL} SELECT id, repo_id, label FROM chunks_vec WHERE id NOT IN (SELECT vec_id FROM embeddings WHERE {_IDS})",
)
def delete_ids(spark, sf):
    ids = TB.table(spark, sf, "embeddings").where(_IDS).select(F.col("vec_id").alias("id"))
    return T.delete_ids(TB.vectors(spark, sf).select("id", "repo_id", "label"), ids)


@query(
    "delete_where",
    f"""WITH {TB.VECTORS_SQL}, t AS (SELECT id, CASE WHEN id % 5 <> 0 THEN team END AS team, label FROM chunks_vec)
    SELECT * FROM t WHERE NOT coalesce(team = 'backend' AND label = 3, false)""",
)
def delete_where(spark, sf):
    table = TB.vectors(spark, sf).select("id", F.when(F.col("id") % 5 != 0, F.col("team")).alias("team"), "label")
    return T.delete_where(table, {"team": "backend", "label": 3})


@query("store_count", f"WITH {_PARAGRAPHS_SQL} SELECT count(*) AS n FROM chunks")
def store_count(spark, sf):
    return T.count(_paragraphs(spark, sf))


@query("repo_ids", "SELECT DISTINCT source AS repo_id FROM documents WHERE lang <> 'en'")
def repo_ids(spark, sf):
    return T.repo_ids(TB.parents(spark, sf).withColumn("repo_id", F.when(F.col("lang") != "en", F.col("repo_id"))))


@query(
    "file_paths_head",
    f"""WITH {_PARAGRAPHS_SQL}, p AS (SELECT DISTINCT file_path FROM chunks)
    SELECT file_path, greatest((SELECT count(*) FROM p) - 20, 0) AS more FROM p ORDER BY file_path LIMIT 20""",
)
def file_paths_head(spark, sf):
    return T.file_paths_head(_paragraphs(spark, sf))


@query(
    "sample_head",
    f"""WITH {_PARAGRAPHS_SQL} SELECT id, file_path, 'N/A' AS function_name, chunk_type, repo_id, substr(content, 1, 80) AS preview
    FROM chunks ORDER BY id LIMIT 10""",
)
def sample_head(spark, sf):
    return T.sample_head(_paragraphs(spark, sf))


_PLANTED = "concat(source, '/', CASE WHEN doc_id % 9 = 0 THEN doc_id % 100 ELSE doc_id END)"


@query(
    "duplicate_ids",
    f"SELECT source AS repo_id, {_PLANTED} AS id, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_ids(spark, sf):
    table = TB.table(spark, sf, "documents").select(F.col("source").alias("repo_id"), F.expr(_PLANTED).alias("id"))
    return Q.duplicate_ids(table, ["repo_id", "id"])


@query(
    "duplicate_summary",
    f"""SELECT count(*) AS total, count(DISTINCT (source, {_PLANTED})) AS unique_ids,
    count(*) - count(DISTINCT (source, {_PLANTED})) AS duplicates FROM documents""",
)
def duplicate_summary(spark, sf):
    table = TB.table(spark, sf, "documents").select(F.col("source").alias("repo_id"), F.expr(_PLANTED).alias("id"))
    return Q.duplicate_summary(table, ["repo_id", "id"])


@query("require_unique", "SELECT source AS repo_id, doc_id AS id, count(*) AS copies FROM documents GROUP BY ALL")
def require_unique(spark, sf):
    table = TB.table(spark, sf, "documents").select(F.col("source").alias("repo_id"), F.col("doc_id").alias("id"))
    return Q.require_unique(table, ["repo_id", "id"])


@query(
    "text_sizes",
    """SELECT source AS repo_id, CAST(sum(length(text) + 2) AS BIGINT) AS chars,
    CAST(sum(length(text) + 2 - length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'))) AS BIGINT) AS removed_chars
    FROM documents GROUP BY ALL""",
)
def text_sizes(spark, sf):
    docs = TB.parents(spark, sf).withColumn("content", F.concat("content", F.lit("\x02\x7f")))
    return Q.text_sizes(docs)


_DIFF_SQL = f"""{TB.SNAPSHOTS_SQL},
both_sides AS (
  SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.path, b.path) AS path,
         a.content AS old_content, b.content AS new_content
  FROM snap_a a FULL JOIN snap_b b ON a.repo_id = b.repo_id AND a.path = b.path),
come AS (
  SELECT repo_id, path, sha256(new_content) AS hash,
         row_number() OVER (PARTITION BY repo_id, sha256(new_content) ORDER BY substr(md5(path), 1, 2), path) AS nth
  FROM both_sides WHERE old_content IS NULL),
gone AS (
  SELECT repo_id, path AS old_path, sha256(old_content) AS hash,
         row_number() OVER (PARTITION BY repo_id, sha256(old_content) ORDER BY substr(md5(path), 1, 2), path) AS nth
  FROM both_sides WHERE new_content IS NULL),
changes AS (
  SELECT repo_id, path, 'M' AS status, NULL::VARCHAR AS old_path FROM both_sides
  WHERE old_content IS NOT NULL AND new_content IS NOT NULL AND old_content <> new_content
  UNION ALL
  SELECT coalesce(c.repo_id, g.repo_id), coalesce(c.path, g.old_path),
         CASE WHEN g.old_path IS NULL THEN 'A' WHEN c.path IS NULL THEN 'D' ELSE 'R' END,
         CASE WHEN c.path IS NOT NULL THEN g.old_path END
  FROM come c FULL JOIN gone g ON c.repo_id = g.repo_id AND c.hash = g.hash AND c.nth = g.nth)"""


@query("snapshot_diff", f"WITH {_DIFF_SQL} SELECT * FROM changes")
def snapshot_diff(spark, sf):
    return D.diff(*TB.snapshots(spark, sf))


@query(
    "diff_summary",
    f"""WITH {_DIFF_SQL} SELECT repo_id, count(*) FILTER (WHERE status = 'A') AS added,
    count(*) FILTER (WHERE status = 'M') AS modified, count(*) FILTER (WHERE status = 'D') AS deleted,
    count(*) FILTER (WHERE status = 'R') AS renamed, count(*) > 0 AS has_changes FROM changes GROUP BY ALL""",
)
def diff_summary(spark, sf):
    return D.has_changes(D.summary(D.diff(*TB.snapshots(spark, sf))))


@query("to_process", f"WITH {_DIFF_SQL} SELECT repo_id, path, status FROM changes WHERE status <> 'D'")
def to_process(spark, sf):
    return D.to_process(D.diff(*TB.snapshots(spark, sf)))


@query(
    "apply_deletes",
    f"""WITH {_DIFF_SQL} SELECT repo_id, path AS file_path, md5(content) AS content FROM snap_a s
    WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.status <> 'A' AND c.repo_id = s.repo_id
                      AND CASE WHEN c.status = 'R' THEN c.old_path ELSE c.path END = s.path)""",
)
def apply_deletes(spark, sf):
    before, after = TB.snapshots(spark, sf)
    stored = before.select("repo_id", F.col("path").alias("file_path"), F.md5("content").alias("content"))
    return D.apply_deletes(stored, D.diff(before, after))


_CODES = "CASE doc_id % 8 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' WHEN 3 THEN 'R100' WHEN 4 THEN 'C75' WHEN 5 THEN 'R087' WHEN 6 THEN 'T' ELSE '' END"


@query(
    "parse_name_status",
    f"""WITH l AS (SELECT doc_id, {_CODES} AS code, concat(source, '/', doc_id) AS p FROM documents)
    SELECT doc_id, CASE WHEN code = 'R100' THEN concat(p, '.new') ELSE p END AS path, substr(code, 1, 1) AS status,
    CASE WHEN code LIKE 'R%' THEN p END AS old_path FROM l WHERE substr(code, 1, 1) IN ('A', 'M', 'D', 'R')""",
)
def parse_name_status(spark, sf):
    path = F.concat("source", F.lit("/"), "doc_id")
    code = F.expr(_CODES)
    line = F.when(code == "", path).when(code == "R100", F.concat(code, F.lit("\t"), path, F.lit("\t"), path, F.lit(".new")))
    line = line.otherwise(F.concat(code, F.lit("\t"), path))
    return D.parse_name_status(TB.table(spark, sf, "documents").select("doc_id", line.alias("line")))


@query(
    "split_listing",
    """SELECT doc_id, line AS path FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''""",
)
def split_listing(spark, sf):
    return D.parse_listing(TB.table(spark, sf, "documents").select("doc_id", F.col("text").alias("listing")))
