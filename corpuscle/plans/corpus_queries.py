"""Chunkers, ingestion and streams over corpora derived from the test tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from corpuscle import schemas
from corpuscle.operators import approx as A

from corpuscle.operators.chunking import blocks, prose
from corpuscle.plans import ingest
from corpuscle.plans import testbed as TB
from corpuscle.plans.registry import query
from corpuscle.session import scratch_path
from corpuscle.sources import files
from corpuscle.sources.store import Table
from corpuscle.streaming import changes as SC
from corpuscle.streaming import ingest as SI
from corpuscle.streaming import jobs as SJ
from corpuscle.streaming import sessions as SS

_CLEAN_SQL = "regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g')"
_COMMENT = "concat('{0} ', replace({1}, chr(10), concat(chr(10), '{0} ')), chr(10))"

# One source file per document: its text becomes the comment above a class with one method.
_SOURCES_SQL = f"""
clean AS (SELECT doc_id, source AS repo_id, {_CLEAN_SQL} AS t FROM documents),
sources AS (
  SELECT doc_id, repo_id, len(string_split(t, chr(10))) AS n,
    concat('src/', doc_id, CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.rb' END) AS path,
    CASE doc_id % 3 WHEN 1 THEN {_COMMENT.format('#', 't')} WHEN 2 THEN {_COMMENT.format('#', 't')} ELSE {_COMMENT.format('//', 't')} END AS note,
    CASE doc_id % 3
      WHEN 0 THEN concat('class K', doc_id, ' {{', chr(10), '  run(a: string) {{ return "}}"; }}', chr(10), '}}')
      WHEN 1 THEN concat('class K', doc_id, ':', chr(10), '    def run(self):', chr(10), '        return "x:"')
      ELSE concat('class K', doc_id, chr(10), '  def run(a)', chr(10), '    a if a', chr(10), '  end', chr(10), 'end') END AS code,
    CASE doc_id % 3 WHEN 0 THEN 'run(a: string) {{ return "}}"; }}' WHEN 1 THEN concat('def run(self):', chr(10), '        return "x:"')
      ELSE concat('def run(a)', chr(10), '    a if a', chr(10), '  end') END AS method
  FROM clean)"""


def _sources(spark, sf):
    text = F.regexp_replace("text", r"[\x00-\x08\x0B-\x1F\x7F]", "")
    kind = F.col("doc_id") % 3

    def note(mark: str):
        return F.concat(F.lit(mark + " "), F.replace(text, F.lit("\n"), F.lit(f"\n{mark} ")), F.lit("\n"))

    number = F.col("doc_id").cast("string")
    ts = F.concat(note("//"), F.lit("class K"), number, F.lit(' {\n  run(a: string) { return "}"; }\n}\n'))
    py = F.concat(note("#"), F.lit("class K"), number, F.lit(':\n    def run(self):\n        return "x:"\n'))
    rb = F.concat(note("#"), F.lit("class K"), number, F.lit("\n  def run(a)\n    a if a\n  end\nend\n"))
    ext = F.when(kind == 0, ".ts").when(kind == 1, ".py").otherwise(".rb")
    return TB.wide_table(spark, sf, "documents").select(
        F.col("source").alias("repo_id"),
        F.concat(F.lit("src/"), number, ext).alias("path"),
        F.when(kind == 0, ts).when(kind == 1, py).otherwise(rb).alias("content"),
    )


_CODE_CHUNKS_SQL = f"""{_SOURCES_SQL},
named AS (
  SELECT *, CASE doc_id % 3 WHEN 0 THEN 'class_declaration' WHEN 1 THEN 'class_definition' ELSE 'class' END AS kind,
    CASE doc_id % 3 WHEN 0 THEN 'method_definition' WHEN 1 THEN 'function_definition' ELSE 'method' END AS inner_kind FROM sources)
SELECT repo_id, concat(path, ':K', doc_id, ':', kind, ':L1') AS id, path AS file_path, concat('K', doc_id) AS name, kind AS chunk_type,
  0::INTEGER AS chunk_index, concat(note, code) AS content, 1::INTEGER AS start_line,
  CAST(n + len(string_split(code, chr(10))) AS INTEGER) AS end_line FROM named
UNION ALL
SELECT repo_id, concat(path, ':run:', inner_kind, ':L', n + 2), path, 'run', inner_kind, 1, method,
  CAST(n + 2 AS INTEGER), CAST(n + 1 + len(string_split(method, chr(10))) AS INTEGER) FROM named"""


@query("code_chunks", f"WITH {_CODE_CHUNKS_SQL}")
def code_chunks(spark, sf):
    return blocks.code_chunks(_sources(spark, sf)).drop("language")


_LINES = "regexp_replace(regexp_replace({0}, '(^|\\n)[ ]*(#|`|~|[\\x2D=])', '\\1.', 'g'), '\\s+$', '')"


@query(
    "markdown_sections",
    f"""WITH d AS (SELECT source AS repo_id, concat(source, '/', doc_id, '.md') AS p, doc_id, concat('w ', replace(replace(replace(
        regexp_replace({_CLEAN_SQL}, '\\s+$', ''), chr(10), concat(chr(10), 'w ')), '`', ''), '~', '')) AS t FROM documents),
    l AS (SELECT *, CAST(len(string_split(t, chr(10))) AS INTEGER) AS n FROM d),
    parts AS (
      SELECT *, concat('# A', doc_id) AS h1, concat('## B', chr(10), t) AS s2, concat('# C', chr(10), '```', chr(10), '# no', chr(10), '```') AS s3 FROM l)
    SELECT repo_id, concat(p, ':anonymous:section:L1') AS id, 'section' AS chunk_type, 0::INTEGER AS chunk_index, concat(h1, chr(10), t, chr(10), s2) AS content, 1::INTEGER AS start_line, 2 * n + 2 AS end_line FROM parts
    UNION ALL SELECT repo_id, concat(p, ':anonymous:atx_heading:L1'), 'atx_heading', 1, h1, 1, 1 FROM parts
    UNION ALL SELECT repo_id, concat(p, ':anonymous:section:L', n + 2), 'section', 2, s2, n + 2, 2 * n + 2 FROM parts
    UNION ALL SELECT repo_id, concat(p, ':anonymous:atx_heading:L', n + 2), 'atx_heading', 3, '## B', n + 2, n + 2 FROM parts
    UNION ALL SELECT repo_id, concat(p, ':anonymous:section:L', 2 * n + 3), 'section', 4, s3, 2 * n + 3, 2 * n + 6 FROM parts
    UNION ALL SELECT repo_id, concat(p, ':anonymous:atx_heading:L', 2 * n + 3), 'atx_heading', 5, '# C', 2 * n + 3, 2 * n + 3 FROM parts
    UNION ALL SELECT repo_id, concat(p, ':anonymous:fenced_code_block:L', 2 * n + 4), 'fenced_code_block', 6, concat('```', chr(10), '# no', chr(10), '```'), 2 * n + 4, 2 * n + 6 FROM parts""",
)
def markdown_sections(spark, sf):
    docs = TB.wide_table(spark, sf, "documents")
    clean = F.regexp_replace(F.regexp_replace("text", r"[\x00-\x08\x0B-\x1F\x7F]", ""), r"\s+\z", "")
    body = F.concat(F.lit("w "), TB.swapped(F.replace(clean, F.lit("\n"), F.lit("\nw ")), "`~", ""))
    content = F.concat(
        F.lit("# A"), F.col("doc_id"), F.lit("\n"), body, F.lit("\n## B\n"), body, F.lit("\n# C\n```\n# no\n```\n")
    )
    sources = docs.select(
        F.col("source").alias("repo_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), content.alias("content")
    )
    return blocks.code_chunks(sources).select("repo_id", "id", "chunk_type", "chunk_index", "content", "start_line", "end_line")


def _lines_sql(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


_HIDING = "(?is)<!--.*?-->|<script.*?</script\\s*>|<style.*?</style\\s*>"


@query(
    "html_blocks",
    f"""WITH h AS (SELECT concat(page_id, '.html') AS p, replace(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '<article>', '<article id="main">') AS html FROM pages),
    t AS (SELECT p, unnest(regexp_split_to_array(html, '{_HIDING}')) AS between, unnest(regexp_extract_all(html, '{_HIDING}')) AS content,
      unnest(range(len(regexp_split_to_array(html, '{_HIDING}')))) AS i FROM h),
    l AS (SELECT p, i, content, 1 + sum({_lines_sql('between')}) OVER (PARTITION BY p ORDER BY i)
      + sum({_lines_sql("coalesce(content, '')")}) OVER (PARTITION BY p ORDER BY i) - {_lines_sql("coalesce(content, '')")} AS line FROM t),
    b AS (
      SELECT p, i, content, line, CASE WHEN content ILIKE '<script%' THEN 'script_element' ELSE 'style_element' END AS chunk_type FROM l WHERE content NOT LIKE '<!--%'
      UNION ALL SELECT p, 0, regexp_extract(html, '(?s)<article id="main">.*?</article>'), 1 + {_lines_sql("split_part(html, '<article id=\"main\">', 1)")}, 'element'
      FROM h WHERE contains(html, '<article id="main">')),
    n AS (SELECT *, row_number() OVER (PARTITION BY p, chunk_type, line ORDER BY i) AS nth FROM b)
    SELECT p AS file_path, concat(p, ':anonymous:', chunk_type, ':L', line, CASE WHEN nth > 1 THEN concat('#', nth) ELSE '' END) AS id, chunk_type,
      line::INTEGER AS start_line, (line + {_lines_sql('content')})::INTEGER AS end_line, content FROM n""",
)
def html_blocks(spark, sf):
    """Scripts, styles and elements with an id, here the article of each page."""
    html = F.replace(F.col("html"), F.lit("<article>"), F.lit('<article id="main">'))
    pages = TB.wide_table(spark, sf, "pages").select(F.concat("page_id", F.lit(".html")).alias("path"), html.alias("content"))
    return blocks.code_chunks(pages).select("file_path", "id", "chunk_type", "start_line", "end_line", "content")


@query(
    "html_elements",
    """WITH h AS (SELECT page_id, replace(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '<article>', '<article id="main">') AS html FROM pages)
    SELECT concat(page_id, '.html') AS file_path, regexp_extract(html, '(?s)<article id="main">.*?</article>') AS content FROM h WHERE contains(html, '<article id="main">')""",
)
def html_elements(spark, sf):
    """Elements with an id attribute, here the article of each page."""
    html = F.replace(F.col("html"), F.lit("<article>"), F.lit('<article id="main">'))
    pages = TB.wide_table(spark, sf, "pages").select(F.concat("page_id", F.lit(".html")).alias("path"), html.alias("content"))
    return blocks.code_chunks(pages).where("chunk_type = 'element'").select("file_path", "content")


_FORMS = ("## Part {0} ##\n", "\n| a | b |\n|---|---|\n| {0} | 2 |\n- one {0}\n  goes on\n* two\n\n1. three\nplain\n  indented\n~~~\n# no heading\n```\n", "\n~~~\n```py\nopen {0}")


@query(
    "prose_blocks",
    f"""WITH d AS (SELECT source AS repo_id, concat(source, '/', doc_id, '.md') AS p, doc_id, regexp_replace(text, '[`~]', '', 'g') AS t FROM documents),
    c AS (SELECT repo_id, p, concat({", t, ".join("'" + f.replace("{0}", "', doc_id, '").replace(chr(10), "', chr(10), '") + "'" for f in _FORMS)}) AS content FROM d),
    l AS (SELECT repo_id, p, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM c),
    k AS (
      SELECT *, CASE WHEN regexp_full_match(x, '[\\s\\x0B\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]*') THEN 'blank'
        WHEN regexp_matches(x, '^ {{0,3}}~~~') THEN 'tildes' WHEN regexp_matches(x, '^ {{0,3}}```') THEN 'ticks'
        WHEN regexp_matches(x, '^ {{0,3}}#{{1,6}}([ \\t]|$)') THEN 'heading' WHEN regexp_matches(x, '^[ \\t]*[|]') THEN 'table'
        WHEN regexp_matches(x, '^[ \\t]*([-*+]|[0-9]{{1,9}}[.)])[ \\t]+[^ \\t]') THEN 'list' WHEN regexp_matches(x, '^(  |\\t)') THEN 'indented' ELSE 'paragraph' END AS c FROM l),
    f AS (SELECT *, sum((c = 'tildes')::INT) OVER (PARTITION BY p ORDER BY n) AS tildes FROM k),
    g AS (SELECT *, CASE WHEN tildes = 1 OR c = 'tildes' THEN 'code_block' WHEN tildes = 2 AND max((tildes = 2 AND c = 'ticks')::INT) OVER (PARTITION BY p ORDER BY n) = 1 THEN 'code_block' ELSE c END AS c2 FROM f),
    h AS (SELECT *, CASE WHEN c2 <> 'indented' THEN c2 WHEN last_value(CASE WHEN c2 <> 'indented' THEN c2 END IGNORE NULLS) OVER (PARTITION BY p ORDER BY n) = 'list' THEN 'list' ELSE 'paragraph' END AS kind FROM g),
    i AS (SELECT *, sum((kind = 'heading' OR kind IS DISTINCT FROM before OR (c = 'ticks' AND tildes = 2))::INT) OVER (PARTITION BY p ORDER BY n) AS block FROM (SELECT *, lag(kind) OVER (PARTITION BY p ORDER BY n) AS before FROM h)),
    b AS (SELECT repo_id, p, block, any_value(kind) AS chunk_type, min(n) AS a, max(n) AS z, string_agg(x, chr(10) ORDER BY n) AS content FROM i WHERE kind <> 'blank' GROUP BY ALL),
    m AS (SELECT *, CASE WHEN chunk_type = 'heading' THEN coalesce(nullif(regexp_extract(content, '^ {{0,3}}#{{1,6}}[ \\t]+(.*?)[ \\t]*#*[ \\t]*$', 1), ''), 'anonymous') ELSE 'anonymous' END AS name FROM b)
    SELECT repo_id, concat(p, ':', name, ':', chunk_type, ':L', a) AS id, p AS file_path, name, chunk_type,
      CAST(row_number() OVER (PARTITION BY p ORDER BY a) - 1 AS INTEGER) AS chunk_index, content, a::INTEGER AS start_line, z::INTEGER AS end_line FROM m""",
)
def prose_blocks(spark, sf):
    """Each text between a heading and a table, in a code block, and so on; marks of code are taken from it."""
    docs = TB.wide_table(spark, sf, "documents")
    number, text = F.col("doc_id").cast("string"), F.translate("text", "`~", "")
    parts = [F.replace(F.lit(form), F.lit("{0}"), number) for form in _FORMS]
    content = F.concat(parts[0], text, parts[1], text, parts[2])
    rows = docs.select(F.col("source").alias("repo_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("id"), content.alias("content"))
    return prose.prose_blocks(rows)


_STATE_SQL = """
asked AS (SELECT DISTINCT concat('https://github.com/org/', source, '.git') AS repo_url, source AS repo_id FROM documents),
known AS (SELECT concat('id-', repo_id) AS id, repo_url, concat('disk/', repo_id) AS local_path,
          concat('snap-', length(repo_id)) AS last_processed_snapshot FROM asked WHERE repo_id LIKE 'src1%'),
loaded AS (SELECT coalesce(id, repo_id) AS id, a.repo_url, coalesce(local_path, concat('repos/', repo_id)) AS local_path, last_processed_snapshot
           FROM asked a LEFT JOIN known k ON a.repo_url = k.repo_url)"""


def _states(spark, sf):
    asked = TB.table(spark, sf, "documents").select(
        F.concat(F.lit("https://github.com/org/"), "source", F.lit(".git")).alias("repo_url"), F.col("source").alias("repo_id")
    ).distinct()
    known = asked.where("repo_id LIKE 'src1%'").select(
        F.concat(F.lit("id-"), "repo_id").alias("id"), "repo_url", F.concat(F.lit("disk/"), "repo_id").alias("local_path"),
        F.concat(F.lit("snap-"), F.length("repo_id")).alias("last_processed_snapshot"),
    )
    return ingest.repo_states(asked, known)


@query("load_state", f"WITH {_STATE_SQL} SELECT * FROM loaded")
def load_state(spark, sf):
    return _states(spark, sf)


@query(
    "commit_state",
    f"""WITH {_STATE_SQL} SELECT id, repo_url, local_path,
    CASE WHEN repo_url LIKE '%5.git' THEN 'now' ELSE last_processed_snapshot END AS last_processed_snapshot FROM loaded""",
)
def commit_state(spark, sf):
    states = _states(spark, sf)
    done = states.where("repo_url LIKE '%5.git'").select("repo_url", F.lit("now").alias("snapshot"))
    return ingest.commit_states(states, done)


@query("scan_files", "SELECT 'corpus' AS repo_id, concat('source=', source) AS folder, concat(text, chr(10)) AS content FROM documents")
def scan_files(spark, sf):
    """Every document written as a text file of its own, then read back by the file scan."""
    root = scratch_path(spark, "files")
    docs = TB.wide_table(spark, sf, "documents").select("source", "text")
    files.write_files(docs, root, "source", "text")
    found = files.scan_files(spark, root, "corpus", "*.txt")
    return found.select("repo_id", F.regexp_replace("path", "/[^/]+$", "").alias("folder"), "content")


_NOW = "2024-01-01"


@query(
    "ingest_corpus",
    f"""WITH {TB.SNAPSHOTS_SQL},
    lines AS (SELECT repo_id, path, regexp_replace(unnest(string_split(content, chr(10))), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS content,
      generate_subscripts(string_split(content, chr(10)), 1) AS line FROM snap_b),
    kept AS (SELECT * FROM lines WHERE NOT regexp_full_match(content, '[\\s\\x0B\\x{{A0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}\\x{{FEFF}}]*'))
    SELECT repo_id, path AS file_path, concat(path, ':anonymous:paragraph:L', line) AS id, 'repository' AS category, 'system' AS user_id,
      '2024-01-01T00:00:00.000Z' AS timestamp, CASE WHEN path LIKE '%.moved' THEN '.moved' ELSE '.md' END AS file_type,
      CAST(row_number() OVER (PARTITION BY repo_id, path ORDER BY line) - 1 AS INTEGER) AS chunk_index, path AS parent_id, content,
      '"backend"' AS team FROM kept""",
)
def ingest_corpus(spark, sf):
    """Two snapshots one after the other; what is stored is the second one."""
    corpus = ingest.Corpus(spark, scratch_path(spark, "corpus"), buckets=4)
    before, after = TB.snapshots(spark, sf)
    owners = after.select("repo_id").distinct().select(
        "repo_id", F.lit(None).cast("string").alias("user_id"), F.lit('{"team":"backend","id":"x","list":[1]}').alias("meta")
    )
    now = F.lit(_NOW).cast("timestamp")
    ingest.run(corpus, before, now, owners, prose_too=True)
    ingest.run(corpus, after, now, owners, prose_too=True)
    return corpus.chunks.read().select(
        "repo_id", "file_path", "id", "category", "user_id", "timestamp", "file_type", "chunk_index", "parent_id", "content",
        F.col("meta")["team"].alias("team"),
    )


def _filed(spark, sf, centres=None):
    corpus = TB.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    filed = A.InvertedFile(spark, scratch_path(spark, "cells"))
    filed.build(corpus, A.train_centres(corpus, 16) if centres is None else centres)
    return filed


@query("approx_search")
def approx_search(spark, sf):
    """Every query probes four of sixteen trained cells; recall against the exact search is unit-tested."""
    return _filed(spark, sf).search(TB.query_vectors(spark, sf), 10, 4).select("query_id", "rank", "id", "score")


@query(
    "approx_search_all_cells",
    f"""WITH {TB.QUERY_VECTORS_SQL}, s AS (SELECT query_id, vec_id AS id, {TB.l2sq_sql('embedding', 'qv')} AS d FROM embeddings, q),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, id, round(1 - d, 9) AS score FROM r WHERE rank <= 10""",
)
def approx_search_all_cells(spark, sf):
    hits = _filed(spark, sf).search(TB.query_vectors(spark, sf), 10, 16)
    return hits.select("query_id", "rank", "id", F.round("score", 9).alias("score"))


@query(
    "approx_given_cells",
    f"""WITH {TB.QUERY_VECTORS_SQL}, c AS (SELECT vec_id AS cell, embedding AS centre FROM embeddings WHERE vec_id < 16),
    filed AS (SELECT vec_id AS id, any_value(embedding) AS v, arg_min(cell, (d, cell)) AS cell
              FROM (SELECT vec_id, embedding, cell, {TB.l2sq_sql('embedding', 'centre')} AS d FROM embeddings, c) GROUP BY vec_id),
    probes AS (SELECT query_id, qv, cell FROM (SELECT query_id, qv, cell, row_number() OVER (PARTITION BY query_id ORDER BY {TB.l2sq_sql('qv', 'centre')}, cell) AS nth FROM q, c) WHERE nth <= 4),
    s AS (SELECT query_id, id, cell, {TB.l2sq_sql('v', 'qv')} AS d FROM probes JOIN filed USING (cell)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, id, round(1 - d, 9) AS score FROM r WHERE rank <= 10""",
)
def approx_given_cells(spark, sf):
    """The first sixteen vectors are the centres, so that SQL can file and probe alike."""
    first = TB.table(spark, sf, "embeddings").where("vec_id < 16").orderBy("vec_id").select("embedding").collect()
    hits = _filed(spark, sf, [r[0] for r in first]).search(TB.query_vectors(spark, sf), 10, 4)
    return hits.select("query_id", "rank", "id", F.round("score", 9).alias("score"))


def _stream(spark, sf, name):
    schema = TB.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query(
    "stream_job_status",
    f"""WITH {TB.JOB_EVENTS_SQL} SELECT job_id, arg_max(state, (ts, event_id)) AS state, max(ts) AS changed_at,
    count(*) FILTER (WHERE state = 'failed') AS attempts FROM job_events GROUP BY job_id""",
)
def stream_job_status(spark, sf):
    events = _stream(spark, sf, "events")
    kind = F.col("event_type")
    events = events.select(
        F.concat(F.lit("job-"), "user_id").alias("job_id"), "ts", "event_id",
        F.when(kind == "signup", "queued").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("active").alias("state"),
        F.lit(None).cast("string").alias("reason"),
    )
    table = Table(spark, scratch_path(spark, "jobs"), schemas.JOBS, ["job_id"], 4)
    SJ.job_status_stream(events, table, scratch_path(spark, "checkpoint")).start().awaitTermination()
    return table.read().select("job_id", "state", F.col("changed_at").cast("timestamp_ntz").alias("changed_at"), "attempts")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query(
    "stream_session_memory",
    "SELECT conv_id AS session_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
)
def stream_session_memory(spark, sf):
    """Turns arrive in two runs of the stream; a session has one set of rows."""
    messages = TB.table(spark, sf, "conversations").withColumnRenamed("conv_id", "session_id")
    table = Table(spark, scratch_path(spark, "memory"), SS.MEMORY, ["session_id"], 4)
    _in_runs(
        spark, messages, F.when(F.col("turn") % 2 == 0, 0).otherwise(1), 2,
        lambda arriving, place: SS.keep_memory(SS.session_memory(arriving, 3, None), table, place),
    )
    return table.read()


def _in_runs(spark, rows, part, parts, writer):
    """Parts of a table that arrive one after the other, each worked off by a run of the stream from one checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    root, place = scratch_path(spark, "arriving"), scratch_path(spark, "checkpoint")
    for n in range(parts):
        rows.where(part == n).write.mode("append").parquet(root)
        writer(spark.readStream.schema(rows.schema).parquet(root), place).start().awaitTermination()


_EXPIRY, _LATE = 3550, 600


@query(
    "stream_session_expiry",
    f"""WITH m AS (SELECT conv_id AS session_id, turn, role, text, conv_id * 600 + turn * 180 AS moment FROM conversations),
    l AS (SELECT session_id, max(moment) AS last FROM m GROUP BY session_id HAVING max(moment) + {_EXPIRY} > (SELECT max(moment) FROM m) - {_LATE})
    SELECT session_id, turn, role, text FROM m JOIN l USING (session_id) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 3""",
)
def stream_session_expiry(spark, sf):
    """Sessions that were silent for the time to live, by the watermark, are gone."""
    seconds = F.lit(1704067200) + (F.col("conv_id") * 10 + F.col("turn") * 3) * 60
    messages = TB.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", "text", F.timestamp_seconds(seconds).alias("ts")
    )
    bounds = messages.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.timestamp_micros(((F.unix_micros("a") + F.unix_micros("b")) / 2).cast("long")))
    half = bounds.first()[0]
    table = Table(spark, scratch_path(spark, "memory"), SS.MEMORY, ["session_id"], 4)
    _in_runs(
        spark, messages, F.when(F.col("ts") < F.lit(half), 0).otherwise(1), 2,
        lambda arriving, place: SS.keep_memory(SS.expiring_memory(arriving, 3, _EXPIRY, f"{_LATE} seconds"), table, place),
    )
    return table.read()


@query(
    "stream_open_sessions",
    """WITH o AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3600000000 THEN 0 ELSE 1 END AS opened
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(opened) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM o),
    s AS (SELECT user_id, min(ts) AS created_at, max(ts) AS last_accessed_at, CAST(count(*) AS BIGINT) AS message_count FROM n GROUP BY user_id, nr)
    SELECT *, CASE WHEN epoch_ms(last_accessed_at) + 3600000 <= (SELECT epoch_ms(max(ts)) FROM events) - 600000 THEN 'closed' ELSE 'open' END AS state FROM s""",
)
def stream_open_sessions(spark, sf):
    """Every session with its last state, those still open too; events arrive in three runs."""
    events = TB.table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.least(F.floor((F.unix_micros("ts") - low) * 3 / (high - low + 1)), F.lit(2))
    table = Table(spark, scratch_path(spark, "sessions"), schemas.OPEN_SESSIONS, ["user_id", "created_at"], 4)
    _in_runs(spark, events, part, 3, lambda arriving, place: SS.keep_sessions(SS.open_sessions(arriving), table, place))
    return table.read().withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "last_accessed_at")})


@query(
    "stream_changes",
    f"""WITH {TB.SNAPSHOTS_SQL},
    lines AS (SELECT repo_id, path AS file_path, regexp_replace(unnest(string_split(content, chr(10))), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS content,
      generate_subscripts(string_split(content, chr(10)), 1) AS line FROM snap_b)
    SELECT repo_id, file_path, concat(file_path, ':anonymous:paragraph:L', line) AS id,
      CAST(row_number() OVER (PARTITION BY repo_id, file_path ORDER BY line) - 1 AS INTEGER) AS chunk_index, content
    FROM lines WHERE NOT regexp_full_match(content, '[\\s\\x0B\\x{{A0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}\\x{{FEFF}}]*')""",
)
def stream_changes(spark, sf):
    """Files arrive, are changed, renamed and deleted, and old versions come late: what is stored is the second snapshot."""
    docs = TB.wide_table(spark, sf, "documents")
    path = F.concat("source", F.lit("/"), "doc_id", F.lit(".md"))
    gone, moved = F.col("doc_id") % 7 == 3, F.col("doc_id") % 13 == 0
    text = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    nothing = F.lit(None).cast("string")

    def events(rows, run, version, op, at=path, content=nothing, old=nothing):
        return rows.select(
            F.col("source").alias("repo_id"), at.alias("path"), F.lit(version).cast("long").alias("version"), op.alias("op"),
            content.alias("content"), old.alias("old_path"), F.lit(run).alias("run"),
        )

    op = F.when(gone, "delete").when(moved, "rename").otherwise("update")
    new_path = F.when(moved & ~gone, F.concat(path, F.lit(".moved"))).otherwise(path)
    first = events(docs.where("doc_id % 10 <> 0"), 0, 1, F.lit("update"), content=F.col("text"))
    second = events(docs.where(gone | moved | ((F.col("doc_id") % 11 == 0) | (F.col("doc_id") % 10 == 0))), 1, 2, op, new_path, F.when(~gone, text), F.when(moved & ~gone, path))
    late = events(docs.where("doc_id % 5 = 0"), 2, 0, F.lit("update"), content=F.lit("old"))
    corpus = ingest.Corpus(spark, scratch_path(spark, "corpus"), buckets=4)
    feed = first.unionByName(second).unionByName(late)
    now = F.lit(_NOW).cast("timestamp")
    _in_runs(spark, feed, F.col("run"), 3, lambda arriving, place: SC.ingest_changes(arriving, corpus, place, now, prose_too=True))
    return corpus.chunks.read().select("repo_id", "file_path", "id", "chunk_index", "content")


@query(
    "stream_session_stats",
    """WITH o AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3600000000 THEN 0 ELSE 1 END AS opened
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(opened) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM o),
    s AS (SELECT user_id, min(ts) AS created_at, max(ts) AS last_accessed_at, CAST(count(*) AS BIGINT) AS message_count FROM n GROUP BY user_id, nr)
    SELECT * FROM s WHERE epoch_ms(last_accessed_at) + 3600000 <= (SELECT epoch_ms(max(ts)) FROM events) - 600000""",
)
def stream_session_stats(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out, place = scratch_path(spark, "sessions"), scratch_path(spark, "checkpoint")
    stats = SS.session_stats(_stream(spark, sf, "events"))
    (
        stats.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema(stats.schema).parquet(out).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "last_accessed_at")}
    )


@query(
    "stream_ingest",
    """WITH lines AS (SELECT source AS repo_id, concat(source, '/', doc_id, '.md') AS file_path,
      regexp_replace(unnest(string_split(text, chr(10))), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS content,
      generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
    SELECT repo_id, file_path, concat(file_path, ':anonymous:paragraph:L', line) AS id,
      CAST(row_number() OVER (PARTITION BY repo_id, file_path ORDER BY line) - 1 AS INTEGER) AS chunk_index, content
    FROM lines WHERE NOT regexp_full_match(content, '[\\s\\x0B\\x{A0}\\x{2028}\\x{2029}\\x{3000}\\x{FEFF}]*')""",
)
def stream_ingest(spark, sf):
    """Documents arriving as a stream end up as the same chunks as in a batch."""
    corpus = ingest.Corpus(spark, scratch_path(spark, "corpus"), buckets=4)
    arriving = _stream(spark, sf, "documents").select(
        F.col("source").alias("repo_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.col("text").alias("content")
    )
    SI.ingest_stream(arriving, corpus, scratch_path(spark, "checkpoint"), F.lit(_NOW).cast("timestamp"), True).start().awaitTermination()
    return corpus.chunks.read().select("repo_id", "file_path", "id", "chunk_index", "content")
