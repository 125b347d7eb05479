"""Text, path, URL, metadata and validation functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import chat, meta, moment, path, text, url, validate
from corpuscle.operators import embed as E
from corpuscle.operators import filters as FL
from corpuscle.operators import tables as T
from corpuscle.operators.chunking import languages
from corpuscle.plans import testbed as TB
from corpuscle.plans.registry import query

_W = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_PADDED = """CASE doc_id % 6 WHEN 0 THEN concat(chr(10), text) WHEN 1 THEN concat('  ', chr(10), text, chr(10), ' ')
 WHEN 2 THEN concat(text, chr(10)) WHEN 3 THEN concat(chr(10), chr(10), text, ' ') WHEN 4 THEN concat(chr(9), text, chr(9)) ELSE chr(10) END"""


@query(
    "embed_prep",
    f"""WITH d AS (SELECT doc_id, {_PADDED} AS t FROM documents),
    e AS (SELECT doc_id, t, regexp_extract(t, '^{_W}*') AS head, regexp_extract(t, '{_W}*$') AS tail FROM d)
    SELECT doc_id, CASE WHEN t = chr(10) THEN ' '
      ELSE concat(CASE WHEN head = chr(10) THEN ' ' ELSE '' END,
                  replace(substr(t, length(head) + 1, length(t) - length(head) - length(tail)), chr(10), ' '),
                  CASE WHEN tail = chr(10) THEN ' ' ELSE '' END) END AS prepared FROM e""",
)
def embed_prep(spark, sf):
    docs = TB.table(spark, sf, "documents")
    return docs.select("doc_id", text.embed_prep(F.expr(_PADDED.replace("chr(", "char("))).alias("prepared"))


@query(
    "token_estimate_truncate",
    """SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens,
    CASE WHEN ceil(length(text) / 4.0) > 500 THEN substr(text, 1, 2000) ELSE text END AS cut,
    CAST(ceil(n_chars / 1000.0) AS BIGINT) AS batches FROM documents""",
)
def token_estimate_truncate(spark, sf):
    t = F.col("text")
    return TB.table(spark, sf, "documents").select(
        "doc_id", text.estimate_tokens(t).alias("tokens"), text.truncate_tokens(t, 500).alias("cut"),
        T.batch_count(F.col("n_chars")).alias("batches"),
    )


@query(
    "sanitize_text",
    """SELECT doc_id, regexp_replace(concat(text, chr(1), 'a', chr(9), chr(31), 'b', chr(13), chr(127)),
    '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS clean FROM documents""",
)
def sanitize_text(spark, sf):
    dirty = F.concat("text", F.lit("\x01a\t\x1fb\r\x7f"))
    return TB.table(spark, sf, "documents").select("doc_id", text.sanitize(dirty).alias("clean"))


_PATHS = """CASE p_partkey % 10 WHEN 0 THEN concat('src/', p_name, '.TS') WHEN 1 THEN concat('img/', p_name, '.PNG')
 WHEN 2 THEN 'Makefile' WHEN 3 THEN 'a.b/Makefile' WHEN 4 THEN '.gitignore' WHEN 5 THEN concat('x/', p_brand, '.tar.gz')
 WHEN 6 THEN concat('lib/', p_name, '.min.js') WHEN 7 THEN 'yarn.lock' WHEN 8 THEN concat(p_type, '.unknown') ELSE 'dir/.hidden.py' END"""
_BASE_NAME = "regexp_extract(p, '([^/]*)$', 1)"
_SUFFIX = "CASE WHEN contains(p, '.') THEN lower(regexp_extract(p, '(\\.[^.]*)$', 1)) ELSE lower(p) END"


@query(
    "is_binary_path",
    f"""WITH t AS (SELECT p_partkey, {_PATHS} AS p FROM part)
    SELECT p_partkey, {_SUFFIX} AS suffix, {_SUFFIX} IN ({", ".join(f"'{e}'" for e in path.BINARY_EXTENSIONS)}) AS is_binary FROM t""",
)
def is_binary_path(spark, sf):
    p = F.expr(_PATHS)
    return TB.table(spark, sf, "part").select(
        "p_partkey", path.last_dot_suffix(p).alias("suffix"), path.is_binary_path(p).alias("is_binary")
    )


_LANGUAGE_CASES = " ".join(
    f"WHEN '{ext}' THEN '{name}'" for name, extensions in languages.EXTENSIONS.items() for ext in extensions
)


@query(
    "detect_language",
    f"""WITH t AS (SELECT p_partkey, {_PATHS} AS p FROM part),
    e AS (SELECT p_partkey, p, regexp_extract({_BASE_NAME}, '^.+(\\.[^.]*)$', 1) AS file_type FROM t)
    SELECT p_partkey, p AS path, file_type, lower(file_type) AS ext, CASE lower(file_type) {_LANGUAGE_CASES} END AS language FROM e""",
)
def detect_language(spark, sf):
    files = TB.table(spark, sf, "part").select("p_partkey", F.expr(_PATHS).alias("path"))
    return languages.detect(files).withColumn("file_type", path.file_type(F.col("path")))


@query(
    "supported_languages",
    f"""WITH t AS (SELECT p_partkey, {_PATHS} AS p FROM part),
    e AS (SELECT lower(regexp_extract({_BASE_NAME}, '^.+(\\.[^.]*)$', 1)) AS ext FROM t),
    l AS (SELECT CASE ext {_LANGUAGE_CASES} END AS language FROM e)
    SELECT coalesce(language, 'unsupported') AS language, count(*) AS files FROM l GROUP BY ALL""",
)
def supported_languages(spark, sf):
    files = languages.detect(TB.table(spark, sf, "part").select(F.expr(_PATHS).alias("path")))
    return files.groupBy(F.coalesce("language", F.lit("unsupported")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


_URLS = """CASE page_id % 9 WHEN 0 THEN concat('https://github.com/org/repo-', page_id, '.git') WHEN 1 THEN concat('https://gitlab.com/g/s/p_', page_id, '///')
 WHEN 2 THEN 'not-a-valid-url' WHEN 3 THEN concat('https://github.com/org/repo<', page_id, '>.git') WHEN 4 THEN concat('git@github.com:org/r', page_id, '.git')
 WHEN 5 THEN concat('ftp://host.org/x', page_id, '.git') WHEN 6 THEN concat('https://host.org/x.y', page_id, '.git') ELSE url END"""


@query(
    "repo_id_from_url",
    f"""WITH u AS (SELECT page_id, {_URLS} AS u FROM pages),
    s AS (SELECT page_id, CASE WHEN contains(rtrim(u, '/'), '/') THEN regexp_replace(string_split(rtrim(u, '/'), '/')[-1], '(.)\\.git$', '\\1') ELSE '' END AS seg FROM u)
    SELECT page_id, CASE WHEN regexp_full_match(seg, '[a-zA-Z0-9._-]+') THEN seg END AS repo_id FROM s""",
)
def repo_id_from_url(spark, sf):
    return TB.table(spark, sf, "pages").select("page_id", url.repo_id(F.expr(_URLS)).alias("repo_id"))


@query(
    "git_url_valid",
    f"""WITH u AS (SELECT page_id, {_URLS} AS u FROM pages)
    SELECT page_id, regexp_matches(u, '^https?://') AND (regexp_matches(u, '\\.git$')
      OR regexp_matches(u, '^https?://[^/?#]*(github\\.com|gitlab\\.com|bitbucket\\.org)')) AS is_git FROM u""",
)
def git_url_valid(spark, sf):
    return TB.table(spark, sf, "pages").select("page_id", url.is_git_url(F.expr(_URLS)).alias("is_git"))


_META = """CASE event_id % 8 WHEN 0 THEN '{"team":"backend","n":42,"ok":true}' WHEN 1 THEN '{"a":{"b":1}}' WHEN 2 THEN '{"a":[1,2]}'
 WHEN 3 THEN '[1,2]' WHEN 4 THEN '{"a":null}' WHEN 5 THEN '{}' WHEN 6 THEN NULL ELSE props END"""


@query(
    "validate_search",
    f"""WITH r AS (SELECT event_id, event_id % 8 AS m, CASE WHEN event_type <> 'view' THEN event_type END AS prompt,
      CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 101 WHEN 3 THEN 5.5 ELSE floor(value) END AS k FROM events)
    SELECT event_id, concat_ws(',', CASE WHEN prompt IS NULL THEN 'prompt' END,
      CASE WHEN k IS NOT NULL AND (k <> floor(k) OR k < 1 OR k > 100) THEN 'k' END,
      CASE WHEN m IN (1, 2, 3, 4) THEN 'meta' END) AS errors FROM r""",
)
def validate_search(spark, sf):
    k = F.expr("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 101 WHEN 3 THEN 5.5 ELSE floor(value) END")
    prompt = F.expr("CASE WHEN event_type <> 'view' THEN event_type END")
    errors = validate.search_request(prompt, k, F.expr(_META))
    return TB.table(spark, sf, "events").select("event_id", F.concat_ws(",", errors).alias("errors"))


@query(
    "validate_ingest",
    f"""WITH u AS (SELECT page_id, {_URLS} AS u FROM pages),
    s AS (SELECT page_id, u, CASE WHEN contains(rtrim(u, '/'), '/') THEN regexp_replace(string_split(rtrim(u, '/'), '/')[-1], '(.)\\.git$', '\\1') ELSE '' END AS seg FROM u),
    r AS (SELECT page_id, u, CASE WHEN regexp_full_match(seg, '[a-zA-Z0-9._-]+') THEN seg END AS derived,
      CASE WHEN page_id % 4 = 0 THEN 'bad id!' WHEN page_id % 4 = 1 THEN 'good_id-1' END AS given,
      CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN 'u1' END AS usr,
      CASE WHEN page_id % 6 = 0 THEN repeat('r', 256) WHEN page_id % 6 = 1 THEN 'dev' END AS ref FROM s)
    SELECT page_id, coalesce(given, derived) AS repo_id, coalesce(ref, 'main') AS ref, coalesce(nullif(usr, ''), 'system') AS user_id,
      concat_ws(',', CASE WHEN NOT regexp_matches(u, '^https?://') OR contains(u, '<') THEN 'repoUrl' END,
        CASE WHEN length(ref) > 255 THEN 'ref' END, CASE WHEN usr = '' THEN 'userId' END,
        CASE WHEN page_id % 4 = 0 THEN 'repoId' END,
        CASE WHEN coalesce(given, derived) IS NULL THEN 'repoIdFromUrl' END,
        CASE WHEN NOT (regexp_matches(u, '^https?://') AND (regexp_matches(u, '\\.git$')
          OR regexp_matches(u, '^https?://[^/?#]*(github\\.com|gitlab\\.com|bitbucket\\.org)'))) THEN 'gitUrl' END) AS errors
    FROM r""",
)
def validate_ingest(spark, sf):
    from corpuscle.plans import ingest

    requests = TB.table(spark, sf, "pages").select(
        "page_id",
        F.expr(_URLS).alias("repo_url"),
        F.expr("CASE WHEN page_id % 6 = 0 THEN repeat('r', 256) WHEN page_id % 6 = 1 THEN 'dev' END").alias("ref"),
        F.lit(None).cast("string").alias("token"),
        F.expr("CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN 'u1' END").alias("user_id"),
        F.expr("CASE WHEN page_id % 4 = 0 THEN 'bad id!' WHEN page_id % 4 = 1 THEN 'good_id-1' END").alias("repo_id"),
        F.lit(None).cast("string").alias("meta"),
    )
    ready = ingest.requests(requests, F.lit("2024-01-01").cast("timestamp"))
    return ready.select("page_id", "repo_id", "ref", "user_id", F.concat_ws(",", "errors").alias("errors"))


@query(
    "meta_flat",
    "SELECT event_id, event_id % 8 NOT IN (1, 2, 3, 4) AS flat FROM events",
)
def meta_flat(spark, sf):
    return TB.table(spark, sf, "events").select("event_id", meta.is_flat(F.expr(_META)).alias("flat"))


@query(
    "meta_sanitize",
    """SELECT event_id, CASE event_id % 4
      WHEN 0 THEN 'customField,k' WHEN 1 THEN 'k' WHEN 2 THEN 'flag,k' ELSE '' END AS keys,
      CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END::INTEGER AS n,
      CASE WHEN event_id % 4 < 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def meta_sanitize(spark, sf):
    extra = F.expr("""CASE event_id % 4 WHEN 0 THEN ',"category":"hacked","id":1,"customField":"x"}'
      WHEN 1 THEN ',"nested":{"a":1},"list":[1],"nothing":null}' WHEN 2 THEN ',"flag":true,"repoId":"r"}' END""")
    body = F.concat(F.expr("substring(props, 1, length(props) - 1)"), extra)
    clean = meta.sanitize(meta.variant_map(body))
    return TB.table(spark, sf, "events").select(
        "event_id", F.concat_ws(",", meta.keys(clean)).alias("keys"), F.size(clean).alias("n"),
        F.try_variant_get(clean["k"], "$", "long").alias("k"),
    )


@query(
    "meta_merge",
    """SELECT event_id, concat('category=repository,id=', event_id, ',k=', json_extract(props, '$.k'),
      ',repoId=r', user_id, ',team=', CASE WHEN event_id % 2 = 0 THEN 'own' ELSE event_type END) AS merged,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.') || printf('%03d', CAST(floor((epoch_us(ts) % 1000000) / 1000) AS INTEGER)) || 'Z' AS ts
    FROM events""",
)
def meta_merge(spark, sf):
    base = F.create_map(F.lit("team"), F.col("event_type"), F.lit("category"), F.lit("?"))
    user = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("repoId"), F.lit("hacked"), F.lit("id"), F.lit("x"))
    user = F.when(F.col("event_id") % 2 == 0, F.map_concat(user, F.create_map(F.lit("team"), F.lit("own")))).otherwise(user)
    forced = F.create_map(
        F.lit("id"), F.col("event_id").cast("string"), F.lit("category"), F.lit("repository"),
        F.lit("repoId"), F.concat(F.lit("r"), "user_id"),
    )
    merged = meta.merge(base, meta.sanitize_typed(user), forced)
    pairs = F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return TB.table(spark, sf, "events").select(
        "event_id", F.concat_ws(",", pairs).alias("merged"), moment.iso8601(F.col("ts").cast("timestamp")).alias("ts")
    )


@query(
    "cross_category",
    """WITH wide AS (
      SELECT 'generated_doc' AS category, concat('doc', doc_id) AS id, 'w' || doc_id % 3 AS workspace_id, 'u' || doc_id % 5 AS user_id,
        strftime(TIMESTAMP '2024-01-01' + INTERVAL (doc_id % 1000) MINUTE, '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp, lang, NULL::INTEGER AS label FROM documents
      UNION ALL
      SELECT 'repository', concat('vec', vec_id), 'w' || vec_id % 3, 'u' || vec_id % 5,
        strftime(TIMESTAMP '2024-01-01' + INTERVAL (vec_id % 1000) MINUTE, '%Y-%m-%dT%H:%M:%S.000Z'), NULL, label FROM embeddings)
    SELECT * FROM wide WHERE workspace_id = 'w1' AND user_id = 'u2'
      AND timestamp >= '2024-01-01T01:00:00.000Z' AND timestamp < '2024-01-01T12:00:00.000Z'""",
)
def cross_category(spark, sf):
    def shared(key: str, category: str, prefix: str):
        at = F.timestamp_seconds(F.lit(1704067200) + F.col(key) % 1000 * 60)
        return [
            F.lit(category).alias("category"), F.concat(F.lit(prefix), key).alias("id"),
            F.concat(F.lit("w"), F.col(key) % 3).alias("workspace_id"), F.concat(F.lit("u"), F.col(key) % 5).alias("user_id"),
            moment.iso8601(at).alias("timestamp"),
        ]

    docs = TB.table(spark, sf, "documents").select(*shared("doc_id", "generated_doc", "doc"), "lang")
    vecs = TB.table(spark, sf, "embeddings").select(*shared("vec_id", "repository", "vec"), "label")
    wide = FL.apply_filter(FL.cross_category([docs, vecs]), {"workspace_id": "w1", "user_id": "u2"})
    return wide.where(moment.in_range(F.col("timestamp"), "2024-01-01T01:00:00.000Z", "2024-01-01T12:00:00.000Z"))


def bucket_sql(words: str) -> str:
    return f"list_transform({words}, lambda w: CAST(concat('0x', substr(md5(w), 1, 8)) AS BIGINT) % 64)"


def words_sql(text_sql: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text_sql}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"


def hash_vector_sql(text_sql: str) -> str:
    """Unit vector of bucket counts as DOUBLE[] rounded to FLOAT."""
    return f"""(SELECT list(CAST(c / sqrt(s) AS FLOAT) ORDER BY i) FROM (
      SELECT i, c, CAST(sum(c * c) OVER () AS DOUBLE) AS s FROM (
        SELECT i, CAST(len(list_filter(b, lambda x: x = i)) AS DOUBLE) AS c
        FROM (SELECT {bucket_sql(words_sql(text_sql))} AS b), range(64) r(i))))"""


@query(
    "hash_embed",
    f"""WITH t AS (SELECT item_id, {bucket_sql(words_sql("text"))} AS b FROM benchmark),
    c AS (SELECT item_id, i, CAST(len(list_filter(b, lambda x: x = i)) AS DOUBLE) AS c FROM t, range(64) r(i)),
    v AS (SELECT item_id, i, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY item_id)) AS FLOAT) AS v FROM c)
    SELECT item_id, CAST(i AS INTEGER) AS dim, v FROM v""",
)
def hash_embed(spark, sf):
    embedded = E.embed(TB.table(spark, sf, "benchmark"), "text")
    return embedded.select("item_id", F.posexplode("vector").alias("dim", "v"))


_MODEL = "CASE item_id % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'CLAUDE-3' WHEN 2 THEN 'llama' ELSE '' END"


@query(
    "model_route",
    f"""SELECT item_id, CASE WHEN lower({_MODEL}) LIKE 'gpt%' THEN 'openai' WHEN lower({_MODEL}) LIKE 'claude%' THEN 'anthropic' END AS provider,
    concat_ws(',', CASE WHEN item_id % 7 = 0 THEN 'prompt' END, CASE WHEN {_MODEL} = '' THEN 'model' END,
      CASE WHEN item_id % 4 > 1 THEN 'provider' END) AS errors FROM benchmark""",
)
def model_route(spark, sf):
    model = F.expr(_MODEL)
    prompt = F.when(F.col("item_id") % 7 != 0, F.col("text")).otherwise("  ")
    return TB.table(spark, sf, "benchmark").select(
        "item_id", chat.route(model).alias("provider"), F.concat_ws(",", chat.errors(prompt, model)).alias("errors")
    )


@query(
    "chat_request",
    """SELECT item_id, concat('{"model":"gpt-4o","messages":[',
      CASE WHEN item_id % 2 = 0 THEN '{"role":"system","content":"be brief"},' ELSE '' END,
      '{"role":"user","content":', CAST(to_json(text) AS VARCHAR), '}]',
      CASE WHEN item_id % 3 = 0 THEN ',"temperature":0.5' ELSE '' END,
      CASE WHEN item_id % 5 = 0 THEN ',"max_tokens":100' ELSE '' END,
      CASE WHEN item_id % 7 = 0 THEN ',"response_format":{"type":"json_object"}' ELSE '' END, '}') AS request FROM benchmark""",
)
def chat_request(spark, sf):
    def every(n: int, value):
        return F.when(F.col("item_id") % n == 0, F.lit(value))

    request = chat.build_request(
        F.col("text"), F.lit("gpt-4o"), every(2, "be brief"), every(3, 0.5), every(5, 100), F.col("item_id") % 7 == 0
    )
    return TB.table(spark, sf, "benchmark").select("item_id", request.alias("request"))
