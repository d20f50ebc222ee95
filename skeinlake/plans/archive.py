"""Queries over the archive operators, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.functions import paths as P
from skeinlake.functions import stamps as S
from skeinlake.functions import urls as U
from skeinlake.operators import checks, index, pages
from skeinlake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- lookups -------------------------------------------------------------------------------------------------------

#: A URL that the captures hold often, and the time range asked for.
ASKED, SINCE, UNTIL = "https://docs.biozhi.example/", "2022-01-01", "2025-01-01"
_CDX = "strptime(substr(ts_raw, 1, 14), '%Y%m%d%H%M%S')"
_KEYS = f"({U.key_sql(f"'{ASKED}'", False)}, {U.key_sql(f"'{ASKED}'", True)})"


@query(f"""SELECT capture_id, key, ts_raw, index_path FROM captures
  WHERE key IN {_KEYS} AND regexp_matches(ts_raw, '^[0-9]{{14}}([0-9]{{3}})?$') AND {_CDX} >= TIMESTAMP '{SINCE}' AND {_CDX} < TIMESTAMP '{UNTIL}'""")
def lookup_url_range(spark: SparkSession, d: str) -> DataFrame:
    return index.lookup(table(spark, d, "captures"), ASKED, SINCE, UNTIL).select("capture_id", "key", "ts_raw", "index_path")


@query(f"SELECT capture_id, key, ts_raw FROM captures WHERE key IN {_KEYS} AND index_path = 'indexes/index.cdx'  AND regexp_matches(ts_raw, '^[0-9]{{14}}([0-9]{{3}})?$')")
def lookup_one_index(spark: SparkSession, d: str) -> DataFrame:
    return index.lookup(table(spark, d, "captures"), ASKED, index_path="indexes/index.cdx").where(c("ts").isNotNull()).select("capture_id", "key", "ts_raw")


@query(f"""WITH k AS (SELECT DISTINCT main_page_url AS asked, unnest([{U.key_sql('main_page_url', False)}, {U.key_sql('main_page_url', True)}]) AS key FROM packages)
  SELECT k.asked, count(*) AS n, min(ts_raw) AS first_ts FROM (SELECT DISTINCT * FROM k) k JOIN captures USING (key) GROUP BY k.asked""")
def lookup_many_urls(spark: SparkSession, d: str) -> DataFrame:
    hits = index.lookup_many(table(spark, d, "captures"), table(spark, d, "packages").select(c("main_page_url").alias("url")))
    return hits.groupBy("asked").agg(F.count(F.lit(1)).alias("n"), F.min("ts_raw").alias("first_ts"))


@query(f"SELECT capture_id, {U.key_sql('url', False)} AS wayback, {U.key_sql('url', True)} AS warcio FROM captures")
def url_key_families(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captures").select("capture_id", U.surt_wayback(c("url")).alias("wayback"), U.surt_warcio(c("url")).alias("warcio"))


@query(f"SELECT page_id, {U.key_sql('url', False)} AS surt FROM wacz_pages")
def surt_wayback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wacz_pages").select("page_id", U.surt_wayback(c("url")).alias("surt"))


@query(f"SELECT page_id, {U.key_sql('url', True)} AS surt FROM wacz_pages")
def surt_warcio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wacz_pages").select("page_id", U.surt_warcio(c("url")).alias("surt"))


@query("SELECT capture_id FROM captures WHERE regexp_matches(url, '(?i)^https?://[^/]')")
def http_captures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captures").where(U.is_http(c("url"))).select("capture_id")


# --- times and digests -----------------------------------------------------------------------------------------------


@query("SELECT page_id, strftime(date_trunc('millisecond', ts), '%Y%m%d%H%M%S%g') AS ts_raw FROM wacz_pages")
def cdx_timestamp_ms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wacz_pages").select("page_id", S.cdx_timestamp(c("ts")).alias("ts_raw"))


@query("""SELECT capture_id, CASE WHEN regexp_matches(ts_raw, '^[0-9]{14}([0-9]{3})?$') THEN epoch_us(strptime(substr(ts_raw, 1, 14), '%Y%m%d%H%M%S')) + coalesce(try_cast(substr(ts_raw, 15, 3) AS BIGINT), 0) * 1000 END AS us FROM captures""")
def cdx_timestamp_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captures").select("capture_id", F.unix_micros(S.parse_cdx(c("ts_raw"))).alias("us"))


@query(r"""SELECT page_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || regexp_replace(strftime(ts, '.%f'), '\.?0+$', '') || 'Z' AS ts_text FROM wacz_pages""")
def rfc3339_render(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wacz_pages").select("page_id", S.render_rfc3339(c("ts")).alias("ts_text"))


_STRICT = "regexp_matches(ts, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]{1,9})?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$') AND NOT regexp_matches(ts, ':60([.Zz+-]|$)')"


@query(f"""SELECT raw_id, CASE WHEN {_STRICT} THEN epoch_us(try_cast(regexp_replace(upper(ts), '(\\.[0-9]{{6}})[0-9]+', '\\1') AS TIMESTAMPTZ)) END AS us FROM raw_pages""")
def rfc3339_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_pages").select("raw_id", F.unix_micros(S.parse_rfc3339(c("ts"))).alias("us"))


@query("""WITH v AS (SELECT date_id, value AS ts FROM manifest_dates) SELECT date_id, CASE WHEN """ + _STRICT + """ THEN epoch_us(try_cast(regexp_replace(upper(ts), '(\\.[0-9]{6})[0-9]+', '\\1') AS TIMESTAMPTZ))
  WHEN regexp_matches(ts, '^[0-9]{4}-[0-9]{2}-[0-9]{2}([Tt ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]{1,9})?)?)?$') AND NOT regexp_matches(ts, ':60([.Zz+-]|$)')
  THEN epoch_us(try_cast(CASE WHEN length(ts) = 16 THEN upper(ts) || ':00' ELSE regexp_replace(upper(ts), '(\\.[0-9]{6})[0-9]+', '\\1') END AS TIMESTAMP)) END AS us,
  coalesce(""" + _STRICT + """, false) AS strict FROM v""")
def manifest_dates_compatible(spark: SparkSession, d: str) -> DataFrame:
    at = table(spark, d, "manifest_dates")
    gate = c("value").rlike(S.RFC3339) & ~c("value").rlike(r":60([.Zz+-]|\z)")
    return at.select("date_id", F.unix_micros(S.parse_compatible(c("value"))).alias("us"), F.coalesce(gate, F.lit(False)).alias("strict"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS hash, octet_length(encode(text)) AS bytes FROM documents")
def sha256_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.sha256_label(c("text")).alias("hash"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT member_id, CASE WHEN regexp_matches(hash, '^sha256:[0-9A-Fa-f]{64}$') THEN 'sha256:' || lower(substr(hash, 8)) END AS hash FROM members")
def canonical_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "members").select("member_id", S.canonical_sha256(c("hash")).alias("hash"))


def _digest_sql(text: str) -> tuple[str, str]:
    """(algorithm, hex) of a labelled digest in hexadecimal or base32."""
    label = f"replace(lower(CASE WHEN contains({text}, ':') THEN split_part({text}, ':', 1) ELSE 'sha1' END), '-', '')"
    value = f"(CASE WHEN contains({text}, ':') THEN regexp_replace({text}, '^[^:]*:', '') ELSE {text} END)"
    bits = f"array_to_string(list_transform(string_split(rtrim(upper({value}), '='), ''), lambda x: lpad(bin(strpos('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x) - 1), 5, '0')), '')"
    digit = f"substr('0123456789abcdef', 1 + 8 * substr({bits}, 4 * i + 1, 1)::INT + 4 * substr({bits}, 4 * i + 2, 1)::INT + 2 * substr({bits}, 4 * i + 3, 1)::INT + substr({bits}, 4 * i + 4, 1)::INT, 1)"
    size = f"(CASE {label} WHEN 'md5' THEN 16 WHEN 'sha1' THEN 20 WHEN 'sha256' THEN 32 WHEN 'sha512' THEN 64 END)"
    return label, (f"CASE WHEN regexp_matches({value}, '^[0-9A-Fa-f]+$') AND length({value}) = 2 * {size} THEN lower({value}) "
                   f"WHEN regexp_matches({value}, '^[A-Za-z2-7]+=*$') AND length(rtrim({value}, '=')) = ceil({size} * 8 / 5.0) THEN array_to_string(list_transform(range(2 * {size}), lambda i: {digit}), '') END")


@query(f"SELECT capture_id, {_digest_sql('digest')[0]} AS algorithm, {_digest_sql('digest')[1]} AS hex FROM captures")
def labelled_digests(spark: SparkSession, d: str) -> DataFrame:
    parts = S.digest_parts(c("digest"))
    return table(spark, d, "captures").select("capture_id", parts["algorithm"].alias("algorithm"), parts["hex"].alias("hex"))


@query(r"""WITH t AS (SELECT page_id, url, id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || regexp_replace(strftime(ts, '.%f'), '\.?0+$', '') || 'Z' AS ts_text FROM wacz_pages)
  SELECT page_id, coalesce(id, substr(sha256(ts_text || url), 1, 24)) AS id FROM t""")
def synthetic_page_id(spark: SparkSession, d: str) -> DataFrame:
    made = S.synthetic_id(S.render_rfc3339(c("ts")), c("url"))
    return table(spark, d, "wacz_pages").select("page_id", F.coalesce("id", made).alias("id"))


# --- paths and lines ---------------------------------------------------------------------------------------------------

_PATHS = "(SELECT DISTINCT path FROM (SELECT path FROM members UNION ALL SELECT path FROM resources UNION ALL SELECT index_path FROM captures UNION ALL SELECT data_path FROM zipnum_blocks) WHERE path IS NOT NULL)"
_SAFE = "(NOT contains(path, '\\') AND NOT regexp_matches(path, '(^|/)(\\.{0,2})(/|$)'))"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    named = {"members": "path", "resources": "path", "captures": "index_path", "zipnum_blocks": "data_path"}
    parts = [table(spark, d, t).select(c(k).alias("path")) for t, k in named.items()]
    return checks.union(parts).where(c("path").isNotNull()).distinct()


@query(f"SELECT path, {_SAFE} AS safe FROM {_PATHS}")
def path_is_safe(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("path", P.is_safe(c("path")).alias("safe"))


@query(f"""SELECT path, {_SAFE} AND regexp_matches(path, '^archive/[^/]+\\.warc(\\.gz)?$') AS is_warc, {_SAFE} AND regexp_matches(path, '^indexes/[^/]+\\.cdxj?(\\.gz)?$') AS is_index,
  {_SAFE} AND regexp_matches(path, '^indexes/[^/]+\\.cdx\\.gz$') AS is_data, {_SAFE} AND regexp_matches(path, '^indexes/[^/]+\\.idx$') AS is_summary,
  CASE WHEN path LIKE '%.warc.gz' THEN 'true' WHEN path LIKE '%.warc' THEN 'false' END AS gzip, (path LIKE 'archive/%' OR path LIKE '%.gz') AS stored FROM {_PATHS}""")
def path_kinds(spark: SparkSession, d: str) -> DataFrame:
    p = c("path")
    return _paths(spark, d).select("path", P.is_warc(p).alias("is_warc"), P.is_cdxj_index(p).alias("is_index"), P.is_zipnum_data(p).alias("is_data"),
                                   P.is_zipnum_summary(p).alias("is_summary"), P.warc_gzip(p).cast("string").alias("gzip"), P.requires_stored(p).alias("stored"))


@query(f"""SELECT path, CASE WHEN path LIKE '%.cdx.gz' THEN left(path, length(path) - 7) || '.idx' WHEN path LIKE '%.idx' THEN left(path, length(path) - 4) || '.cdx.gz' END AS partner,
  regexp_extract(path, '([^/]*)$', 1) AS file_name, CASE WHEN regexp_matches(path, '^indexes/[^/]+$') THEN substr(path, 9) END AS index_name,
  CASE WHEN regexp_extract(path, '([^/]*)$', 1) = 'extraPages.jsonl' THEN 'extra-pages.jsonl' ELSE regexp_extract(path, '([^/]*)$', 1) END AS resource_name FROM {_PATHS}""")
def path_names(spark: SparkSession, d: str) -> DataFrame:
    p = c("path")
    return _paths(spark, d).select("path", P.zipnum_partner(p).alias("partner"), P.file_name(p).alias("file_name"), P.direct_name(p, "indexes").alias("index_name"), P.resource_name(p).alias("resource_name"))


@query("SELECT resource_id, regexp_matches(name, '^[a-z0-9._-]+$') AS valid FROM resources")
def valid_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resources").select("resource_id", P.valid_name(c("name")).alias("valid"))


@query("SELECT capture_id, nullif(trim(string_split(mime, ';')[1]), '') AS essence, CASE WHEN status BETWEEN 300 AND 399 THEN 'warc/revisit' ELSE coalesce(nullif(trim(string_split(mime, ';')[1]), ''), 'unk') END AS mime FROM captures")
def mime_projection(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(c("status").between(300, 399), "revisit").otherwise("response")
    return table(spark, d, "captures").select("capture_id", P.content_type_essence(c("mime")).alias("essence"), pages.mime_type(kind, c("mime"), F.lit(None).cast("string")).alias("mime"))


@query("SELECT capture_id, coalesce(digest, 'sha256:' || sha256(url)) AS digest, CASE WHEN filename LIKE 'archive/%' THEN filename ELSE 'archive/' || filename END AS member FROM captures")
def digest_projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captures").select("capture_id", F.coalesce("digest", S.sha256_label(c("url"))).alias("digest"), P.archive_path(c("filename")).alias("member"))


_LINE = "key || ' ' || ts_raw || ' {\"n\":' || capture_id || '}'"


@query(f"WITH l AS (SELECT capture_id, {_LINE} AS line FROM captures) SELECT capture_id, split_part(line, ' ', 1) AS key, split_part(line, ' ', 2) AS ts_raw, split_part(line, ' ', 3) AS json, split_part(line, ' ', 1) AS line_key FROM l WHERE line IS NOT NULL")
def index_line_parts(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(c("key"), F.lit(" "), c("ts_raw"), F.lit(' {"n":'), c("capture_id").cast("string"), F.lit("}"))
    at = table(spark, d, "captures").select("capture_id", line.alias("line")).where(c("line").isNotNull())
    parts = P.split_prefix(c("line"))
    return at.select("capture_id", parts["key"].alias("key"), parts["ts_raw"].alias("ts_raw"), parts["json"].alias("json"), P.line_key(c("line")).alias("line_key"))


# --- index building --------------------------------------------------------------------------------------------------------

_DAYS = "SELECT DISTINCT key || ' ' || substr(ts_raw, 1, 8) AS line FROM captures WHERE key IS NOT NULL AND ts_raw IS NOT NULL"


def _day_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captures").select(F.concat(c("key"), F.lit(" "), F.substring("ts_raw", 1, 8)).alias("line"))


@query(_DAYS)
def index_sort_dedup(spark: SparkSession, d: str) -> DataFrame:
    return index.build_index(_day_lines(spark, d))


_LINE = """concat_ws(' ', key, ts_raw, '{' || concat_ws(',', '"url":' || to_json(url), '"digest":' || to_json(digest), '"mime":' || to_json(mime), '"status":' || status, '"offset":' || byte_offset,
  '"length":' || byte_length, '"filename":' || to_json(filename), '"recordDigest":' || to_json(record_digest)) || '}')"""
_WHOLE = f"SELECT DISTINCT {_LINE} AS line FROM captures WHERE key IS NOT NULL AND ts_raw IS NOT NULL"


@query(f"SELECT DISTINCT {_LINE} AS line FROM captures")
def index_lines(spark: SparkSession, d: str) -> DataFrame:
    return index.build_index(index.capture_lines(table(spark, d, "captures")))


@query(f"SELECT line, row_number() OVER (ORDER BY line) - 1 AS ordinal, (row_number() OVER (ORDER BY line) - 1) // 1024 AS block_no FROM ({_DAYS})")
def zipnum_block_assign(spark: SparkSession, d: str) -> DataFrame:
    return index.assign_blocks(_day_lines(spark, d))


_BLOCKS = f"""WITH b AS (SELECT line, (row_number() OVER (ORDER BY line) - 1) // 1024 AS block_no FROM ({_DAYS})),
  s AS (SELECT block_no, min(line) AS first_prefix, count(*) AS n_lines, sum(octet_length(encode(line)) + 1) AS n_bytes FROM b GROUP BY block_no)"""


@query(_BLOCKS + "SELECT block_no, first_prefix, n_lines, n_bytes::BIGINT AS n_bytes FROM s")
def zipnum_block_summary(spark: SparkSession, d: str) -> DataFrame:
    return index.block_summary(index.assign_blocks(_day_lines(spark, d)))


@query(_BLOCKS + "SELECT block_no, n_bytes::BIGINT AS n_bytes, coalesce(sum(n_bytes) OVER (ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM s")
def zipnum_running_offset(spark: SparkSession, d: str) -> DataFrame:
    return index.block_offsets(index.block_summary(index.assign_blocks(_day_lines(spark, d)))).select("block_no", "n_bytes", "byte_offset")


# The same over whole index lines, as index_lines has them. The queries above keep the day lines of their SQL.

_LINE_BLOCKS = f"""WITH b AS (SELECT line, row_number() OVER (ORDER BY line) - 1 AS ordinal, (row_number() OVER (ORDER BY line) - 1) // 1024 AS block_no FROM ({_WHOLE})),
  s AS (SELECT block_no, array_to_string(string_split(min(line), ' ')[1:2], ' ') AS first_prefix, count(*) AS n_lines, sum(octet_length(encode(line)) + 1)::BIGINT AS n_bytes FROM b GROUP BY block_no)
"""


def _index_lines(spark: SparkSession, d: str) -> DataFrame:
    return index.capture_lines(table(spark, d, "captures").where(c("key").isNotNull() & c("ts_raw").isNotNull()))


@query(_LINE_BLOCKS + "SELECT line, ordinal, block_no FROM b")
def index_line_blocks(spark: SparkSession, d: str) -> DataFrame:
    return index.assign_blocks(_index_lines(spark, d))


@query(_LINE_BLOCKS + "SELECT block_no, first_prefix, n_lines, n_bytes FROM s")
def index_line_summary(spark: SparkSession, d: str) -> DataFrame:
    return index.block_summary(index.assign_blocks(_index_lines(spark, d)))


@query(_LINE_BLOCKS + "SELECT block_no, n_bytes, coalesce(sum(n_bytes) OVER (ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM s")
def index_line_offsets(spark: SparkSession, d: str) -> DataFrame:
    return index.block_offsets(index.block_summary(index.assign_blocks(_index_lines(spark, d)))).select("block_no", "n_bytes", "byte_offset")


_PREVIOUS = "lag(row(key, ts_raw)) OVER (PARTITION BY package_id, index_path ORDER BY line_no, capture_id)"


@query(f"SELECT capture_id, package_id, index_path, line_no FROM (SELECT *, {_PREVIOUS} AS p FROM captures WHERE key IS NOT NULL AND ts_raw IS NOT NULL) WHERE p > row(key, ts_raw)")
def index_order_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "captures").where(c("key").isNotNull() & c("ts_raw").isNotNull())
    return index.order_violations(rows, ["package_id", "index_path"], ["line_no", "capture_id"]).select("capture_id", "package_id", "index_path", "line_no")


@query(f"SELECT package_id, index_path, min(line_no) AS line_no FROM (SELECT *, {_PREVIOUS} AS p FROM captures WHERE key IS NOT NULL AND ts_raw IS NOT NULL) WHERE p > row(key, ts_raw) GROUP BY ALL")
def first_error_per_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "captures").where(c("key").isNotNull() & c("ts_raw").isNotNull())
    return index.first_violation(index.order_violations(rows, ["package_id", "index_path"], ["line_no", "capture_id"]), ["package_id", "index_path"], "line_no")


@query("""SELECT block_id FROM (SELECT *, lag(row(key, ts_raw)) OVER (PARTITION BY package_id, summary_path ORDER BY block_no, block_id) AS p FROM zipnum_blocks) WHERE p > row(key, ts_raw)""")
def summary_order_violations(spark: SparkSession, d: str) -> DataFrame:
    return index.order_violations(table(spark, d, "zipnum_blocks"), ["package_id", "summary_path"], ["block_no", "block_id"]).select("block_id")


_FIRST = "(SELECT package_id, summary_path, block_no, min(key) AS key FROM zipnum_blocks GROUP BY ALL)"


@query(f"""WITH b AS (SELECT *, lead(key) OVER (PARTITION BY package_id, summary_path ORDER BY block_no) AS upper FROM {_FIRST}),
  k AS (SELECT DISTINCT {U.key_sql('main_page_url', False)} AS k FROM packages)
  SELECT package_id, summary_path, block_no, k FROM b JOIN k ON b.key <= k.k AND (b.upper IS NULL OR b.upper >= k.k)""")
def zipnum_block_prune(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "zipnum_blocks").groupBy("package_id", "summary_path", "block_no").agg(F.min("key").alias("key"))
    keys = table(spark, d, "packages").select(U.surt_wayback(c("main_page_url")).alias("k"))
    return index.candidate_blocks(blocks, keys, ["package_id", "summary_path"])


@query("""SELECT z.block_id FROM zipnum_blocks z WHERE NOT EXISTS (SELECT 1 FROM captures WHERE captures.package_id = z.package_id AND captures.key = z.key AND captures.ts_raw = z.ts_raw)""")
def blocks_without_capture(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "captures").select("package_id", "key", "ts_raw").distinct()
    return table(spark, d, "zipnum_blocks").join(lines, ["package_id", "key", "ts_raw"], "left_anti").select("block_id")


# --- pages -------------------------------------------------------------------------------------------------------------------

_META = """(SELECT event_id AS ord, user_id AS record_id, CASE WHEN event_type = 'view' THEN json_extract_string(props, '$.k') END AS title, event_type = 'click' AS via,
  CASE WHEN event_type = 'purchase' THEN 'https://annotated.example/' || user_id || '/' || event_id END AS page_url FROM events)"""
_ANN = f"""ann AS (SELECT record_id, arg_max(title, ord) FILTER (title IS NOT NULL AND title <> '') AS title, bool_or(via) AS via, arg_max(page_url, ord) FILTER (page_url IS NOT NULL) AS page_url FROM {_META} GROUP BY record_id)"""
_DRAFTS = "drafts AS (SELECT raw_id AS ord, raw_id AS record_id, url, ts AS ts_text, title FROM raw_pages)"
_JOINED = f"""WITH {_ANN}, {_DRAFTS}, j AS (SELECT d.ord, d.record_id, coalesce(a.page_url, d.url) AS url, d.ts_text, coalesce(a.title, d.title) AS title, coalesce(a.via, false) AS via, a.page_url
  FROM drafts d LEFT JOIN ann a USING (record_id))"""


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    kind, n = c("event_type"), c("user_id").cast("string")
    return table(spark, d, "events").select(
        c("event_id").alias("ord"), c("user_id").alias("record_id"), F.when(kind == "view", F.get_json_object("props", "$.k")).alias("title"), (kind == "click").alias("via"),
        F.when(kind == "purchase", F.concat(F.lit("https://annotated.example/"), n, F.lit("/"), c("event_id").cast("string"))).alias("page_url"))


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_pages").select(c("raw_id").alias("ord"), c("raw_id").alias("record_id"), "url", c("ts").alias("ts_text"), "title")


def _pages(spark: SparkSession, d: str, only: bool = False) -> DataFrame:
    return pages.annotate(_drafts(spark, d), pages.merge_annotations(_metadata(spark, d)), only)


@query(f"WITH {_ANN} SELECT * FROM ann")
def annotation_merge(spark: SparkSession, d: str) -> DataFrame:
    return pages.merge_annotations(_metadata(spark, d))


@query(_JOINED + "SELECT ord, record_id, url, ts_text, title, via FROM j")
def pages_join_annotations(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d)


@query(_JOINED + "SELECT ord, CASE WHEN via THEN 'pages/extraPages.jsonl' ELSE 'pages/pages.jsonl' END AS list_path FROM j")
def pages_split_via(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("ord", F.when(c("via"), "pages/extraPages.jsonl").otherwise("pages/pages.jsonl").alias("list_path"))


@query(_JOINED + "SELECT ord, record_id, url, ts_text, title, via FROM j WHERE page_url IS NOT NULL")
def pages_metadata_only(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, True)


@query(_JOINED + "SELECT url, ts_text FROM j WHERE NOT via ORDER BY ord LIMIT 1")
def main_page(spark: SparkSession, d: str) -> DataFrame:
    return pages.main_page(_pages(spark, d))


@query(_JOINED + "SELECT (SELECT count(*) FROM captures) AS records, (SELECT count(*) FROM captures WHERE key IS NOT NULL) AS captures, count(*) AS pages, count(*) FILTER (via) AS extra_pages FROM j")
def conversion_summary(spark: SparkSession, d: str) -> DataFrame:
    caps = table(spark, d, "captures").agg(F.count(F.lit(1)).alias("records"), F.count("key").alias("captures"))
    listed = _pages(spark, d).agg(F.count(F.lit(1)).alias("pages"), F.count_if("via").alias("extra_pages"))
    return caps.crossJoin(listed)  # one row each


@query("SELECT package_id, arg_min(source, doc_id) AS title, min(doc_id) AS ord FROM documents GROUP BY package_id")
def first_warcinfo(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("package_id", c("doc_id").alias("ord"), c("source").alias("title"))
    return pages.first_record(rows, ["package_id"], "ord", ["title", "ord"])


@query("""SELECT package_id, doc_id AS ord FROM (SELECT package_id, doc_id, row_number() OVER (PARTITION BY package_id ORDER BY doc_id) AS n FROM documents) WHERE n > 1""")
def later_warcinfos(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("package_id", c("doc_id").alias("ord"))
    first = rows.groupBy(c("package_id").alias("p")).agg(F.min("ord").alias("first"))
    return rows.join(first, c("package_id").eqNullSafe(c("p"))).where(c("ord") > c("first")).select("package_id", "ord")


_SKIP = "CASE WHEN status IS NULL THEN 'HTTP_UNPARSEABLE' WHEN mime IS NULL THEN 'PAYLOAD_UNDETERMINED' WHEN NOT coalesce(regexp_matches(ts_raw, '^[0-9]{14}([0-9]{3})?$'), false) THEN 'TIMESTAMP_UNREPRESENTABLE' END"


@query(f"SELECT capture_id, {_SKIP} AS reason FROM captures WHERE {_SKIP} IS NOT NULL")
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    reason = pages.skip_reason(c("status"), c("mime"), S.parse_cdx(c("ts_raw")))
    return table(spark, d, "captures").select("capture_id", reason.alias("reason")).where(c("reason").isNotNull())


@query(f"""SELECT 'skipped' AS kind, {_SKIP} AS detail, capture_id AS ord FROM captures WHERE {_SKIP} IS NOT NULL
  UNION ALL SELECT 'multiple_warcinfo', package_id, count(*) - 1 FROM documents WHERE package_id IS NOT NULL GROUP BY package_id HAVING count(*) > 1""")
def warnings_union(spark: SparkSession, d: str) -> DataFrame:
    skipped = skip_reasons(spark, d).select(F.lit("skipped").alias("kind"), c("reason").alias("detail"), c("capture_id").alias("ord"))
    many = table(spark, d, "documents").where(c("package_id").isNotNull()).groupBy("package_id").agg(F.count(F.lit(1)).alias("n")).where(c("n") > 1)
    return many.select(F.lit("multiple_warcinfo").alias("kind"), c("package_id").alias("detail"), (c("n") - 1).alias("ord")).unionByName(skipped)


@query("""SELECT capture_id, unnest(list_filter([record_digest, digest], lambda x: x IS NOT NULL)) AS linked FROM captures""")
def linked_ids_explode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captures").select("capture_id", F.explode(F.array_compact(F.array("record_digest", "digest"))).alias("linked"))


# --- constraints ---------------------------------------------------------------------------------------------------------------

_RES = "NOT IN ('datapackage.json', 'datapackage-digest.json')"


@query(f"SELECT DISTINCT package_id, path FROM members m WHERE path {_RES} AND NOT EXISTS (SELECT 1 FROM resources r WHERE r.package_id = m.package_id AND r.path = m.path)")
def members_unlisted(spark: SparkSession, d: str) -> DataFrame:
    found = checks.manifest_resources(table(spark, d, "resources"), table(spark, d, "members"))
    return found.where(c("code") == "MANIFEST_UNLISTED_MEMBER").select("package_id", "path")


@query(f"SELECT package_id, path FROM resources r WHERE path {_RES} AND NOT EXISTS (SELECT 1 FROM members m WHERE r.package_id = m.package_id AND r.path = m.path)")
def resources_missing(spark: SparkSession, d: str) -> DataFrame:
    found = checks.manifest_resources(table(spark, d, "resources"), table(spark, d, "members"))
    return found.where(c("code") == "MANIFEST_MISSING_MEMBER").select("package_id", "path")


@query("""WITH m AS (SELECT package_id, path, arg_max(hash, row(listed_at, member_id)) AS hash, arg_max(size, row(listed_at, member_id)) AS size FROM members GROUP BY ALL),
  h AS (SELECT r.package_id, r.path, r.bytes, m.size, m.path AS mp, CASE WHEN regexp_matches(r.hash, '^sha256:[0-9A-Fa-f]{64}$') THEN lower(r.hash) END AS rh,
    CASE WHEN regexp_matches(m.hash, '^sha256:[0-9A-Fa-f]{64}$') THEN lower(m.hash) END AS mh FROM resources r LEFT JOIN m ON m.package_id = r.package_id AND m.path = r.path)
  SELECT DISTINCT package_id, path, CASE WHEN mp IS NULL THEN 'missing' WHEN coalesce(rh = mh AND bytes = size, false) THEN 'verified' ELSE 'mismatched' END AS status FROM h""")
def fixity(spark: SparkSession, d: str) -> DataFrame:
    return checks.fixity(table(spark, d, "resources"), table(spark, d, "members"))


@query("SELECT package_id, path, count(*) AS n FROM members GROUP BY ALL HAVING count(*) > 1")
def duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicates(table(spark, d, "members"), ["package_id", "path"])


@query("SELECT package_id, name AS path FROM (SELECT *, min(ord) OVER (PARTITION BY package_id, name) AS f FROM resources) WHERE ord > f")
def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "resources")
    first = rows.groupBy("package_id", "name").agg(F.min("ord").alias("f"))
    return rows.join(first, ["package_id", "name"]).where(c("ord") > c("f")).select("package_id", c("name").alias("path"))


_W, _I, _SUM = (f"({_SAFE} AND regexp_matches(path, '{r}'))" for r in ("^archive/[^/]+\\.warc(\\.gz)?$", "^indexes/[^/]+\\.cdxj?(\\.gz)?$", "^indexes/[^/]+\\.idx$"))
_LAYOUT = f"""WITH d AS (SELECT DISTINCT package_id, path FROM members),
  has AS (SELECT package_id, bool_or(path = 'datapackage.json') AS m, bool_or(path = 'pages/pages.jsonl') AS p, bool_or({_W}) AS w, bool_or({_I}) AS i FROM d GROUP BY package_id),
  layout AS (
    SELECT package_id, 'LAYOUT_DUPLICATE' AS code, path FROM members GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT package_id, 'LAYOUT_MISSING_MANIFEST', NULL FROM has WHERE NOT m
    UNION ALL SELECT package_id, 'LAYOUT_MISSING_PAGES', NULL FROM has WHERE NOT p
    UNION ALL SELECT package_id, 'LAYOUT_MISSING_WARC', NULL FROM has WHERE NOT w
    UNION ALL SELECT package_id, 'LAYOUT_MISSING_INDEX', NULL FROM has WHERE NOT i
    UNION ALL SELECT package_id, 'LAYOUT_BAD_WARC_PATH', path FROM d WHERE path LIKE 'archive/%' AND NOT {_W}
    UNION ALL SELECT package_id, 'LAYOUT_BAD_INDEX_PATH', path FROM d WHERE path LIKE 'indexes/%' AND NOT {_I} AND NOT {_SUM}
    UNION ALL SELECT package_id, 'LAYOUT_INCOMPLETE_INDEX', path FROM d s WHERE {_SUM} AND NOT EXISTS (SELECT 1 FROM d WHERE d.package_id = s.package_id AND d.path = left(s.path, length(s.path) - 4) || '.cdx.gz')
    UNION ALL SELECT DISTINCT package_id, 'LAYOUT_NOT_STORED', path FROM members WHERE (path LIKE 'archive/%' OR path LIKE '%.gz') AND compression <> 'stored')"""


@query(_LAYOUT + " SELECT * FROM layout")
def layout_findings(spark: SparkSession, d: str) -> DataFrame:
    return checks.layout(table(spark, d, "members"))


@query(_LAYOUT + " SELECT DISTINCT p.package_id, NOT EXISTS (SELECT 1 FROM layout l WHERE l.package_id = p.package_id) AS conformant FROM packages p")
def conformance(spark: SparkSession, d: str) -> DataFrame:
    return checks.conformance(checks.layout(table(spark, d, "members")), table(spark, d, "packages"))


@query(f"""SELECT package_id, 'MANIFEST_BAD_NAME' AS code, path FROM resources WHERE NOT regexp_matches(name, '^[a-z0-9._-]+$')
  UNION ALL SELECT package_id, 'MANIFEST_DUPLICATE_NAME', path FROM (SELECT *, min(ord) OVER (PARTITION BY package_id, name) AS f FROM resources) WHERE ord > f
  UNION ALL SELECT package_id, 'MANIFEST_DUPLICATE_PATH', path FROM (SELECT *, min(ord) OVER (PARTITION BY package_id, path) AS f FROM resources) WHERE ord > f
  UNION ALL SELECT package_id, 'MANIFEST_RESERVED_PATH', path FROM resources WHERE NOT path {_RES}
  UNION ALL SELECT package_id, 'MANIFEST_UNSAFE_PATH', path FROM resources WHERE path {_RES} AND NOT {_SAFE}
  UNION ALL SELECT package_id, 'MANIFEST_MISSING_MEMBER', path FROM resources r WHERE path {_RES} AND NOT EXISTS (SELECT 1 FROM members m WHERE r.package_id = m.package_id AND r.path = m.path)
  UNION ALL SELECT DISTINCT package_id, 'MANIFEST_UNLISTED_MEMBER', path FROM members m WHERE path {_RES} AND NOT EXISTS (SELECT 1 FROM resources r WHERE r.package_id = m.package_id AND r.path = m.path)""")
def manifest_findings(spark: SparkSession, d: str) -> DataFrame:
    return checks.manifest_resources(table(spark, d, "resources"), table(spark, d, "members"))


@query(f"SELECT package_id, bool_or({_W}) AS warc, bool_or({_I}) AS index, bool_or(path = 'datapackage.json') AS manifest, bool_or(path = 'pages/pages.jsonl') AS pages FROM members GROUP BY package_id")
def required_members(spark: SparkSession, d: str) -> DataFrame:
    p = c("path")
    return table(spark, d, "members").groupBy("package_id").agg(F.bool_or(P.is_warc(p)).alias("warc"), F.bool_or(P.is_cdxj_index(p)).alias("index"),
                                                              F.bool_or(p == checks.MANIFEST).alias("manifest"), F.bool_or(p == "pages/pages.jsonl").alias("pages"))


@query(f"SELECT DISTINCT package_id, path FROM members m WHERE {_I} AND NOT EXISTS (SELECT 1 FROM zipnum_blocks z WHERE z.package_id = m.package_id AND z.data_path = m.path)")
def index_minus_referenced(spark: SparkSession, d: str) -> DataFrame:
    data = table(spark, d, "zipnum_blocks").select("package_id", c("data_path").alias("path")).distinct()
    return table(spark, d, "members").where(P.is_cdxj_index(c("path"))).select("package_id", "path").distinct().join(data, ["package_id", "path"], "left_anti")


@query("""SELECT DISTINCT z.package_id, z.data_path FROM zipnum_blocks z WHERE z.data_path LIKE '%.cdx.gz' AND NOT EXISTS
  (SELECT 1 FROM members m WHERE m.package_id = z.package_id AND m.path = left(z.data_path, length(z.data_path) - 7) || '.idx')""")
def data_without_summary(spark: SparkSession, d: str) -> DataFrame:
    data = table(spark, d, "zipnum_blocks").select("package_id", "data_path").distinct().where(c("data_path").endswith(".cdx.gz")).withColumn("path", P.zipnum_partner(c("data_path")))
    return data.join(table(spark, d, "members").select("package_id", "path").distinct(), ["package_id", "path"], "left_anti").select("package_id", "data_path")


@query("""SELECT c.capture_id, count(m.member_id) AS n, count(m.member_id) = 1 AS exactly_one FROM captures c
  LEFT JOIN members m ON m.package_id = c.package_id AND m.path = CASE WHEN c.filename LIKE 'archive/%' THEN c.filename ELSE 'archive/' || c.filename END GROUP BY c.capture_id""")
def exactly_one_record(spark: SparkSession, d: str) -> DataFrame:
    # members are counted by key first: a path that many captures name is joined to one row
    m = table(spark, d, "members").groupBy("package_id", "path").agg(F.count(F.lit(1)).alias("n"))
    at = table(spark, d, "captures").select("capture_id", "package_id", P.archive_path(c("filename")).alias("path")).join(m, ["package_id", "path"], "left")
    n = F.coalesce("n", F.lit(0))
    return at.groupBy("capture_id").agg(F.sum(n).alias("n")).withColumn("exactly_one", c("n") == 1)


@query(f"""SELECT capture_id, CASE WHEN NOT key IN ({U.key_sql('url', False)}, {U.key_sql('url', True)}) THEN 'KEY' WHEN NOT coalesce(regexp_matches(ts_raw, '^[0-9]{{14}}([0-9]{{3}})?$'), false) THEN 'TIMESTAMP'
  WHEN status IS NULL THEN 'STATUS' WHEN mime IS NULL THEN 'MIME' END AS error FROM captures WHERE key IS NOT NULL AND url IS NOT NULL""")
def capture_match_first_error(spark: SparkSession, d: str) -> DataFrame:
    url = c("url")
    at = table(spark, d, "captures").where(c("key").isNotNull() & url.isNotNull())
    ts = S.parse_cdx(c("ts_raw"))
    error = checks.match_error(url, url, c("key"), c("ts_raw"), ts, c("status"), F.when(c("status").isNull(), -1).otherwise(c("status")), c("mime"),
                               F.coalesce("mime", F.lit("?")), c("digest"), c("digest"))
    return at.select("capture_id", error.alias("error"))


_REAL = """WITH f AS (SELECT package_id, key, min(capture_id) AS record_id FROM captures WHERE key IS NOT NULL GROUP BY ALL),
  e AS (SELECT c.*, r.url AS r_url, r.ts_raw AS r_ts, r.status AS r_status, r.mime AS r_mime, r.digest AS r_digest FROM captures c JOIN f USING (package_id, key) JOIN captures r ON r.capture_id = f.record_id WHERE c.url IS NOT NULL)
"""
_ANY_TS = "regexp_matches({0}, '^[0-9]{{14}}([0-9]{{3}})?$')"


@query(_REAL + f"""SELECT capture_id, CASE WHEN url IS DISTINCT FROM r_url THEN 'URL' WHEN NOT key IN ({U.key_sql('r_url', False)}, {U.key_sql('r_url', True)}) THEN 'KEY'
  WHEN NOT coalesce({_ANY_TS.format('ts_raw')} AND {_ANY_TS.format('r_ts')} AND rpad(ts_raw, 17, '0') = rpad(CASE WHEN length(ts_raw) = 17 THEN r_ts ELSE left(r_ts, 14) END, 17, '0'), false) THEN 'TIMESTAMP'
  WHEN status IS DISTINCT FROM r_status THEN 'STATUS' WHEN lower(mime) IS DISTINCT FROM lower(r_mime) THEN 'MIME'
  WHEN digest IS NOT NULL OR r_digest IS NOT NULL THEN CASE WHEN coalesce({_digest_sql('digest')[0]} = {_digest_sql('r_digest')[0]} AND {_digest_sql('digest')[1]} = {_digest_sql('r_digest')[1]}, false) THEN NULL ELSE 'DIGEST' END END AS error FROM e""")
def capture_against_first(spark: SparkSession, d: str) -> DataFrame:
    """Each capture against the first capture of its key in its package, which stands in for the record: they differ in every field."""
    rows = table(spark, d, "captures").where(c("key").isNotNull())
    fields = ["url", "ts_raw", "status", "mime", "digest"]
    first = rows.groupBy("package_id", "key").agg(F.min_by(F.struct(*fields), "capture_id").alias("r"))
    at = rows.where(c("url").isNotNull()).join(first, ["package_id", "key"])
    error = checks.match_error(c("url"), c("r.url"), c("key"), c("ts_raw"), S.parse_cdx(c("r.ts_raw")), c("status"), c("r.status"), c("mime"), c("r.mime"), c("digest"), c("r.digest"))
    return at.select("capture_id", error.alias("error"))


@query("SELECT date_id, property IN ('created', 'modified', 'mainPageDate', 'profile', 'name') AS collides FROM manifest_dates")
def extra_property_collision(spark: SparkSession, d: str) -> DataFrame:
    modelled = F.array(*[F.lit(x) for x in ("created", "modified", "mainPageDate", "profile", "name")])
    extra = F.map_from_arrays(F.array("property"), F.array(F.lit("{}")))
    return table(spark, d, "manifest_dates").select("date_id", F.arrays_overlap(F.map_keys(extra), modelled).alias("collides"))


@query("SELECT role, lower(trim(role)) IN ('author', 'publisher', 'maintainer', 'wrangler', 'contributor') AS loose, role IN ('author', 'publisher', 'maintainer', 'wrangler', 'contributor') AS valid FROM (SELECT DISTINCT mediatype AS role FROM resources WHERE mediatype IS NOT NULL)")
def role_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resources").where(c("mediatype").isNotNull()).select(c("mediatype").alias("role")).distinct().select(
        "role", F.lower(F.trim("role")).isin(*checks.ROLES).alias("loose"), c("role").isin(*checks.ROLES).alias("valid"))


@query("SELECT list_path, count(*) AS n, min(line_no) AS first_line, count(*) FILTER (text IS NULL OR text = '') AS blank FROM wacz_pages GROUP BY list_path")
def page_list_counts(spark: SparkSession, d: str) -> DataFrame:
    blank = c("text").isNull() | (c("text") == "")
    return table(spark, d, "wacz_pages").groupBy("list_path").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"), F.count_if(blank).alias("blank"))
