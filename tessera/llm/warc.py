"""Not-modified revisits of a web archive, resolved to the response that they stand for.

A revisit is joined as of its time to the latest earlier full response of the
same canonical URL.  Time is cut into ranges of equally many records: the last
response before a range comes from a summary of a row for each URL and range,
the last one inside it from a window over URL and range.  So no task gets more
records of a URL than a range holds, however often the URL was captured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ranges import quantile_bounds, range_number

#: Records that a range of time holds, and the most ranges.
RANGE_RECORDS, MAX_RANGES = 20_000, 16_384
#: Query parameters that name a campaign or a session, no resource (fixed values).
TRACKING = r"^(utm_[^=]*|gclid|fbclid|sessionid|phpsessid|jsessionid|sid)(=|$)"
#: Fields of a 304 response that do not replace stored ones (fixed values; RFC 9111, 3.2, and fields that describe the body).
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "set-cookie", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Key under which captures of one resource meet; null for null and for URLs without ``://``.

    Without scheme, ``www`` label, user, default port, fragment, tracking
    parameters and trailing slashes; host lower-cased, parameters sorted."""
    rest = F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]+://([^#]*)", 1), r"\s+$", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    parameters = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.rlike(F.lower(p), F.lit(TRACKING))))
    query = F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(parameters, "&"))).otherwise(F.lit(""))
    return F.when(F.instr(url, "://") > 1, F.concat(host, path, query))


def opaque_tag(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(etag, r"^\s*[Ww]/", "")


def resolve_revisits(records: DataFrame, *, range_records: int = RANGE_RECORDS) -> DataFrame:
    """Every revisit of ``records`` with the response that it stands for.

    ``records``: ``record_id`` long, ``kind`` (``response`` or ``revisit``), ``url``,
    ``time`` long, ``digest``, ``headers`` map<string,string> with lower-case names.
    Returns ``record_id, url_key, time, refers_to, status, headers``.  Of several
    responses at the latest time before a revisit's the largest id counts; one
    at its own time is no earlier one.  Validators: the entity tag if the revisit
    has one (weak comparison), else its ``last-modified``, else its digest; the
    first of these that it has must equal the response's.  ``status``: ``resolved``
    (headers of the response, replaced by the revisit's permitted ones),
    ``changed`` (validators differ), ``unverified`` (no validator), ``orphan`` (no
    earlier response, null URL or null time); the latter three keep the revisit's
    own headers.  Null headers count as none.  Repeated rows each get a result."""
    none = F.create_map().cast("map<string,string>")
    rows = records.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", canonical_url(F.col("url")).alias("url_key"), F.col("time").cast("long").alias("time"), "digest", F.coalesce("headers", none).alias("headers")
    )
    known = rows.filter(F.col("url_key").isNotNull() & F.col("time").isNotNull())
    n = known.select(F.count("*")).first()[0]
    bounds = quantile_bounds(known, F.col("time"), min(MAX_RANGES, -(-n // range_records)))
    known = known.withColumn("range", range_number(bounds, F.col("time")))
    stored = F.struct("time", "record_id", "digest", "headers")
    summary = known.filter("kind = 'response'").groupBy("url_key", "range").agg(F.max_by(stored, F.struct("time", "record_id")).alias("last"))
    # a row for each URL and range that has a record, with the last response before the range
    present = known.filter("kind = 'revisit'").select("url_key", "range").distinct()
    by_range = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = present.join(summary, ["url_key", "range"], "full").withColumn("before", F.last("last", ignorenulls=True).over(by_range)).filter("before IS NOT NULL").select("url_key", "range", "before")
    inside = Window.partitionBy("url_key", "range").orderBy("time", F.col("kind") == "response", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    scanned = known.withColumn("inside", F.last(F.when(F.col("kind") == "response", stored), ignorenulls=True).over(inside)).filter("kind = 'revisit'")
    # a response at the revisit's own time sorts after it, so what precedes is earlier
    joined = scanned.join(before, ["url_key", "range"], "left").withColumn("found", F.coalesce("inside", "before"))
    orphans = rows.filter((F.col("kind") == "revisit") & (F.col("url_key").isNull() | F.col("time").isNull())).withColumn("found", F.lit(None).cast(joined.schema["found"].dataType))
    columns = ["record_id", "url_key", "time", "digest", "headers", "found"]
    return _judged(joined.select(columns).unionByName(orphans.select(columns)))


def _judged(joined: DataFrame) -> DataFrame:
    own, stored = F.col("headers"), F.col("found.headers")
    same = (
        F.when(own["etag"].isNotNull(), F.coalesce(opaque_tag(own["etag"]) == opaque_tag(stored["etag"]), F.lit(False)))
        .when(own["last-modified"].isNotNull(), F.coalesce(own["last-modified"] == stored["last-modified"], F.lit(False)))
        .when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == F.col("found.digest"), F.lit(False)))
    )
    status = F.when(F.col("found").isNull(), "orphan").when(same.isNull(), "unverified").when(same, "resolved").otherwise("changed")
    permitted = F.map_filter(own, lambda k, v: ~k.isin(*NOT_MERGED))
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(permitted, k))
    return (
        joined.withColumn("status", status)
        .withColumn("merged", F.when(F.col("status") == "resolved", F.map_concat(kept, permitted)).otherwise(own))
        .select("record_id", "url_key", "time", F.col("found.record_id").alias("refers_to"), "status", F.col("merged").alias("headers"))
    )


DAY = 86_400


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl of ``pages``: each page is a full response, minute by minute, and is asked
    for again a day later with the validators of its text; the server answers 304.

    Every seventh of these carries the tag of another version, every fifth a weak
    tag, every eleventh a modification date instead, every thirteenth a digest alone."""
    p = F.col("page_id")
    text = F.coalesce("html", F.lit(""))
    tag = F.concat(F.lit('"'), F.substring(F.md5(text.cast("binary")), 1, 16), F.lit('"'))
    time = F.lit(1_700_000_000).cast("long") + p * 60
    modified = F.concat(F.lit("day "), F.floor(p / 1440).cast("string"))
    first = F.struct(
        (2 * p).alias("record_id"),
        F.lit("response").alias("kind"),
        time.alias("time"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length(text).cast("string"), F.lit("etag"), tag, F.lit("last-modified"), modified, F.lit("date"), time.cast("string")).alias("headers"),
    )
    other = F.when(p % 7 == 0, F.lit('"0"')).when(p % 5 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    dated = F.create_map(F.lit("date"), (time + DAY).cast("string"), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=60"))
    validators = (
        F.when(p % 13 == 0, F.create_map().cast("map<string,string>"))
        .when(p % 11 == 0, F.create_map(F.lit("last-modified"), modified))
        .otherwise(F.create_map(F.lit("etag"), other))
    )
    again = F.struct((2 * p + 1).alias("record_id"), F.lit("revisit").alias("kind"), (time + DAY).alias("time"), F.map_concat(dated, validators).alias("headers"))
    rows = pages.select("url", F.sha1(text.cast("binary")).alias("digest"), F.explode(F.array(first, again)).alias("r"))
    return rows.select("r.record_id", "r.kind", "url", "r.time", "digest", "r.headers")


def op7_warc_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolve_revisits(records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "url_key", "refers_to", "status", listed.alias("headers"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id AS p, url, coalesce(html, '') AS html, 1700000000 + page_id * 60 AS t FROM pages
), c AS (
  SELECT *, rtrim(regexp_extract(url, '^[^:/?#]+://([^#]*)', 1)) AS rest FROM p
), d AS (
  SELECT *,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^.*@', ''), ':(80|443)?$', ''), '^www\d*\.', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|sessionid|phpsessid|jsessionid|sid)(=|$)'))) AS q
  FROM c
), k AS (
  SELECT *, CASE WHEN strpos(url, '://') > 1 THEN host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS url_key,
    '"' || substr(md5(html), 1, 16) || '"' AS tag, 'day ' || CAST(p // 1440 AS VARCHAR) AS modified, sha1(html) AS digest, strlen(html) AS size
  FROM d
), m AS (
  SELECT v.p AS v, max_by(r.p, (r.t, r.p)) AS r FROM k v JOIN k r ON v.url_key = r.url_key AND r.t < v.t + 86400 GROUP BY v.p
), j AS (
  SELECT v.*, r.p AS rp, r.tag AS rtag, r.modified AS rmodified, r.digest AS rdigest, r.size AS rsize, r.t AS rt,
    CASE WHEN v.p % 13 = 0 THEN 'digest' WHEN v.p % 11 = 0 THEN 'date' ELSE 'tag' END AS how,
    CASE WHEN v.p % 7 = 0 THEN '"0"' WHEN v.p % 5 = 0 THEN 'W/' || v.tag ELSE v.tag END AS etag
  FROM k v LEFT JOIN m ON v.p = m.v LEFT JOIN k r ON m.r = r.p
), s AS (
  SELECT *, CASE WHEN rp IS NULL THEN 'orphan'
    WHEN CASE how WHEN 'digest' THEN digest = rdigest WHEN 'date' THEN modified = rmodified ELSE regexp_replace(etag, '^W/', '') = rtag END THEN 'resolved' ELSE 'changed' END AS status
  FROM j
)
SELECT 2 * p + 1 AS record_id, url_key, 2 * rp AS refers_to, status,
  'cache-control: max-age=60' || chr(10) || 'content-length: ' || CASE WHEN status = 'resolved' THEN CAST(rsize AS VARCHAR) ELSE '0' END || chr(10) ||
  CASE WHEN status = 'resolved' THEN 'content-type: text/html' || chr(10) ELSE '' END || 'date: ' || CAST(t + 86400 AS VARCHAR) ||
  CASE WHEN how = 'tag' THEN chr(10) || 'etag: ' || etag WHEN status = 'resolved' THEN chr(10) || 'etag: ' || rtag ELSE '' END ||
  CASE WHEN how = 'date' THEN chr(10) || 'last-modified: ' || modified WHEN status = 'resolved' THEN chr(10) || 'last-modified: ' || rmodified ELSE '' END AS headers
FROM s
"""
