"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over a canonical key ``host + path`` of a URL
together with the literal tokens that every matching URL must hold.  Each rule
is filed under the one of its tokens that is rarest in the URLs themselves; a
URL looks up its own tokens and runs only the regular expressions that it finds
there.  Everything is DataFrame expressions: the index is a literal hash table
in the plan, so judging is one projection over the scan, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules the index is part of the plan that every task gets; more rules are tables that URLs are joined with.
LITERAL_RULES = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN_SPLIT = "[^0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in ``//host path`` (two slashes, host, path);
    ``tokens`` are lower-case alphanumeric runs that every match holds in full."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = field(default=())


def host_path_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """A rule for ``host`` and all its subdomains whose URL path starts with ``path``."""
    pieces = re.split("[^0-9a-z]+", host.lower())
    inside = re.findall(r"(?<=[^0-9A-Za-z])[0-9A-Za-z]+(?=[^0-9A-Za-z])", path)
    tokens = tuple(dict.fromkeys(t for t in [*pieces, *(x.lower() for x in inside)] if t))
    quoted = re.sub(r"([^0-9A-Za-z])", r"\\\1", host.lower())
    return Rule(host.lower() + path, verdict, rf"^//(?:[^/]*\.)?{quoted}" + re.sub(r"([^0-9A-Za-z])", r"\\\1", path), tokens)


#: The rules judged by the registered query (fixed values).
DEFAULT_RULES = (
    host_path_rule("block", "com", "/en/"),
    host_path_rule("allow", "example.com", "/en/7"),
    host_path_rule("allow", "net", "/de/"),
    host_path_rule("block", "example.net", "/de/8"),
    host_path_rule("block", "org", "/es/"),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    empty for null and for URLs without ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    key = F.translate(F.concat(host, F.lit("/"), path), UPPER, LOWER)
    return F.array_distinct(F.split(key, TOKEN_SPLIT))


def token_counts(urls: DataFrame, rules: Iterable[Rule], url_col: str = "url") -> dict[str, int]:
    """How many of the URLs hold each token that some rule names: one scan of the
    URL column, partially aggregated; the answer has at most a row for each rule token."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    own = F.array_intersect(url_tokens(url_host(F.col(url_col)), url_path(F.col(url_col))), F.array(*map(F.lit, wanted)))
    rows = urls.select(F.explode(own).alias("token")).groupBy("token").count().collect()
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in rows}


def _bucket(token: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(size)).cast("int") + 1


def build_index(urls: DataFrame, rules: Iterable[Rule], url_col: str = "url") -> tuple[Column, int, Column]:
    """(hash table of rules by rarest token, its size, rules without a token), as literals.

    Ties between equally rare tokens go to the longer, then to the smaller token."""
    rules = list(rules)
    counts = token_counts(urls, rules, url_col)
    size = max(1, 2 * len(rules))
    spark = urls.sparkSession
    rarest = {r: min(r.tokens, key=lambda t: (counts[t], -len(t), t)) for r in rules if r.tokens}
    tokens = sorted(set(rarest.values()))
    slot = {}
    if tokens:
        slot = {r["t"]: r["b"] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", _bucket(F.col("t"), size).alias("b")).collect()}
    table: list[list[Column]] = [[] for _ in range(size)]
    for rank, rule in enumerate(rules):
        if rule in rarest:
            table[slot[rarest[rule]] - 1].append(_entry(rule, rank, rarest[rule]))
    empty = F.array().cast(ENTRY)
    index = F.array(*[F.array(*x).cast(ENTRY) if x else empty for x in table])
    loose = [_entry(r, k, "") for k, r in enumerate(rules) if r not in rarest]
    return index, size, F.array(*loose).cast(ENTRY) if loose else empty


ENTRY = "array<struct<token:string,pattern:string,length:int,rank:int,name:string,verdict:string>>"


def _entry(rule: Rule, rank: int, token: str) -> Column:
    return F.struct(*map(F.lit, (token, rule.pattern, len(rule.name), -rank, rule.name, rule.verdict)))


def judge(urls: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, *, default: str = "allow", url_col: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``verdict`` and ``candidates``, the number of
    regular expressions that were run.

    The longest matching rule (by its name, ties to the earlier rule) decides;
    without one, ``rule`` is null and ``verdict`` is ``default``.  Null, empty and
    scheme-less URLs have empty host and path.  Columns of the input that clash
    with the added ones are replaced.  Repeated rows are judged alike, each on its own.

    Up to LITERAL_RULES rules this is one projection.  More rules are filed in a table
    by their rarest token; distinct (host, path) are joined with it on their tokens, judged,
    and joined back, with the same result."""
    rules = list(rules)
    if len(rules) > LITERAL_RULES:
        return _judge_by_tables(urls, rules, default, url_col)
    index, size, loose = build_index(urls, rules, url_col)
    out = urls.withColumn("host", url_host(F.col(url_col))).withColumn("path", url_path(F.col(url_col)))
    found = F.flatten(
        F.transform(
            url_tokens(F.col("host"), F.col("path")),
            lambda t: F.filter(F.element_at(index, _bucket(t, size)), lambda r: r["token"] == t),
        )
    )
    key = F.concat(F.lit("//"), F.col("host"), F.col("path"))
    out = out.withColumn("_found", F.concat(found, loose))
    hits = F.filter(F.col("_found"), lambda r: F.rlike(key, r["pattern"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["length"], r["rank"], r["name"], r["verdict"])))
    out = out.withColumn("_best", best)
    return (
        out.withColumn("rule", F.col("_best.name"))
        .withColumn("verdict", F.coalesce(F.col("_best.verdict"), F.lit(default)))
        .withColumn("candidates", F.size("_found"))
        .drop("_found", "_best")
    )


def _judge_by_tables(urls: DataFrame, rules: list[Rule], default: str, url_col: str) -> DataFrame:
    spark = urls.sparkSession
    listed = spark.createDataFrame([(-k, r.name, r.verdict, r.pattern, len(r.name)) for k, r in enumerate(rules)], "rank int, name string, verdict string, pattern string, length int")
    named = spark.createDataFrame([(-k, t) for k, r in enumerate(rules) for t in r.tokens], "rank int, token string")
    out = urls.drop("host", "path", "rule", "verdict", "candidates").withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    keys = out.select("host", "path").distinct()
    tokens = keys.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = tokens.join(named.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarity = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), "token")).alias("r")
    index = named.join(counts, "token", "left").groupBy("rank").agg(rarity).select("rank", "r.token").join(listed, "rank")
    key = F.concat(F.lit("//"), F.col("host"), F.col("path"))
    hit = F.struct("length", "rank", "name", "verdict")
    run = tokens.join(index, "token").groupBy("host", "path").agg(F.count("*").alias("candidates"), F.max(F.when(F.rlike(key, F.col("pattern")), hit)).alias("best"))
    judged = keys.join(run, ["host", "path"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)).cast("int"))
    loose = [(r, -k) for k, r in enumerate(rules) if not r.tokens]  # these run on every URL
    for a in range(0, len(loose), LITERAL_RULES or 1):
        some = F.array(*[F.struct(F.lit(len(r.name)).alias("length"), F.lit(k).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern")) for r, k in loose[a : a + (LITERAL_RULES or 1)]])
        hits = F.transform(F.filter(some, lambda r: F.rlike(key, r["pattern"])), lambda r: F.struct(r["length"], r["rank"], r["name"], r["verdict"]))
        judged = judged.withColumns({"best": F.greatest("best", F.array_max(hits)), "candidates": F.col("candidates") + F.size(some)})
    verdicts = judged.select("host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "candidates")
    return out.join(verdicts, ["host", "path"]).select(*[F.col(f"`{c}`") for c in out.columns], "rule", "verdict", "candidates")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rhost, rpath, rverdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
