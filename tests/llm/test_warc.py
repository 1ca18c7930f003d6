import random

from pyspark.sql import functions as F

from tessera.llm import warc as W

SCHEMA = "record_id long, kind string, url string, time long, digest string, headers map<string,string>"


def test_canonical_urls(spark):
    same = ["http://www.Example.com:80/a/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2", "HTTPS://user:pw@example.com:443/a/?b=2&a=1&gclid=9"]
    df = spark.createDataFrame([(u,) for u in [*same, "http://example.com/", None, "nothing", "http://example.com/A"]], "u string")
    got = [r[0] for r in df.select(W.canonical_url(F.col("u"))).collect()]
    assert got == ["example.com/a?a=1&b=2"] * 3 + ["example.com", None, None, "example.com/A"]


def plain(records):
    out = {}
    for rid, kind, url, time, digest, headers in records:
        if kind != "revisit":
            continue
        own = headers or {}
        earlier = [r for r in records if r[1] == "response" and r[2] == url and url and r[3] is not None and time is not None and r[3] < time]
        if not earlier:
            out[rid] = (None, "orphan", own)
            continue
        best = max(earlier, key=lambda r: (r[3], r[0]))
        have = best[5] or {}
        tag = lambda t: t[2:] if t and t[:2] in ("W/", "w/") else t
        if "etag" in own:
            same = tag(own["etag"]) == tag(have.get("etag"))
        elif "last-modified" in own:
            same = own["last-modified"] == have.get("last-modified")
        elif digest is not None:
            same = digest == best[4]
        else:
            same = None
        if same:
            out[rid] = (best[0], "resolved", {**have, **{k: v for k, v in own.items() if k not in W.NOT_MERGED}})
        else:
            out[rid] = (best[0], "unverified" if same is None else "changed", own)
    return out


def check(spark, records, **how):
    df = spark.createDataFrame([(*r, "x") for r in records], SCHEMA + ", status string").repartition(4)
    got = {r["record_id"]: (r["refers_to"], r["status"], r["headers"]) for r in W.resolve_revisits(df, **how).collect()}
    assert got == plain(records)


def test_against_brute_force(spark):
    rng = random.Random(4)
    urls = ["http://a.com/x", "http://a.com/y", None, "bad"] + ["http://hot.com/z"] * 6
    records = []
    for k in range(600):
        url = rng.choice(urls)
        headers = {}
        if rng.random() < 0.6:
            headers["etag"] = rng.choice(['"1"', 'W/"1"', '"2"'])
        if rng.random() < 0.5:
            headers["last-modified"] = rng.choice(["mon", "tue"])
        if rng.random() < 0.5:
            headers |= {"content-length": str(k), "cache-control": f"max-age={k}"}
        records.append((k, rng.choice(["response", "revisit", "revisit"]), url, None if rng.random() < 0.03 else rng.randrange(80), rng.choice(["d1", "d2", None]), None if rng.random() < 0.05 else headers))
    records = [(r[0], r[1], None if r[2] == "bad" else r[2], *r[3:]) for r in records]
    check(spark, records)
    check(spark, records, range_records=20)


def test_edges(spark):
    check(spark, [(1, "revisit", "http://a.com/", 5, None, None)])
    check(spark, [(1, "response", "http://a.com/", 5, "d", {}), (2, "revisit", "http://a.com/", 5, "d", {})])
    assert W.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = [(1, "response", "http://a.com/", 5, "d", {}), (2, "revisit", "http://a.com/", 9, "d", {}), (2, "revisit", "http://a.com/", 9, "d", {})]
    assert [r["status"] for r in W.resolve_revisits(spark.createDataFrame(twice, SCHEMA)).collect()] == ["resolved"] * 2
