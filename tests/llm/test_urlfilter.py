from __future__ import annotations

from pyspark.sql import functions as F

from shoebox.llm.urlfilter import URL_RULES, cascades, judge_urls, junk_hosts

RULES = "host string, path string, verdict string"


def brute(url, rules, listed):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    under = lambda d: host == d or host.endswith("." + d)
    fit = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules if under(h) and path.startswith(p)]
    if fit:
        *_, block, rule = max(fit)
        return host, path, rule, "block" if block else "allow"
    return host, path, None, "block" if any(under(d) for d in listed) else "allow"


URLS = [
    "http://a.com/", "http://a.com", "http://COM/x", "http://xcom/", "http://www.example.com/en/1?x=/y", "http://m.example.com/en/1#t",
    "http://example.com/en", "https://Www.Example.Com/en/?q", "https://x.net/es/a", "https://x.net/ES/a", "https://x.net?/es/", "ftp://net/fr/",
    "no scheme", "", None, "://", "://com/", "http://é.com/日本/😀", "http://a..com/x", "http://.com/", "http://com./", "http://a.com:80/",
    "http://u@b.com/x\ny", "http://bad.org/x", "http://sub.bad.org/", "http://notbad.org/", "a://b://com/", "http://" + "x." * 3000 + "com/" + "p/" * 9000,
]


def test_equals_brute_force_with_nulls_repeats_and_clashing_names(spark):
    listed = ["bad.org", "Nowhere.test"]
    rows = [(i if i % 7 else None, u, "x", 1) for i, u in enumerate(URLS)] + [(1, URLS[1], None, None)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, key string, rule int").withColumn("asked", F.lit(1)).withColumn("host", F.lit("z"))
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block"), ("a.com", None, "allow")], RULES)
    hosts = spark.createDataFrame([(h,) for h in listed] + [(None,)], "host string")
    got = [tuple(r) for r in judge_urls(pages, rules, hosts).collect()]
    want = [(i, *brute(u, URL_RULES, [h.lower() for h in listed])) for i, u, *_ in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_ties_and_rules_listed_both_ways(spark):
    rules = [("b.c", "/x/", "allow"), ("b.c", "/x/", "block"), ("a.b.c", "/", "allow"), ("b.c", "/ab", "block")]
    pages = spark.createDataFrame([(1, "h://a.b.c/x/1"), (2, "h://b.c/x/1"), (3, "h://a.b.c/abc"), (4, "h://q/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, spark.createDataFrame(rules, RULES)).collect()}
    assert got == {1: ("a.b.c/", "allow"), 2: ("b.c/x/", "block"), 3: ("a.b.c/", "allow"), 4: (None, "allow")}


def test_no_rules_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "h://a.com/"), (2, None)], "page_id long, url string")
    none = spark.createDataFrame([], RULES)
    assert {tuple(r) for r in judge_urls(pages, none).collect()} == {(1, "a.com", "/", None, "allow"), (2, "", "", None, "allow")}
    assert judge_urls(pages.limit(0), spark.createDataFrame(list(URL_RULES), RULES)).count() == 0
    assert junk_hosts(pages).count() == 0


def test_cascade_is_exact_over_its_universe_in_one_and_in_many_parts(spark):
    keys = spark.range(6000).select(F.concat(F.lit("key-"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    keys = keys.union(keys.limit(500)).union(spark.sql("SELECT CAST(NULL AS string), true"))
    for max_bytes in (1 << 20, 400):
        filters = cascades(keys, max_bytes=max_bytes)
        assert (len(filters) > 1) == (max_bytes == 400) and all(len(c.levels) > 2 for c in filters)
        member = F.lit(False)
        for c in filters:
            member = member | c.member(F.col("key"))
        assert keys.where("key IS NOT NULL").where(member != F.col("listed")).count() == 0
    assert cascades(keys.where("NOT listed")) == []


def test_pages_are_judged_alike_by_filters_in_many_parts(spark):
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.format_string("http://h%d.org/p%d", F.col("id") % 90, "id").alias("url"))
    hosts = spark.range(60).select(F.format_string("h%d.org", F.col("id") * 2).alias("host"))
    rules = spark.createDataFrame([("org", "/p1", "allow"), ("h4.org", "/p", "block")], RULES)
    one, many = ({tuple(r) for r in judge_urls(pages, rules, hosts, max_bytes=b).collect()} for b in (1 << 20, 16))
    assert one == many and len(one) == 500


def test_junk_hosts_are_cut_to_the_junk_domain(spark):
    urls = ["http://m.ads-track.example.com/x", "http://blog.Cheap-Pills.org", "http://spam", "http://spammer.org/", "http://a.bets.b.c/", None]
    got = {r[0] for r in junk_hosts(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert got == {"ads-track.example.com", "cheap-pills.org", "spam", "bets.b.c"}
