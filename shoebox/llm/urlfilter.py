"""URL rules by Bloom filter cascades: exact membership over a known key universe, without joins.

DataFrame operations only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import ascii_lower

#: Terms that mark a host as junk when one of its labels holds them between hyphens.
JUNK_TERMS = ("ads", "adult", "bets", "casino", "pills", "spam")

URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class Level:
    salt: int
    probes: int
    words: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        # The words are one text, folded once into a constant array.
        words = F.split(F.lit(" ".join(map(str, self.words))), " ").cast("array<bigint>")
        bits = [_bit(key, self.salt, j, 64 * len(self.words)) for j in range(self.probes)]
        tests = [F.getbit(F.get(words, F.shiftright(b, 6).cast("int")), F.pmod(b, F.lit(64)).cast("int")) == 1 for b in bits]
        found = tests[0]
        for t in tests[1:]:
            found &= t
        return found


@dataclass(frozen=True)
class Cascade:
    """Levels over one part of the keys. Level 1 holds the listed keys, level 2 the others
    that level 1 passes, level 3 the listed keys that level 2 passes, until none is passed wrongly."""

    part: int
    parts: int
    levels: tuple[Level, ...]

    def member(self, key: Column) -> Column:
        answer = F.lit(False)
        for level in reversed(self.levels):
            answer = level.holds(key) & ~answer
        return answer if self.parts == 1 else (part_of(key, self.parts) == self.part) & answer


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))


def _bit(key: Column, salt: int, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), F.lit(probe), key), F.lit(bits))


def _shape(held: int, others: int, first: bool) -> tuple[int, int]:
    """64-bit words and probes of a level: about one in two false, but fewer on the first when few keys are listed."""
    share = min(0.5, held / (math.sqrt(2) * max(others, 1))) if first else 0.5
    bits = held * -math.log(share) / math.log(2) ** 2
    return max(1, math.ceil(bits / 64)), max(1, round(-math.log2(share)))


def cascades(keys: DataFrame, *, max_bytes: int = 4 << 20) -> list[Cascade]:
    """Filters that tell the listed keys from all others of the universe, exactly.

    keys: key, listed; null keys are left out, and a key that stands in several
    rows is listed if one of them says so. Only bits reach the driver: at most
    ``max_bytes`` for each part of the keys, of which there are as many as
    that takes. No listed key: no filter. Only for keys of the universe is the
    answer exact.
    """
    spark = keys.sparkSession
    universe = keys.where(F.col("key").isNotNull()).groupBy("key").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    universe = cut_lineage(universe, "keys")
    held, all_keys = universe.agg(F.coalesce(F.sum(F.col("listed").cast("bigint")), F.lit(0)), F.count(F.lit(1))).head()
    if not held:
        return []
    # The first level has most of the bits, the others about as many again.
    parts = max(1, math.ceil(16 * _shape(held, all_keys - held, True)[0] / max_bytes))
    found = []
    for part in range(parts):
        mine = universe if parts == 1 else universe.where(part_of(F.col("key"), parts) == part)
        left, sides = {}, (True, False)
        for side in sides:
            left[side] = mine.where(F.col("listed") == side).select("key")
        count = {side: left[side].count() for side in sides}
        levels: list[Level] = []
        side = True
        while count[side]:
            words, probes = _shape(count[side], count[not side], not levels)
            salt = len(levels)
            bit = F.explode(F.array(*[_bit(F.col("key"), salt, j, 64 * words) for j in range(probes)]))
            bits = (
                left[side].select(bit.alias("bit"))
                .groupBy(F.shiftright("bit", 6).alias("word"))
                .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
            )
            filled = [0] * words
            for row in bits.toLocalIterator():
                filled[row["word"]] = row["bits"]
            levels.append(Level(salt, probes, tuple(filled)))
            side = not side
            left[side] = cut_lineage(left[side].where(levels[-1].holds(F.col("key"))), "passed")
            count[side] = left[side].count()
        found.append(Cascade(part, parts, tuple(levels)))
    return found


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty if the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def _domains(host: Column, labels: int) -> Column:
    """The host's last 1, 2, ... labels, as many as ``labels``."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    reach = F.least(n, F.lit(labels))
    return F.transform(F.sequence(F.lit(1), reach), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))


def _candidates(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """All keys a rule that fits the url can have."""
    heads = F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths])
    pairs = F.transform(
        _domains(host, labels), lambda d: F.transform(F.filter(heads, lambda h: h.isNotNull()), lambda h: F.concat(d, h))
    )
    return F.array_distinct(F.flatten(pairs))


def _found(rows: DataFrame, filters: Sequence[Cascade], column: str, alias: str) -> DataFrame:
    """Adds the listed ones of an array of keys; one pass for each part of the filters."""
    if not filters:
        return rows.withColumn(alias, F.array().cast("array<string>"))
    for c in filters:
        mine = F.filter(column, c.member)
        if c.part == 0:
            rows = rows.withColumn(alias, mine)
        else:
            rows = cut_lineage(rows.withColumn(alias, F.concat(alias, mine)), "found")
    return rows


def _shape_of(keys: DataFrame, host: str) -> int:
    labels = keys.agg(F.max(F.size(F.split(host, r"\.")))).head()[0]
    return labels or 1


def judge_urls(
    pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, *, max_bytes: int = 4 << 20
) -> DataFrame:
    """Allows or blocks every url by rules, else by a list of hosts.

    pages: page_id, url. rules: host, path, verdict. listed: host. Other
    columns are ignored, whatever their names. Returns page_id, host, path,
    rule, verdict for every row, repeated ones and those without an id too.
    A rule fits its host and all subdomains if the url's path starts with the
    rule's; the longest text wins, between equal lengths the longer host; a
    rule listed both ways blocks. Without a rule (rule null), a url is blocked
    if its host or a parent domain is listed, else allowed. Rules or hosts
    that are null are left out; an empty table gives no rows.

    The universe of keys is everything the corpus's urls could be asked for:
    each domain of a host with each path prefix as long as a rule's. Over it
    one cascade tells the allowing, one the blocking rules and one the listed
    hosts, so a page is judged by expressions in its own row; no url meets a
    table of rules.
    """
    both = rules.where("host IS NOT NULL AND path IS NOT NULL")
    key = F.concat(ascii_lower(F.col("host")), "path")
    told = both.select(
        ascii_lower(F.col("host")).alias("host"), "path", key.alias("key"), (F.col("verdict") == "block").alias("block")
    )
    hosts = (
        told.select("host").limit(0) if listed is None
        else listed.where("host IS NOT NULL").select(ascii_lower(F.col("host")).alias("host"))
    )
    lengths = sorted(r[0] for r in told.select(F.length("path")).distinct().collect())
    labels, deep = _shape_of(told, "host"), _shape_of(hosts, "host")

    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    asked = _candidates(F.col("host"), F.col("path"), labels, lengths) if lengths else F.array().cast("array<string>")
    rows = urls.select("page_id", "host", "path", asked.alias("asked"), _domains(F.col("host"), deep).alias("domains"))

    # Equal candidate lists first: a host with most pages is one row per task.
    universe = rows.groupBy("asked").agg(F.lit(False).alias("listed")).select(F.explode("asked").alias("key"), "listed")
    domains = rows.groupBy("domains").agg(F.lit(False).alias("listed")).select(F.explode("domains").alias("key"), "listed")
    of = lambda block: universe.union(told.where(F.col("block") == block).select("key", F.lit(True)))
    rows = _found(rows, cascades(of(False), max_bytes=max_bytes), "asked", "allowing")
    rows = _found(rows, cascades(of(True), max_bytes=max_bytes), "asked", "blocking")
    rows = _found(rows, cascades(domains.union(hosts.select("host", F.lit(True))), max_bytes=max_bytes), "domains", "junk")

    ranked = lambda keys, block: F.transform(
        keys, lambda k: F.struct(F.length(k).alias("n"), F.length(F.substring_index(k, "/", 1)).alias("h"), F.lit(block).alias("block"), k.alias("rule"))
    )
    best = F.array_max(F.concat(ranked("allowing", False), ranked("blocking", True)))
    judged = rows.withColumn("best", best)
    verdict = F.when(F.coalesce("best.block", F.size("junk") > 0), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def junk_hosts(pages: DataFrame, terms: Sequence[str] = JUNK_TERMS) -> DataFrame:
    """The corpus's hosts, cut to the domain of the first label that holds a junk term between hyphens."""
    host, _ = split_url(F.col("url"))
    any_of = "|".join(terms)
    junk = F.regexp_extract("host", rf"(?:^|\.)((?:[^.]*-)?(?:{any_of})(?:-[^.]*)?(?:\..*)?)$", 1)
    return pages.select(host.alias("host")).distinct().select(junk.alias("host")).where("host <> ''").distinct()
