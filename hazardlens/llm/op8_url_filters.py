"""URL filters by a Bloom filter cascade.

Level 1 encodes the listed keys; level 2 the keys of the corpus's universe
that level 1 takes for listed though they are not; level 3 the listed keys
that level 2 would wrongly clear; and so on, until a level makes no mistake
over the universe. A key's membership is then exact for every key of that
universe and is read from the bits alone: no join when rows are filtered.

The bits are literals of the plan. Their number depends on the list (about
1.44 * log2(universe / listed) bits a key), not on the corpus, and is
checked against ``MAX_BITS``. Corpus keys are never sent to the driver.

Nulls and empty urls, and urls without ``://``, have an empty host and path
and match no rule. Repeated urls are judged alike. An empty table gives an
empty result. Extra columns pass through unless they are named like a result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

MAX_BITS = 1 << 23  # 1 MB of literals over all levels

# Verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed * 64 + i)), F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = F.lit(list(self.words)).cast("array<bigint>")  # small words would make it array<int>
        out = F.lit(True)
        for p in self.positions(key):
            word = F.element_at(words, F.shiftright(p, 6).cast("int") + 1)
            out = out & (F.getbit(word, F.pmod(p, F.lit(64)).cast("int")) == 1)
        return out


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """True for listed keys, False for every other key of the universe."""
        out = F.lit(False)
        for i in range(len(self.levels) - 1, -1, -1):
            inner = ~out if i < len(self.levels) - 1 else F.lit(True)
            out = self.levels[i].holds(key) & inner
        return out


def _level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """Bits of one level, gathered as at most ``bits / 64`` words."""
    bits = max(64, 64 * math.ceil(-count * math.log(rate) / math.log(2) ** 2 / 64))
    if bits > MAX_BITS:
        raise ValueError(f"{count} keys need {bits} bits; the bound is {MAX_BITS}")
    level = Level((), bits, max(1, round(bits / max(count, 1) * math.log(2))) if rate < 0.4 else 1, seed)
    level = Level((), bits, min(level.hashes, 16), seed)
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    rows = (at.groupBy(F.shiftright("p", 6).cast("int").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("v")).collect())
    words = [0] * (bits // 64)
    for r in rows:
        words[r["w"]] = r["v"]
    return Level(tuple(words), bits, level.hashes, seed)


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 24) -> Cascade:
    """Cascade for column ``key`` of ``listed`` over column ``key`` of ``universe``.

    The universe may repeat keys and may hold listed ones. Only keys that a
    level mistakes are written between levels; their number falls with each.
    """
    listed = stored(listed.select("key").where("key is not null").distinct(), "cascade-listed")
    n = listed.count()
    if n == 0:
        return Cascade(())
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, math.sqrt(0.5) * n / max(size, 1))
    levels = [_level(listed, n, rate, 1)]
    wrong = universe.where(levels[0].holds(F.col("key"))).select("key").distinct()
    holders, others = listed, stored(wrong.join(listed, "key", "left_anti"), "cascade-level")
    while (count := others.count()) and len(levels) < max_levels:
        levels.append(_level(others, count, 0.5, len(levels) + 1))
        again = holders.where(levels[-1].holds(F.col("key"))).select("key")
        holders, others = others, stored(again, "cascade-level")
    if count:
        raise ValueError(f"{count} keys are still mistaken after {max_levels} levels")
    return Cascade(tuple(levels))


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path of a url."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (pages.withColumn("host", F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower()))
            .withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)))


def candidate_keys(shapes: list[tuple[int, int]]) -> Column:
    """The keys that a url could match: for each (labels, path length) that a
    rule has, the host's last labels and the path's first characters."""
    host, path = F.col("host"), F.col("path")
    labels = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    each = [F.when((labels >= j) & (F.length(path) >= k),
                   F.concat(F.substring_index(host, ".", -j), F.substring(path, 1, k)))
            for j, k in shapes]
    return F.array_compact(F.array(*each))


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to each row of ``pages``.

    One cascade per verdict holds the rules' keys (host followed by path);
    a url's candidate keys are tested, and the longest listed one decides.
    A url with no listed key is on no list: it gets ``default``.
    """
    spark = pages.sparkSession
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    base = with_host_path(pages)
    if not rules:
        return base.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    universe = base.select(F.explode(candidate_keys(shapes)).alias("key"))
    cascades = {}
    for verdict in ("allow", "block"):
        names = F.lit([h + p for v, h, p in rules if v == verdict]).cast("array<string>")
        keys = spark.range(1).select(F.explode(names).alias("key"))
        cascades[verdict] = build_cascade(keys, universe)

    def judged(key: Column) -> Column:
        hit = F.when(cascades["block"].contains(key), F.lit("block")).when(cascades["allow"].contains(key), F.lit("allow"))
        return F.when(hit.isNotNull(), F.struct(F.length(key).alias("n"), key.alias("rule"), hit.alias("verdict")))

    best = F.array_max(F.array_compact(F.transform(F.col("_keys"), judged)))
    return (base.withColumn("_keys", candidate_keys(shapes)).withColumn("_best", best)
            .withColumn("rule", F.col("_best.rule"))
            .withColumn("verdict", F.coalesce(F.col("_best.verdict"), F.lit(default)))
            .drop("_keys", "_best"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _fits(v: str, h: str, p: str) -> str:
    return (f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')"
            f" then {{'rule': '{h}{p}', 'verdict': '{v}'}}")


ORACLE_SQL = f"""
with u as (
  select page_id, case when instr(coalesce(url, ''), '://') > 0
                       then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select *, case {' '.join(_fits(*x) for x in sorted(RULES, key=lambda r: -len(r[1] + r[2])))} end as hit from h)
select page_id, host, path, hit.rule as rule, coalesce(hit.verdict, 'allow') as verdict from r
"""
