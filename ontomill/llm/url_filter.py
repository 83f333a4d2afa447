"""URL rules by a cascade of Bloom filters, in DataFrame operations alone.

A cascade is a list of Bloom filters. The first holds the listed keys; each further one holds those keys of the other side
that the filter before it takes in falsely: of the corpus's complete universe of keys that aren't listed, then of the listed
ones, and so on until none is left. A key's membership is read off by walking the levels, and is exact for every key of the
universe, without a join. Bits are held as arrays of 64-bit words, which travel as constants within the expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.plans.rounds import durable, maybe_broadcast

#: Bits of one level at most: an expression holds them as a constant of 8 MB.
MAX_BITS = 1 << 26


@dataclass(frozen=True)
class Level:
    words: np.ndarray
    hashes: int
    seed: int

    def place(self, key: Column, j: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(j)), F.lit(64 * len(self.words)).cast("long"))

    def holds(self, key: Column) -> Column:
        words = F.lit(self.words)
        out = F.lit(True)
        for j in range(self.hashes):
            at = self.place(key, j)
            word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
            out = out & (F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
        return out


def bloom(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of the ``n`` rows of column ``key`` at about the false positive rate; its words are one aggregate each."""
    bits = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
    if bits > MAX_BITS:
        raise ValueError(f"a level of {n} keys needs {bits} bits, over the bound of {MAX_BITS}")
    level = Level(np.zeros(-(-bits // 64), np.int64), max(1, round(math.log2(1 / rate))), seed)
    places = keys.select(F.explode(F.array(*[level.place(F.col("key"), j) for j in range(level.hashes)])).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    for w, b in words.collect():
        level.words[w] = b
    return level


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(False)
        for k, level in reversed(list(enumerate(self.levels))):
            # past an even level, what it holds is listed unless the next levels say otherwise
            out = level.holds(key) & ~out if k < len(self.levels) - 1 else level.holds(key)
        return out


def build(listed: DataFrame, universe: DataFrame, max_levels: int = 64) -> Cascade:
    """A cascade of the keys of ``listed`` that is exact over ``universe`` (both: column ``key``, any multiplicity).

    The list is bounded by ``MAX_BITS`` (``listed_among`` has no such bound); the universe isn't. Null keys are left out. An empty list gives an empty cascade.
    """
    listed = durable(listed.where("key is not null").select("key").distinct())
    universe = durable(universe.where("key is not null").select("key").distinct())
    n = listed.count()
    if not n:
        return Cascade(())
    rate = min(0.5, 0.5 * math.sqrt(n / max(universe.count(), 1)))
    others = universe.join(maybe_broadcast(listed, n, 100), "key", "left_anti")
    levels: list[Level] = []
    inside, outside = listed, others
    while n and len(levels) < max_levels:
        level = bloom(inside, n, rate if not levels else 0.5, len(levels))
        levels.append(level)
        inside, outside = durable(outside.where(level.holds(F.col("key")))), inside
        n = inside.count()
    if n:
        raise RuntimeError("the cascade did not end")
    return Cascade(tuple(levels))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` and for null."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2147483647))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, lengths: tuple[int, ...]) -> Column:
    """Every key that a rule fitting the URL could have: the host or a parent domain, then a start of the path of a rule's length."""
    labels = F.split(host, "[.]", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    def with_start(n: int) -> Column:
        start = F.substring(path, 1, n)
        return F.when(F.length(path) >= n, F.transform(parents, lambda h: F.concat(h, start))).otherwise(F.array().cast("array<string>"))

    each = [with_start(n) for n in lengths]
    return F.flatten(F.array(*each)) if each else F.array().cast("array<string>")


def keys(spark: SparkSession, values: list[str]) -> DataFrame:
    listed = F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
    return spark.range(1).select(F.explode(listed).alias("key"))


def _tagged(kind: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(kind), k))


def _ways(n: int, max_bits: int) -> int:
    """Parts by hash that a list of ``n`` keys needs so that no level of a part is over ``max_bits``."""
    return max(1, math.ceil(64 * n / max_bits))


def listed_among(listed: DataFrame, universe: DataFrame, ways: int) -> DataFrame:
    """``key``: those of ``universe`` that are listed, by a cascade for each of ``ways`` parts of the keys by hash, one after another."""
    part = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(ways))
    listed, universe = durable(listed.where("key is not null").distinct()), durable(universe.where("key is not null").distinct())
    found = None
    for k in range(ways):
        own = universe.where(part == k)
        hits = durable(own.where(build(listed.where(part == k), own).holds(F.col("key"))))
        found = hits if found is None else found.unionAll(hits)
    return found


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], blocked_hosts: list[str] | DataFrame, url_col: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``, columns of these names replaced.

    ``rules`` are (action, host, path); a rule fits its host and all subdomains if the path starts with its own, and the
    longest wins. Where none fits, a URL is blocked if its host or a parent domain is one of ``blocked_hosts`` (a list, or a table
    with column ``key``), else allowed. Null and relative URLs have empty host and path and are allowed. An empty table gives an
    empty result.

    Rules and hosts are listed together, each key marked with its list, in one cascade. Where the list is too long for a
    cascade of ``max_bits`` a level, its keys are split by hash, each part has a cascade over its own part of the universe, and
    the keys found are joined back to hosts and paths; the result is the same.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = pages.withColumns({"host": host, "path": path})
    lengths = tuple(sorted({len(p) for _, _, p in rules}))
    marked = keys(spark, [("b" if a == "block" else "a") + h + p for a, h, p in rules])
    hosts = blocked_hosts.select("key") if isinstance(blocked_hosts, DataFrame) else keys(spark, blocked_hosts)
    listed = durable(marked.unionAll(hosts.select(F.concat(F.lit("h"), "key"))).where("key is not null").distinct())
    of_url, of_host = candidates(F.col("host"), F.col("path"), lengths), candidates(F.col("host"), F.lit(""), (0,))
    every = F.concat(_tagged("b", of_url), _tagged("a", of_url), _tagged("h", of_host))
    seen = rows.select("host", "path").distinct()
    ways = _ways(listed.count(), max_bits)
    if ways == 1:
        cascade = build(listed, seen.select(F.explode(every).alias("key")).distinct())
        blocking = lambda k: cascade.holds(F.concat(F.lit("b"), k))
        found = F.filter(of_url, lambda k: blocking(k) | cascade.holds(F.concat(F.lit("a"), k)))
        longest = F.array_max(F.transform(found, lambda k: F.struct(F.length(k).alias("n"), k.alias("key")))).getField("key")
        rows = rows.withColumn("rule", longest)
        known, blocked = F.exists(_tagged("h", of_host), cascade.holds), blocking(F.col("rule"))
        return rows.withColumn("verdict", _verdict(F.col("rule"), blocked, known))
    seen = durable(seen)
    asked = seen.select("host", "path", F.explode(every).alias("key"))
    hit = asked.join(listed_among(listed, asked.select("key"), ways), "key", "left_semi")
    kind, name = F.substring("key", 1, 1), F.expr("substring(key, 2)")
    best = F.max(F.when(kind != "h", F.struct(F.length(name).alias("n"), name.alias("rule"), (kind == "b").alias("blocked"))))
    judged = hit.groupBy("host", "path").agg(best.alias("best"), F.max(kind == "h").alias("known"))
    judged = judged.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("best.rule").alias("__rule"), _verdict(F.col("best.rule"), F.col("best.blocked"), F.col("known")).alias("__verdict"))
    rows = rows.join(judged, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    return rows.withColumns({"rule": F.col("__rule"), "verdict": F.coalesce("__verdict", F.lit("allow"))}).drop("__host", "__path", "__rule", "__verdict")


def _verdict(rule: Column, blocked: Column, known: Column) -> Column:
    return F.when(rule.isNull(), F.when(known, "block").otherwise("allow")).when(blocked, "block").otherwise("allow")
