"""Operator 3: URL rules by exact membership in Bloom filter cascades."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

#: Rules of the query: host and path, longest wins.
RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}
#: Hosts that are blocked where no rule fits.
BLOCKED_HOSTS = tuple(f"{name}.example.{tld}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for tld in ("com", "net", "org"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits for each key of a level but the first, and hashes of a key.
BITS_PER_KEY, HASHES = 10, 4
#: The first level lets about as many other keys of the universe through as this times the listed ones.
PASSED = 1.0
#: Listed keys that may be broadcast (some 64 MB); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to
    ``?``, ``#`` or the end. Both are empty for null and where there is no ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: the words of its bit set, as a constant array, and the number of its hashes."""

    bits: int
    words: str  # 64-bit words, comma-separated
    salt: int
    hashes: int

    def holds(self, key: Column) -> Column:
        words = F.expr(f"cast(split('{self.words}', ',') as array<bigint>)")
        return F.forall(positions(key, self.bits, self.salt, self.hashes), lambda p: F.shiftright(F.get(words, (p / 64).cast("int")), 0).bitwiseAND(_bit(p)) != 0)


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (position % 64).cast("int"))


def positions(key: Column, bits: int, salt: int, hashes: int) -> Column:
    """The places of a key in a filter."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(salt * 64 + k), key), F.lit(bits)) for k in range(hashes)])


def bloom(keys: DataFrame, salt: int, n: int, bits_per_key: float = BITS_PER_KEY) -> Level:
    """A filter of the n keys of the column ``key``; only its bit set reaches the driver."""
    bits = 64 * max(1, math.ceil(n * bits_per_key / 64))
    hashes = max(1, min(40, round(bits_per_key * math.log(2)))) if n else 1
    at = keys.select(F.explode(positions(F.col("key"), bits, salt, hashes)).alias("p"))
    rows = at.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(_bit(F.col("p"))).alias("m")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r.w] = r.m
    return Level(bits, ",".join(map(str, words)), salt, hashes)


def listed_keys(spark: SparkSession, keys: Iterable[str]) -> DataFrame:
    """A table of the distinct keys, made in the plan."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(sorted(set(keys)))), "array<string>")).alias("key"))


def cascade(universe: DataFrame, listed: list[str], bits_per_key: float = BITS_PER_KEY) -> list[Level]:
    """Levels that tell exactly, for every key of ``universe`` (column ``key``, distinct), whether it is listed.

    Level 0 encodes the listed keys, level 1 the other keys of the universe that level 0 lets through, level 2
    the listed keys that level 1 lets through, and so on until no key is wrong. Level 0 has log2(universe / listed) /
    ln 2 bits and more for a key, so what it lets through is about as many as are listed: all levels together follow the
    list (which the caller holds), and the universe by its logarithm only. It is read once, for level 0.
    """
    spark = universe.sparkSession
    if not listed:
        return []
    inside = written(listed_keys(spark, listed), "listed")
    n, size = inside.count(), universe.count()
    levels, encoded, other = [], inside, universe.join(F.broadcast(inside) if n <= BROADCAST_KEYS else inside, "key", "left_anti")
    bits = max(bits_per_key, math.log2(max(2.0, size / (PASSED * n))) / math.log(2))
    while True:
        levels.append(bloom(encoded, len(levels), n, bits))
        wrong = written(other.where(levels[-1].holds(F.col("key"))), "wrong")
        n, bits = wrong.count(), bits_per_key
        if not n:
            return levels
        encoded, other = wrong, encoded


def member(key: Column, levels: list[Level]) -> Column:
    """Whether ``key``, of the universe, is listed: the first level that doesn't hold it decides."""
    answer = F.lit(len(levels) % 2 == 1)
    for k in reversed(range(len(levels))):
        answer = F.when(~levels[k].holds(key), F.lit(k % 2 == 1)).otherwise(answer)
    return answer


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    if not slash:
        raise ValueError(f"a rule is a host and a path: {rule!r}")
    return host, slash + path


def judge(pages: DataFrame, rules: dict[str, str] = RULES, blocked_hosts: tuple[str, ...] = BLOCKED_HOSTS, url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` (replacing columns of those names) to every row.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins, among
    equally long ones the one with the longer host. A url's keys are its host's suffixes of as many labels as
    some rule has, each with path prefixes of the rules' lengths; the distinct keys of all rows are the
    universe of one cascade per verdict. Without a rule the verdict is ``block`` if a suffix of the host is in
    ``blocked_hosts`` (a cascade over all suffixes), else ``allow``. Null or malformed urls have an empty host
    and path, no rule, and are allowed.
    """
    parts = {r: _split(r) for r in rules}
    labels = sorted({h.count(".") + 1 for h, _ in parts.values()} | {h.count(".") + 1 for h in blocked_hosts})
    prefixes = sorted({len(p) for _, p in parts.values()})
    host, path = host_and_path(url)
    rows = pages.withColumn("__host", host).withColumn("__path", path).drop("host", "path", "rule", "verdict")
    suffixes = F.array_distinct(F.array(*[F.substring_index("__host", ".", -n) for n in labels]) if labels else F.array().cast("array<string>"))
    lengths = F.array(*[F.lit(n) for n in prefixes]) if prefixes else F.array().cast("array<int>")
    keys = F.expr("flatten(transform(__suffixes, s -> transform(filter(__lengths, n -> n <= char_length(__path)), n -> concat(s, substring(__path, 1, n)))))")
    rows = rows.withColumn("__suffixes", F.when(F.col("__host") != "", suffixes).otherwise(F.array().cast("array<string>"))).withColumn("__lengths", lengths).withColumn("__keys", keys)
    universe = written(rows.select(F.explode("__keys").alias("key")).distinct(), "universe")
    hosts = written(rows.select(F.explode("__suffixes").alias("key")).distinct(), "hosts")
    blocks = cascade(universe, [r for r, v in rules.items() if v == "block"])
    allows = cascade(universe, [r for r, v in rules.items() if v != "block"])
    listed = cascade(hosts, list(blocked_hosts))
    fits = F.filter(
        F.transform("__keys", lambda k: F.struct(F.char_length(k).alias("n"), F.char_length(F.substring_index(k, "/", 1)).alias("h"), k.alias("rule"),
                                                 F.when(member(k, blocks), "block").when(member(k, allows), "allow").alias("verdict"))),
        lambda x: x.verdict.isNotNull(),
    )
    return (
        rows.withColumn("__best", F.array_max(fits))
        .withColumn("__listed", F.exists("__suffixes", lambda s: member(s, listed)))
        .withColumns({"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__best.rule"),
                      "verdict": F.coalesce("__best.verdict", F.when(F.col("__listed"), "block").otherwise("allow"))})
        .drop("__host", "__path", "__suffixes", "__lengths", "__keys", "__best", "__listed")
    )
