"""Url rules and a Bloom filter cascade over the hosts of all pages.

The cascade holds listed keys exactly, given the complete universe of keys that can be asked for:
level 1 encodes the listed keys, level 2 the unlisted keys that level 1 lets through, level 3 the
listed keys that level 2 lets through, and so on until nothing passes wrongly. A key is listed if the
number of levels it passes, one after the other, is odd. Keys are dealt by hash to shards of bounded
size, so each shard's cascade is built in one bounded task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderframe.llm.common import Query, lower_ascii, table
from girderframe.session import stored

#: Keys of the universe in one shard, about.
SHARD_KEYS = 500_000
#: Bits for each key that a level encodes.
BITS_PER_KEY = 12
HASHES = 5
#: Bytes of all cascades up to which they are sent to the executors.
MAX_SENT = 32 << 20

#: (host, path, verdict), fixed values of the contract.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: A host is on the list if one of its labels is one of these names.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, written host + path, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _two_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.concat(F.lit("\u0001"), key))


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    """One row of bit positions for each key; other positions on each level."""
    a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
    steps = np.arange(HASHES, dtype=np.uint64) + np.uint64(level * HASHES + 1)
    v = a[:, None] + b[:, None] * steps[None, :]
    v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (v >> np.uint64(20)) % np.uint64(bits)


def _passes(bitmap: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    at = _positions(h1, h2, level, len(bitmap) * 8)
    return ((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[bytes]:
    """The cascade of one shard."""
    levels: list[bytes] = []
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        if len(levels) > 64:
            raise ValueError("two different keys share both hashes")
        bits = np.zeros(max(8, math.ceil(len(inside) * BITS_PER_KEY / 8)), np.uint8)
        at = _positions(h1[inside], h2[inside], len(levels), len(bits) * 8).ravel()
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        wrong = outside[_passes(bits, h1[outside], h2[outside], len(levels))] if len(outside) else outside
        levels.append(bits.tobytes())
        inside, outside = wrong, inside
    return levels


def is_member(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed."""
    found = np.zeros(len(h1), bool)
    left = np.arange(len(h1))
    for k, bits in enumerate(levels):
        left = left[_passes(bits, h1[left], h2[left], k)]
        found[left] = k % 2 == 0
        if not len(left):
            break
    return found


def build_cascades(universe: DataFrame) -> DataFrame:
    """(shard, shards, levels) from all keys (key, listed), each key once."""
    keys = universe.count()
    shards = max(1, math.ceil(keys / SHARD_KEYS))
    h1, h2 = _two_hashes(F.col("key"))
    dealt = universe.select(F.pmod(h1, F.lit(shards)).cast("int").alias("shard"), h1.alias("h1"), h2.alias("h2"), "listed")
    schema = pa.schema([("shard", pa.int32()), ("shards", pa.int32()), ("levels", pa.list_(pa.binary()))])

    def build(group: pa.Table) -> pa.Table:
        get = lambda n: np.asarray(group.column(n).to_numpy())
        levels = build_levels(get("h1"), get("h2"), get("listed").astype(bool))
        return pa.table({"shard": [group.column("shard")[0].as_py()], "shards": [shards], "levels": [levels]}, schema=schema)

    return dealt.groupBy("shard").applyInArrow(build, "shard int, shards int, levels array<binary>")


def listed_keys(rows: DataFrame, key: str, universe: DataFrame, output: str = "listed") -> DataFrame:
    """``rows`` with a boolean column that tells whether ``key`` is listed.

    ``universe`` (key, listed) holds every key of ``rows`` once. Up to ``MAX_SENT`` bytes the cascades
    are sent to the executors and no row moves; beyond it the shards test the distinct keys where the
    cascades lie and the answers are joined.
    """
    spark = rows.sparkSession
    cascades = stored(build_cascades(universe), "cascades")
    total = cascades.select(F.sum(F.aggregate("levels", F.lit(0).cast("long"), lambda s, x: s + F.length(x)))).first()[0] or 0
    h1, h2 = _two_hashes(F.col(key))
    if total > MAX_SENT:
        return rows.join(_tested(universe, cascades).withColumnsRenamed({"key": key, "listed": output}), key, "left").withColumn(output, F.coalesce(output, F.lit(False)))
    held = {r["shard"]: (r["shards"], list(r["levels"])) for r in cascades.collect()}  # at most MAX_SENT bytes
    sent = spark.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def member(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.to_numpy(np.int64), b.to_numpy(np.int64)
        found = np.zeros(len(x), bool)
        shards = next((n for n, _ in sent.value.values()), 1)
        of = x % shards
        for s in np.unique(of):
            at = np.flatnonzero(of == s)
            if int(s) in sent.value:
                found[at] = is_member([np.frombuffer(v, np.uint8) for v in sent.value[int(s)][1]], x[at], y[at])
        return pd.Series(found)

    return rows.withColumn(output, member(h1, h2))


def _tested(universe: DataFrame, cascades: DataFrame) -> DataFrame:
    """(key, listed) as the cascades say, for more cascades than may be sent."""
    shards = cascades.agg(F.max("shards")).first()[0]
    h1, h2 = _two_hashes(F.col("key"))
    keys = universe.select("key", h1.alias("h1"), h2.alias("h2"), F.pmod(h1, F.lit(shards)).cast("int").alias("shard"))

    def test(left: pa.Table, right: pa.Table) -> pa.Table:
        levels = [np.frombuffer(v, np.uint8) for v in right.column("levels")[0].as_py()] if right.num_rows else []
        found = is_member(levels, left.column("h1").to_numpy(), left.column("h2").to_numpy())
        return pa.table({"key": left.column("key"), "listed": pa.array(found)})

    return keys.groupBy("shard").cogroup(cascades.groupBy("shard")).applyInArrow(test, "key string, listed boolean")


def filter_urls(pages: DataFrame, listed_names: Sequence[str] = LISTED_NAMES, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Every page with ``host``, ``path``, ``rule`` and ``verdict``.

    A rule decides where one fits; elsewhere a listed host is blocked and any other allowed. Null urls,
    and urls without ``://``, have an empty host and path and are allowed. Repeated rows are judged
    alike; other columns of ``pages`` do not matter and are left out.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("key", r"\.")
    universe = judged.select(F.col("host").alias("key")).distinct()
    universe = stored(universe.withColumn("listed", F.arrays_overlap(labels, F.array(*map(F.lit, listed_names)))), "hosts")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return listed_keys(judged, "host", universe).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"))


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url,'://')>0 THEN substr(url, instr(url,'://')+3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest,'^[^/?#]*') AS raw, regexp_extract(substr(rest, length(regexp_extract(rest,'^[^/?#]*'))+1),'^[^?#]*') AS path FROM u),
k AS (SELECT page_id, translate(raw,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
r AS (SELECT *, CASE
 WHEN (host='example.org' OR host LIKE '%.example.org') AND starts_with(path,'/en/1') THEN 'example.org/en/1'
 WHEN (host='example.org' OR host LIKE '%.example.org') AND starts_with(path,'/es/') THEN 'example.org/es/'
 WHEN (host='com' OR host LIKE '%.com') AND starts_with(path,'/fr/') THEN 'com/fr/'
 WHEN (host='com' OR host LIKE '%.com') AND starts_with(path,'/de/') THEN 'com/de/'
 WHEN (host='org' OR host LIKE '%.org') AND starts_with(path,'/') THEN 'org/' END AS rule FROM k)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1','example.org/es/','com/de/') THEN 'block' WHEN rule IN ('org/','com/fr/') THEN 'allow'
 WHEN list_has_any(string_split(host,'.'), ['ads-track','adult-x','casino-win','cheap-pills','free-bets','spam-farm']) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

QUERIES = {"op3_url_filter": Query(lambda spark, folder: filter_urls(table(spark, folder, "pages")), SQL)}
