"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash. A source with target / size = r takes each document floor(r)
times, and once more those whose hash lies below a threshold. The threshold comes from sums of words
by source and hash bucket: the bucket in which the budget ends is split into buckets again, and only
it, until it holds one hash value. No row is sorted and no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girderframe.llm.common import Query, table, word_count
from girderframe.operators.numbering import global_row_number
from girderframe.session import stored

#: Times a document may be taken.
MAX_REPEATS = 3
#: Bits of the hash, and of it that one histogram resolves.
HASH_BITS, STEP_BITS = 60, 15
#: Sources up to which their table is sent to all executors.
SENT_SOURCES = 100_000


def document_hash(doc_id: Column, seed: str) -> Column:
    """A number below 2^60 that depends on nothing but the id and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in order of code points, null last, weigh 1, 2, 3, 1, 2, 3 and so on, and share all words.
    A target stops at three times its source's size; the excess is shared again by weight until no
    target is above its limit. Each round is one sum over the sources.
    """
    order = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    numbered = global_row_number(sizes, order, "row_no")
    weighed = stored(
        numbered.select("source", "source_size", (F.pmod(F.col("row_no") - 1, F.lit(3)) + 1).alias("weight"), (F.col("source_size") * MAX_REPEATS).alias("most")),
        "weights",
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rate = None
    while True:
        full = F.lit(False) if rate is None else F.col("weight") * F.lit(rate) >= F.col("most")
        held, weight = weighed.agg(F.sum(F.when(full, F.col("most")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        new = (total - (held or 0)) / weight if weight else rate
        if new is None or new == rate:
            break
        rate = new
    target = F.least(F.col("weight") * F.lit(rate or 0.0), F.col("most").cast("double"))
    return weighed.select("source", "source_size", F.round(target, 6).alias("target"))


def thresholds(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``repeats`` and ``threshold`` to the sources: a document is taken ``repeats`` times, and once more below the threshold.

    ``documents`` has source, size and hash; the words taken miss a target by less than one document's size.
    """
    same = lambda a, b: a.source.eqNullSafe(b.source)
    whole = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_REPEATS))
    plan = sources.withColumn("repeats", F.when(F.col("source_size") > 0, whole).otherwise(0).cast("int"))
    plan = plan.withColumn("need", F.col("target") - F.col("repeats") * F.col("source_size")).withColumn("base", F.lit(0).cast("long"))
    plan = stored(plan, "budgets")
    count = sources.count()
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        # The bucket in which a source's budget ends is the only one that is counted again.
        b = _sent(plan.select("source", "base"), count)
        inside = documents.join(b, same(documents, b)).drop(b.source)
        inside = inside.filter(F.shiftright(F.col("hash") - F.col("base"), shift + STEP_BITS) == 0) if shift < HASH_BITS - STEP_BITS else inside
        inside = inside.filter(F.col("hash") >= F.col("base"))
        sums = inside.groupBy("source", F.shiftright(F.col("hash") - F.col("base"), shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
        p = plan.alias("p")
        h = sums.alias("h")
        joined = h.join(_sent(p, count), F.col("h.source").eqNullSafe(F.col("p.source")), "right").filter(F.col("h.bucket").isNull() | (F.col("h.before") <= F.col("p.need")))
        # The last bucket that begins within the budget.
        last = joined.groupBy("p.source").agg(
            F.first("p.source_size").alias("source_size"),
            F.first("p.target").alias("target"),
            F.first("p.repeats").alias("repeats"),
            F.first("p.need").alias("need"),
            F.first("p.base").alias("base"),
            F.max_by(F.struct("h.bucket", "h.before", "h.words"), "h.bucket").alias("end"),
        )
        plan = stored(
            last.select(
                "source", "source_size", "target", "repeats",
                (F.col("need") - F.coalesce("end.before", F.lit(0))).alias("need"),
                (F.col("base") + F.shiftleft(F.coalesce("end.bucket", F.lit(0)).cast("long"), shift)).alias("base"),
                F.coalesce("end.words", F.lit(0)).alias("words"),
            ),
            "budgets",
        )
    # The budget ends inside the documents of one hash value: take them if that comes nearer.
    nearer = (F.col("repeats") < MAX_REPEATS) & (F.col("words") > 0) & (F.abs(F.col("need") - F.col("words")) <= F.abs(F.col("need")))
    return plan.select("source", "source_size", "target", "repeats", (F.col("base") + nearer.cast("long")).alias("threshold"))


def _sent(frame: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has few rows; else left to adaptive skew splitting."""
    return F.broadcast(frame) if rows <= SENT_SOURCES else frame


def _planned(documents: DataFrame, seed: str) -> DataFrame:
    """(source, source_size, target, repeats, threshold) of all sources of ``documents``."""
    sized = stored(documents.select("source", word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id"), seed).alias("hash")), "sizes")
    sources = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    # Documents without words change no sum.
    return stored(thresholds(sized.filter("size > 0"), sources), "thresholds")


def with_repeats(documents: DataFrame, seed: str = "mix") -> DataFrame:
    """All rows and columns of ``documents`` with ``repeats``, how often the mix takes them, and source_size and target of their source.

    Columns of ``documents`` that are called so are replaced.
    """
    plan = _planned(documents, seed)
    p = _sent(plan.select(F.col("source").alias("_source"), "source_size", "target", F.col("repeats").alias("_times"), F.col("threshold").alias("_below")), plan.count())
    rows = documents.drop("source_size", "target", "repeats")
    times = p["_times"] + (document_hash(rows["doc_id"], seed) < p["_below"]).cast("int")
    return rows.join(p, rows["source"].eqNullSafe(p["_source"])).withColumn("repeats", times).drop(p["_source"], p["_times"], p["_below"])


def mix(documents: DataFrame, seed: str = "mix") -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` of its source and ``taken`` words.

    Null and empty texts have size 0 and are taken with 0 words; a null source is a source of its own.
    Rows that repeat an id share one hash and are taken or left together. An empty table gives none.
    """
    size = word_count(F.col("text"))
    return with_repeats(documents.select("doc_id", "source", "text"), seed).select(
        "doc_id", size.alias("size"), "source_size", "target", (size * F.col("repeats")).cast("long").alias("taken"), "repeats"
    )


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 15))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS s, 1 + (row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, coalesce(sum(3*s) OVER (ORDER BY 3*s/w, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  sum(w) OVER (ORDER BY 3*s/w DESC, encode(source) DESC ROWS UNBOUNDED PRECEDING) AS open, sum(s) OVER () AS total FROM s),
r AS (SELECT coalesce(arg_min((total - held)/open, 3*s/w) FILTER (WHERE (total - held)/open <= 3*s/w), max(3*s/w)) AS rate FROM o),
t AS (SELECT source, s, round(least(w*rate, 3*s), 6) AS target FROM s, r),
p AS (SELECT source, s, target, CASE WHEN s>0 THEN least(floor(target/s),3) ELSE 0 END AS repeats FROM t),
c AS (SELECT d.*, p.s, p.target, p.repeats, p.target - p.repeats*p.s AS need,
  sum(size) OVER (PARTITION BY d.source ORDER BY hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY d.source, hash) AS same
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, s::BIGINT AS source_size, target, (size*times)::BIGINT AS taken, times::INT AS repeats FROM (
 SELECT *, repeats + CASE WHEN size=0 OR repeats>=3 THEN 0 WHEN upto <= need THEN 1 WHEN upto - same <= need AND abs(need-(upto-same)-same) <= abs(need-(upto-same)) THEN 1 ELSE 0 END AS times FROM c)
"""

QUERIES = {"op4_mixing": Query(lambda spark, folder: mix(table(spark, folder, "documents")), SQL)}
