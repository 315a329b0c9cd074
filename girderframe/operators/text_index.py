"""Text search over a stored index: trigram postings of blocks of the distinct texts of some columns.

Four tables lie in one folder. ``texts`` holds every distinct text once, in blocks of texts that follow each other in
order and so have most trigrams in common; ``postings`` the trigrams of every block, with the number of its texts that
hold them; ``grams`` the sums of these; ``uses`` the rows in which a text stands. The files of postings and uses are
sorted by what a search looks up, those of the texts by their blocks. A search reads the postings of the rarest
trigrams of its query, checks the texts of the blocks that hold them all, and reads the uses of those that
really hold the query. Few blocks or texts are looked up by value, so Parquet skips all other pages. The rows of
the searched table are not read at all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girderframe.session import stored, stored_counting

GRAM = 3
#: Trigrams of a query that are looked up; the check of the texts takes care of the others.
LOOKED_UP = 4
#: Texts of a block: a block has a posting for each trigram that any of them holds.
BLOCK = 64
#: Keys up to which a table is read by value.
FEW = 200
#: Keys from which a join is told not to sort the table that it looks them up in.
MANY = 1_000_000


@dataclass(frozen=True)
class Found:
    """Rows that hold the query, and how many texts were looked at and how many of them held it."""

    rows: DataFrame
    candidates: int
    texts: int


def grams(texts: DataFrame, lowered: str) -> DataFrame:
    """``texts`` with a row for each distinct trigram (``gram``) of each; shorter texts have none."""
    text, gram = F.col(lowered), F.substring(F.col(lowered), F.col("_at"), F.lit(GRAM))
    placed = texts.filter(F.length(text) >= GRAM).withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(text) - (GRAM - 1))))
    # Only at its first place in the text.
    return placed.withColumn("gram", gram).filter(F.instr(text, F.col("gram")) == F.col("_at")).drop("_at")


def build(rows: DataFrame, key: str, columns: list[str], path: str, files: int | None = None, block: int = BLOCK) -> None:
    """Write the index of ``columns``; ``key`` tells the rows apart. Null counts as no text.

    Uses stay where their rows are and are sorted there, so that a text with very many uses is dealt out as the rows
    are. Only distinct texts and the postings of blocks are shuffled. ``files`` limits the files of postings; by default
    there are as many as the shuffle has partitions, so that a task does not grow with the table.
    """
    spark = rows.sparkSession
    text_of = {c: F.col(f"`{c}`").cast("string") for c in columns}
    # A text is named by its hash; what a search finds is compared by the text itself.
    cells = [F.struct(F.lit(c).alias("column"), F.when(text.isNotNull(), F.xxhash64(text)).alias("text_id")) for c, text in text_of.items()]
    uses = rows.select(F.col(key).alias("key"), F.explode(F.array(*cells)).alias("cell")).select("cell.text_id", "cell.column", "key").filter("text_id IS NOT NULL")
    uses.sortWithinPartitions("text_id").write.mode("overwrite").parquet(f"{path}/uses")
    texts = rows.select(F.explode(F.array(*text_of.values())).alias("text")).filter("text IS NOT NULL").distinct()
    number = F.floor(F.monotonically_increasing_id() / block).alias("block")
    texts.sortWithinPartitions("text").select(number, F.xxhash64("text").alias("text_id"), "text").write.mode("overwrite").parquet(f"{path}/texts")
    lowered = spark.read.parquet(f"{path}/texts").select("block", F.lower("text").alias("lowered"))
    postings = grams(lowered, "lowered").groupBy("gram", "block").agg(F.count(F.lit(1)).alias("texts"))
    postings = postings if files is None else postings.coalesce(files)
    postings.sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.sum("texts").alias("texts"))
    counts.sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")


def search(spark: SparkSession, path: str, query: str, column: str | None = None) -> Found:
    """Keys of the rows in which ``query`` stands in one of the columns, whatever its case.

    Queries of fewer than three letters have no trigram and are compared with every distinct text.
    """
    wanted = query.lower()
    texts, lowered = spark.read.parquet(f"{path}/texts"), F.lower("text")
    asked = sorted({wanted[k : k + GRAM] for k in range(len(wanted) - GRAM + 1)})
    if asked:
        sizes = {r["gram"]: r["texts"] for r in spark.read.parquet(f"{path}/grams").filter(F.col("gram").isin(asked)).collect()}
        rarest = sorted(asked, key=lambda g: (sizes.get(g, 0), g))[:LOOKED_UP]
        hits = spark.read.parquet(f"{path}/postings").filter(F.col("gram").isin(rarest))
        all_of = hits.groupBy("block").agg(F.count(F.lit(1)).alias("grams")).filter(F.col("grams") == len(rarest))
        texts = _picked(texts, "block", *stored_counting(all_of.select("block"), "blocks", F.lit(True))[:2])
        for gram in rarest:
            texts = texts.filter(F.contains(lowered, F.lit(gram)))
    return _found(spark, path, texts, F.contains(lowered, F.lit(wanted)), column)


def lookup(spark: SparkSession, path: str, text: str, column: str | None = None) -> Found:
    """Keys of the rows in which exactly ``text`` stands in one of the columns."""
    texts = spark.read.parquet(f"{path}/texts").filter(F.col("text_id") == F.xxhash64(F.lit(text)))
    return _found(spark, path, texts, F.col("text") == text, column)


def _found(spark: SparkSession, path: str, texts: DataFrame, held: Column, column: str | None) -> Found:
    """The uses of those ``texts`` for which ``held`` is true."""
    checked, candidates, found = stored_counting(texts.select("text_id", held.alias("held")), "candidates", F.col("held"))
    uses = spark.read.parquet(f"{path}/uses")
    if column is not None:
        uses = uses.filter(F.col("column") == column)
    rows = _picked(uses, "text_id", checked.filter("held").select("text_id"), found)
    return Found(rows.select("key").distinct(), candidates, found)


def _picked(table: DataFrame, column: str, keys: DataFrame, n: int) -> DataFrame:
    """Rows of ``table`` whose ``column`` is among the ``n`` stored ``keys``."""
    if n <= FEW:
        return table.filter(reduce(lambda a, b: a | b, [F.col(column) == r[0] for r in keys.collect()], F.lit(False)))
    return table.join(keys.hint("shuffle_hash") if n > MANY else keys, column, "left_semi")
