"""Jaccard join of documents on word n-grams as a blocked sparse matrix product.

The documents form a sparse 0/1 matrix over their n-grams; its product with its transpose counts the
n-grams that two documents share. The first block of columns holds, for each document, as many of its n-grams in
one fixed order (rare ones first) as make sure that linked documents meet in it; it says which pairs to look
at. Their overlap is then summed up over blocks of columns, ranges of the n-grams' hashes, one block after the
other. After each block a pair is discarded if the overlap so far plus all that can follow, given both sizes,
stays below what the similarity asks for, so later blocks are read for ever fewer pairs.

Classes need no pair twice: equal sets are one row of the matrix, every column is first multiplied
with its first document alone, and then only across the classes found so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girderframe.llm.common import Query, column_of, lists, mix, shingles, signed, small_batches, table, text_slices, words
from girderframe.operators.graph import component_labels
from girderframe.session import stored, stored_counting

#: N-grams whose frequency is known when they are ordered; all others count as rare. The order has no
#: influence on the result, only on the number of pairs that are looked at.
ORDERED = 65_536
#: Hashes that one count of frequent n-grams looks at, and repeats from which it reports one.
CHUNK, REPEATS = 2_000_000, 2
#: Blocks of columns over which overlaps are summed up.
BLOCKS = 3


def _document_sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each n-gram, its hash); each n-gram of a row once."""
    for first, end, data, offsets in text_slices(column_of(batch, "text")):
        rows, hashes, _, _ = words(data, offsets)
        r, h = shingles(rows, hashes, size)
        order = np.lexsort((h, r))
        r, h = r[order], h[order]
        if len(h):
            new = np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1]))
            r, h = r[new], h[new]
        yield first, end, r, h


def _filled(sizes: dict[int, int], above: int, room: int) -> tuple[int, int]:
    """Going down from ``above``, the first key whose size is more than the room left, or 0, and that room."""
    key = above
    while key > 0 and sizes.get(key, 0) <= room:
        room -= sizes.get(key, 0)
        key -= 1
    return key, room


def frequent(documents: DataFrame, size: int) -> np.ndarray:
    """Hashes of the most frequent n-grams, the least frequent of them first; about ``ORDERED`` at most."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n >= REPEATS
        return pa.RecordBatch.from_arrays([pa.array(signed(h[keep])), pa.array(n[keep])], schema=schema)

    def count(parts):
        held, total = [], 0
        for batch in parts:
            for _, _, _, h in _document_sets(batch, size):
                held.append(h)
                total += len(h)
                if total >= CHUNK:
                    yield counted(held)
                    held, total = [], 0
        if held:
            yield counted(held)

    sums = documents.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    sums = stored(sums, "frequent")
    # Counts by power of two, then the power in which the list gets full in 1,024 steps, then a part of that step by
    # hash: about ORDERED rows reach the driver, and none is sorted.
    count_of, power = F.count(F.lit(1)).alias("grams"), F.floor(F.log2("n")).cast("int")
    powers = {r["k"]: r["grams"] for r in sums.groupBy(power.alias("k")).agg(count_of).collect()}
    full, room = _filled(powers, 63, ORDERED)
    low, step = 1 << full, max(1, (1 << full) // 1024)
    at = F.floor((F.col("n") - low) / step)
    steps = {r["k"]: r["grams"] for r in sums.filter(power == full).groupBy(at.alias("k")).agg(count_of).collect()}
    last, room = _filled(steps, low // step, room)
    part = F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < int(1_000_000 * room / max(steps.get(last, 0), room, 1))
    top = sums.filter((F.col("n") >= low + (last + 1) * step) | ((power == full) & (at == last) & part)).collect()
    return np.array([r["h"] for r in sorted(top, key=lambda r: (r["n"], r["h"]))], np.int64).view(np.uint64)


def _needed(percent: int, a, b):
    """Least overlap of linked sets of sizes a and b."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def _first_block(documents: DataFrame, size: int, percent: int, common: np.ndarray) -> DataFrame:
    """(doc_id, n, s1, s2, block): set size, two signatures of the set, and its n-grams of the first block in order."""
    by_hash = np.argsort(common)
    known, place = common[by_hash], by_hash.astype(np.uint64)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("block", pa.list_(pa.int64()))])

    def keys(h: np.ndarray) -> np.ndarray:
        key = h >> np.uint64(2)
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            key[hit] = np.uint64(1 << 62) + place[at[hit]]
        return key

    def block(parts):
        for batch in parts:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, end, r, h in _document_sets(batch, size):
                count = end - first
                n = np.bincount(r, minlength=count)
                s1, s2 = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
                np.add.at(s1, r, mix(h + np.uint64(1)))
                np.add.at(s2, r, mix(h ^ np.uint64(0x5851F42D4C957F2D)))
                k = keys(h)
                k = k[np.lexsort((k, r))]
                p = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                begin = np.cumsum(n) - n
                at = np.arange(len(k)) - np.repeat(begin, n)
                kept = k[at < np.repeat(p, n)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, count).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(signed(s1)), pa.array(signed(s2)), lists(signed(kept), p, pa.int64())], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(block, "doc_id long, n long, s1 long, s2 long, block array<long>")


def _set_blocks(documents: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, block, grams): the sets of the documents in ``ids``, cut into ``BLOCKS`` ranges of hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("grams", pa.list_(pa.int64()))])
    width = np.uint64((1 << 64) // BLOCKS + 1)

    def cut(parts):
        for batch in parts:
            doc = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            for first, end, r, h in _document_sets(batch, size):
                # Hashes of a row are sorted, so the blocks of a row follow each other.
                cells = r * BLOCKS + (h // width).astype(np.int64)
                at = np.arange((end - first) * BLOCKS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[first:end].astype(np.int64)[at // BLOCKS]), pa.array((at % BLOCKS).astype(np.int32)), lists(signed(h), np.bincount(cells, minlength=len(at)), pa.int64())], schema=schema
                )

    wanted = documents.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    return wanted.mapInArrow(cut, "doc_id long, block int, grams array<long>")


def _early_enough(percent: int, na, nb, ia, ib):
    """Whether a column at places ia and ib of two documents can be the first one that linked documents share."""
    return (na - ia >= _needed(percent, na, nb)) & (nb - ib >= _needed(percent, na, nb))


def _within_bounds(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose overlap in the first block can still grow to what their sizes ask for, with their sizes.

    Of the two, the one whose block ends first has met all it shares up to there, so only its other
    columns can add to the overlap.
    """
    a, b = (rows.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("block").alias(f"block_{x}")) for x in "ab")
    joined = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("block_a", "block_b"))
    first_ends = F.element_at("block_a", -1) <= F.element_at("block_b", -1)
    rest = F.when(first_ends, F.col("na") - F.size("block_a")).otherwise(F.col("nb") - F.size("block_b"))
    left = joined.filter(shared + rest >= _needed(percent, F.col("na"), F.col("nb")))
    return left.select("a", "b", "na", "nb", F.col("na").alias("rest_a"), F.col("nb").alias("rest_b"), F.lit(0).alias("shared"))


def _linked(documents: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose sets reach the similarity, as (source_id, target_id).

    Block by block the shared n-grams of a pair are added up; ``rest_a`` and ``rest_b`` are what is left of both sets.
    """
    pairs = stored(pairs, "candidates")
    ids, count, _ = stored_counting(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted", F.lit(True))
    sets, rows, _ = stored_counting(_set_blocks(documents, ids, size), "sets", F.lit(True))
    if rows > count * BLOCKS:  # rows that repeat an id
        sets = stored(sets.dropDuplicates(["doc_id", "block"]), "sets")
    for block in range(BLOCKS):
        own = sets.filter(F.col("block") == block)
        a = own.select(F.col("doc_id").alias("a"), F.col("grams").alias("grams_a"))
        b = own.select(F.col("doc_id").alias("b"), F.col("grams").alias("grams_b"))
        met = pairs.join(a, "a").join(b, "b").withColumn("shared", F.col("shared") + F.size(F.array_intersect("grams_a", "grams_b")))
        met = met.withColumns({"rest_a": F.col("rest_a") - F.size("grams_a"), "rest_b": F.col("rest_b") - F.size("grams_b")})
        possible = F.col("shared") + F.least("rest_a", "rest_b") >= _needed(percent, F.col("na"), F.col("nb"))
        pairs = stored(met.filter(possible).select("a", "b", "na", "nb", "rest_a", "rest_b", "shared"), "overlaps")
    # Nothing is left of the sets: the overlap is whole.
    links = pairs.filter(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("shared")))
    return stored(links.select(F.col("a").alias("source_id"), F.col("b").alias("target_id")), "links")


def ngram_components(documents: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Words are runs of other characters than blanks and control characters 9 to 13, A-Z lower-cased.
    A document's set holds its distinct runs of ``size`` words, or all its words as one if there are
    fewer. Documents are linked if 100 * shared >= percent * union; component_id is the smallest id that
    can be reached by links, its own included. Null, empty and blank texts have an empty set and are
    alone. Rows that repeat an id and text come out as often; a null id has a null class. Sets are
    compared by 64-bit hashes of their n-grams.
    """
    small_batches(documents.sparkSession)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = frequent(documents, size)
    blocks = stored(_first_block(documents, size, percent, common), "blocks")
    same = ["n", "s1", "s2"]
    reps = stored(blocks.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep")), "representatives")
    rows = blocks.join(reps.select("rep"), blocks.doc_id == F.col("rep"), "left_semi").dropDuplicates(["doc_id"])
    rows = stored(rows.select(F.col("doc_id").alias("rep"), F.col("n").cast("int").alias("n"), "block"), "rows")
    cells = rows.select("rep", "n", F.posexplode("block").alias("at", "column"))
    firsts = cells.groupBy("column").agg(F.min(F.struct("rep", "n", "at")).alias("first"), F.count(F.lit(1)).alias("count")).filter("count > 1").select("column", "first")
    shared = stored(cells.join(firsts, "column"), "shared")

    stars = shared.filter((F.col("rep") != F.col("first.rep")) & _early_enough(percent, F.col("first.n"), F.col("n"), F.col("first.at"), F.col("at")))
    stars = stored(stars.select(F.col("first.rep").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    near = _linked(documents, _within_bounds(stars, rows, percent), size, percent)

    # Columns whose documents lie in several classes are multiplied across these.
    labels = stored(component_labels(near), "labels")
    placed = shared.join(labels.withColumnRenamed("object_id", "rep"), "rep", "left").select("column", "rep", "n", "at", F.coalesce("label", "rep").alias("label"))
    placed = stored(placed, "placed")
    mixed = placed.groupBy("column").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("column")
    open_ = stored(placed.join(mixed, "column", "left_semi"), "open")
    a, b = (open_.select("column", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at_{x}"), F.col("label").alias(f"l{x}")) for x in "ab")
    early = _early_enough(percent, F.col("na"), F.col("nb"), F.col("at_a"), F.col("at_b"))
    across = a.join(b, (a.column == b.column) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & early).select("a", "b").distinct()
    across = across.join(stars, ["a", "b"], "left_anti")
    far = _linked(documents, _within_bounds(across, rows, percent), size, percent)

    labels = stored(component_labels(near.unionByName(far)), "labels")
    of_rep = reps.join(labels.withColumnRenamed("object_id", "rep"), "rep", "left").select(*same, F.coalesce("label", "rep").alias("label"))
    out = blocks.select("doc_id", *same).join(of_rep, same, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))


def one_of_each(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose id is the smallest of their class; one row for an id.

    Rows without an id have no class and stay.
    """
    classes = ngram_components(documents, size, percent)
    kept = classes.filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    first = documents.join(kept, documents["doc_id"] == kept["_kept"], "left_semi").dropDuplicates(["doc_id"])
    return first.unionByName(documents.filter("doc_id IS NULL"))


QUERIES = {"op8_ngram_jaccard_join": Query(lambda spark, folder: ngram_components(table(spark, folder, "documents")))}
