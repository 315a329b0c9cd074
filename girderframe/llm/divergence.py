"""Divergence of sources by single-pass indexing in blocks.

Each task counts the terms of its documents in one block of postings until the block is full, writes it
out as a run sorted by term and begins the next. Runs are dealt out to hash shards of (lang, term, source)
and merged there in order, so one row for each block and key is all that a shard sees of the most common
term. A second pass over the merged postings, term by term, corrects the divergence of pairs of sources:
a pair starts from the value that it would have if no term occurred in either, terms that occur in one of
them are corrected from a histogram of their counts, and only terms that occur in both are met pairwise,
inside the task that streams them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girderframe.llm.common import LETTERS, Query, column_of, runs_of, small_batches, table, text_parts
from girderframe.session import stored

#: Documents of a lang that a kept term occurs in, at least.
LEAST_DOCUMENTS = 10
#: Terms listed for each source.
TOP_TERMS = 10
#: Bytes of postings that a task holds before it writes a run.
BLOCK_BYTES = 48 << 20
#: Text bytes that are counted together.
COUNTED_BYTES = 2 << 20
#: Pairs of postings that one numpy step corrects; its sums stay below 2^53.
STEP_PAIRS = 1 << 20
#: Pairs of sources whose sums a task holds before it hands them on.
HELD_PAIRS = 1 << 20

_RUN = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_ORDER = ["lang", "term", "source"]


def _block(held: list[pa.Table]) -> pa.Table:
    """One row for each (lang, term, source) of the block."""
    summed = pa.concat_tables(held).group_by(_ORDER, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return summed.rename_columns([c.removesuffix("_sum") for c in summed.column_names]).select(_RUN.names)


def _run(block: pa.Table) -> Iterator[pa.RecordBatch]:
    """The block as a run, sorted by term."""
    order = pc.sort_indices(block, sort_keys=[(c, "ascending") for c in _ORDER])
    yield from block.take(order).cast(_RUN).combine_chunks().to_batches(max_chunksize=50_000)


def sorted_runs(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, term, source, n, docs): the runs of all blocks, ``n`` occurrences in ``docs`` documents.

    ``documents`` has text, lang and source, none of them null.
    """

    def counted(rows: np.ndarray, terms: pa.StringArray, lang: pa.Array, source: pa.Array) -> pa.Table:
        coded = terms.dictionary_encode()
        k = max(1, len(coded.dictionary))
        seen, times = np.unique(rows * k + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        doc = pa.array(seen // k)
        return pa.table([lang.take(doc), coded.dictionary.take(pa.array(seen % k)), source.take(doc), pa.array(times.astype(np.int64)), pa.array(np.ones(len(seen), np.int64))], schema=_RUN)

    def index(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, merged = 0, 0
        for batch in parts:
            lang, source = column_of(batch, "lang"), column_of(batch, "source")
            whole: list[pa.Table] = []
            for first, _, data, offsets, more in text_parts(column_of(batch, "text"), COUNTED_BYTES):
                found = counted(*_shifted(runs_of(data, offsets, LETTERS[data]), first), lang, source)
                if more:  # a further part of one document: its terms count for one document
                    found = pa.concat_tables([whole.pop(), found]).group_by(_ORDER, use_threads=False).aggregate([("n", "sum"), ("docs", "max")])
                    found = found.rename_columns([c.split("_")[0] for c in found.column_names]).select(_RUN.names)
                whole.append(found)
            for found in whole:
                found = _block([found])
                held.append(found)
                size += found.nbytes
            if size - merged > block_bytes // 2:
                held = [_block(held)]
                size = merged = held[0].nbytes
                if size > block_bytes:
                    yield from _run(held[0])
                    held, size, merged = [], 0, 0
        if held:
            yield from _run(_block(held))

    return documents.select("text", "lang", "source").mapInArrow(index, "lang string, term string, source string, n long, docs long")


def _shifted(found: tuple[np.ndarray, pa.StringArray], first: int) -> tuple[np.ndarray, pa.StringArray]:
    return found[0] + first, found[1]


def merge_runs(runs: DataFrame) -> DataFrame:
    """(lang, term, source, n, docs), each key once: the runs of a shard merged in order and summed as they stream by."""

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        for batch in parts:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).cast(_RUN)
            rows = rows if last is None else pa.concat_tables([last, rows]).combine_chunks()
            new = np.ones(rows.num_rows, bool)
            if rows.num_rows > 1:
                same = [pc.equal(rows[c].combine_chunks()[1:], rows[c].combine_chunks()[:-1]).to_numpy(zero_copy_only=False) for c in _ORDER]
                new[1:] = ~np.logical_and.reduce(same)
            begins = np.flatnonzero(new)
            summed = rows.take(pa.array(begins))
            for c in ("n", "docs"):
                summed = summed.set_column(summed.schema.get_field_index(c), c, pa.array(np.add.reduceat(rows[c].to_numpy(), begins)))
            # The last key may go on in the next batch.
            last = summed.slice(summed.num_rows - 1)
            yield from summed.slice(0, summed.num_rows - 1).combine_chunks().to_batches()
        if last is not None:
            yield from last.combine_chunks().to_batches()

    return runs.repartition(*_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(fold, runs.schema)


def share(count: Column, words: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (words + 2 terms)), exact; null without terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    scaled = (wide(count + 2) * F.lit(1_000_000_000).cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.call_function("div", scaled, wide(F.nullif(words + 2 * terms, F.lit(0)))) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def postings(documents: DataFrame, least: int = LEAST_DOCUMENTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, term, source, n, total, leads) of all kept terms; one row of each (lang, term) ``leads``."""
    merged = merge_runs(sorted_runs(documents, block_bytes))
    one = Window.partitionBy("lang", "term")
    kept = merged.withColumns({"in_docs": F.sum("docs").over(one), "total": F.sum("n").over(one), "leads": F.col("source") == F.min("source").over(one)})
    return kept.filter(F.col("in_docs") >= least).select("lang", "term", "source", "n", "total", "leads")


def _corrections(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value): for terms that occur in both a and b, what their distance adds to the one-sided corrections.

    ``rows`` has lang, term, source, p and z, the share and that of a term which does not occur.
    """
    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])

    def stream(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[str, str], int] = {}
        names: list[tuple[str, str]] = []
        sums: dict[int, int] = {}
        wide = 1 << 31
        f = lambda p, q: (p - q) * (p - q) // (p + q)

        def flush() -> pa.RecordBatch:
            keys = list(sums)
            left, right = [names[k // wide] for k in keys], [names[k % wide] for k in keys]
            out = [[x[0] for x in left], [x[1] for x in left], [x[1] for x in right], [sums[k] for k in keys]]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, s.type) for x, s in zip(out, schema)], schema=schema)

        def add(block: pa.Table) -> Iterator[pa.RecordBatch]:
            """Pairs of all terms of the block, each of which it holds whole."""
            lang, source = block["lang"].combine_chunks().dictionary_encode(), block["source"].combine_chunks().dictionary_encode()
            pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            distinct, local = np.unique(pair, return_inverse=True)
            known = np.empty(len(distinct), np.int64)
            for i, k in enumerate(distinct.tolist()):
                name = (lang.dictionary[k // len(source.dictionary)].as_py(), source.dictionary[k % len(source.dictionary)].as_py())
                if name not in codes:
                    codes[name] = len(names)
                    names.append(name)
                known[i] = codes[name]
            code = known[local]
            p, z = block["p"].to_numpy(), block["z"].to_numpy()
            begins = np.flatnonzero(_changes(block))
            ends = np.append(begins[1:], block.num_rows)
            partners = np.repeat(ends, ends - begins) - 1 - np.arange(block.num_rows)
            upto = np.cumsum(partners)
            lo = 0
            while lo < block.num_rows:
                done = int(upto[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(upto, done + STEP_PAIRS, side="right")))
                count = partners[lo:hi]
                i = np.repeat(np.arange(lo, hi), count)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
                value = f(p[i], p[j]) - f(p[i], z[j]) - f(z[i], p[j]) + f(z[i], z[j])
                pairs, at = np.unique(code[i] * wide + code[j], return_inverse=True)
                for k, v in zip(pairs.tolist(), np.bincount(at, weights=value, minlength=len(pairs)).tolist()):
                    sums[k] = sums.get(k, 0) + int(v)
                if len(sums) > HELD_PAIRS:
                    yield flush()
                lo = hi

        held: pa.Table | None = None
        for batch in parts:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            last = int(np.flatnonzero(_changes(rows))[-1])
            held = rows.slice(last)
            if last:
                yield from add(rows.slice(0, last).combine_chunks())
        if held is not None:
            yield from add(held.combine_chunks())
        if sums:
            yield flush()

    dealt = rows.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(stream, "lang string, a string, b string, value long")


def _changes(rows: pa.Table) -> np.ndarray:
    """True where a row begins a new (lang, term)."""
    new = np.ones(rows.num_rows, bool)
    if rows.num_rows > 1:
        same = [pc.equal(rows[c].combine_chunks()[1:], rows[c].combine_chunks()[:-1]).to_numpy(zero_copy_only=False) for c in ("lang", "term")]
        new[1:] = ~np.logical_and.reduce(same)
    return new


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a lang lies from the others and which terms mark it.

    Part ``pair`` gives every other source of the lang with the distance of the two, part ``term`` the ``top``
    terms that the source uses more than its lang does. Ranks count from 1 by falling value, then by item.

    Null lang, source or text count as empty; a group without terms is a group. Repeated rows count each.
    Very long texts are counted in parts and stay one document. An empty table gives no rows, a lang without
    kept terms pairs of value 0. Other columns of ``documents`` do not matter.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = stored(postings(rows, least, block_bytes), "postings")
    words = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    langs = kept.groupBy("lang").agg(F.count_if("leads").alias("terms"), F.sum("n").alias("lang_words"))
    groups = rows.select("lang", "source").distinct().join(words, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["words", "terms", "lang_words"]).withColumn("z", share(F.lit(0), F.col("words"), F.col("terms")))
    groups = stored(groups, "groups")
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("words"), F.col("terms")))

    q = share(F.col("total"), F.col("lang_words"), F.col("terms"))
    marking = shares.withColumn("q", q).filter("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marking = marking.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    # Pairs, a before b: all terms as if in neither, then terms in one, then terms in both.
    left = groups.select("lang", F.col("source").alias("a"), F.col("z").alias("za"), "terms")
    right = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"))
    nowhere = left.join(right, "lang").filter("a < b").select("lang", "a", "b", (F.col("terms") * F.coalesce(distance(F.col("za"), F.col("zb")), F.lit(0))).alias("value"))
    counts = shares.groupBy("lang", "source", "n", "p", "z").agg(F.count(F.lit(1)).alias("times"))
    gain = F.col("times") * (distance(F.col("p"), F.col("zb")) - distance(F.col("z"), F.col("zb")))
    in_one = counts.join(right, "lang").filter("source <> b").select("lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b"), gain.alias("value"))
    in_both = _corrections(shares)
    pairs = nowhere.unionByName(in_one).unionByName(in_both.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value"))
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = pairs.select("lang", "value", F.explode(ends).alias("end")).select("lang", "end.source", "end.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    shape = lambda part, frame: frame.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return shape("pair", pairs).unionByName(shape("term", marking))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text,'') AS text, coalesce(lang,'') AS lang, coalesce(source,'') AS source FROM documents),
t AS (SELECT doc, lang, source, translate(raw,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM d)),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM c GROUP BY ALL HAVING sum(docs) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n,0)::HUGEINT AS n, k.total FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT *, sum(n) OVER w AS words, sum(total) OVER w AS lang_words, count(*) OVER w AS v FROM m WINDOW w AS (PARTITION BY lang, source)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT*(n+2)) // (words+2*v)::HUGEINT AS p, 1 + (1000000000::HUGEINT*(total+2)) // (lang_words+2*v)::HUGEINT AS q FROM s),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p-b.p)*(a.p-b.p) // (a.p+b.p)) AS value FROM p a JOIN p b ON a.lang=b.lang AND a.term=b.term AND a.source<>b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value,0) AS value FROM g a JOIN g b ON a.lang=b.lang AND a.source<>b.source
  LEFT JOIN x ON x.lang=a.lang AND x.source=a.source AND x.item=b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p-q)*(p-q) // (p+q) AS value FROM p WHERE n>0 AND p>q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part='pair' OR rank<=10
"""

QUERIES: dict[str, Query] = {"op12_source_divergence": Query(lambda spark, folder: audit(table(spark, folder, "documents")), SQL)}
