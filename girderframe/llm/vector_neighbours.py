"""Near-duplicate vectors: inverted lists, product-quantised residuals, exact rerank.

Unit vectors are assigned to the nearest of a few coarse centroids. Their residuals are coded by product
quantisation: one codebook for each subspace. Distances of a query to the coded vectors of a list come
from a table of query-to-codeword distances. The coding error e of every vector is kept with its code,
so a vector can only lie within r of the query if its coded distance is at most r + e; exactly these
are compared by cosine in double precision. A query probes every list whose border with the query's own
list is near enough for a vector within r to lie behind it. Lists at a distance of r cannot hold any. How
far links really lead beyond a border is measured: queries picked by hash are compared with all vectors,
and the farthest border that one of their links crosses is the reach. Where the picked queries show links
in too few lists to tell, every border within r is probed, which is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girderframe.llm.common import Query, table
from girderframe.operators.graph import component_labels
from girderframe.session import stored

#: Vectors that centroids and codebooks are fitted on, at most; all vectors are indexed.
FIT_ROWS = 20_000
#: Subspaces and codewords for each.
SUBSPACES, CODEWORDS = 8, 64
#: Coarse lists for n vectors: the root of n, at most this many.
MOST_LISTS = 4096
#: Borders within this many times radius / sqrt(dimensions) are probed in any case.
SURE = 3.0
#: Queries compared with all vectors to measure the reach, at most.
PROOF_ROWS = 2048
#: Lists whose queries must show links before the measured reach counts, unless all vectors were compared.
LEAST_LISTS = 30
#: Vectors of one list that lie in one block, and queries that probe a list from one block.
BLOCK, QUERY_BLOCK = 1024, 8192


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


class Codec:
    """Coarse centroids and one codebook of residuals for each subspace."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = np.unique(_kmeans(sample, lists, 8, 1), axis=0)
        own = self.nearest(sample)
        residual = sample - self.centres[own]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_kmeans(residual[:, p], CODEWORDS, 6, 2 + k) for k, p in enumerate(self.parts)]

    def state(self) -> tuple:
        """Plain arrays, for sending."""
        return self.centres, self.parts, self.books

    @classmethod
    def restored(cls, state: tuple) -> Codec:
        codec = cls.__new__(cls)
        codec.centres, codec.parts, codec.books = state
        return codec

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centres**2).sum(1)[None, :] - 2 * x @ self.centres.T, axis=1)

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all lists whose border with the own one is at most ``radius`` away; the own list is among them."""
        d = (self.centres**2).sum(1)[None, :] - 2 * x @ self.centres.T
        apart = np.sqrt(np.maximum(((self.centres[:, None, :] - self.centres[None, :, :]) ** 2).sum(2), 0)) if len(self.centres) <= 512 else None
        gap = d - d[np.arange(len(x)), own][:, None]
        between = apart[own] if apart is not None else np.sqrt(np.maximum((self.centres**2).sum(1)[None, :] + (self.centres[own] ** 2).sum(1)[:, None] - 2 * self.centres[own] @ self.centres.T, 0))
        return np.nonzero(gap <= 2 * between * (radius + 1e-9) + 1e-9)

    def borders(self, x: np.ndarray, own: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Distance of each vector from the border of its own list with another one; 0 for its own."""
        other, mine = self.centres[lists], self.centres[own]
        gap = ((other**2).sum(1) - (mine**2).sum(1)) - 2 * np.einsum("ij,ij->i", x, other - mine)
        between = np.sqrt(((other - mine) ** 2).sum(1))
        return np.where(between > 0, gap / (2 * np.where(between > 0, between, 1)), 0)

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and coding errors."""
        residual = x - self.centres[own]
        codes = np.empty((len(x), len(self.parts)), np.uint8)
        error = np.zeros(len(x))
        for k, (p, book) in enumerate(zip(self.parts, self.books)):
            d = (book**2).sum(1)[None, :] - 2 * residual[:, p] @ book.T
            codes[:, k] = np.argmin(d, axis=1)
            error += ((residual[:, p] - book[codes[:, k]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def coded_distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distances of the queries to the coded vectors of list ``at``, by table look-up."""
        residual = queries - self.centres[at]
        out = np.zeros((len(queries), len(codes)))
        for k, (p, book) in enumerate(zip(self.parts, self.books)):
            lookup = ((residual[:, None, p] - book[None]) ** 2).sum(2)
            out += lookup[:, codes[:, k]]
        return np.sqrt(out)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)


def usable(vector) -> F.Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the classes of ``a`` and ``b``; every label ends as the smallest index of its class."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        np.minimum.at(label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def _links_of_block(codec: Codec, at: int, queries, items, cosine: float, radius: float):
    """Links between queries and vectors of a block: (id, number of links as a query, id of its class here) of all that have one."""
    q_id, q = queries
    i_id, x, codes, error = items
    ids, place = np.unique(np.concatenate([q_id, i_id]), return_inverse=True)
    q_at, i_at = place[: len(q_id)], place[len(q_id) :]
    label, count = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    linked = np.zeros(len(ids), bool)
    for lo in range(0, len(q_id), 256):
        s = slice(lo, lo + 256)
        near = codec.coded_distances(q[s], at, codes) <= radius + error[None, :] + 1e-9
        rows, cols = np.nonzero(near)
        for part in range(0, len(rows), 50_000):
            r, c = rows[part : part + 50_000], cols[part : part + 50_000]
            hit = (np.einsum("ij,ij->i", q[s][r], x[c]) >= cosine) & (q_id[s][r] != i_id[c])
            u, v = q_at[s][r[hit]], i_at[c[hit]]
            np.add.at(count, u, 1)
            linked[u] = linked[v] = True
            _join(label, u, v)
    return ids[linked], count[linked], ids[label[linked]]


def neighbours(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Two vectors of equal length are linked if their cosine is at least ``cosine``. Null, empty and zero
    vectors and those with null or non-finite components are alone. component_id is the smallest id that
    can be reached by links, kept whether it is the vector's own. Rows that repeat a vec_id must repeat its
    vector and come out as often; a null id has no links and a null class.
    """
    # Single precision travels as it is; all sums are in double precision.
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    good = rows.filter(usable(F.col("v")) & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id"])
    lengths = [r["k"] for r in good.groupBy(F.size("v").alias("k")).count().orderBy("k").collect()]
    found = None
    for size in lengths:  # lengths of vectors: one for each model that made them
        part = _neighbours_of_size(good.filter(F.size("v") == size), size, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = stored(found, "neighbours")
    edges = found.filter("other <> vec_id").select(F.col("vec_id").alias("source_id"), F.col("other").alias("target_id"))
    labels = component_labels(edges).withColumnRenamed("object_id", "vec_id")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    out = rows.select("vec_id").join(links, "vec_id", "left").join(labels, "vec_id", "left")
    label = F.coalesce("label", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), label.alias("component_id"), (F.col("vec_id").isNotNull() & F.col("vec_id").eqNullSafe(label)).alias("kept"))


def _reach(placed: DataFrame, codec: Codec, sent, n: int, size: int, cosine: float, radius: float) -> float:
    """How far the links of picked queries lead beyond a border; the radius where these show too little."""
    spark = placed.sparkSession
    share = min(1.0, 1.2 * PROOF_ROWS / max(n, 1))
    picked = placed.filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).limit(PROOF_ROWS)
    picked = picked.select("vec_id", "own", "v").toArrow().combine_chunks()
    if not picked.num_rows:
        return radius
    q_id, q_own = (picked.column(k).to_numpy().astype(np.int64) for k in ("vec_id", "own"))
    queries = spark.sparkContext.broadcast((q_id, q_own, _unit(_matrix(picked.column("v").chunk(0), size))))

    def farthest(parts):
        q_id, q_own, q = queries.value
        codec, most = Codec.restored(sent.value), np.full(len(q), -1.0)
        for batch in parts:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                x, own = _unit(_matrix(part.column(2), size)), part.column(1).to_numpy().astype(np.int64)
                row, col = np.nonzero(q @ x.T >= cosine)
                row, col = (k[q_id[row] != part.column(0).to_numpy()[col]] for k in (row, col))
                pair = np.unique(row * len(codec.centres) + own[col])
                row, lists = np.divmod(pair, len(codec.centres))
                np.maximum.at(most, row, np.maximum(codec.borders(q[row], q_own[row], lists), 0))
        seen = np.flatnonzero(most >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(q_own[seen]), pa.array(most[seen])], names=["own", "far"])

    # At most one row for each list of the picked queries.
    far = placed.select("vec_id", "own", "v").mapInArrow(farthest, "own long, far double").groupBy("own").agg(F.max("far").alias("far")).collect()
    if len(far) < LEAST_LISTS and len(q_id) < n:
        return radius
    return min(radius, max([r["far"] for r in far], default=0.0) + 1e-6)


def _neighbours_of_size(vectors: DataFrame, size: int, cosine: float) -> DataFrame:
    """(vec_id, links, other): for each block, how many of its vectors a vector links to as a query, and the
    smallest vector of its class among the block's links. Every link lies in one block, so these classes
    are enough for those of all links.
    """
    spark, kind = vectors.sparkSession, vectors.schema["v"].dataType.simpleString()
    n = vectors.count()
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    share = min(1.0, 1.2 * FIT_ROWS / max(n, 1))
    picked = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).select("v").limit(FIT_ROWS)
    sample = _unit(_matrix(picked.toArrow().column("v").combine_chunks(), size))
    codec = Codec(sample, min(MOST_LISTS, max(1, math.isqrt(n))))
    sent = spark.sparkContext.broadcast(codec.state())

    def assign(parts):
        for batch in parts:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(1), size))
            own = Codec.restored(sent.value).nearest(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(own.astype(np.int32)), batch.column(1)], names=["vec_id", "own", "v"])

    placed = vectors.select("vec_id", "v").mapInArrow(assign, f"vec_id long, own int, v {kind}")
    placed = stored(placed, "placed")
    reach = max(radius * min(1.0, SURE / math.sqrt(size)), _reach(placed, codec, sent, n, size, cosine, radius))

    def probed(parts):
        total = np.zeros(len(sent.value[0]), np.int64)
        for batch in parts:
            if batch.num_rows:
                _, lists = Codec.restored(sent.value).probes(_unit(_matrix(batch.column(1), size)), batch.column(0).to_numpy(), reach)
                total += np.bincount(lists, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["list", "probes"])

    # Blocks of a list, by hash: of its vectors as many as its size asks for, of queries as many as probe it.
    probes = placed.select("own", "v").mapInArrow(probed, "list long, probes long").groupBy("list").agg(F.sum("probes").alias("probes"))
    i_blocks, q_blocks = np.zeros((2, len(codec.centres)), np.int64)
    for r in placed.groupBy("own").count().collect():  # at most MOST_LISTS rows, as the next
        i_blocks[r["own"]] = -(-r["count"] // BLOCK)
    for r in probes.collect():
        q_blocks[r["list"]] = -(-r["probes"] // QUERY_BLOCK)
    of_list = spark.sparkContext.broadcast((i_blocks, q_blocks))

    def deal(parts):
        for batch in parts:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            own = batch.column(1).to_numpy()
            x = _unit(_matrix(batch.column(2), size))
            hashed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            i_blocks, q_blocks = of_list.value
            rows, lists = Codec.restored(sent.value).probes(x, own, reach)
            rows, lists = rows[i_blocks[lists] > 0], lists[i_blocks[lists] > 0]
            # As a query: its own number of block, against every block of the list.
            counts = i_blocks[lists]
            mine = (hashed[rows] % q_blocks[lists].astype(np.uint64)).astype(np.int64)
            reps = np.repeat(np.arange(len(rows)), counts)
            against = np.arange(len(reps)) - np.repeat(np.cumsum(counts) - counts, counts)
            q = rows[reps]
            # As an item: in its own list, for every block of queries that probes it.
            counts = q_blocks[own]
            own_mine = (hashed % i_blocks[own].astype(np.uint64)).astype(np.int64)
            reps_i = np.repeat(np.arange(len(own)), counts)
            for_block = np.arange(len(reps_i)) - np.repeat(np.cumsum(counts) - counts, counts)
            who = np.concatenate([q, reps_i])
            lists_all = np.concatenate([lists[reps], own[reps_i]]).astype(np.int64)
            q_block = np.concatenate([mine[reps], for_block])
            i_block = np.concatenate([against, own_mine[reps_i]])
            item = np.concatenate([np.zeros(len(q), bool), np.ones(len(reps_i), bool)])
            for lo in range(0, len(who), 5000):
                s = slice(lo, lo + 5000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists_all[s]), pa.array(q_block[s]), pa.array(i_block[s]), pa.array(item[s]), pa.array(ids[who[s]]), batch.column(2).take(pa.array(who[s]))],
                    names=["list", "q_block", "i_block", "item", "vec_id", "v"],
                )

    dealt = placed.mapInArrow(deal, f"list long, q_block long, i_block long, item boolean, vec_id long, v {kind}")

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        at = group.column("list")[0].as_py()
        item = group.column("item").to_numpy(zero_copy_only=False).astype(bool)
        ids = group.column("vec_id").to_numpy().astype(np.int64)
        v = group.column("v")
        x = _unit(_matrix(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v, size))
        codec = Codec.restored(sent.value)
        codes, error = codec.encode(x[item], np.full(int(item.sum()), at))
        q = (ids[~item], x[~item])
        who, count, least = _links_of_block(codec, at, q, (ids[item], x[item], codes, error), cosine, radius)
        return pa.table({"vec_id": who, "links": count, "other": least})

    return dealt.groupBy("list", "q_block", "i_block").applyInArrow(search, "vec_id long, links long, other long")


QUERIES = {"op7_vector_neighbours": Query(lambda spark, folder: neighbours(table(spark, folder, "embeddings")))}
