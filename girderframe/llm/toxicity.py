"""Toxicity by a factorisation machine over hashed terms.

Terms are the words of a text and the starts of its words, as sets, hashed to 30 bits. Of all terms of the
training rows those are kept whose frequency differs most between the two labels, and those that tell nothing
alone but in pairs: the frequent terms are counted together, two by two, and a pair is kept whose frequency
differs clearly more than that of its terms. The machine scores w0 + sum of w_i + sum over pairs of <v_i, v_j>,
so a pair of terms can count for more, or for less, than its two terms do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderframe.llm.common import LETTERS, Query, column_of, lists, mix, small_batches, table, text_slices, words
from girderframe.session import stored

#: Labelled rows that the machine is fitted on, at most; chosen by the hash of their id.
FIT_ROWS = 16_000
#: Terms that it looks at, at most, and in how many training rows a term must occur.
TERMS, LEAST_ROWS = 4096, 5
#: A term is kept if its frequencies differ by so many standard deviations.
LEAST_DIFFERENCE = 4.0
#: Terms that are counted in pairs, at most: the most frequent ones and those that differ most alone; a pair is kept
#: if its frequencies differ by so many standard deviations, and by so many more than those of its terms.
PAIR_TERMS, PAIR_DIFFERENCE, PAIR_GAIN = 2048, 8.0, 3.0
HASH_BITS, PREFIXES = 30, (4, 5)
FACTORS, EPOCHS, RATE, DECAY = 8, 40, 0.1, 1e-4


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _terms(batch: pa.RecordBatch):
    """(first row, end row, row of each term, its hash); each term of a row once."""
    text = pc.utf8_lower(column_of(batch, "text"))
    for first, end, data, offsets in text_slices(text):
        rows, whole, _, _, *starts = words(data, offsets, LETTERS, PREFIXES)
        kinds = [whole, *starts]
        h = np.concatenate([mix(x + np.uint64(k + 1)) >> np.uint64(64 - HASH_BITS) for k, x in enumerate(kinds)]).astype(np.int64)
        both = np.unique((np.tile(rows, len(kinds)) << HASH_BITS) | h)
        yield first, end, both >> HASH_BITS, both & ((1 << HASH_BITS) - 1)


@dataclass
class Model:
    terms: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, rows: np.ndarray, columns: np.ndarray, count: int) -> np.ndarray:
        out = np.full(count, self.w0)
        np.add.at(out, rows, self.w[columns])
        s, q = np.zeros((count, self.v.shape[1])), np.zeros(count)
        np.add.at(s, rows, self.v[columns])
        np.add.at(q, rows, (self.v[columns] ** 2).sum(1))
        return out + 0.5 * ((s**2).sum(1) - q)


def _found(model_terms: np.ndarray, rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(model_terms) or not len(terms):
        return rows[:0], rows[:0]
    at = np.minimum(np.searchsorted(model_terms, terms), len(model_terms) - 1)
    hit = model_terms[at] == terms
    return rows[hit], at[hit]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_machine(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, size: int, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic factorisation machine by mini-batches with adaptive steps; a row's terms lie together."""
    rng = np.random.default_rng(seed)
    rate = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
    w0, w, v = float(np.log(rate / (1 - rate))), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))
    g0, gw, gv = 1e-6, np.full(size, 1e-6), np.full((size, FACTORS), 1e-2)
    begin = np.searchsorted(rows, np.arange(len(labels) + 1))
    for _ in range(EPOCHS if size else 0):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), 256):
            some = order[lo : lo + 256]
            n = begin[some + 1] - begin[some]
            at = np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            r, c = np.repeat(np.arange(len(some)), n), columns[at]
            m = Model(np.zeros(0), w0, w, v)
            error = _sigmoid(m.raw(r, c, len(some))) - labels[some]
            s = np.zeros((len(some), FACTORS))
            np.add.at(s, r, v[c])
            d = error.mean()
            g0 += d * d
            w0 -= RATE * d / np.sqrt(g0)
            used, back = np.unique(c, return_inverse=True)
            dw, dv = np.zeros(len(used)), np.zeros((len(used), FACTORS))
            np.add.at(dw, back, error[r])
            np.add.at(dv, back, error[r, None] * (s[r] - v[c]))
            dw, dv = dw / len(some) + DECAY * w[used], dv / len(some) + DECAY * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
    return w0, w, v


def _difference(n: np.ndarray, positive: np.ndarray, rows: int, positives: int) -> np.ndarray:
    """By how many standard deviations the positive ones among n rows are more or fewer than their share."""
    rate = positives / rows
    return np.abs(positive - n * rate) / np.sqrt(n * rate * (1 - rate) * (1 - n / rows) + 0.05)


def telling_pairs(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """Columns of pairs that occur together in rows of one label far more often than their two columns do.

    All pairs are counted by products of the incidence matrix with itself, block by block.
    """
    incidence = np.zeros((len(labels), size), np.uint8)
    for low in range(0, len(rows), 1 << 20):
        incidence[rows[low : low + (1 << 20)], columns[low : low + (1 << 20)]] = 1
    toxic = np.flatnonzero(labels > 0)
    alone = _difference(incidence.sum(0, dtype=np.int64), incidence[toxic].sum(0, dtype=np.int64), len(labels), len(toxic))
    told = np.zeros(size, bool)
    # Two blocks of columns are held as numbers at a time.
    for low in range(0, size, 256):
        a = incidence[:, low : low + 256].astype(np.float32)
        for other in range(low, size, 256):
            b = incidence[:, other : other + 256].astype(np.float32)
            n = a.T @ b
            z = _difference(n, a[toxic].T @ b[toxic], len(labels), len(toxic))
            best = np.maximum(alone[low : low + 256, None], alone[None, other : other + 256])
            i, j = np.nonzero((n >= LEAST_ROWS) & (z >= PAIR_DIFFERENCE) & (z >= best + PAIR_GAIN))
            apart = i + low != j + other
            told[i[apart] + low] = told[j[apart] + other] = True
    return np.flatnonzero(told)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on the labelled documents that are not held out; a document with several labels has their highest."""
    small_batches(documents.sparkSession)
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    marks = stored(marks.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y")), "marks")
    n = marks.count()
    by_hash = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    marks = marks.filter(by_hash < int(min(1.0, 1.1 * FIT_ROWS / max(n, 1)) * 1_000_000)).limit(FIT_ROWS)
    # At most FIT_ROWS rows are sent, so the texts stay where they are.
    rows = stored(documents.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "y"), "fitted")

    def count(parts):
        for batch in parts:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for first, _, r, t in _terms(batch):
                terms, back = np.unique(t, return_inverse=True)
                positive = np.bincount(back, weights=y[first + r], minlength=len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.bincount(back, minlength=len(terms)).astype(np.int64)), pa.array(positive)], names=["term", "n", "positive"])

    all_rows, all_positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not all_rows or all_positive in (0, all_rows):
        return Model(np.zeros(0, np.int64), float(np.log((all_positive + 0.5) / (all_rows - all_positive + 0.5))), np.zeros(0), np.zeros((0, FACTORS)))
    sums = rows.mapInArrow(count, "term long, n long, positive long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))
    share, part = F.col("n") / F.lit(all_rows), F.col("n") * F.lit(all_positive / all_rows)
    z = F.abs(F.col("positive") - part) / F.sqrt(part * F.lit(1 - all_positive / all_rows) * (F.lit(1.0) - share) + F.lit(0.05))
    sums = stored(sums.filter(f"n >= {LEAST_ROWS}").withColumn("z", z), "terms")
    best = sums.filter(F.col("z") >= LEAST_DIFFERENCE).orderBy(F.desc("z"), "term").limit(TERMS).select("term").collect()
    often = sums.orderBy(F.desc(F.least("n", F.lit(all_rows) - F.col("n"))), "term").limit(PAIR_TERMS).select("term").collect()
    alone = [r["term"] for r in best]  # at most TERMS, and PAIR_TERMS in pairs
    paired = np.array(sorted({r["term"] for r in often} | set(alone[: PAIR_TERMS // 4])), np.int64)
    terms = np.array(sorted({*paired.tolist(), *alone}), np.int64)

    def seen(parts):
        for batch in parts:
            for first, end, r, t in _terms(batch):
                r, c = _found(terms, r, t)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, end - first), lists(c.astype(np.int32), np.bincount(r, minlength=end - first), pa.int32())], names=["y", "terms"])

    found = rows.mapInArrow(seen, "y int, terms array<int>").toArrow()  # at most FIT_ROWS rows of len(terms) numbers
    labels_of = found.column("y").to_numpy().astype(float)
    chunks = found.column("terms").chunks
    columns = np.concatenate([c.flatten().to_numpy() for c in chunks])
    of_row = np.repeat(np.arange(len(labels_of), dtype=np.int32), np.concatenate([np.diff(c.offsets.to_numpy()) for c in chunks]))
    del found, chunks

    def only(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and numbers of the terms in ``some``."""
        number = np.full(len(terms), -1, np.int32)
        number[np.searchsorted(terms, some)] = np.arange(len(some))
        at = number[columns]
        return of_row[at >= 0], at[at >= 0]

    kept = np.unique(np.concatenate([np.array(alone, np.int64), paired[telling_pairs(*only(paired), labels_of, len(paired))]]))
    return Model(kept, *fit_machine(*only(kept), labels_of, len(kept)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, from its text alone."""
    small_batches(documents.sparkSession)
    terms, w0, w, v = model.terms, model.w0, model.w, model.v

    def judge(parts):
        machine = Model(terms, w0, w, v)
        for batch in parts:
            for first, end, r, t in _terms(batch):
                r, c = _found(terms, r, t)
                s = _sigmoid(machine.raw(r, c, end - first))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(s)], names=["doc_id", "score"])

    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document with a machine fitted on the labels.

    Null and empty texts have no terms and get the score of the bias alone. Without labels of both kinds the
    score is the share of the only kind. Repeated rows are scored alike; null ids count as held out. Texts are
    read whole, in steps that hold one text at least. Other columns of ``documents`` do not matter.
    """
    return score(documents, fit(documents, labels))


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose score stays below the threshold."""
    model = fit(documents, labels)
    terms, w0, w, v = model.terms, model.w0, model.w, model.v
    columns = documents.columns

    def keep(parts):
        machine = Model(terms, w0, w, v)
        for batch in parts:
            fine = [_sigmoid(machine.raw(*_found(terms, r, t), end - first)) < threshold for first, end, r, t in _terms(batch)]
            if fine:
                yield batch.filter(pa.array(np.concatenate(fine)))

    return documents.mapInArrow(keep, documents.schema).select(*columns)


QUERIES = {"op2_toxicity": Query(lambda spark, folder: toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")))}
