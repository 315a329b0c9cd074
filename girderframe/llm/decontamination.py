"""Benchmark decontamination: BM25 index of the test items, searched with every passage of the corpus.

The inverted index holds the BM25 weight of each term in each item, as a share of the score that the item
must reach, so every item's threshold is 1. Items lie in blocks; for each term the largest weight in all
blocks and in each block is kept. Whole runs of passages are skipped when their terms' largest weights
stay below 1, blocks of items when the block's largest weights do (block-max WAND), and only what is left
is scored. All items at or above their threshold are retrieved, without a limit, and then the overlap
with the item's question and answer is verified.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girderframe.llm.common import LETTERS, Query, column_of, shingles, small_batches, table, text_slices, words
from girderframe.session import stored

#: Share of an item's own score from which it is retrieved, and overlaps from which it counts as leaked.
SCORE, QUESTION, ANSWER = 0.5, 0.6, 0.6
K1, B, BLOCK = 1.2, 0.75, 16
#: Words of a shingle, words by which passages advance at least, and words below which an item says too little.
SHINGLE, STEP, LEAST_WORDS = 5, 64, 8
#: Bytes of test items in one index. More items are searched for in several passes.
INDEX_BYTES = 16 << 20
#: Pairs of a passage and a block of items whose bounds are held together.
PASSAGE_BLOCKS = 4_000_000

_WORD_BYTES = LETTERS.copy()
_WORD_BYTES[48:58] = True


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is what follows the last ``Answer:``, else the last sentence, else the last third of the words."""
    marked = re.search(r"(?is)^(.*)\banswer\s*:(.*)$", text)
    if marked and marked[1].strip() and marked[2].strip():
        return marked[1], marked[2]
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text) if p.strip()]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    every = text.split()
    at = max(1, len(every) * 2 // 3)
    return " ".join(every[:at]), " ".join(every[at:])


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode(), np.uint8)
    return words(data, np.array([0, len(data)]), _WORD_BYTES)[1]


def _shingle_set(h: np.ndarray) -> np.ndarray:
    return np.unique(shingles(np.zeros(len(h), np.int64), h, SHINGLE)[1])


def _parts(text: str) -> tuple[bool, np.ndarray, bool, np.ndarray]:
    """What must be found of question and answer: whether it is shingles, else words, and their hashes.

    A question is looked for by shingles and an answer by words, but the other way round if the question is
    shorter than a shingle.
    """
    question, answer = map(_hashes, question_and_answer(text))
    short = len(question) < SHINGLE
    by_shingle = short and len(answer) >= SHINGLE
    return not short, np.unique(question) if short else _shingle_set(question), by_shingle, _shingle_set(answer) if by_shingle else np.unique(answer)


@dataclass
class Index:
    """Terms in order; postings of a block lie together, by term: ``posting[block]`` = (term, item, weight).

    ``maxima`` = (first, block, weight) is a reduction of the postings: the blocks in which term t occurs, and its
    largest weight there, stand from ``first[t]`` to ``first[t + 1]``.
    """

    items: list[tuple[int, bool, np.ndarray, bool, np.ndarray]]
    terms: np.ndarray
    most: np.ndarray
    maxima: tuple[np.ndarray, np.ndarray, np.ndarray]
    postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    step: int


@dataclass
class Statistics:
    """Of all items of enough words: their number, mean and largest length, and terms with the items that hold them."""

    items: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


def build_index(rows: list[tuple[int, str]], statistics: Statistics | None = None) -> Index | None:
    """None without an item of enough words. ``statistics`` is that of all items if ``rows`` are but a part of them."""
    kept, counts = [], []
    for item, text in sorted((i, t) for i, t in rows if i is not None and t):
        h = _hashes(text)
        if len(h) < LEAST_WORDS:
            continue
        kept.append((item, *_parts(text)))
        counts.append(np.unique(h, return_counts=True))
    if not kept:
        return None
    terms, df = np.unique(np.concatenate([t for t, _ in counts]), return_counts=True)
    lengths = np.array([n.sum() for _, n in counts], float)
    total, mean, longest = len(kept), lengths.mean(), int(lengths.max())
    if statistics is not None:
        df = statistics.df[np.searchsorted(statistics.terms, terms)]
        total, mean, longest = statistics.items, statistics.mean, statistics.longest
    idf = np.log1p((total - df + 0.5) / (df + 0.5))
    blocks = math.ceil(len(kept) / BLOCK)
    maxima, postings = [], []
    for b in range(blocks):
        t_all, i_all, w_all = [], [], []
        for i in range(b * BLOCK, min(len(kept), (b + 1) * BLOCK)):
            t, n = counts[i]
            at = np.searchsorted(terms, t)
            weight = idf[at] * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[i] / mean))
            weight = weight / (SCORE * weight.sum())
            t_all.append(at)
            i_all.append(np.full(len(at), i))
            w_all.append(weight)
        t, i, w = (np.concatenate(x) for x in (t_all, i_all, w_all))
        order = np.argsort(t, kind="stable")
        t, i, w = t[order], i[order], w[order]
        postings.append((t, i, w))
        begins = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        maxima.append((t[begins], np.full(len(begins), b, np.int32), np.maximum.reduceat(w, begins)))
    t, of_block, w = (np.concatenate(x) for x in zip(*maxima))
    order = np.argsort(t, kind="stable")
    first = np.searchsorted(t[order], np.arange(len(terms) + 1))
    return Index(kept, terms, np.maximum.reduceat(w[order], first[:-1]), (first, of_block[order], w[order]), postings, max(STEP, longest))


def _score_block(postings, passage: np.ndarray, term: np.ndarray, count: int, first: int) -> np.ndarray:
    """Scores of (passage, item of the block) from pairs of passage and term."""
    t, i, w = postings
    lo, hi = np.searchsorted(t, term), np.searchsorted(t, term, side="right")
    n = hi - lo
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out = np.zeros((count, BLOCK))
    np.add.at(out, (np.repeat(passage, n), i[at] - first), w[at])
    return out


def search_slice(index: Index, rows: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, int, float, float, float]]:
    """(row, item number, passage, score, question overlap, answer overlap) of all that is retrieved and verified."""
    n_words = len(hashes)
    if not n_words:
        return []
    first_word = np.searchsorted(rows, rows)
    half = (np.arange(n_words) - first_word) // index.step
    new = np.append(True, (rows[1:] != rows[:-1]) | (half[1:] != half[:-1]))
    cell = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    cell_row = rows[begins]
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    hit = index.terms[at] == hashes
    both = np.unique(cell[hit] * np.int64(len(index.terms)) + at[hit])
    c, t = both // len(index.terms), both % len(index.terms)
    bound = np.bincount(c, weights=index.most[t], minlength=len(begins))
    # A passage is a cell and the next one of the same text.
    joined = np.append(cell_row[1:] == cell_row[:-1], False)
    upper = bound + np.where(joined, np.append(bound[1:], 0.0), 0.0)
    passages = np.flatnonzero(upper >= 1 - 1e-9)
    if not len(passages):
        return []
    start = np.searchsorted(c, np.arange(len(begins) + 1))
    found = []
    blocks, (first, of_block, largest) = len(index.postings), index.maxima
    together = max(1, min(2000, PASSAGE_BLOCKS // blocks))
    for lo in range(0, len(passages), together):
        some = passages[lo : lo + together]
        p_parts, t_parts = [], []
        for k, p in enumerate(some):
            last = p + 2 if joined[p] else p + 1
            own = np.unique(t[start[p] : start[last]])
            p_parts.append(np.full(len(own), k))
            t_parts.append(own)
        passage, term = np.concatenate(p_parts), np.concatenate(t_parts)
        n = first[term + 1] - first[term]
        held = np.repeat(first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        reach = np.bincount(np.repeat(passage, n) * blocks + of_block[held], weights=largest[held], minlength=len(some) * blocks).reshape(len(some), blocks)
        for b in np.flatnonzero((reach >= 1 - 1e-9).any(axis=0)).tolist():
            postings, possible = index.postings[b], reach[:, b] >= 1 - 1e-9
            use = possible[passage]
            number = np.cumsum(possible) - 1
            scores = _score_block(postings, number[passage[use]], term[use], int(possible.sum()), b * BLOCK)
            for x, i in zip(*np.nonzero(scores >= 1 - 1e-9)):
                p = int(some[np.flatnonzero(possible)[x]])
                last = p + 2 if joined[p] else p + 1
                h = hashes[begins[p] : begins[last] if last < len(begins) else n_words]
                item = b * BLOCK + int(i)
                _, q_shingles, question, a_shingles, answer = index.items[item]
                grams = _shingle_set(h)
                q = float(np.isin(question, grams if q_shingles else h).mean()) if len(question) else 1.0
                a = float(np.isin(answer, grams if a_shingles else h).mean()) if len(answer) else 1.0
                if q >= QUESTION and a >= ANSWER:
                    found.append((int(cell_row[p]), item, int(half[begins[p]]), float(scores[x, i]) * SCORE, q, a))
    return found


_FOUND = "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double"


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, passage, score, question_overlap, answer_overlap): the best passage of each leaked item in each document.

    A passage is two steps of words, and the next one begins one step later; a step is as long as the longest
    item at least, so every item lies within a passage. ``score`` is the BM25 score as a share of the
    item's own. Null and empty texts, and items of fewer than ``LEAST_WORDS`` words, match nothing. Items
    with equal texts are all reported. Repeated rows of a document count once. Texts are searched whole, in steps that
    hold one text at least. Frequencies and lengths are those of all items, however many passes there are.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(total / INDEX_BYTES))
    counted = _item_terms(items) if passes > 1 else None
    found = None
    for k in range(passes):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k
        rows = [(r[0], r[1]) for r in items.filter(mine).collect()]  # about INDEX_BYTES
        index = build_index(rows, None if counted is None else _statistics(counted, mine))
        if index is None:
            continue
        one = _search(docs, index)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], _FOUND)
    others = ["score", "passage", "question_overlap", "answer_overlap"]
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("passage")).alias("passage"), *others[2:])).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.passage")).alias("passage"), "best.score", "best.question_overlap", "best.answer_overlap")


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, length, term) of all items of enough words, each term of an item once."""

    def count(parts):
        for batch in parts:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = _hashes(text) if item is not None and text else np.zeros(0, np.uint64)
                if len(h) >= LEAST_WORDS:
                    t = np.unique(h).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), item)), pa.array(np.full(len(t), len(h))), pa.array(t)], names=["item_id", "length", "term"])

    return stored(items.mapInArrow(count, "item_id long, length long, term long"), "item_terms")


def _statistics(counted: DataFrame, mine) -> Statistics:
    """Of all items, with the frequencies of the terms of those that ``mine`` picks."""
    each = counted.groupBy("item_id").agg(F.max("length").alias("length"))
    n, mean, longest = each.agg(F.count(F.lit(1)), F.avg("length"), F.max("length")).first()
    wanted = counted.filter(mine).select("term").distinct()
    df = counted.join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()  # terms of about INDEX_BYTES
    terms = np.array([r["term"] for r in df], np.int64).view(np.uint64)
    order = np.argsort(terms)
    return Statistics(n, mean or 0.0, longest or 0, terms[order], np.array([r["df"] for r in df], np.int64)[order])


def _search(docs: DataFrame, index: Index) -> DataFrame:
    plain = docs.sparkSession.sparkContext.broadcast((index.items, index.terms, index.most, index.maxima, index.postings, index.step))

    def search(parts):
        own = Index(*plain.value)
        for batch in parts:
            out = []
            ids = batch.column(0)
            for first, _, data, offsets in text_slices(pc.utf8_lower(column_of(batch, "text"))):
                rows, hashes, _, _ = words(data, offsets, _WORD_BYTES)
                out += [(ids[first + r].as_py(), own.items[i][0], *rest) for r, i, *rest in search_slice(own, rows, hashes)]
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=[f.split()[0] for f in _FOUND.split(", ")])

    return docs.mapInArrow(search, _FOUND)


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents``, with all their columns, in which no item leaked."""
    found = leaks(documents, benchmark).select(F.col("doc_id").alias("_leaked")).distinct()
    return documents.join(found, documents["doc_id"] == found["_leaked"], "left_anti")


QUERIES = {"op9_benchmark_decontamination": Query(lambda spark, folder: leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")))}
