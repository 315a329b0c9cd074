"""Quality of documents from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Documents with the same votes are counted
together, so expectation-maximisation over the patterns of votes covers all documents: it estimates how
often each labeller votes what for good and for bad documents, and the share of good ones. The posterior of
each pattern is the soft label on which a linear scorer over hashed word shapes is trained; the scorer judges
every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girderframe.llm.common import LETTERS, Query, column_of, lists, mix, small_batches, table, text_slices, words
from girderframe.session import stored

#: Documents that the scorer is trained on, at most; chosen by the hash of their id. Votes and their accuracies cover all.
FIT_ROWS = 16_000
HASH_BITS, EPOCHS, RATE, DECAY = 14, 60, 0.3, 1e-5
LABELLERS = ("capitals", "symbols", "exclamations", "echoes", "variety", "bars", "length", "sentences", "word_length")
GOOD, BAD, NONE = 1, 0, 2
#: Assumed chances of the votes bad, good and nothing for bad and for good documents, and their weight.
CHANCES, ASSUMED = {BAD: (0.11, 0.84, 0.05), GOOD: (0.002, 0.93, 0.068)}, 1.0
#: A labeller calls at most this share of the good documents bad.
MOST_WRONG = 0.01
#: Documents that stand for what is believed beforehand where nothing is assumed.
PSEUDO = 3.0

_UPPER, _SYMBOL, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_SYMBOL[[ord(c) for c in "#%$&*|{}<>~^=\\_@"]] = True
_DIGIT[48:58] = True
_CLASS = np.arange(256, dtype=np.uint64) + np.uint64(8)
_CLASS[LETTERS], _CLASS[_UPPER], _CLASS[_DIGIT] = 1, 2, 3


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, NONE))


def votes_and_shapes(batch: pa.RecordBatch):
    """(first row, end row, votes by labeller, row, hashed shape and share of it among the row's words)."""
    for first, end, data, offsets in text_slices(column_of(batch, "text")):
        count = end - first
        rows, h, start, stop = words(data, offsets)
        n = np.bincount(rows, minlength=count).astype(float)
        some = np.maximum(n, 1)
        sums = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offsets]).astype(float)
        letters, size = np.maximum(sums(LETTERS[data]), 1), np.maximum(np.diff(offsets), 1)
        same = np.append(False, (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])) if len(h) else np.zeros(0, bool)
        echoes = np.bincount(rows, weights=same, minlength=count) / some
        order = np.lexsort((h, rows))
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])) if len(h) else np.zeros(0, bool)
        variety = np.bincount(rows[order], weights=new, minlength=count) / some
        bar = (stop - start == 1) & (data[start] == ord("|")) if len(h) else np.zeros(0, bool)
        bars = np.bincount(rows, weights=bar, minlength=count) / some
        ends = np.isin(data[stop - 1], [46, 63, 33]) if len(h) else np.zeros(0, bool)
        sentences = np.bincount(rows, weights=ends, minlength=count) / some
        caps, symbols, shouts = sums(_UPPER[data]) / letters, sums(_SYMBOL[data]) / size, sums(data == 33) / some
        mean = np.bincount(rows, weights=stop - start, minlength=count) / some
        votes = np.stack(
            [
                _vote(caps < 0.2, caps > 0.5),
                _vote(symbols < 0.01, symbols > 0.04),
                _vote(shouts < 0.1, shouts > 0.3),
                _vote(echoes < 0.05, echoes > 0.2),
                _vote((variety > 0.35) & (n >= 20), (variety < 0.2) & (n >= 20) & (n <= 2000)),
                _vote(bars < 0.01, bars > 0.08),
                _vote(n >= 30, n < 4),
                _vote((sentences > 0.01) & (sentences < 0.4), ((sentences == 0) & (n >= 40)) | (sentences > 0.6)),
                _vote((mean > 3) & (mean < 10), (mean < 2) | (mean > 20)),
            ],
            axis=1,
        )
        # Shape of a word: its runs of letters, capitals, digits and single other signs.
        kind = _CLASS[data] if len(data) else np.zeros(0, np.uint64)
        if len(h):
            change = np.append(True, kind[1:] != kind[:-1])
            change[start] = True
            run = np.cumsum(change)
            within = np.zeros(len(data), bool)
            edges = np.zeros(len(data) + 1, np.int64)
            np.add.at(edges, start, 1)
            np.add.at(edges, stop, -1)
            within = np.cumsum(edges[:-1]) > 0
            place = np.minimum(run - run[start][np.maximum(np.searchsorted(start, np.arange(len(data)), side="right") - 1, 0)], 40)
            power = np.full(42, 0x9E3779B97F4A7C15, np.uint64)
            power[0] = 1
            value = np.where(change & within, kind * np.cumprod(power, dtype=np.uint64)[np.maximum(place, 0)], np.uint64(0))
            shape = mix(np.add.reduceat(value, start)) >> np.uint64(64 - HASH_BITS)
            echo = mix(np.array([12345], np.uint64)) >> np.uint64(64 - HASH_BITS)
            r = np.concatenate([rows, rows[same]])
            t = np.concatenate([shape, np.full(int(same.sum()), echo[0])]).astype(np.int64)
            both, times = np.unique((r << HASH_BITS) | t, return_counts=True)
            r, t = both >> HASH_BITS, both & ((1 << HASH_BITS) - 1)
            share = times / some[r]
        else:
            r, t, share = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        yield first, end, votes, r, t, share


@dataclass
class LabelModel:
    """prior of good, and for each labeller and class the chances of its three votes."""

    prior: float
    chances: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = np.arange(votes.shape[1])
        good, bad = (np.log(self.chances[at[:, None], c, votes.T]).sum(0) for c in (GOOD, BAD))
        x = good - bad + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 50, assumed: float | None = ASSUMED) -> LabelModel:
    """From patterns of votes and how many documents have each; it starts from the share of good votes.

    With ``assumed`` None, prior share and all chances are learnt from the votes alone, up to ``PSEUDO`` documents;
    that is right for labellers whose votes are independent given the class. Where bad documents are bad
    in different ways they are not, and every way counts as an error on good documents. Assumed chances,
    which weigh as much as ``assumed`` times all documents, then keep the classes apart: labellers seldom call a good
    document bad, and most of them call a bad one good.
    """
    good, bad = (votes == GOOD).sum(1), (votes == BAD).sum(1)
    p = np.where(bad > 0, 0.15 * good / np.maximum(good + bad, 1), 0.95)
    model = LabelModel(0.8, np.full((votes.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds if len(votes) else 0):
        chances = np.empty((votes.shape[1], 2, 3))
        for c, weight in ((GOOD, counts * p), (BAD, counts * (1 - p))):
            for v in range(3):
                believed = PSEUDO / 3 if assumed is None else assumed * counts.sum() * CHANCES[c][v] + 1e-3
                chances[:, c, v] = ((votes == v) * weight[:, None]).sum(0) + believed
        chances /= chances.sum(axis=2, keepdims=True)
        if assumed is not None:
            chances[:, GOOD, BAD] = np.minimum(chances[:, GOOD, BAD], MOST_WRONG)
        prior = float(np.clip((counts * p).sum() / max(counts.sum(), 1), 0.01, 0.99))
        model = LabelModel(prior, chances)
        new = model.posterior(votes)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return model


def train(rows: np.ndarray, columns: np.ndarray, shares: np.ndarray, targets: np.ndarray, seed: int = 5) -> np.ndarray:
    """Weights of a logistic scorer on soft labels; the last one is the bias."""
    rng, w = np.random.default_rng(seed), np.zeros((1 << HASH_BITS) + 1)
    g = np.full(len(w), 1e-6)
    begin = np.searchsorted(rows, np.arange(len(targets) + 1))
    for _ in range(EPOCHS):
        order = rng.permutation(len(targets))
        for lo in range(0, len(order), 256):
            some = order[lo : lo + 256]
            n = begin[some + 1] - begin[some]
            at = np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            r, c, x = np.repeat(np.arange(len(some)), n), columns[at], shares[at]
            error = 1 / (1 + np.exp(-np.clip(np.bincount(r, weights=x * w[c], minlength=len(some)) + w[-1], -30, 30))) - targets[some]
            d = np.bincount(np.append(c, len(w) - 1), weights=np.append(error[r] * x, error.sum()), minlength=len(w)) / len(some) + DECAY * w
            g += d * d
            w -= RATE * d / np.sqrt(g)
    return w


def label_model(documents: DataFrame) -> tuple[LabelModel, DataFrame]:
    """The model of all documents' votes, and the patterns of votes with their counts."""
    names = [f"v{k}" for k in range(len(LABELLERS))]

    def vote(parts):
        for batch in parts:
            for _, _, votes, *_ in votes_and_shapes(batch):
                found, n = np.unique(votes, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*[pa.array(found[:, k].astype(np.int32)) for k in range(len(names))], pa.array(n.astype(np.int64))], names=[*names, "n"])

    kinds = ", ".join(f"{n} int" for n in names) + ", n long"
    patterns = stored(documents.select("text").mapInArrow(vote, kinds).groupBy(*names).agg(F.sum("n").alias("n")), "votes")
    found = patterns.toPandas()  # at most 3 ** len(LABELLERS) rows
    return expectation_maximisation(found[names].to_numpy(np.int64), found["n"].to_numpy(float)), patterns


def quality(documents: DataFrame) -> DataFrame:
    """(doc_id, posterior, score, predicted, keep) of every document.

    ``posterior`` is that of its votes, ``score`` the scorer's, ``keep`` whether it reaches 0.5. Null and
    empty texts are judged like texts without words. Repeated rows are judged alike; an empty table gives none.
    """
    small_batches(documents.sparkSession)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, patterns = label_model(documents)
    n = patterns.agg(F.sum("n")).first()[0] or 0
    by_hash = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    picked = documents.filter(by_hash < int(min(1.0, 1.1 * FIT_ROWS / max(n, 1)) * 1_000_000)).limit(FIT_ROWS)
    prior, chances = model.prior, model.chances

    def sample(parts):
        known = LabelModel(prior, chances)
        for batch in parts:
            for first, end, votes, r, t, share in votes_and_shapes(batch):
                c = np.bincount(r, minlength=end - first)
                yield pa.RecordBatch.from_arrays([pa.array(known.posterior(votes)), lists(t, c, pa.int64()), lists(share, c, pa.float64())], names=["p", "terms", "shares"])

    rows = picked.mapInArrow(sample, "p double, terms array<long>, shares array<double>").toArrow()  # at most FIT_ROWS rows
    targets = rows.column("p").to_numpy()
    counts = np.concatenate([np.diff(c.offsets.to_numpy()) for c in rows.column("terms").chunks] or [np.zeros(0, np.int64)])
    flat = lambda name: np.concatenate([c.flatten().to_numpy() for c in rows.column(name).chunks] or [np.zeros(0)])
    weights = train(np.repeat(np.arange(len(targets)), counts), flat("terms").astype(np.int64), flat("shares"), targets)

    def judge(parts):
        known = LabelModel(prior, chances)
        for batch in parts:
            for first, end, votes, r, t, share in votes_and_shapes(batch):
                x = np.bincount(r, weights=share * weights[t], minlength=end - first) + weights[-1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(known.posterior(votes)), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))], names=["doc_id", "posterior", "score"])

    scored = documents.mapInArrow(judge, "doc_id long, posterior double, score double")
    good = F.col("score") >= 0.5
    return scored.select("doc_id", "posterior", "score", good.cast("int").alias("predicted"), good.alias("keep"))


QUERIES = {"op1_quality_classifier": Query(lambda spark, folder: quality(table(spark, folder, "documents")))}
