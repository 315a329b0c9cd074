"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: blank and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one numpy step works on at most, but for one longer text.
SLICE_BYTES = 1 << 18


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of long texts small. Session-wide; only ever lowers the number of rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def fresh(columns: list[str], stem: str) -> str:
    """A column name that none of ``columns`` has, whatever their case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def lower_ascii(column: Column) -> Column:
    """Lower-case A to Z and leave all else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def shared_broadcast(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)


# --- numpy over the UTF-8 bytes of Arrow strings -------------------------------------------


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column without nulls (null: empty)."""
    array = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_string(array.type):
        array = array.cast(pa.string())
    return array.fill_null("") if array.null_count else array


def text_slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them), at most ``limit`` bytes unless one row is longer."""
    if not len(array):
        return
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(array):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, len(array))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of a multiplicative hash)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> np.ndarray:
    base = np.full(max(n, 1), _BASE, dtype=np.uint64)
    base[0] = 1
    return np.cumprod(base, dtype=np.uint64)


#: Bytes of letters: A-Z, a-z and all of other scripts.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray | None = None, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Words of concatenated texts, A-Z lower-cased: (row, 64-bit hash, start, end) of each.

    ``letters`` tells which bytes belong to words. For each of ``prefixes`` an array follows with the hash of
    that many bytes at the word's start; of shorter words it is that of the word.
    """
    empty = np.zeros(0, np.int64)
    if not len(data):
        return (empty, empty.astype(np.uint64), empty, empty, *[empty.astype(np.uint64)] * len(prefixes))
    inside = ~_IS_SPACE[data] if letters is None else letters[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    if not len(starts):
        return (empty, empty.astype(np.uint64), empty, empty, *[empty.astype(np.uint64)] * len(prefixes))
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = ~inside[1:] | first[1:-1]
    ends = np.flatnonzero(inside & last) + 1
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if place is None:
        place = np.zeros(len(data), np.int64)
        place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = (_LOWER[data].astype(np.uint64) + _U(1)) * _powers(int(place.max()) + 1)[place]
    value[~inside] = 0
    hashes = mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    some = [mix(np.add.reduceat(np.where(place < k, value, np.uint64(0)), starts) + np.minimum(ends - starts, k).astype(np.uint64)) for k in prefixes]
    return (rows, hashes, starts, ends, *some)


def shingles(rows: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words; a row with fewer words has its whole sequence as one."""
    n = len(hashes)
    if not n:
        return rows, hashes
    short_rows, first, count = np.unique(rows, return_index=True, return_counts=True)
    out_r, out_h = [], []
    if n >= size:
        h = hashes[: n - size + 1]
        for k in range(1, size):
            h = mix(h * _U(_BASE) + hashes[k : n - size + 1 + k])
        whole = rows[: n - size + 1] == rows[size - 1 :]
        out_r.append(rows[: n - size + 1][whole])
        out_h.append(h[whole])
    for r, at, c in zip(short_rows, first, count):
        if c < size:
            h = hashes[at : at + 1]
            for k in range(1, c):
                h = mix(h * _U(_BASE) + hashes[at + k : at + k + 1])
            out_r.append(np.array([r]))
            out_h.append(mix(h + _U(int(c))))
    r, h = np.concatenate(out_r), np.concatenate(out_h)
    order = np.argsort(r, kind="stable")
    return r[order], h[order]


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    """A list column: ``counts`` values for each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def batches(found: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for columns in found:
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


#: Bytes after which a single very long text is looked at in a further step.
LONG_TEXT = 8 << 20


def _next_gap(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on whose byte is no letter, or the end."""
    for low in range(at, len(data), 1 << 20):
        gaps = np.flatnonzero(~LETTERS[data[low : low + (1 << 20)]])
        if len(gaps):
            return low + int(gaps[0])
    return len(data)


def text_parts(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """As ``text_slices``, with very long texts cut at an ASCII byte that is no letter; the last value marks all parts of a text but its first."""
    for row, end, data, offsets in text_slices(array, limit):
        at = 0
        while end - row == 1 and len(data) - at > LONG_TEXT:
            stop = _next_gap(data, at + LONG_TEXT)
            yield row, end, data[at:stop], np.array([0, stop - at]), at > 0
            at = stop
        yield row, end, data[at:], offsets if at == 0 else np.array([0, len(data) - at]), at > 0


def runs_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """(row, run) of every longest run of the bytes marked by ``inside``, A-Z lower-cased; a run ends with its text."""
    if not len(data):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    places = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    return rows, pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(_LOWER[data[inside]]))
