"""Substring deduplication with a suffix array that is dealt out by anchors.

Two windows of ``min_bytes`` bytes that are equal choose the same anchor: the piece of ``PIECE`` bytes
with the smallest hash in the window. Runs of windows with one anchor form a context; equal windows
always lie in contexts with equal anchors, so the suffixes of each anchor's contexts can be sorted on
their own. Most anchors occur once or have only equal contexts and need no bytes at all. For the others an
enhanced suffix array (sorted suffixes, common prefix lengths, the byte to the left) is scanned with a
stack; intervals whose suffixes have different bytes to their left are the maximal repeat groups.
A group's first occurrence stays, and every other one is covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girderframe.llm.common import Query, column_of, mix, signed, small_batches, table, text_slices
from girderframe.session import stored

MIN_BYTES = 100
#: Bytes of an anchor.
PIECE = 32
#: Windows of one text that are looked at together; longer texts continue in the next stretch.
STRETCH = 1 << 18
#: Different contexts of one anchor up to which they are sorted in one task. More of them are dealt out by window.
IN_ONE_TASK = 1_000
#: Bytes of contexts that one suffix array holds, about.
ARRAY_BYTES = 1 << 17

_U = np.uint64
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_ODD = 0xD6E8FEB86659FD93


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the PIECE bytes at every position."""
    h, span, odd = _TABLE[data], 1, _ODD
    while span < PIECE:
        h = h[:-span] * _U(odd) + h[span:]
        span, odd = span * 2, (odd * odd + 2) & 0xFFFFFFFFFFFFFFFF
    return mix(h)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span, m = 1, values
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (width - span)], m[width - span :]) if width > span else m


def contexts(data: np.ndarray, offsets: np.ndarray, min_bytes: int) -> tuple[np.ndarray, ...]:
    """Contexts of concatenated texts: (row, anchor hash, context hash, start in the text, windows)."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    if len(data) < min_bytes:
        return none
    pieces = _piece_hashes(data)
    # The upper bits order the pieces; the position below makes the leftmost of equal ones win.
    low = np.arange(len(pieces), dtype=np.uint64)
    ordered = (pieces >> _U(24) << _U(24)) | low
    least = _sliding_min(ordered, min_bytes - PIECE + 1)
    anchor = (least & _U((1 << 24) - 1)).astype(np.int64)
    window = np.arange(len(least))
    row = np.searchsorted(offsets, window, side="right") - 1
    valid = window + min_bytes <= offsets[row + 1]
    window, anchor, row = window[valid], anchor[valid], row[valid]
    if not len(window):
        return none
    begins = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
    first = window[begins]
    count = np.diff(np.append(begins, len(window)))
    end = first + count + min_bytes - 1
    powers = np.full(len(data), _ODD, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * powers, dtype=np.uint64)])
    inverse = np.full(len(data), pow(_ODD, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    at = anchor[begins]
    whole = mix((sums[end] - sums[first]) * inverse[first] + ((at - first) * 1024 + count).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
    return row[begins], pieces[at], whole, first - offsets[row[begins]], count


def _stretches(batch: pa.RecordBatch, min_bytes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``contexts`` of all rows of a batch, with the row in the batch; long texts in overlapping stretches."""
    for first, end, data, offsets in text_slices(column_of(batch, "text")):
        if len(data) <= 2 * STRETCH:
            r, *rest = contexts(data, offsets, min_bytes)
            yield r + first, *rest
            continue
        # One long text.
        for begin in range(0, max(1, len(data) - min_bytes + 1), STRETCH):
            part = data[begin : begin + STRETCH + min_bytes - 1]
            r, h, c, start, count = contexts(part, np.array([0, len(part)]), min_bytes)
            yield r + first, h, c, start + begin, count


_ANCHORS = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("again", pa.bool_())])


def anchor_rows(documents: DataFrame, min_bytes: int) -> DataFrame:
    """(key, context, doc_id, start, windows, again): contexts of all texts.

    ``again`` marks a context that the same batch holds at an earlier place; it is covered for sure, gets a
    key of its own and so never piles up under the key of its anchor.
    """

    def rows(parts):
        for batch in parts:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)
            found = list(zip(*_stretches(batch, min_bytes)))
            if not found:
                continue
            r, h, c, start, count = (np.concatenate(x) for x in found)
            doc = ids[r] if len(r) else np.zeros(0, np.int64)
            order = np.lexsort((start, doc, c, h))
            doc, h, c, start, count = doc[order], h[order], c[order], start[order], count[order]
            if len(h):  # rows that repeat a doc_id are one document
                new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))
                doc, h, c, start, count = doc[new], h[new], c[new], start[new], count[new]
            again = np.append(False, (h[1:] == h[:-1]) & (c[1:] == c[:-1])) if len(h) else np.zeros(0, bool)
            key = np.where(again, mix(doc.astype(np.uint64) * _U(_ODD) + start.astype(np.uint64)), h)
            for lo in range(0, len(key), 50_000):
                s = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key[s])), pa.array(signed(c[s])), pa.array(doc[s]), pa.array(start[s]), pa.array(count[s].astype(np.int32)), pa.array(again[s])], schema=_ANCHORS
                )

    return documents.mapInArrow(rows, "key long, context long, doc_id long, start long, windows int, again boolean")


@dataclass(frozen=True)
class IntervalTree:
    """Maximal repeat groups as the tree of common-prefix intervals; every suffix appears once in each list.

    Group k repeats ``length[k]`` bytes and lies inside group ``parent[k]`` (-1: none), whose repeat is shorter.
    ``members`` holds (text, start, smallest group of the suffix); a group's occurrences are its members and those
    of the groups inside it. ``covered`` holds (text, start, length) of the longest repeat of a suffix that occurs
    at an earlier place too.
    """

    length: list[int]
    parent: list[int]
    members: list[tuple[int, int, int]]
    covered: list[tuple[int, int, int]]


def interval_tree(texts: list[bytes], group: np.ndarray, min_bytes: int, origin: list[tuple[int, int]] | None = None) -> IntervalTree:
    """Maximal repeats of at least ``min_bytes`` among texts of one group, by a stack scan of their sorted suffixes.

    Only suffixes of at least ``min_bytes`` bytes are sorted. A byte to the left that differs, or a text's
    start, ends a repeat on the left. Repeats never join texts of different groups. ``origin`` gives the place of
    each text, its own number by default. An interval is left on the stack with what is still open in it: its
    suffixes outside smaller groups, these groups, and the suffixes that no repeat covers yet; each closed group
    leaves its first suffix open alone, so the lists stay as short as the suffixes are many.
    """
    tree = IntervalTree([], [], [], [])
    sizes = np.array([len(t) for t in texts])
    width = int(sizes.max())
    counts = np.maximum(sizes - min_bytes + 1, 0)
    text = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    if len(text) < 2:
        return tree
    flat = np.frombuffer(b"".join(texts) + bytes(width), np.uint8)
    begin = (np.cumsum(sizes) - sizes)[text] + start
    rest = sizes[text] - start
    rows = np.lib.stride_tricks.sliding_window_view(flat, width)[begin]
    rows = np.where(np.arange(width) < rest[:, None], rows, 0)
    keyed = np.concatenate([group[text].astype(">u4").view(np.uint8).reshape(-1, 4), rows, rest.astype(">u2").view(np.uint8).reshape(-1, 2)], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{keyed.shape[1]}").ravel(), kind="stable")
    text, start, rest, rows = text[order], start[order], rest[order], rows[order]
    same = group[text[1:]] == group[text[:-1]]
    differs = rows[1:] != rows[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    common = np.where(same, np.minimum(common, np.minimum(rest[1:], rest[:-1])), 0)
    # Beginnings of texts are all different from one another.
    left = np.where(start > 0, flat[np.maximum((np.cumsum(sizes) - sizes)[text] + start - 1, 0)].astype(np.int64), -1 - np.arange(len(text))).tolist()
    where = np.array([(k, 0) for k in range(len(texts))] if origin is None else origin, np.int64)
    place = np.empty(len(text), np.int64)
    place[np.lexsort((where[text, 1] + start, where[text, 0]))] = np.arange(len(text))
    place = place.tolist()
    inside = np.flatnonzero(common >= min_bytes)
    if not len(inside):
        return tree
    text, start = text.tolist(), start.tolist()

    def merged(into: _Interval, other: _Interval) -> None:
        into.left = into.left if into.left == other.left else None
        for name in ("loose", "groups", "open"):
            mine, theirs = getattr(into, name), getattr(other, name)
            if len(mine) < len(theirs):
                mine, theirs = theirs, mine
            mine.extend(theirs)
            setattr(into, name, mine)

    def closed(i: _Interval) -> None:
        """Make the interval a group if the bytes to its left differ."""
        if i.left is not None:
            return
        number = len(tree.length)
        tree.length.append(i.length)
        tree.parent.append(-1)
        for k in i.groups:
            tree.parent[k] = number
        tree.members.extend((text[k], start[k], number) for k in i.loose)
        first = min(i.open, key=place.__getitem__)
        tree.covered.extend((text[k], start[k], i.length) for k in i.open if k != first)
        i.loose, i.groups, i.open = [], [number], [first]

    for stretch in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1):
        stack: list[_Interval] = []
        for here in [*stretch.tolist(), int(stretch[-1]) + 1]:
            length = int(common[here]) if here <= stretch[-1] else 0
            carried = _Interval(length, left[here], [here], [], [here])
            if stack and stack[-1].length >= length:
                merged(stack[-1], carried)
                carried = None
            while stack and stack[-1].length > length:
                top = stack.pop()
                closed(top)
                if stack and stack[-1].length >= length:
                    merged(stack[-1], top)
                else:
                    carried = top
            if length and carried is not None:
                carried.length = length
                stack.append(carried)
    return tree


@dataclass
class _Interval:
    """An interval on the stack; ``left`` is the one byte to the left of its suffixes, or None."""

    length: int
    left: int | None
    loose: list[int]
    groups: list[int]
    open: list[int]


def scan_suffixes(texts: list[bytes], group: np.ndarray, min_bytes: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, start), ...]) of every maximal repeat group with all its occurrences, read off the interval tree.

    Written out like this the occurrences grow with the depth of the tree; jobs keep the tree.
    """
    tree = interval_tree(texts, group, min_bytes)
    places: list[list[tuple[int, int]]] = [[] for _ in tree.length]
    for t, s, g in tree.members:
        while g >= 0:
            places[g].append((t, s))
            g = tree.parent[g]
    yield from zip(tree.length, places)


_SPANS = "doc_id long, start long, length long"


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(doc_id, start, length) with spans of a document that touch made one."""
    out: list[list[int]] = []
    for doc, start, length in sorted(spans):
        if out and out[-1][0] == doc and start <= out[-1][1] + out[-1][2]:
            out[-1][2] = max(out[-1][2], start + length - out[-1][1])
        else:
            out.append([doc, start, length])
    return [tuple(x) for x in out]


def _mixed_repeats(mixed: DataFrame, min_bytes: int) -> DataFrame:
    """What maximal repeats of (key, doc_id, start, bytes) cover; the rows of a key are few.

    Spans of one document are joined in the task, so no more rows come out than contexts go in.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])

    def scan(parts):
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush(rows):
            keys, group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
            tree = interval_tree([r[3] for r in rows], group, min_bytes, [(r[1], r[2]) for r in rows])
            out = _joined([(rows[t][1], rows[t][2] + s, length) for t, s, length in tree.covered])
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], schema=schema)

        for batch in parts:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if size >= ARRAY_BYTES and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush(held)

    return mixed.select("key", "doc_id", "start", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(scan, _SPANS)


def _window_repeats(mixed: DataFrame, min_bytes: int) -> DataFrame:
    """The same for keys with very many contexts: their suffixes are dealt out by their first ``min_bytes`` bytes.

    All suffixes with equal first bytes form one interval of the suffix array, whose first occurrence is a
    minimum that is combined before the shuffle.
    """
    suffixes = mixed.select("key", "doc_id", "start", "bytes", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("at"))
    prefix = F.substring(F.col("bytes"), F.col("at") + 1, F.lit(min_bytes))
    suffixes = suffixes.select("doc_id", (F.col("start") + F.col("at")).alias("start"), F.xxhash64("key", prefix).alias("x"), F.xxhash64(prefix, "key").alias("y"))
    suffixes = stored(suffixes, "suffixes")
    place = F.struct("doc_id", "start")
    first = suffixes.groupBy("x", "y").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("count")).filter("count > 1")
    found = suffixes.join(first, ["x", "y"]).filter(place != F.col("first"))
    return found.select("doc_id", "start", F.lit(min_bytes).cast("long").alias("length"))


def covered_spans(documents: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, start, length) of occurrences of maximal repeats that are not the first of their group.

    Groups are maximal within the contexts of one anchor: a longer repeat comes as a chain of overlapping
    spans. Byte positions count from 0. Texts without a repeat have no row.
    """
    small_batches(documents.sparkSession)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = anchor_rows(documents, min_bytes)
    # One sort serves both windows: contexts of an anchor lie together, the first occurrence ahead.
    one = Window.partitionBy("key", "again", "context").orderBy("doc_id", "start")
    anchor = Window.partitionBy("key", "again")
    # The same place comes from several batches if rows repeat a doc_id; it counts once.
    rows = rows.repartition("key").withColumns({"nth": F.row_number().over(one), "rank": F.rank().over(one)}).filter("nth = rank")
    rows = rows.withColumns({"low": F.min("context").over(anchor), "high": F.max("context").over(anchor)})
    rows = rows.filter("again OR nth > 1 OR low < high").withColumn("whole", F.expr("again OR nth > 1")).select("key", "doc_id", "start", "windows", "whole")
    rows = stored(rows, "repeats")
    whole = rows.filter("whole").select("doc_id", "start", (F.col("windows") + (min_bytes - 1)).cast("long").alias("length"))

    mixed = rows.filter("NOT whole")
    many = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > IN_ONE_TASK)
    many = stored(many, "many")
    piece = F.substring(F.col("text").cast("binary"), (F.col("start") + 1).cast("int"), (F.col("windows") + (min_bytes - 1)).cast("int"))
    texts = documents.dropDuplicates(["doc_id"])
    with_bytes = stored(mixed.join(texts, "doc_id").select("key", "doc_id", "start", "windows", piece.alias("bytes")), "contexts")
    few = with_bytes.join(many, "key", "left_anti")
    spans = [_mixed_repeats(few, min_bytes)]
    if many.limit(1).count():
        spans.append(_window_repeats(with_bytes.join(many, "key", "left_semi"), min_bytes))
    for found in spans:
        whole = whole.unionByName(found.select("doc_id", "start", "length"))
    return whole


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def deduplicated(documents: DataFrame, min_bytes: int = MIN_BYTES, keep_text: bool = False) -> DataFrame:
    """Every document with n_bytes, n_removed, n_spans and kept_sha256, and on request ``kept``, the remaining bytes.

    A byte is removed if a string of ``min_bytes`` bytes covers it that also starts earlier: in a smaller
    doc_id, or earlier in the same document. Strings never cross documents and are judged on the input.
    Null and empty texts have no bytes. A null doc_id is neither compared nor changed. Rows with one
    doc_id are one document and must repeat its text.
    """
    small_batches(documents.sparkSession)
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = covered_spans(documents, min_bytes).groupBy("doc_id").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    joined = source.join(spans, "doc_id", "left").select("doc_id", "text", "spans.start", "spans.length")

    def digest(parts):
        for batch in parts:
            text = column_of(batch, "text")
            doc = batch.column(0)
            starts, lengths = batch.column(2), batch.column(3)
            out = []
            kept_all = []
            for k in range(len(text)):
                data = text[k].as_buffer()
                view, size = (memoryview(data), data.size) if data is not None else (memoryview(b""), 0)
                spans = []
                if starts[k].is_valid:
                    s = np.asarray(starts[k].values)
                    e = s + np.asarray(lengths[k].values)
                    o = np.argsort(s, kind="stable")
                    s, e = s[o], np.maximum.accumulate(e[o])
                    new = np.append(True, s[1:] > e[:-1])
                    spans = list(zip(s[new].tolist(), e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)].tolist()))
                sha, at, gone, kept = hashlib.sha256(), 0, 0, []
                for b, f in [*spans, (size, size)]:
                    sha.update(view[at:b])
                    if keep_text:
                        kept.append(bytes(view[at:b]))
                    gone += f - b
                    at = f
                out.append((doc[k].as_py(), size, gone, len(spans), sha.hexdigest()))
                kept_all.append(b"".join(kept))
            arrays = [pa.array([x[i] for x in out], f.type) for i, f in enumerate(_DIGEST)]
            if keep_text:
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept_all, pa.binary())], names=[*_DIGEST.names, "kept"])
            else:
                yield pa.RecordBatch.from_arrays(arrays, schema=_DIGEST)

    return joined.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))


QUERIES = {"op6_suffix_array_dedup": Query(lambda spark, folder: deduplicated(table(spark, folder, "documents")))}
