"""Groups of spelling variants, found by a relational trie frontier.

All words form two tries, one of the words and one of the reversed words. A single edit lies in the second
half of a word or of its reversal, so edits begin at deep nodes only, which have few children. The tries are
tables: a node is the hash of its prefix, and an edge leads from a branching node over one or more letters to
the next one. The frontier is a table of (word, position, node, edits) states that is joined with the edges
level by level: a state without edits stands on its word's own path and takes an edge that differs by one
letter, or skips a letter of its word; a state with one edit must match to the end. Terminal states with one
edit are the neighbours; a longer word finds the shorter one, and the pair counts both ways.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girderframe.llm.common import LETTERS, Query, column_of, runs_of, small_batches, table, text_parts
from girderframe.session import stored, stored_if_any

#: Code points and occurrences that a word has at least.
LEAST_LETTERS, LEAST_USES = 6, 5
#: A form is this many times as common as its variant, at least.
FORM_RATIO = 5
#: One of so many occurrences loses a letter (fixed value of the contract).
SLIP = 199
#: Text bytes that are counted together, and bytes of words that a task holds before it hands its counts on.
COUNTED_BYTES, HELD_BYTES = 2 << 20, 32 << 20

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _with_slips(rows: np.ndarray, runs: pa.StringArray, ids: list[str]) -> pa.Table:
    """(word, n) of runs (row, run), where a run loses a letter if the checksum of ``<id>:<run>`` says so."""
    coded = runs.dictionary_encode()
    k = max(1, len(coded.dictionary))
    seen, times = np.unique(rows * k + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    doc, run = seen // k, seen % k
    text = [x.as_buffer().to_pybytes() for x in coded.dictionary]
    size = np.array([len(x) for x in text], np.int64)
    # crc32(a + b) is crc32(len(b) zero bytes from crc32(a) on), xor b's remainder from an empty register.
    rest = np.array([zlib.crc32(x, 0xFFFFFFFF) ^ 0xFFFFFFFF for x in text], np.int64)
    wide = int(size.max(initial=0)) + 1
    heads, at = np.unique(doc * wide + size[run], return_inverse=True)
    crc = np.array([zlib.crc32(bytes(h % wide), zlib.crc32(ids[h // wide].encode() + b":")) for h in heads.tolist()], np.int64)
    value = crc[at] ^ rest[run] if len(seen) else np.zeros(0, np.int64)
    slips = np.flatnonzero(value % SLIP == 0)
    kept = np.ones(len(seen), bool)
    kept[slips] = False
    changed = []
    for i in slips.tolist():
        word = text[run[i]].decode()
        gone = int(value[i]) % len(word)
        changed.append(word[:gone] + word[gone + 1 :])
    n = np.bincount(run[kept], weights=times[kept], minlength=len(text)).astype(np.int64)
    whole = pa.table([coded.dictionary, pa.array(n)], schema=_COUNTS).filter(pa.array(n > 0))
    return pa.concat_tables([whole, pa.table([pa.array(changed, pa.string()), pa.array(times[slips].astype(np.int64))], schema=_COUNTS)])


def word_counts(documents: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n) of all words of at least ``least_letters`` code points in ``documents`` (doc_id, text)."""

    def summed(held: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select(_COUNTS.names)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        held: list[pa.Table] = []
        size = merged = 0
        for batch in parts:
            ids = ["" if x is None else str(x) for x in batch.column(batch.schema.get_field_index("doc_id")).to_pylist()]
            found: list[tuple[np.ndarray, pa.Array]] = []
            for first, _, data, offsets, more in text_parts(column_of(batch, "text"), COUNTED_BYTES):
                # The letters from U+00C0 to U+00FF are the byte C3 and one more.
                latin = data == 0xC3
                inside = (LETTERS[data] & (data < 0x80)) | latin | np.append(False, latin[:-1])
                rows, runs = runs_of(data, offsets, inside)
                counts = _with_slips(rows + first, runs, ids)
                counts = counts.filter(pc.greater_equal(pc.utf8_length(counts["word"]), least_letters))
                held.append(counts)
                size += counts.nbytes
            if size - merged > HELD_BYTES // 2:
                held = [summed(held)]
                size = merged = held[0].nbytes
                if size > HELD_BYTES:
                    yield from held[0].combine_chunks().to_batches(max_chunksize=50_000)
                    held, size, merged = [], 0, 0
        if held:
            yield from summed(held).combine_chunks().to_batches(max_chunksize=50_000)

    return documents.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _both_ways(words: DataFrame) -> DataFrame:
    """(side, text, half): every word and its reversal, and the position from which edits of it begin."""
    size = F.length("word")
    return words.select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("word").alias("text"), F.floor(size / 2).cast("int").alias("half")),
                F.struct(F.lit(1).alias("side"), F.reverse("word").alias("text"), (size - F.floor(size / 2)).cast("int").alias("half")),
            )
        ).alias("t")
    ).select("t.*")


def _letters(text: Column, at: Column, count: Column | None = None) -> Column:
    """The letters of a text from position ``at`` (from 0) on."""
    return F.substring(text, at + 1, F.length(text) if count is None else count)


def trie_paths(words: DataFrame) -> DataFrame:
    """(side, node, text, position, letter): the second half of each word's path; the letter at a word's end is empty."""
    text, position = F.col("text"), F.col("position")
    steps = _both_ways(words).select("side", "text", F.explode(F.sequence(F.col("half"), F.length("text"))).alias("position"))
    return steps.select("side", F.xxhash64("side", F.substring(text, F.lit(1), position)).alias("node"), "text", "position", _letters(text, position, F.lit(1)).alias("letter"))


def trie_edges(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The paths' rows at branching nodes, and the edges (side, node, letter, label, child, target).

    A label holds the letters up to the next branching node ``child``, or up to the end of the word ``target``.
    """
    # A node has no more letters than the alphabet.
    split = paths.groupBy("side", "node").agg(F.count_distinct("letter").alias("letters")).filter("letters > 1").select("side", "node")
    forks = stored(paths.join(split, ["side", "node"]), "forks")
    along = Window.partitionBy("side", "text").orderBy("position")
    forks_on = forks.withColumns({"next_node": F.lead("node").over(along), "next_position": F.lead("position").over(along)})
    label = F.when(F.col("next_node").isNull(), _letters(F.col("text"), F.col("position"))).otherwise(_letters(F.col("text"), F.col("position"), F.col("next_position") - F.col("position")))
    edges = forks_on.select("side", "node", "letter", label.alias("label"), F.col("next_node").alias("child"), F.when(F.col("next_node").isNull(), F.col("text")).alias("target"))
    return forks, stored(edges.groupBy("side", "node", "letter").agg(*[F.min(c).alias(c) for c in ("label", "child", "target")]), "edges")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): every two different words of ``words`` that one inserted, deleted or replaced letter tells apart, both ways."""
    forks, edges = trie_edges(stored(trie_paths(words), "paths"))
    edge = edges.withColumnRenamed("letter", "other")
    rest = _letters(F.col("text"), F.col("position") + 1)
    replaced = rest.startswith(_letters(F.col("label"), F.lit(1))) & (F.col("other") != "")
    skipped = rest.startswith(F.col("label"))
    states = forks.filter("letter <> ''").join(edge, ["side", "node"]).filter("other <> letter").filter(replaced | skipped)
    # A replaced letter uses up one of the word's letters like the label's first; a skipped one comes on top.
    moves = F.array_compact(
        F.array(
            F.when(replaced, F.col("position") + F.length("label")),
            F.when(skipped, F.col("position") + 1 + F.length("label")),
        )
    )
    frontier = states.select("side", "text", F.explode(moves).alias("position"), F.col("child").alias("node"), "target")
    frontier = stored_if_any(frontier, "frontier")
    found = None
    while frontier is not None:
        ended = frontier.filter("target IS NOT NULL AND position = length(text)").select("side", "text", "target")
        found = ended if found is None else found.unionByName(ended)
        after = _letters(F.col("text"), F.col("position"), F.lit(1))
        going = frontier.filter("node IS NOT NULL").drop("target").withColumn("letter", after)
        onward = going.join(edges.withColumnRenamed("child", "next"), ["side", "node", "letter"])
        onward = onward.filter(_letters(F.col("text"), F.col("position")).startswith(F.col("label")))
        frontier = stored_if_any(onward.select("side", "text", (F.col("position") + F.length("label")).alias("position"), F.col("next").alias("node"), "target"), "frontier")
    if found is None:
        return words.select("word", F.col("word").alias("near")).limit(0)
    forward = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c))
    pairs = found.select(forward("text").alias("word"), forward("target").alias("near"))
    # Hashes of prefixes may meet by chance, so every pair is looked at once more.
    pairs = pairs.filter(F.levenshtein("word", "near") == 1)
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def spelling_groups(documents: DataFrame, least_letters: int = LEAST_LETTERS, least_uses: int = LEAST_USES, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the texts of ``documents``.

    ``form`` is the most common near word, ties by code points, if it is ``ratio`` times as common; ``root`` is
    where the forms lead to. Null and empty texts have no words; a null doc_id counts as empty text. Repeated rows
    count each. Very long texts are counted in parts. An empty table gives no rows. Other columns do not matter.
    """
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", "text")
    words = stored(word_counts(rows, least_letters).filter(F.col("n") >= least_uses), "words")
    near = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    is_form = F.col("best.near_n") >= ratio * F.col("n")
    linked = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("best.near_n")).alias("form_n")
    )
    linked = stored(linked, "forms")
    # Every step to a form multiplies the occurrences, so the chains are short; each round doubles their reach.
    roots = linked.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    links = roots
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        stepped = links.join(further, "root", "left")
        moved = stored_if_any(stepped.filter("beyond IS NOT NULL").select("word", F.col("beyond").alias("root")), "roots")
        if moved is None:
            break
        links = stored(moved.unionByName(links.join(moved, "word", "left_anti")), "roots")
    return linked.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
r AS (SELECT doc_id, translate(raw,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text,''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS raw FROM documents) GROUP BY ALL),
b AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR,'') || ':' || run)) AS x FROM r),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x)//2), lambda i: ('0x' || substr(x, 2*i+1, 2))::BIGINT)),
  lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM b, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
words AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, length(word) AS size, substr(word, 1, i) || substr(word, i + 2) AS key FROM (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.key = b.key AND a.word <> b.word
  WHERE (a.size = b.size AND a.i = b.i) OR (a.i = a.size AND b.size = a.size + 1) OR (b.i = b.size AND a.size = b.size + 1)),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word),
f AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5*words.n THEN other END AS form, CASE WHEN m >= 5*words.n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
"""
SQL = "WITH RECURSIVE " + SQL.strip().removeprefix("WITH ") + r"""
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
root AS (SELECT chain.word, chain.root FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)
"""

QUERIES: dict[str, Query] = {"op13_spelling_variants": Query(lambda spark, folder: spelling_groups(table(spark, folder, "documents")), SQL)}
