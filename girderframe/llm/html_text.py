"""Main text of web pages: markup roles, and repeats found by a suffix array over each host's pages.

A page is cut into blocks. Blocks in menus, headers, footers, sidebars, notices, adverts, forms, scripts
and comments are known by their markup and go. What lies in an ``article`` or ``main`` element is the
article and stays as it is, also where pages repeat it. On pages without such an element the markup says
too little, and there the other blocks are held against the host: the token streams of a host's blocks
outside articles form a suffix array, runs of tokens that occur on several pages are boilerplate, blocks
covered by them are removed, and unique runs are kept.

The suffix array is dealt out by the first tokens of each suffix, since only suffixes that begin alike can
share a long run. Equal blocks of a host are one row with the range of their pages.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderframe.llm.common import Query, small_batches, table
from girderframe.llm.url_filter import host_and_path
from girderframe.session import stored

#: Tokens of a run that counts as repeated, and share of a block's tokens that such runs must cover.
LEAST_TOKENS, COVERED = 4, 0.8
#: Suffixes of one bucket that are sorted together; a bucket holds suffixes with equal first tokens.
SUFFIXES = 50_000

# Elements by their part in a page.
SILENT = frozenset("script style noscript template textarea svg iframe select head title object canvas audio video math".split())
DROPPED = frozenset("nav footer aside form button menu dialog".split())
BLOCKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre section article main header footer nav aside "
    "figure figcaption form fieldset address details summary hr body html center hgroup search menu dialog".split()
)
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs topbar sidebar "
    "footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login search comment comments disqus respond "
    "replies share sharing social related recommended widget pagination pager toolbar".split()
)

COMMENT_MARKS = frozenset("comment comments respond replies ad ads advert advertisement sponsored promo related".split())
NEGATIONS = frozenset("no not has with without free".split())

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:\-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")


def _is_dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if "=" in attributes and tag not in ("body", "html", "main"):
        marks = COMMENT_MARKS if tag == "article" else MARKS
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values)
            if name.lower() == "role" and value.lower() in ROLES:
                return True
            if name.lower() in ("class", "id") and any(_is_mark(word, marks) for word in value.split()):
                return True
    return False


def _is_mark(word: str, marks: frozenset[str]) -> bool:
    """Whether a class or id begins or ends with one of the marks, as in ``ad-box`` or ``leftSidebar`` but not ``ad-free`` or ``no-sidebar``."""
    parts = [p for p in re.split(r"[^a-z0-9]+", _CAMEL.sub("-", word).lower()) if p]
    return bool(parts) and (parts[0] in marks or parts[-1] in marks) and NEGATIONS.isdisjoint(parts)


def page_blocks(source: str) -> tuple[bool, list[tuple[bool, str]]]:
    """Whether the page has an article or main element, and (inside it, text) of its blocks in order, without what markup drops."""
    stack: list[tuple[str, bool, bool]] = []  # element, dropped, article; each as it holds inside
    blocks: list[tuple[bool, str]] = []
    held: list[str] = []
    has_article, at, end = False, 0, len(source)

    def close_block() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                blocks.append((bool(stack) and stack[-1][2], text))

    def pop_to(tag: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return

    while at < end:
        found = _TOKEN.search(source, at)
        upto = found.start() if found else end
        if upto > at and not (stack and stack[-1][1]):
            held.append(source[at:upto])
        if not found:
            break
        at = found.end() if found.end() > found.start() else found.start() + 1
        closing, tag, attributes = found[1], (found[2] or "").lower(), found[3] or ""
        if not tag:
            continue
        if tag in BLOCKS:
            close_block()
        elif tag == "br":
            held.append(" ")
        if closing:
            pop_to(tag)
            continue
        dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if tag in ("body", "article", "main") and any(s[0] == "head" for s in stack):
            pop_to("head")
            dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in SILENT and tag != "head":
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if tag in BLOCKS and stack and stack[-1][0] == "p":
            stack.pop()
            dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        drop = dropped or tag == "head" or _is_dropped(tag, attributes, article)
        article = article or tag in ("article", "main")
        has_article = has_article or (article and not drop)
        if tag in BLOCKS or tag == "head" or drop != dropped:
            if drop and not dropped:
                close_block()
            stack.append((tag, drop, article and not drop))
    close_block()
    return has_article, blocks


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def has_main(source: Column) -> Column:
    return F.coalesce(source.rlike(r"(?i)<(?:article|main)[\s>/]"), F.lit(False))


def _outside_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, host, at, block, mark): blocks outside articles, their place on the page, and a hash of them."""

    def cut(parts):
        for batch in parts:
            out = []
            for page, host, source in zip(*(batch.column(k).to_pylist() for k in range(3))):
                out += [(page, host, k, text, _hash(text)) for k, (inside, text) in enumerate(page_blocks(source or "")[1]) if not inside]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["page_id", "host", "at", "block", "mark"])

    return pages.select("page_id", "host", "html").mapInArrow(cut, "page_id long, host string, at int, block string, mark long")


def repeated_runs(suffixes: list[tuple[tuple[str, ...], int, int]], least: int) -> list[int]:
    """For each suffix (tokens, first page, last page) the longest run at its start that another page has, or 0.

    The suffixes are sorted; common prefix lengths of neighbours are scanned with a stack of intervals that
    know the range of pages of their suffixes.
    """
    order = sorted(range(len(suffixes)), key=lambda k: suffixes[k][0])
    best = [0] * len(suffixes)
    common = []
    for a, b in zip(order, order[1:]):
        n = 0
        for x, y in zip(suffixes[a][0], suffixes[b][0]):
            if x != y:
                break
            n += 1
        common.append(n)
    for k, o in enumerate(order):
        if suffixes[o][1] != suffixes[o][2]:
            best[o] = len(suffixes[o][0])
    stack: list[list[int]] = []  # length, first place, smallest page, largest page
    for k in range(1, len(order) + 1):
        length = common[k - 1] if k < len(order) else 0
        low, high = suffixes[order[k - 1]][1:]
        begin = k - 1
        while stack and stack[-1][0] > length:
            size, first, lo, hi = stack.pop()
            lo, hi = min(lo, low), max(hi, high)
            if lo < hi and size >= least:
                for p in range(first, k):
                    best[order[p]] = max(best[order[p]], size)
            begin, low, high = first, lo, hi
        if length >= least:
            if stack and stack[-1][0] == length:
                stack[-1][2], stack[-1][3] = min(stack[-1][2], low), max(stack[-1][3], high)
            else:
                stack.append([length, begin, low, high])
    return [b if b >= least else 0 for b in best]


def boilerplate(outside: DataFrame, least: int = LEAST_TOKENS) -> DataFrame:
    """(host, mark): blocks outside articles that runs of tokens from other pages of the host cover.

    ``mark`` is a hash of the block. A block shorter than ``least`` tokens is boilerplate if another page has
    the same block.
    """
    blocks = outside.groupBy("host", "block", "mark").agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"))
    blocks = stored(blocks, "blocks")

    def deal(parts):
        for batch in parts:
            out = []
            for host, block, mark, low, high in zip(*(batch.column(k).to_pylist() for k in range(5))):
                tokens = block.split()
                for k in range(max(1, len(tokens) - least + 1)):
                    out.append((_hash(f"{host}\n" + " ".join(tokens[k : k + least])), host, mark, k, len(tokens), " ".join(tokens[k:]), low, high))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["key", "host", "mark", "at", "size", "suffix", "low", "high"])

    suffixes = blocks.mapInArrow(deal, "key long, host string, mark long, at int, size int, suffix string, low long, high long")

    def scan(parts):
        held: list[tuple] = []

        def flush():
            runs = repeated_runs([(tuple(x[5].split(" ")), x[6], x[7]) for x in held], 1 if least < 1 else min(least, min(len(x[5].split(" ")) for x in held)))
            out = [(x[1], x[2], x[3], x[4], n) for x, n in zip(held, runs) if n]
            held.clear()
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["host", "mark", "at", "size", "run"])

        for batch in parts:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8))):
                # A bucket is a key; a very large one is scanned in sorted stretches that overlap in their border suffix.
                if held and held[-1][0] != row[0]:
                    yield flush()
                elif len(held) >= SUFFIXES:
                    last = held[-1]
                    yield flush()
                    held.append(last)
                held.append(row)
        if held:
            yield flush()

    spread = suffixes.repartition("key", "host").sortWithinPartitions("key", "host", "suffix")
    runs = spread.mapInArrow(scan, "host string, mark long, at int, size int, run int")
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("run") - 1)))))
    return runs.groupBy("host", "mark").agg(covered.alias("covered"), F.max("size").alias("size")).filter(F.col("covered") >= F.lit(COVERED) * F.col("size")).select("host", "mark")


def _texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of (page_id, url, html, gone): ``gone`` are places of blocks to leave out."""

    def extract(parts):
        for batch in parts:
            texts = []
            for source, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                has_article, blocks = page_blocks(source or "")
                gone = set(gone or ())
                texts.append("\n\n".join(text for k, (inside, text) in enumerate(blocks) if (inside if has_article else k not in gone)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html", "gone").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Blocks of the article, character references decoded and white space made one space, joined by empty
    lines in page order. Null and empty html, and pages without an article, give an empty text. A page
    without article or main element gives its blocks that are neither dropped by markup nor repeated on
    other pages of the host. Rows that repeat a page_id count as one page and come out as often.
    """
    small_batches(pages.sparkSession, 500)
    host, _ = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    no_gone = F.lit(None).cast("array<int>")
    marked = has_main(F.col("html"))
    outside = _outside_blocks(rows)
    known = stored(boilerplate(outside.filter("page_id IS NOT NULL")), "boilerplate")
    plain = rows.filter(~marked)
    at_plain = _outside_blocks(plain).select("page_id", "host", "at", "mark")
    gone = at_plain.join(known, ["host", "mark"]).groupBy("page_id").agg(F.collect_set("at").alias("gone"))
    with_article = rows.filter(marked).withColumn("gone", no_gone)
    without = plain.join(gone, "page_id", "left").select(*rows.columns, "gone")
    return _texts(with_article.unionByName(without))


QUERIES = {"op5_html_text": Query(lambda spark, folder: main_text(table(spark, folder, "pages")))}
