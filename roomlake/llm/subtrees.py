"""Removal of repeated word sequences by prefix-partitioned suffix trees.

A word of a document goes if a window of LENGTH words that covers it also starts in a document with a
smaller id.  A window is the first LENGTH words of a suffix; two suffixes that share them meet in an
internal node of that depth of the corpus' suffix tree.  The tree is never built whole:

1. Anchors.  Of every SPAN words the GRAM-word string of the smallest hash is an anchor.  Equal spans have
   equal anchors, so a window one of whose spans has an anchor that a single document holds cannot
   repeat elsewhere; only suffixes whose spans' anchors are all shared go on.
2. Prefixes.  A suffix is LENGTH / GRAM symbols, each the hash of GRAM words; below that depth nothing is
   asked.  Suffixes are split by their first symbol, groups of over GROUP suffixes by two symbols, and so
   on: variable-length prefixes whose groups fit in memory.  Small groups share blocks.
3. Subtrees.  In each block the subtrees grow breadth first, level by level; a node with suffixes of one
   document only is a leaf.  Internal nodes of the full depth are the repeats; in those every suffix but
   the smallest document's starts a window that goes.
   A prefix that is still too frequent at the full depth is such a node already: the smallest document
   comes from an aggregation and meets the suffixes in a join, so no task holds them together.
4. The windows that go meet their documents, and the words they cover are cut.

Texts that are copies of a smaller document's go as a whole (if they have LENGTH words) and take no part in
the search.  Words are told by 64-bit mixes of their bytes, windows by LENGTH / GRAM such hashes.

Null, empty and blank texts have no words.  Texts are whole, of any length; windows never cross
documents.  Rows without an id lose nothing and take nothing from others; rows that share an id are one
document's, and each keeps its own result.  An empty table gives no rows; other columns are left out
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U64, give_back, lean, mix, text_rows, word_hashes, word_spans
from .store import Store

LENGTH = 50
GRAM = 10
DEPTH = LENGTH // GRAM  # symbols of a window
SPAN = 30  # words; each has an anchor
GROUP = 100_000  # suffixes of a prefix that one task takes
BROADCAST = 200_000  # rows of a small table
SYMBOLS = [f"s{i}" for i in range(DEPTH)]
_SUFFIXES = "id long, pos int, " + ", ".join(f"{s} long" for s in SYMBOLS)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of two neighbours in order."""
    return mix(mix(a + U64(0x9E3779B97F4A7C15)) ^ b)


def grams(words: np.ndarray) -> np.ndarray:
    """Hashes of GRAM = 8 + 2 words from each word on."""
    two = _joined(words[:-1], words[1:])
    four = _joined(two[:-2], two[2:])
    eight = _joined(four[:-4], four[4:])
    return _joined(eight[: len(words) - GRAM + 1], two[8:])


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` neighbours: out[i] = op(x[i : i + width])."""
    span = 1
    while span * 2 <= width:
        x = op(x[: len(x) - span], x[span:])
        span *= 2
    return op(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def _looked_at(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grams, anchors of the spans, spans' flags, rows) by word; spans that leave their row are not whole."""
    start, end, row = word_spans(raw, offsets)
    if len(start) < SPAN:
        z = np.zeros(0, U64)
        return z, z, np.zeros(0, bool), row
    h = grams(word_hashes(raw, start, end))
    least = _slide(h, SPAN - GRAM + 1, np.minimum)
    return h, least, row[: len(least)] == row[SPAN - 1 :], row


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct anchors of each document."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for i, j, offsets, raw in text_rows(batch):
            _, least, whole, row = _looked_at(raw, offsets)
            h, r = least[whole], row[: len(least)][whole]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            h, r = h[new], r[new]
            order = np.lexsort((h, r))
            h, r = h[order], r[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(ids[i:j][r[new]])], names=["h", "id"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, its shared anchors) as the suffixes that may repeat, by symbols."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for i, j, offsets, raw in text_rows(batch):
            known = np.unique(batch.column(2).slice(i, j - i).flatten().to_numpy().view(U64))
            h, least, whole, row = _looked_at(raw, offsets)
            if not len(known) or len(row) < LENGTH:
                continue
            met = whole & (known[np.minimum(np.searchsorted(known, least), len(known) - 1)] == least)
            at = np.flatnonzero(_slide(met, LENGTH - SPAN + 1, np.logical_and) & (row[: len(row) - LENGTH + 1] == row[LENGTH - 1 :]))
            first = np.searchsorted(row, np.arange(j - i))  # of each row's words
            symbols = [pa.array(h[at + GRAM * d].view(np.int64)) for d in range(DEPTH)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][row[at]]), pa.array((at - first[row[at]]).astype(np.int32)), *symbols], names=["id", "pos", *SYMBOLS])


def repeats(symbols: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, smallest ids): of the suffixes in internal nodes of full depth the smallest id there.

    Nodes grow breadth first; of each level those with suffixes of one document only are dropped.
    """
    at, node, least = np.arange(len(ids)), np.zeros(len(ids), np.int64), ids
    for s in symbols:
        order = np.lexsort((s[at], node))
        at, node = at[order], node[order]
        if not len(at):
            break
        new = np.ones(len(at), bool)
        new[1:] = (node[1:] != node[:-1]) | (s[at[1:]] != s[at[:-1]])
        starts = np.flatnonzero(new)
        low, high = np.minimum.reduceat(ids[at], starts), np.maximum.reduceat(ids[at], starts)
        node = np.cumsum(new) - 1
        inner = (low < high)[node]
        at, node, least = at[inner], node[inner], low[node[inner]]
    return at, least


def _block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The suffixes of a block's subtrees that start a window of a smaller document."""
    ids = table.column("id").to_numpy()
    at, least = repeats([table.column(s).to_numpy() for s in SYMBOLS], ids)
    goes = pa.array(at[least < ids[at]])
    out = table.select(["id", "pos"]).take(goes)
    give_back()
    return out


def _small(df: DataFrame) -> DataFrame:
    """With a hint to broadcast where the table's size allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def windows_that_go(suffixes: DataFrame, store: Store) -> DataFrame:
    """(id, pos) of the windows that start in a document of a smaller id as well."""
    blocks = max(1, -(-suffixes.count() // GROUP))
    prefix = lambda d: F.xxhash64(*SYMBOLS[:d])
    left, dealt = suffixes, None
    for d in range(1, DEPTH + 1):
        # prefixes of d symbols that one task cannot take
        heavy = store.put(left.groupBy(prefix(d).alias("p")).agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("p"), f"heavy{d}")
        none = not heavy.limit(1).count()
        keyed = left.withColumn("p", prefix(d))
        own = keyed if none else keyed.join(_small(heavy), "p", "left_anti")
        own = own.select("id", "pos", *SYMBOLS, F.pmod(F.xxhash64("p", F.lit(d)), F.lit(blocks)).cast("int").alias("block"))
        dealt = own if dealt is None else dealt.union(own)
        if none:
            left = None
            break
        left = store.put(keyed.join(_small(heavy), "p", "left_semi").drop("p"), f"left{d}")
    found = dealt.groupBy("block").applyInArrow(_block, "id long, pos int")
    if left is not None:  # nodes of full depth
        least = left.groupBy(*SYMBOLS).agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
        found = found.union(left.join(least, SYMBOLS).filter("id > least").select("id", "pos"))
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, copy, windows) as (id, n_words, n_removed, kept)."""
    for batch in batches:
        for i, j, offsets, raw in text_rows(batch):
            part = batch.slice(i, j - i)
            start, end, row = word_spans(raw, offsets)
            n = np.bincount(row, minlength=j - i)
            first = np.cumsum(n) - n
            hits = part.column(3)
            of = np.repeat(np.arange(j - i), pc.fill_null(pc.list_value_length(hits), 0).to_numpy())
            at = first[of] + hits.flatten().to_numpy()
            whole = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False) & (n >= LENGTH))
            low, high = np.concatenate([at, first[whole]]), np.concatenate([at + LENGTH, (first + n)[whole]])
            deep = np.cumsum(np.bincount(low, minlength=len(row) + 1) - np.bincount(high, minlength=len(row) + 1))[: len(row)]
            stay = deep == 0
            start, end, row = start[stay], end[stay], row[stay]
            kept = np.bincount(row, minlength=j - i)
            size = end - start + 1  # a space after each word
            cuts = np.cumsum(size)
            text = np.append(raw, np.uint8(32))[np.arange(int(cuts[-1]) if len(cuts) else 0) + np.repeat(start - (cuts - size), size)]
            text[cuts - 1] = 32
            last = np.cumsum(kept)[kept > 0] - 1
            text = np.delete(text, cuts[last] - 1)  # none after the last
            sizes = np.bincount(row, weights=size, minlength=j - i).astype(np.int64) - (kept > 0)
            out = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(np.ascontiguousarray(text))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(n - kept), out.cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])


def without_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept) per row: kept are the words that stay, joined by one space."""
    spark = docs.sparkSession
    store = Store(spark, "subtrees")
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = every.filter("id is not null and text is not null")
    keys = store.put(texts.select("id", F.md5(F.col("text").cast("binary")).alias("md5"), F.xxhash64("text").alias("x")), "keys")
    firsts = keys.groupBy("md5", "x").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    copies = store.put(keys.join(firsts, ["md5", "x"]).filter("id <> least").select("id", "x").distinct(), "copies")
    copies = _small(copies)
    own = texts.withColumn("x", F.xxhash64("text")).join(copies, ["id", "x"], "left_anti").select("id", "text")

    held = store.put(own.mapInArrow(lean(_anchors), "h long, id long"), "anchors")
    shared = held.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("h")
    shared = store.put(held.join(shared, "h").select("h", "id"), "shared")
    store.drop("keys", "anchors")
    known = shared.groupBy("id").agg(F.collect_list("h").alias("known"))
    suffixes = store.put(own.join(known, "id").select("id", "text", "known").mapInArrow(lean(_suffixes), _SUFFIXES), "suffixes")
    hits = store.put(windows_that_go(suffixes, store), "windows")
    store.drop("shared", "suffixes", *(f"left{d}" for d in range(1, DEPTH + 1)))
    hits = hits.groupBy("id").agg(F.collect_list("pos").alias("hits"))
    marked = every.withColumn("x", F.xxhash64("text")).join(copies.withColumn("copy", F.lit(True)), ["id", "x"], "left").join(hits, "id", "left")
    rows = marked.select("id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "hits")
    return rows.mapInArrow(lean(_cut), "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """The same result for a few documents, window by window: for tests."""
    words = [(doc, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc, text in rows]
    first: dict[tuple, int] = {}
    for doc, w in words:
        for i in range(len(w) - LENGTH + 1):
            key = tuple(w[i : i + LENGTH])
            first[key] = min(first.get(key, doc), doc)
    out = {}
    for doc, w in words:
        gone: set[int] = set()
        for i in range(len(w) - LENGTH + 1):
            if first[tuple(w[i : i + LENGTH])] < doc:
                gone |= set(range(i, i + LENGTH))
        out[doc] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


CUT_SQL = r"""with doc as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
word as (select r, doc_id, len(w) as n, unnest(w) as word, unnest(range(1, len(w) + 1)) as i, w from doc),
win as (select r, doc_id, i, case when i + 49 <= n then array_to_string(w[i:i + 49], ' ') end as s from word),
first as (select s, min(doc_id) as least from win where s is not null group by s),
flag as (select w.r, w.i, coalesce(f.least < w.doc_id, false) as goes from win w left join first f on w.s = f.s),
gone as (select r, i, max(goes) over (partition by r order by i rows between 49 preceding and current row) as gone from flag),
kept as (select word.r, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by word.i) filter (where not gone) as kept from word join gone on word.r = gone.r and word.i = gone.i group by word.r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from doc d left join kept k on d.r = k.r"""
