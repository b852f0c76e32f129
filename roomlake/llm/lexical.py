"""Ranked lexical search as a blocked sparse matrix product.

Scores are the product of two sparse matrices: items x terms (how often an item has a term) and terms x
documents (int64 impacts).  Both are cut into blocks:

1. Items are dealt into blocks of about ITEM_TERMS entries.  A block's terms and entries are all that is
   broadcast, so its size does not grow with the number of items or documents.
2. For each block one pass over the texts counts the block's terms in every document; the counts are
   written once.  Sums over them give the number of documents N, of terms L, and every term's df.
3. Blocks of documents are multiplied row by row (Gustavson): an item's row of the product is the sum of
   the rows of its terms, merged in a dense accumulator of the block's documents.
4. Of each row of a block only what can be among the first k stays; a task keeps k an item, and the
   tasks' rows meet in a window with a limit, which Spark applies before the shuffle as well.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased.
Null and empty texts have no terms: such documents do not count in N and are never found, such items
find nothing.  Repeated rows are documents (or items) of their own.  Equal scores go by ascending id;
documents without an id come last among them.  Texts are whole, of any length; empty tables give no
rows; other columns are left out whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import LOWER, lean, text_rows, word_spans
from .store import Store

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = np.ones(256, bool)
GAP[[*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *UPPER.encode(), *range(128, 256)]] = False
ITEM_TERMS = 200_000  # entries of a block of items, about
DOC_BLOCK = 4096  # documents of a block
_COUNTS = "doc_id long, n long, terms array<int>, tfs array<int>"


def term_rows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, times): the entries of the items' matrix; ``item`` tells rows apart."""
    terms = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, UPPER.lower()), F.lit(PATTERN), F.lit(0))
    keyed = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), terms.alias("terms"))
    rows = keyed.select("item", "item_id", F.explode("terms").alias("term"))  # the key of a row, not of a term
    return rows.groupBy("item", "item_id", "term").agg(F.count("*").alias("times"))


def _counts(vocabulary):
    """(id, text) as (doc_id, n, terms, tfs): all terms' number, and those of the vocabulary with theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for i, j, offsets, raw in text_rows(batch, "text"):
                low = LOWER[raw]
                start, end, row = word_spans(low, offsets, GAP)
                ends = np.cumsum(end - start)
                cuts = np.concatenate([[0], ends]).astype(np.int32)
                tokens = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(low[~GAP[low]])])
                at = pc.fill_null(pc.index_in(tokens, value_set=known), -1).to_numpy()
                key, tf = np.unique((row * len(known) + at)[at >= 0], return_counts=True)
                of = np.searchsorted(key, np.arange(j - i + 1) * max(len(known), 1)).astype(np.int32)
                n = np.bincount(row, minlength=j - i)
                lists = [pa.ListArray.from_arrays(of, pa.array(v.astype(np.int32))) for v in (key % max(len(known), 1), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])

    return lean(run)


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 8 m)) with m = 25 + (75 n docs) div length, in 64-bit integers."""
    if len(n) and 75 * int(n.max()) * docs >= 1 << 63:
        m = np.array([25 + 75 * int(x) * docs // length for x in n.tolist()], np.int64)
    else:
        m = 25 + 75 * n * docs // length
    return w * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def _first(k: int, score: np.ndarray, lone: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the first k by descending score, those with an id first, ascending id."""
    if len(score) > k:
        may = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        may = np.arange(len(score))
    return may[np.lexsort((doc[may], lone[may], -score[may]))[:k]]


def _product(block, docs: int, length: int, k: int):
    """Rows of counts as (item, doc_id, score): the first k of each item in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, term, times, weight = block.value
        none = np.zeros(0, np.int64)
        best = [(none, none.astype(bool), none)] * (len(begin) - 1)
        for batch in batches:
            for s in range(0, batch.num_rows, DOC_BLOCK):
                part = batch.slice(s, DOC_BLOCK)
                ids, lone = part.column(0).fill_null(0).to_numpy(), part.column(0).is_null().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy())
                t, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                impact = impacts(weight[t], tf, part.column(1).to_numpy()[row], docs, length)
                by = np.argsort(t, kind="stable")
                row, impact = row[by], impact[by]
                at = np.searchsorted(t[by], np.arange(len(weight) + 1))
                low, high = at[term].tolist(), at[term + 1].tolist()
                total = np.empty(part.num_rows, np.int64)
                for i, (lo, hi) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
                    total[:] = 0
                    for e in range(lo, hi):  # the rows of the item's terms, merged
                        a, b = low[e], high[e]
                        if a < b:
                            total[row[a:b]] += times[e] * impact[a:b]
                    had = best[i]
                    found = np.flatnonzero(total >= (max(1, int(had[0][-1])) if len(had[0]) == k else 1))
                    if len(found):
                        both = tuple(map(np.concatenate, zip(had, (total[found], lone[found], ids[found]))))
                        keep = _first(k, *both)
                        best[i] = tuple(x[keep] for x in both)
        score, lone, doc = (np.concatenate([b[c] for b in best]) if best else none for c in range(3))
        item = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=lone.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"])

    return lean(run)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    store = Store(spark, "lexical")
    entries = store.put(term_rows(items, item_col, item_text_col), "entries")
    blocks = max(1, -(-entries.count() // ITEM_TERMS))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pick = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = None
    for b in range(blocks):
        own = entries.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item").toArrow().combine_chunks()
        terms = own.column("term").combine_chunks().dictionary_encode()
        item, first = np.unique(own.column("item").to_numpy(), return_index=True)
        names = own.column("item_id").take(pa.array(first)).to_pylist()
        vocabulary = spark.sparkContext.broadcast(terms.dictionary)
        counts = store.put(texts.mapInArrow(_counts(vocabulary), _COUNTS), f"counts{b}")
        n, length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms.dictionary), np.int64)
        met = counts.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        df[met.column("term").to_numpy()] = met.column("count").to_numpy()
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        block = spark.sparkContext.broadcast((np.append(first, len(own)), terms.indices.to_numpy().astype(np.int64), own.column("times").to_numpy(), weight))
        found = counts.mapInArrow(_product(block, n, max(length, 1), k), "item long, doc_id long, score long")
        top = found.withColumn("rank", F.row_number().over(pick)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(names))), "item_id": pa.array(names, pa.int64())})) if names else spark.createDataFrame([], "item long, item_id long")
        top = store.put(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), f"top{b}")
        store.drop(f"counts{b}")
        ranked = top if ranked is None else ranked.union(top)
    return ranked


SEARCH_SQL = f"""with doc as (select row_number() over () as r, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{PATTERN}')) as term from documents),
post as (select r, doc_id, term, count(*) as tf from doc group by all),
len as (select r, count(*) as n from doc group by r),
total as (select count(*) as docs, cast(sum(n) as bigint) as length from len),
weight as (select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1))) as bigint) as w from post, total group by term, docs),
item as (select item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{PATTERN}')) as term from benchmark),
entry as (select item_id, term, count(*) as times from item group by all),
scored as (select e.item_id, p.r, p.doc_id, cast(sum(e.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * l.n * t.docs) // t.length)))) as bigint) as score
    from entry e join post p on e.term = p.term join weight w on w.term = e.term join len l on l.r = p.r cross join total t group by e.item_id, p.r, p.doc_id)
select item_id, cast(rank as int) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) x where rank <= 10"""
