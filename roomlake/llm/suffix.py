"""Exact repeated-passage removal with a Burrows-Wheeler transform and interval expansion.

A byte of a document goes if a LENGTH-byte string that covers it also starts in a document with a
smaller id.  Only strings that two documents share matter, and they are found in three steps:

1. Anchors.  Every LENGTH-byte window holds LENGTH - GRAM + 1 GRAM-byte strings; the one of the
   smallest hash is its anchor.  Equal windows have equal anchors at equal places, so windows whose
   anchor only one document has cannot repeat.  About one byte in sixteen is an anchor.  Anchors that
   two documents of a small sample hold are shared for certain: at most HOT of them, the most frequent,
   are broadcast, and so never meet in one task.
2. Contexts.  Around each anchor that two documents share, the bytes of all windows that hold it.
   Equal contexts are one from here on, with their smallest document.  An anchor with one context is
   settled: all its windows start first in that document.
3. Blocks.  Contexts are dealt by anchor into blocks of bounded size; anchors with very many
   contexts are dealt by whole windows instead.  In each block the contexts' transform is expanded
   breadth first: the interval of a string w becomes those of all c w.  An interval that ends at a
   place without a common-prefix value gives it one, so values come out in increasing order, and
   expansion stops at LENGTH.  Suffixes with no smaller value between them share LENGTH bytes; the
   smallest document of each such run is where the string starts first.

Texts that are copies of a smaller document's go as a whole (if they have LENGTH bytes at least) and
take no part in the search.  Null and empty texts have no bytes.  Texts are whole, of any length;
matches never cross documents.  Rows without an id lose nothing and take nothing from others; rows that
share an id are one document's and each keeps its own result.  An empty table gives no rows.  Columns
to carry along may have any names.  Python workers get rows in Arrow batches and work on pieces of
bounded size of them; the only groups that meet in one task are blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import U64, give_back, lean, mix, prefix, spans_hash, text_rows
from .minhash import BROADCAST_IDS
from .store import Store

LENGTH = 50
GRAM = 20
WINDOW = LENGTH - GRAM + 1  # anchors of a window
HOT = 50_000  # anchors that are broadcast, at most
HOT_DOCS = 20_000  # documents that are looked at for them, about
BLOCK_BYTES = 1 << 20  # of contexts in a block, about
MANY = 8192  # contexts of one anchor; more are dealt by whole windows
END = 255  # a byte that no UTF-8 text holds


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` neighbours: out[i] = op(x[i : i + width])."""
    span = 1
    while span * 2 <= width:
        x = op(x[: len(x) - span], x[span:])
        span *= 2
    return op(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of the rows of a buffer."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    start = np.arange(n - GRAM + 1)
    h = spans_hash(prefix(raw), start, start + GRAM) | U64(1)
    least = _slide(h, WINDOW, np.minimum)  # of the window that starts here
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    least[np.arange(len(least)) + LENGTH > room] = 0
    pad = np.zeros(WINDOW - 1, U64)
    most = _slide(np.concatenate([pad, least, pad]), WINDOW, np.maximum)
    at = np.flatnonzero(h == most)
    return at, h[at]


def _known(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted array ``known``."""
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def _anchor_rows(hot):
    """The distinct anchors of each document, but those that are known to be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = hot.value if hot is not None else np.zeros(0, U64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, offsets, raw in text_rows(batch):
                at, h = anchors(raw, offsets)
                row = np.searchsorted(offsets, at, side="right") - 1
                if len(skip):
                    new = ~_known(h, skip)
                    h, row = h[new], row[new]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(ids[i:j][row[new]])], names=["h", "id"])

    return lean(run)


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in ``flat`` and end at ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _slices(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    size = hi - lo
    ends = np.cumsum(size)
    return _binary(raw[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(lo - (ends - size), size)], ends)


def _contexts(hot):
    """Every shared anchor of (id, text, its document's shared anchors), with its context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, offsets, raw in text_rows(batch):
                # an anchor that any document shares is shared in every document that holds it
                own = batch.column(2).slice(i, j - i).flatten().to_numpy().view(U64)
                known = np.unique(np.concatenate([own, hot.value])) if hot is not None else np.unique(own)
                at, h = anchors(raw, offsets)
                keep = _known(h, known)
                at, h = at[keep], h[keep]
                if not len(at):
                    continue
                row = np.searchsorted(offsets, at, side="right") - 1
                lo = np.maximum(offsets[row], at - (LENGTH - GRAM))
                hi = np.minimum(offsets[row + 1], at + LENGTH)
                k1 = spans_hash(prefix(raw), lo, hi)
                k2 = mix(k1 ^ mix(spans_hash(prefix(raw[::-1]), len(raw) - hi, len(raw) - lo)) + (at - lo).astype(U64))
                flat = (h.view(np.int64), k1.view(np.int64), k2.view(np.int64), ids[i:j][row], lo - offsets[row], at - lo)
                yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int64)) for v in flat), _slices(raw, lo, hi)], names=["h", "k1", "k2", "id", "pos", "left", "text"])

    return lean(run)


_OCCURRENCES = "h long, k1 long, k2 long, id long, pos long, left long, text binary"


def suffix_order(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes by their first 64 bytes; ties in any order."""
    n = len(data)
    padded = np.concatenate([data, np.full(8, END, np.uint8)])
    key = np.zeros(n, U64)
    for i in range(8):
        key = key << U64(8) | padded[i : n + i].astype(U64)
    order = np.argsort(key)
    span = 8
    while True:
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if span >= 64 or new.all():
            break
        after = np.full(n, n, np.int64)
        after[: n - span] = rank[span:]
        key = (rank.astype(U64) << U64(32)) | after.astype(U64)
        order = np.argsort(key)
        span *= 2
    rank[order] = np.arange(n)
    return order, rank


def runs_of_repeats(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): suffixes in order, and where runs that share ``length`` bytes start.

    Breadth-first backward extension of intervals on the transform; a place between two suffixes gets
    its common-prefix value from the first interval that ends there.
    """
    n = len(data)
    order, rank = suffix_order(data)
    before = data[order - 1]  # the transform
    back = rank[order - 1]  # where the suffix one byte longer stands
    ends = np.zeros(n + 1, bool)  # places that have a value below ``length``
    ends[n] = True
    first = data[order]
    cut = np.flatnonzero(np.append(first[1:] != first[:-1], True)) + 1
    lo, hi = np.concatenate([[0], cut[:-1]]), cut
    ends[hi] = True
    real = first[lo] != END
    lo, hi = lo[real], hi[real]
    for _ in range(length - 1):
        if not len(lo):
            break
        width = hi - lo
        owner = np.repeat(np.arange(len(lo)), width)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width) + lo[owner]
        byte = before[at]
        keep = byte != END
        owner, at, byte = owner[keep], at[keep], byte[keep]
        if not len(at):
            break
        by = np.argsort(owner * 256 + byte)
        label = (owner * 256 + byte)[by]
        new = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
        low = np.minimum.reduceat(back[at[by]], new)
        high = low + np.diff(np.append(new, len(label)))
        fresh = ~ends[high]
        low, high = low[fresh], high[fresh]
        high, once = np.unique(high, return_index=True)
        ends[high] = True
        lo, hi = low[once], high
    starts = np.flatnonzero(np.concatenate([[True], ends[1:n]]))
    return order, starts


def first_documents(texts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each window of each context the smallest document of the contexts that hold it."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(bytes([END]).join(texts) + bytes([END]) * 64, np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    order, starts = runs_of_repeats(data)
    owner = np.full(len(data), -1)
    owner[: int(sizes.sum() + len(texts))] = np.repeat(np.arange(len(texts)), sizes + 1)
    inside = (owner >= 0) & (np.arange(len(data)) + LENGTH <= np.append(begin + sizes, 0)[owner])
    value = np.where(inside, np.append(docs, 0)[owner], np.iinfo(np.int64).max)
    least = np.minimum.reduceat(value[order], starts)
    per = np.empty(len(data), np.int64)
    per[order] = np.repeat(least, np.diff(np.append(starts, len(data))))
    return [per[b : b + s - LENGTH + 1] for b, s in zip(begin.tolist(), sizes.tolist())]


def _longest_match(groups: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """For each row of padded bytes the longest prefix that another row of its group has too."""
    width = sides.shape[1]
    order = np.lexsort((np.ascontiguousarray(sides).view(f"S{width}").ravel(), groups))
    rows, own = sides[order], groups[order]
    same = (rows[1:] == rows[:-1]) & (rows[1:] != END)
    run = np.where(same.all(axis=1), width, same.argmin(axis=1)) * (own[1:] == own[:-1])
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(np.append(run, 0), np.concatenate([[0], run]))
    return out


def shareable(h: np.ndarray, left: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(from, to): the part of each context that another one of its anchor may share.

    It ends where the longest matches to the left and to the right of the anchor do.
    """
    side = LENGTH - GRAM
    ahead = np.frombuffer(b"".join(t[i + GRAM :].ljust(side, bytes([END])) for t, i in zip(texts, left.tolist())), np.uint8).reshape(-1, side)
    behind = np.frombuffer(b"".join(t[:i][::-1].ljust(side, bytes([END])) for t, i in zip(texts, left.tolist())), np.uint8).reshape(-1, side)
    return left - _longest_match(h, behind), left + GRAM + _longest_match(h, ahead)


def _block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """First documents of the windows of contexts; contexts that share no window give no row."""
    texts, lo = table.column("text").to_pylist(), table.column("lo").to_numpy()
    a, b = shareable(table.column("h").to_numpy(), table.column("left").to_numpy(), texts)
    may = np.flatnonzero(b - a >= LENGTH)
    parts = first_documents([texts[i][a[i] : b[i]] for i in may.tolist()], lo[may]) if len(may) else []
    out = []
    for i, part in zip(may.tolist(), parts):
        first = np.full(len(texts[i]) - LENGTH + 1, lo[i])
        first[a[i] : a[i] + len(part)] = part
        out.append(first.tobytes())
    take = pa.array(may)
    give_back()
    return pa.table({"k1": table.column("k1").take(take), "k2": table.column("k2").take(take), "first": pa.array(out, pa.binary())})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of every context, by two hashes."""
    for batch in batches:
        for s in range(0, batch.num_rows, 2048):
            part = batch.slice(s, 2048)
            text = part.column(3).to_pylist()
            sizes = np.fromiter(map(len, text), np.int64, len(text))
            raw = np.frombuffer(b"".join(text), np.uint8)
            begin = np.cumsum(sizes) - sizes
            count = sizes - LENGTH + 1
            owner = np.repeat(np.arange(len(text)), count)
            off = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            at = begin[owner] + off
            w1 = spans_hash(prefix(raw), at, at + LENGTH)
            w2 = spans_hash(prefix(raw[::-1].copy()), len(raw) - at - LENGTH, len(raw) - at)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(off.astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], names=["k1", "k2", "lo", "off", "w1", "w2"])


def _by_windows(contexts: DataFrame) -> DataFrame:
    """(k1, k2, first) of contexts of anchors with very many contexts, without collecting them."""
    w = contexts.select("k1", "k2", "lo", "text").mapInArrow(lean(_windows), "k1 long, k2 long, lo long, off int, w1 long, w2 long")
    least = w.groupBy("w1", "w2").agg(F.min("lo").alias("least"))
    seen = w.join(least, ["w1", "w2"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("off", "least"))).alias("f"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.asarray(x, np.int64).tobytes() for x in b.column(2).to_pylist()], pa.binary())], names=["k1", "k2", "first"])

    return seen.select("k1", "k2", F.col("f.least").alias("f")).mapInArrow(lean(pack), "k1 long, k2 long, first binary")


def _spans_of(mask: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)


def _covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n bytes the intervals cover."""
    return np.cumsum(np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1])[:n] > 0


def _mask(ids: np.ndarray, offsets: np.ndarray, copy: np.ndarray, hits: pa.ListArray) -> np.ndarray:
    """Which bytes of the rows go, by their copies' marks and their occurrences."""
    n = int(offsets[-1])
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(hits), 0).to_numpy())
    found = hits.flatten()
    pos, length, lo = (found.field(c).to_numpy() for c in ("pos", "size", "lo"))
    base = offsets[:-1][row] + pos
    firsts = found.field("first")
    plain = firsts.is_null().to_numpy(zero_copy_only=False)
    use = plain & (lo < ids[row])
    start, end = [base[use], offsets[:-1][copy & (size >= LENGTH)]], [base[use] + length[use], offsets[1:][copy & (size >= LENGTH)]]
    some = np.flatnonzero(~plain)
    if len(some):
        values = np.frombuffer(b"".join(firsts.drop_null().to_pylist()), np.int64)
        count = length[some] - LENGTH + 1
        owner = np.repeat(some, count)
        off = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        goes = values < ids[row[owner]]
        start.append((base[owner] + off)[goes])
        end.append((base[owner] + off)[goes] + LENGTH)
    return _covered(np.concatenate(start), np.concatenate(end), n)


def _whole_characters(raw: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mask of the characters all of whose bytes are masked."""
    if not len(raw):
        return mask
    first = (raw & 0xC0) != 0x80
    first[0] = True
    return np.logical_and.reduceat(mask, np.flatnonzero(first))[np.cumsum(first) - 1]


def _row_spans(mask: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """Of each row its masked runs: start, end, start, end, ..."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], mask[:-1]]) if len(mask) else mask
    after = np.concatenate([mask[1:], [False]]) if len(mask) else mask
    start = np.flatnonzero(mask & (~before | edge[: len(mask)]))
    end = np.flatnonzero(mask & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    flat = np.stack([start - offsets[row], end - offsets[row]], axis=1).ravel()
    cuts = 2 * np.searchsorted(row, np.arange(len(offsets)))
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.astype(np.int64)))


def _cut(names: list[str], characters: bool):
    """(_id, text, _copy, _hits, carried columns) as the carried columns and what is left of the text.

    That is bytes, their former number and the removed spans, or with ``characters`` the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, offsets, raw in text_rows(batch):
                part = batch.slice(i, j - i)
                ids = part.column(0).fill_null(0).to_numpy()
                mask = _mask(ids, offsets, part.column(2).to_numpy(zero_copy_only=False), part.column(3))
                if characters:
                    mask = _whole_characters(raw, mask)
                kept = _binary(raw[~mask], np.concatenate([[0], np.cumsum(~mask)])[offsets[1:]])
                if characters:
                    text = pc.if_else(part.column(1).is_null(), pa.scalar(None, pa.string()), kept.cast(pa.string()))
                    out = [text]
                else:
                    out = [pa.array(np.diff(offsets)), kept, _row_spans(mask, offsets)]
                yield pa.RecordBatch.from_arrays([*part.columns[4:], *out], names=names)

    return lean(run)


def _anchored(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """(_id, text, _copy, _hits, _carried0, ...) per row: what decides which bytes of it go."""
    spark = docs.sparkSession
    store = Store(spark, "suffix")
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_carried{i}") for i, c in enumerate(carry)))
    texts = every.filter("id is not null and text is not null").select("id", "text")
    keys = store.put(texts.select("id", F.md5(F.col("text").cast("binary")).alias("md5"), F.xxhash64("text").alias("x")), "keys")
    n = keys.count()
    firsts = keys.groupBy("md5", "x").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    # a copy is known by its id and text: another text of the same id is none
    copies = store.put(keys.join(firsts, ["md5", "x"]).filter("id <> least").select("id", "x").distinct(), "copies")
    small = copies.count() <= BROADCAST_IDS
    copies = F.broadcast(copies) if small else copies
    own = texts.withColumn("x", F.xxhash64("text")).join(copies, ["id", "x"], "left_anti").select("id", "text")

    found = "h long, id long"
    looked = own.filter(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, HOT_DOCS / max(n, 1)))))
    often = looked.mapInArrow(_anchor_rows(None), found).groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
    hot = spark.sparkContext.broadcast(np.sort(often.orderBy(F.desc("n"), "h").limit(HOT).select("h").toArrow().column("h").to_numpy().view(U64)))
    by_anchor = Window.partitionBy("h")
    met = own.mapInArrow(_anchor_rows(hot), found).withColumn("least", F.min("id").over(by_anchor)).withColumn("most", F.max("id").over(by_anchor))
    shared = store.put(met.filter("least < most").select("h", "id"), "shared").groupBy("id").agg(F.collect_list("h").alias("known"))
    read = own.join(shared, "id", "left").select("id", "text", F.coalesce("known", F.array().cast("array<long>")).alias("known"))
    occurrences = store.put(read.mapInArrow(_contexts(hot), _OCCURRENCES), "occurrences")

    contexts = occurrences.filter(F.octet_length("text") >= LENGTH).groupBy("h", "k1", "k2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.first("left").alias("left"), F.first("text").alias("text"))
    contexts = store.put(contexts, "contexts")
    number = contexts.groupBy("h").agg(F.count("*").alias("contexts"), F.min("lo").alias("l"), F.max("hi").alias("m")).filter("contexts > 1 and l < m").select("h", "contexts")
    several = store.put(contexts.join(number, "h"), "several")
    some = several.filter(F.col("contexts") <= MANY)
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = some.withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int")).select("block", "h", "k1", "k2", "lo", "left", "text")
    settled = dealt.groupBy("block").applyInArrow(_block, "k1 long, k2 long, first binary")
    if several.filter(F.col("contexts") > MANY).limit(1).count():
        settled = settled.union(_by_windows(several.filter(F.col("contexts") > MANY)))
    settled = store.put(settled, "settled")

    # an occurrence matters unless its context is settled and first in its own document
    known = contexts.select("k1", "k2", "lo").join(settled, ["k1", "k2"], "left")
    hits = occurrences.select("id", "pos", "k1", "k2", F.octet_length("text").alias("size")).join(known, ["k1", "k2"]).filter("first is not null or lo < id")
    hits = store.put(hits.select("id", "pos", "size", "lo", "first"), "hits")
    store.drop("keys", "shared", "occurrences", "contexts", "several", "settled")
    hits = hits.groupBy("id").agg(F.collect_list(F.struct("pos", F.col("size").cast("long").alias("size"), "lo", "first")).alias("_hits"))
    copies = copies.withColumn("_copy", F.lit(True))
    marked = every.withColumn("x", F.xxhash64("text")).join(copies, ["id", "x"], "left").drop("x").join(hits, "id", "left")
    return marked.select(F.col("id").alias("_id"), "text", F.coalesce("_copy", F.lit(False)).alias("_copy"), "_hits", *(f"_carried{i}" for i in range(len(carry))))


def _schema(docs: DataFrame, carry: tuple[str, ...], more: str) -> tuple[list[str], str]:
    fields = [f"_carried{i}" for i in range(len(carry))]
    kinds = ", ".join(f"{f} {docs.schema[c].dataType.simpleString()}" for f, c in zip(fields, carry))
    return fields, f"{kinds}, {more}" if carry else more


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, kept binary, spans array<long>) per row: spans is start, end, start, end, ..."""
    fields, schema = _schema(docs, (id_col,), "n_bytes long, kept binary, spans array<long>")
    rows = _anchored(docs, id_col, text_col, (id_col,)).mapInArrow(_cut([*fields, "n_bytes", "kept", "spans"], False), schema)
    return rows.select(F.col(fields[0]).cast("long").alias(id_col), "n_bytes", "kept", "spans")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all of its rows and columns, with what is left of the texts.

    A character goes when all of its bytes do.  Null texts stay null.
    """
    carry = tuple(c for c in docs.columns if c != text_col)
    fields, schema = _schema(docs, carry, "_left string")
    rows = _anchored(docs, id_col, text_col, carry).mapInArrow(_cut([*fields, "_left"], True), schema)
    name = dict(zip(carry, fields)) | {text_col: "_left"}
    return rows.select(*(F.col(name[c]).alias(c) for c in docs.columns))


def digest(rows: DataFrame) -> DataFrame:
    """n_removed, n_spans and kept_sha256 of the rows of ``repeated_spans``."""
    return rows.select("*", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """The same result for a few documents, window by window: for tests."""
    first: dict[bytes, int] = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - LENGTH + 1):
            w = raw[i : i + LENGTH]
            first[w] = min(first.get(w, doc), doc)
    out = {}
    for doc, text in rows:
        raw = (text or "").encode()
        mask = np.zeros(len(raw), bool)
        for i in range(len(raw) - LENGTH + 1):
            if first[raw[i : i + LENGTH]] < doc:
                mask[i : i + LENGTH] = True
        kept = bytes(b for b, m in zip(raw, mask) if not m)
        out[doc] = (len(raw), int(mask.sum()), len(_spans_of(mask)), hashlib.sha256(kept).hexdigest())
    return out
