"""Cross-tokenizer alignment as relations: token rows, cumulative lengths, equi-joins on ends.

Two tokenizers cut the same bytes differently.  Where tokens of both end, the bytes are cut into groups;
tokens of a group are linked.  Neither tokenizer merges across a space that follows a character that is no
white space, so texts are cut there into spans first, equal spans are aligned once, and documents put
their spans' groups together:

1. Documents are dealt into chunks of at most about SPANS different spans and become lists of numbers of their
   chunk's dictionary.
2. The different spans of all chunks are encoded by both tokenizers (the only use of the libraries).
3. Tokens become rows (posexplode), ends are windowed cumulative lengths, cuts an equi-join of both
   tokenizers' rows on span and end.  The running number of a cut in its span is the group; the places of
   its two tokens and of the cut before bound the ranges of tokens that are linked.
4. Each chunk gets its dictionary's groups, adds them up by document and counts the documents of each
   linked pair of ids; the counts of all chunks are summed.
5. Links meet the counts and are added up by span, and these sums by document.

A vocabulary with pieces that go on after such a space, or another way of cutting words, makes every text one
span; all else is the same.  A document counts once for a pair of ids,
however often it holds it.

Null and empty texts have no tokens, and so have texts that a tokenizer does not give back byte by byte:
their numbers are 0 and their groups ''.  Texts are whole, of any length.  Every row gives one row, and
counts as a document of its own; rows without an id keep none.  Empty tables give no rows; other
columns are left out whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytesops import buffers, give_back, lean, text_rows
from .store import Store

SPANS = 250_000  # different spans of a chunk, about
PIECE = 1 << 21  # bytes of texts that are cut at once
BLOCK = 200_000  # occurrences of spans that are added up at once, about
ROUNDS = 4  # parts of the chunks that are added up one after another: what is shuffled at once is a part
BROADCAST = 500_000  # pairs of ids with their counts
META = "▁"  # stands for a space in pieces
_ROWS = "chunk long, row int, doc_id long, spans array<int>, at int, words array<string>"
_TOKENS = "sid long, a array<int>, a_size array<int>, b array<int>, b_size array<int>"
_ADDED = "chunk long, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, link long, n long"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def encoders(a_path: str, b_path: str):
    """(encode a, bytes of a's ids, encode b, bytes of b's ids); spans begin with a space, which b adds itself."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=b_path)
    level = byte_level()
    a_bytes = [bytes(level[c] for c in t) if t and all(c in level for c in t) else None for t in map(a.id_to_token, range(a.get_vocab_size()))]
    pieces = [b.id_to_piece(i) for i in range(b.vocab_size())]
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(META, " ").encode() for i, p in enumerate(pieces)]
    return (
        lambda texts: [e.ids for e in a.encode_batch(texts, add_special_tokens=False)],
        a_bytes,
        lambda texts: b.encode([t[1:] for t in texts], num_threads=1),
        b_bytes,
    )


def cuts_at_spaces(a_path: str, b_path: str) -> bool:
    """Whether neither tokenizer has tokens that go on after a space behind other characters."""
    with open(a_path, encoding="utf-8") as f:
        a = json.load(f)
    words = a.get("normalizer") is None and (a.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and a["pre_tokenizer"].get("use_regex", True)
    from sentencepiece import SentencePieceProcessor

    b = SentencePieceProcessor(model_file=b_path)
    return bool(words) and not any(re.search(f"[^{META}]{META}", b.id_to_piece(i)) for i in range(b.vocab_size()))


def span_starts(raw: np.ndarray, offsets: np.ndarray, at_spaces: bool) -> np.ndarray:
    """Where the spans of non-empty rows start: at rows, and at spaces behind what is surely no white space."""
    rows = offsets[:-1][np.diff(offsets) > 0]
    if not at_spaces:
        return rows
    last = np.zeros(len(raw) + 1, bool)
    last[offsets] = True
    i = np.flatnonzero((raw == 32) & ~last[1:])  # a lone space at the end is no span: b would add none to nothing
    i = i[i > 0]
    back = [raw[np.maximum(i - k, 0)] for k in range(1, 5)]
    rest = [(x & 0xC0) == 0x80 for x in back]
    ascii_ = (back[0] > 32) & (back[0] < 127)
    two = rest[0] & (back[1] >= 0xC3) & (back[1] < 0xE0)
    three = rest[0] & rest[1] & ((back[2] == 0xE0) | (back[2] >= 0xE4) & (back[2] < 0xF0))
    four = rest[0] & rest[1] & rest[2] & (back[3] >= 0xF0)
    starts = np.zeros(len(raw), bool)
    starts[i[ascii_ | two | three | four]] = True
    starts[rows] = True
    return np.flatnonzero(starts)


def _encoded(at_spaces: bool):
    """(doc_id, text with a space before it) as documents in numbers of spans, and the chunks' dictionaries."""
    none = {"row": pa.int32(), "doc_id": pa.int64(), "spans": pa.list_(pa.int32()), "at": pa.int32(), "words": pa.list_(pa.string())}

    def rows(chunk: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), *(columns.get(c, pa.nulls(n, kind)) for c, kind in none.items())], names=["chunk", *none])

    def dictionary(chunk: int, words: list[str]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            yield rows(chunk, 1, at=pa.array([i], pa.int32()), words=pa.array([part], pa.list_(pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, row, known = TaskContext.get().partitionId() << 32, 0, {}
        for batch in batches:
            for i, j, offsets, raw in text_rows(batch, limit=PIECE):
                start = span_starts(raw, offsets, at_spaces)
                cuts = np.append(start, len(raw)).astype(np.int32)
                words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).dictionary_encode()
                number = np.array([known.setdefault(w, len(known)) for w in words.dictionary.to_pylist()], np.int32)
                flat = number[words.indices.to_numpy()] if len(start) else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, offsets).astype(np.int32)), pa.array(flat))
                yield rows(chunk, j - i, row=pa.array(np.arange(row, row + j - i, dtype=np.int32)), doc_id=batch.column(0).slice(i, j - i), spans=lists)
                row += j - i
                if len(known) >= SPANS:
                    yield from dictionary(chunk, list(known))
                    chunk, row, known = chunk + 1, 0, {}
        yield from dictionary(chunk, list(known))

    return lean(run)


def _cut_run(ids: list[int], known: list[bytes | None], size: np.ndarray, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(ids, sizes, tokens up to each end) of encoded spans that lie one after another; None if they are not cut there."""
    flat = np.array(ids, np.int32)
    sizes = size[flat]
    to = np.cumsum(sizes)
    last = np.minimum(np.searchsorted(to, ends), max(len(to) - 1, 0))
    if not len(to) or not np.array_equal(to[last], ends) or b"".join([known[i] or b"" for i in ids]) != raw:
        return None
    return flat, sizes.astype(np.int32), np.concatenate([[0], last + 1]).astype(np.int32)


def _tokens(a_path: str, b_path: str, at_spaces: bool):
    """(sid, span) as both tokenizers' ids and sizes; null lists where the bytes differ.

    Spans that end in what is surely no white space are encoded as one text, which is cut at them again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, a_bytes, encode_b, b_bytes = encoders(a_path, b_path)
        sides = [(encode, known, np.array([len(x or b"") for x in known])) for encode, known in ((encode_a, a_bytes), (encode_b, b_bytes))]

        def together(sid: pa.Array, raw: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
            text = raw.tobytes()
            found = [_cut_run(encode([text.decode()])[0], known, size, text, ends) for encode, known, size in sides]
            if None in found:
                return None
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for flat, sizes, at in found for v in (flat, sizes)]
            return pa.RecordBatch.from_arrays([sid, *lists], names=["sid", "a", "a_size", "b", "b_size"])

        def alone(sid: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
            none = [pa.nulls(1, pa.list_(pa.int32()))] * 4
            for i, text in enumerate(texts.to_pylist()):
                raw = np.frombuffer(text.encode(), np.uint8)
                yield together(sid.slice(i, 1), raw, np.array([len(raw)])) or pa.RecordBatch.from_arrays([sid.slice(i, 1), *none], names=["sid", "a", "a_size", "b", "b_size"])

        for batch in batches:
            for s in range(0, batch.num_rows, 8192):
                part = batch.slice(s, 8192)
                offsets, raw = buffers(part.column(1))
                follows = np.append(raw, np.frombuffer(b" x", np.uint8))
                starts = np.zeros(len(follows), bool)
                starts[span_starts(follows, np.array([0, len(follows)]), True)] = True
                clean = pa.array(starts[offsets[1:]] & at_spaces)
                sid, texts = (part.column(c).filter(clean) for c in (0, 1))
                if len(sid):
                    offsets, raw = buffers(texts)
                    if (found := together(sid, raw, offsets[1:])) is not None:
                        yield found
                    else:
                        yield from alone(sid, texts)
                yield from alone(*(part.column(c).filter(pc.invert(clean)) for c in (0, 1)))

    return lean(run)


@contextmanager
def _by_span(spark: SparkSession):
    """Rows that lie together by span are neither shuffled to be joined by span and end nor sorted to be collected."""
    want = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.useObjectHashAggregateExec": "false"}
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def token_rows(spans: DataFrame, side: str) -> DataFrame:
    """(sid, pos, end): every token of one side, with the bytes up to its end."""
    order = Window.partitionBy("sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = spans.select("sid", F.posexplode(f"{side}_size").alias("pos", "size"))
    return rows.select("sid", "pos", F.sum("size").over(order).alias("end"))


def groups(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sid, grp, a_last, b_last): the running number of each cut, and the places of the tokens that end there.

    The group's tokens are those behind the cut before, up to these.
    """
    cuts = a.withColumnRenamed("pos", "a_last").join(b.withColumnRenamed("pos", "b_last"), ["sid", "end"])
    return cuts.select("sid", F.row_number().over(Window.partitionBy("sid").orderBy("end")).alias("grp"), "a_last", "b_last")


def linked_spans(spans: DataFrame) -> DataFrame:
    """(sid, groups) of spans (sid, a, a_size, b, b_size).

    groups is the number of groups, the last places of their a and b tokens, and all ids of a and b.
    """
    spans = spans.filter("a is not null").repartition("sid").sortWithinPartitions("sid")
    found = groups(token_rows(spans, "a"), token_rows(spans, "b"))
    by_span = found.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("grp", "a_last", "b_last"))).alias("g"))
    return spans.join(by_span, "sid").selectExpr("sid", "concat(array(size(g)), g.a_last, g.b_last, a, b) as groups")


class _Groups:
    """The groups of an array of spans; null spans have none."""

    def __init__(self, spans: pa.Array):
        at = spans.offsets.to_numpy().astype(np.int64)
        flat = spans.values.to_numpy(zero_copy_only=False)
        self.n = n = len(spans)
        start, full = at[:-1], np.diff(at) > 0
        self.n_groups = np.zeros(n, np.int64)
        self.n_groups[full] = flat[start[full]]
        self.owner = np.repeat(np.arange(n), self.n_groups)  # the span of each group
        begin = np.cumsum(self.n_groups) - self.n_groups
        first = np.zeros(len(self.owner), bool)
        first[begin[full]] = True

        def sizes(of: np.ndarray) -> np.ndarray:
            last = flat[_ranges(of, self.n_groups)].astype(np.int64)
            before = np.concatenate([[-1], last[:-1]]) if len(last) else last
            return last - np.where(first, -1, before)

        self.in_a, self.in_b = sizes(start + 1), sizes(start + 1 + self.n_groups)
        by_span = lambda w: np.bincount(self.owner, weights=w, minlength=n).astype(np.int64)
        self.n_a, self.n_b, self.n_links = by_span(self.in_a), by_span(self.in_b), by_span(self.in_a * self.in_b)
        ids = start + 1 + 2 * self.n_groups
        self.a = flat[_ranges(ids, self.n_a)].astype(np.int64)
        self.b = flat[_ranges(ids + self.n_a, self.n_b)].astype(np.int64)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(a * 2^32 + b of all pairs of linked tokens, their spans)."""
        of = np.repeat(np.arange(len(self.owner)), self.in_a)  # the group of each token of a
        each = self.in_b[of]
        first = (np.cumsum(self.in_b) - self.in_b)[of]
        return np.repeat(self.a, each) << 32 | self.b[_ranges(first, each)], np.repeat(self.owner[of], each)

    def text(self) -> pa.Array:
        """`a1,a2|b1;` for each group of a span."""
        side = lambda ids, sizes: pc.binary_join(_listed(pa.array(ids).cast(pa.string()), sizes), ",")
        one = pc.binary_join_element_wise(side(self.a, self.in_a), side(self.b, self.in_b), "|")
        return pc.binary_join(_listed(pc.binary_join_element_wise(one, "", ";"), self.n_groups), "")


def _listed(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, groups) as (sid, link), a row for each pair of linked tokens."""
    for batch in batches:
        links, owner = _Groups(batch.column(1)).links()
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(links)], names=["sid", "link"])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of all ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _doc_blocks(docs: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(documents, document of each occurrence, spans) for bounded numbers of occurrences."""
    sizes = pc.fill_null(pc.list_value_length(docs.column("spans")), 0).to_numpy()
    ends = np.cumsum(sizes)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK, side="right")))
        part = docs.slice(i, j - i)
        yield part, np.repeat(np.arange(j - i), sizes[i:j]), pc.list_flatten(part.column("spans")).to_numpy()
        i = j


def _added(digest: bool):
    """A chunk's documents with their groups and numbers, then the documents of each linked pair."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, words: pa.Table) -> pa.Table:
        order = np.argsort(words.column("at").to_numpy())
        code = words.column("groups").combine_chunks().take(pa.array(order))
        bad = code.is_null().to_numpy(zero_copy_only=False)
        found = _Groups(code)
        text, sums = found.text(), (found.n_a, found.n_b, found.n_groups, found.n_links)
        links, owner = found.links()
        del code, found
        pair, link = np.unique(links, return_inverse=True)
        cut = np.searchsorted(owner, np.arange(len(text) + 1))
        n = np.zeros(len(pair), np.int64)
        done: dict[str, list] = {c: [] for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")}
        for part, doc, at in _doc_blocks(docs):
            rows = part.num_rows
            zero = np.bincount(doc[bad[at]], minlength=rows) > 0
            doc, at = doc[~zero[doc]], at[~zero[doc]]
            for c, s in zip(("n_a", "n_b", "n_groups", "n_links"), sums):
                done[c].append(np.bincount(doc, weights=s[at], minlength=rows).astype(np.int64))
            seen = np.unique(doc * len(text) + at)
            of, word = seen // max(len(text), 1), seen % max(len(text), 1)
            size = cut[word + 1] - cut[word]
            held = np.unique(np.repeat(of, size) * len(pair) + link[_ranges(cut[word], size)])
            n += np.bincount(held % max(len(pair), 1), minlength=len(pair))
            joined = text.take(pa.array(at)).cast(pa.large_string())
            ends = np.frombuffer(joined.buffers()[1], np.int64, len(at) + 1)
            raw = joined.buffers()[2].to_pybytes() if len(at) and joined.buffers()[2] else b""
            to = np.cumsum(np.bincount(doc, minlength=rows))
            lo, hi = ends[np.concatenate([[0], to[:-1]])].tolist(), ends[to].tolist()
            whole = [raw[x : y - 1] for x, y in zip(lo, hi)]
            done["groups"] += [(hashlib.sha256(w).hexdigest() if digest else w.decode()) if w else "" for w in whole]
            done["row"].append(part.column("row").to_numpy())
            done["doc_id"] += part.column("doc_id").to_pylist()
        rows, some = docs.num_rows, int((n > 0).sum())
        number = lambda c: np.concatenate(done[c]) if done[c] else np.zeros(0, np.int64)
        out = {
            "chunk": pa.array(np.full(rows + some, key[0].as_py())),
            "row": pa.array([*number("row").tolist(), *[None] * some], pa.int32()),
            "doc_id": pa.array(done["doc_id"] + [None] * some, pa.int64()),
            **{c: pa.concat_arrays([pa.array(number(c)), pa.nulls(some, pa.int64())]) for c in ("n_a", "n_b", "n_groups", "n_links")},
            "groups": pa.array(done["groups"] + [None] * some, pa.string()),
            "link": pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(pair[n > 0])]),
            "n": pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(n[n > 0])]),
        }
        give_back()
        return pa.table(out)

    return run


def _summed(key: tuple[pa.Scalar, ...], docs: pa.Table, words: pa.Table) -> pa.Table:
    """A chunk's documents with the sums of their spans; those with spans that have none get none."""
    order = np.argsort(words.column("at").to_numpy())
    sums = [pc.fill_null(words.column(c), 0).to_numpy()[order] for c in ("n_best", "count_sum")]
    bad = words.column("count_sum").is_null().to_numpy()[order]
    row, out = [], ([], [])
    for part, doc, at in _doc_blocks(docs):
        zero = np.bincount(doc[bad[at]], minlength=part.num_rows) > 0
        row.append(part.column("row").to_numpy())
        for found, s in zip(out, sums):
            total = np.zeros(part.num_rows, np.int64)
            np.add.at(total, doc, s[at])
            found.append(np.where(zero, 0, total))
    whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    give_back()
    return pa.table({"chunk": np.full(docs.num_rows, key[0].as_py()), "row": pa.array(whole(row), pa.int32()), "n_best": whole(out[0]), "count_sum": whole(out[1])})


def aligned(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per row.

    groups is `a1,a2|b1;a3|b2,b3` with the ids in order, or with ``digest`` its SHA-256 in hex.
    """
    spark = docs.sparkSession
    store = Store(spark, "alignment")
    at_spaces = cuts_at_spaces(a_path, b_path)
    spaced = F.when(F.col(text_col) != "", F.concat(F.lit(" "), F.col(text_col)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), spaced.alias("text"))
    rows = store.put(texts.mapInArrow(_encoded(at_spaces), _ROWS), "rows")
    numbered = rows.filter("row is not null").select("chunk", "row", "doc_id", "spans")
    entries = rows.filter("words is not null").select("chunk", "at", F.posexplode("words").alias("i", "span"))
    entries = entries.select("chunk", (F.col("at") + F.col("i")).alias("at"), "span")
    different = store.put(entries.select("span").distinct().select(F.monotonically_increasing_id().alias("sid"), "span"), "different")
    words = store.put(entries.join(different, "span").select("sid", "chunk", "at"), "words")
    spans = store.put(different.mapInArrow(_tokens(a_path, b_path, at_spaces), _TOKENS), "spans")
    store.drop("different")
    with _by_span(spark):
        linked = store.put(linked_spans(spans), "linked")
    store.drop("spans")
    def by_chunk(of: DataFrame, columns: tuple[str, ...], run, schema: str, name: str) -> DataFrame:
        """``run`` on each chunk's documents and its words with what their spans have, a part of the chunks after another."""
        done = None
        for i in range(ROUNDS):
            docs_of, words_of = (t.filter(F.pmod(F.xxhash64("chunk"), F.lit(ROUNDS)) == i) for t in (numbered, words))
            found = words_of.join(of, "sid", "left").select("chunk", "at", *columns)
            part = store.put(docs_of.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, schema), f"{name}{i}")
            done = part if done is None else done.union(part)
        return done

    added = by_chunk(linked, ("groups",), _added(digest), _ADDED, "added")
    counts = added.filter("link is not null").groupBy("link").agg(F.sum("n").alias("n"))
    counts = store.put(counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("link", 32)))), "counts")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST else counts
    sums = linked.mapInArrow(lean(_link_rows), "sid long, link long").join(counts, "link").groupBy("sid").agg(F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))
    sums = store.put(sums, "sums")
    store.drop("linked", "counts")
    best = by_chunk(sums, ("n_best", "count_sum"), _summed, "chunk long, row int, n_best long, count_sum long", "best")
    store.drop("rows", "words", "sums")
    out = added.filter("row is not null").join(best, ["chunk", "row"])
    return out.select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def brute_force(rows: list[tuple[int, str | None]], a_path: str, b_path: str) -> list[tuple]:
    """The same result for a few documents, each text encoded whole: for tests."""
    encode_a, a_bytes, encode_b, b_bytes = encoders(a_path, b_path)
    found = []
    for doc, text in rows:
        links, gs = [], []
        a, b = (encode([" " + text])[0] for encode in (encode_a, encode_b)) if text else ([], [])
        x, y = [a_bytes[i] for i in a], [b_bytes[i] for i in b]
        if not text or None in x or not b"".join(x) == b"".join(y) == f" {text}".encode():
            a, b = [], []
        i = j = 0
        while i < len(a):
            p, q, u, v = i + 1, j + 1, len(x[i]), len(y[j])
            while u != v:
                if u < v:
                    u, p = u + len(x[p]), p + 1
                else:
                    v, q = v + len(y[q]), q + 1
            gs.append((a[i:p], b[j:q]))
            links += [(s, t) for s in a[i:p] for t in b[j:q]]
            i, j = p, q
        found.append((doc, a, b, gs, links))
    n: dict[tuple, int] = {}
    for *_, links in found:
        for link in set(links):
            n[link] = n.get(link, 0) + 1
    top: dict[int, int] = {}
    for (s, _), k in n.items():
        top[s] = max(top.get(s, 0), k)
    join = lambda ids: ",".join(map(str, ids))
    return [(doc, len(a), len(b), len(gs), len(links), sum(n[e] == top[e[0]] for e in links), sum(n[e] for e in links), ";".join(f"{join(s)}|{join(t)}" for s, t in gs)) for doc, a, b, gs, links in found]
