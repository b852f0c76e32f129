"""Language ID by language-bitmask n-gram filters.

Every learned language is one bit of a mask.  Its frequent byte n-grams are put into a Bloom filter;
the filters lie bit-sliced: slot s holds the mask of the languages whose filter has bit s set, so the
AND of an n-gram's HASHES slots is the mask of all languages that contain it.  A text's n-grams are
looked up, each language's bits are counted (its popcount), and the share of hits is corrected for
the filter's false positives, (hits / n - f) / (1 - f) with f the chance that HASHES random slots are
all set.  The highest corrected share decides, ties by name; the score is its part of all shares.

N-grams are GRAM bytes of the text with ASCII letters in lower case and runs of other ASCII bytes as
one space.  Null texts and texts without a letter are ``und`` with score 0; a text without a single
full n-gram (one ASCII letter) is looked up by that letter as a word, which is
fitted like an n-gram.  Any number of languages can be learned.  Texts of any length are looked up whole;
equal texts get one answer.  An empty table gives no rows.

The filters are fitted on a bounded sample of labelled rows (``per_language``); n-gram frequencies
are counted on the executors and only n-grams that SUPPORT of a language's sampled texts contain come
back to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U64, buffers, give_back, lean, mix, pieces
from .store import Store

GRAM = 4
HASHES = 3
SUPPORT = 0.02  # of a language's sampled texts must hold an n-gram
PER_LANGUAGE = 2000  # sampled texts of each language
BITS_PER_GRAM = 12
UND = "und"

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[:128] = 32
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Filters:
    """The bit-sliced filters: names of the languages, slots of masks, false-positive rates."""

    names: tuple[str, ...]
    slots: np.ndarray
    false_positive: np.ndarray


def gram_hashes(raw: np.ndarray, offsets: np.ndarray, lone: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cuts) of the n-grams of rows: row i has hashes[cuts[i]:cuts[i + 1]].

    Words of one letter count too, as their byte: with ``lone`` in all rows, else in those without a full n-gram.
    """
    n = len(offsets) - 1
    size = np.diff(offsets)
    # two spaces before and after every row, so that words at its ends count like others
    out = np.full(len(raw) + 4 * n, 32, np.uint8)
    shift = offsets[:-1] + 4 * np.arange(n) + 2
    at = np.repeat(shift - offsets[:-1], size) + np.arange(len(raw))
    out[at] = _CLASS[raw]
    row = np.repeat(np.arange(n), size + 4)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32) | (row[1:] != row[:-1])
    out, row = out[keep], row[keep]
    full = max(len(out) - GRAM + 1, 0)
    word = out[:full].astype(np.uint32)
    for i in range(1, GRAM):
        word = word << np.uint32(8) | out[i : full + i]
    whole = row[:full] == row[GRAM - 1 :]
    word, owner = word[whole], row[:full][whole]
    at = np.flatnonzero((out[:-2] == 32) & (out[1:-1] != 32) & (out[2:] == 32) & (row[:-2] == row[2:])) + 1
    if not lone:
        at = at[np.bincount(owner, minlength=n)[row[at]] == 0]
    if len(at):
        word, owner = np.concatenate([word, out[at].astype(np.uint32)]), np.concatenate([owner, row[at]])
        order = np.argsort(owner, kind="stable")
        word, owner = word[order], owner[order]
    return word, np.searchsorted(owner, np.arange(n + 1))


def _slots(grams: np.ndarray, size: int) -> list[np.ndarray]:
    h = mix(grams.astype(U64) + U64(0x9E37))
    return [(mix(h + U64(i)) & U64(size - 1)).astype(np.int64) for i in range(HASHES)]


def build(grams: dict[str, np.ndarray]) -> Filters:
    """Filters of the n-grams (distinct uint32) of each language.

    A slot has as many 64-bit words as the languages need; filters are as large as the largest language
    needs for BITS_PER_GRAM bits an n-gram.
    """
    names = tuple(sorted(grams))
    most = max((len(g) for g in grams.values()), default=1)
    size = 1 << max(10, (most * BITS_PER_GRAM - 1).bit_length())
    kind = next((k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(names) <= n), np.uint64)
    wide = kind(0).itemsize * 8
    slots = np.zeros((max(1, -(-len(names) // wide)), size), kind)
    for i, name in enumerate(names):
        for at in _slots(grams[name], size):
            slots[i // wide, at] |= kind(1 << i % wide)
    fill = np.array([np.count_nonzero(slots[i // wide] & kind(1 << i % wide)) / size for i in range(len(names))])
    return Filters(names, slots, fill**HASHES)


def shares(filters: Filters, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected shares (rows x languages) and numbers of n-grams of rows."""
    grams, cuts = gram_hashes(raw, offsets)
    kind, wide = filters.slots.dtype.type, filters.slots.dtype.itemsize * 8
    found = _slots(grams, filters.slots.shape[1])
    n = np.diff(cuts)
    out = np.zeros((len(n), len(filters.names)))
    for word in range(len(filters.slots)):
        mask = filters.slots[word][found[0]]
        for at in found[1:]:
            mask &= filters.slots[word][at]
        for i in range(word * wide, min(len(filters.names), (word + 1) * wide)):
            total = np.concatenate([[0], np.cumsum((mask >> kind(i % wide)) & kind(1), dtype=np.int64)])
            out[:, i] = total[cuts[1:]] - total[cuts[:-1]]
    f = filters.false_positive[None, :]
    return np.clip((out / np.maximum(n, 1)[:, None] - f) / np.maximum(1 - f, 1e-9), 0, 1), n


def _letters(column: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter (of any script)."""
    ascii_ = np.concatenate([[0], np.cumsum((_CLASS[raw] != 32) & (raw < 128), dtype=np.int64)])
    some = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~some & (np.diff(offsets) > 0)):
        some[i] = any(map(str.isalpha, column[int(i)].as_py() or ""))
    return some


def _sampled_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and language: each n-gram with the number of texts that hold it."""
    for batch in batches:
        offsets, raw = buffers(batch.column(1))
        langs = np.array(batch.column(0).to_pylist(), object)
        for i, j in pieces(offsets):
            grams, cuts = gram_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lone=True)
            owner = np.repeat(np.arange(i, j), np.diff(cuts))
            once = np.unique(owner.astype(np.uint64) << U64(32) | grams)
            gram, lang = (once & U64(0xFFFFFFFF)).astype(np.int64), langs[(once >> U64(32)).astype(np.int64)]
            for name in sorted(set(lang)):
                g, c = np.unique(gram[lang == name], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g), pa.array(c.astype(np.int64))], names=["lang", "gram", "texts"])


def fit(labelled: DataFrame, *, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters of the languages of ``labelled`` rows; rows without text or language are left out.

    The sample is the ``per_language`` rows of each language whose hashed ids come first.
    """
    rows = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    # a hash threshold for each language keeps the sample bounded without ranking all rows
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return build({})
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    taken = rows.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    store = Store(labelled.sparkSession, "langid")
    sample = store.put(taken.select("lang", "text"), "sample")
    sampled = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    least = F.create_map(*[x for k, n in sorted(sampled.items()) for x in (F.lit(k), F.lit(max(1.0, SUPPORT * n)))]) if sampled else F.create_map()
    grams = sample.mapInArrow(lean(_sampled_grams), "lang string, gram long, texts long").groupBy("lang", "gram").agg(F.sum("texts").alias("texts"))
    kept = grams.filter(F.col("texts") >= least[F.col("lang")]).select("lang", "gram").toArrow() if sampled else None
    store.drop("sample")
    if kept is None:
        return build({})
    langs, grams = np.array(kept.column("lang").to_pylist(), object), kept.column("gram").to_numpy().astype(np.uint32)
    found = {name: grams[langs == name] for name in sorted(set(langs.tolist()))}
    give_back()
    return build(found)


def _languages(spread):
    """Texts to (lang_pred, score, hit_share)."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        filters = spread.value
        for texts in columns:
            offsets, raw = buffers(texts)
            pred, score, top = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            for i, j in pieces(offsets) if filters.names else ():
                off, own = offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]
                share, n = shares(filters, own, off)
                known = _letters(texts.slice(i, j - i), own, off) & (n > 0)
                best = share.argmax(axis=1)
                top[i:j] = np.where(known, share[np.arange(j - i), best], 0.0)
                score[i:j] = top[i:j] / np.maximum(share.sum(axis=1), 1e-12)
                pred[i:j] = [filters.names[b] if k else UND for b, k in zip(best.tolist(), known.tolist())]
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score), pa.array(top)], names=["lang_pred", "score", "hit_share"])
        give_back()

    return run


def predict(docs: DataFrame, filters: Filters, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and hit_share of every whole text (columns of these names are replaced).

    score is the best language's part of the corrected shares, hit_share its corrected share.  Only the
    texts go to Python; repeated rows and rows without an id count like others.
    """
    spread = docs.sparkSession.sparkContext.broadcast(filters)  # of a size that build() bounds
    found = F.arrow_udf(_languages(spread), "lang_pred string, score double, hit_share double").asNondeterministic()
    rows = docs.drop("lang_pred", "score", "hit_share", "_found").withColumn("_found", found(F.col(text_col)))
    return rows.select(*(c for c in rows.columns if c != "_found"), "_found.lang_pred", "_found.score", "_found.hit_share")
