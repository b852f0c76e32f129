"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen, Thorup, 2017): T bins are filled in up to 2 T rounds.  In round i < T
every element falls into one hashed bin with a hashed value; an earlier round beats a later one.  In
round T + j every element falls into bin j.  So every bin fills, about n + T log T hash values are
needed, and the share of equal bins of two sets estimates their Jaccard similarity with the
concentration of independent MinHash.

BANDS bands of ROWS bins: a pair at similarity s shares a band with probability
1 - (1 - s^ROWS)^BANDS; at 0.8 it is missed with probability 5e-8.

Equal sets are one class from the start (two 64-bit sums over 64-bit hashes of their shingles, and
their size).  Classes that share a band are compared on their full sets: first every class with the
smallest of each of its bands (a star: no bucket emits its pairs), then, in buckets that still hold
several components, the pairs between components that exact bounds allow.  Buckets of up to PAIRED
such members are joined by the band; members of larger ones by the tokens of an exact prefix filter,
so that what many documents share (a passage, a frequent line) brings no two of them together.
Pairs inside one component cannot change it and are not compared.

Null and empty texts have no words: their set is empty and they link with nothing.  Ties and
repeated rows: ids are taken to identify rows; equal texts get one class.  Other columns are left
alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U64, lean, mix, row_shingles, text_rows
from .components import components, with_component
from .store import Store

ROWS, BANDS = 4, 32
BINS = ROWS * BANDS
WORDS = 16  # 64-bit words of a parity bitmap
PAIRED = 256  # members of a bucket whose pairs between components are joined by the band
BROADCAST_IDS = 1_000_000  # ids (8 bytes each) that may be broadcast; more are joined by shuffle
_SALT = mix(np.arange(1, 2 * BINS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


_EMPTY = np.iinfo(U64).max


def sketches(items: np.ndarray, cuts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches, one row of ``bins`` (a power of two) for each set of 64-bit hashes.

    The round stands in the top bits of a value, so an earlier one wins.  An empty set fills nothing.
    """
    n = len(cuts) - 1
    size = np.diff(cuts)
    full = np.full(n * bins, _EMPTY, U64)
    owner = np.repeat(np.arange(n), size)
    for i in range(bins):
        h = mix(items ^ _SALT[i])
        np.minimum.at(full, owner * bins + (h & U64(bins - 1)).astype(np.int64), (U64(i) << U64(55)) | (h >> U64(9)))
        left = (full.reshape(n, bins) == _EMPTY).any(axis=1)
        keep = left[owner]
        if not keep.any():
            break
        items, owner = items[keep], owner[keep]
    grid = full.reshape(n, bins)
    for row in np.flatnonzero((grid == _EMPTY).any(axis=1) & (size > 0)):
        own = items[owner == row]
        for j in np.flatnonzero(grid[row] == _EMPTY):
            grid[row, j] = (U64(bins) << U64(55)) | (mix(own ^ _SALT[bins + j]) >> U64(9)).min()
    return grid


def band_keys(grid: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    parts = grid.reshape(len(grid), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F), parts.shape[:2])
    for r in range(ROWS):
        key = mix(key ^ parts[:, :, r]) + U64(r)
    return key


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    return (total[cuts[1:]] - total[cuts[:-1]]).view(np.int64)


_SKETCHED = "id long, n_shingles long, sig1 long, sig2 long, bands array<long>"


def _ragged(flat: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.view(np.int64)))


def _sketch_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, offsets, raw in text_rows(batch):
                items, cuts = row_shingles(raw, offsets, k)
                size = np.diff(cuts)
                keys = band_keys(sketches(items, cuts))[size > 0].ravel()
                columns = [
                    batch.column(0).slice(i, j - i).cast(pa.int64()),
                    pa.array(size.astype(np.int64)),
                    pa.array(_sums(mix(items), cuts)),
                    pa.array(_sums(mix(items ^ U64(0x5851F42D4C957F2D)), cuts)),
                    _ragged(keys, np.concatenate([[0], np.cumsum((size > 0) * BANDS)])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "sig1", "sig2", "bands"])

    return run


def _parity(items: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Of each set WORDS longs of which bit h is the parity of its items that hash to h."""
    n = len(cuts) - 1
    owner = np.repeat(np.arange(n), np.diff(cuts))
    h = mix(items ^ U64(0x2545F4914F6CDD1D)) & U64(64 * WORDS - 1)
    out = np.zeros(n * WORDS, U64)
    np.bitwise_xor.at(out, owner * WORDS + (h >> U64(6)).astype(np.int64), U64(1) << (h & U64(63)))
    return out


def _set_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, offsets, raw in text_rows(batch):
                items, cuts = row_shingles(raw, offsets, k)
                bits = _ragged(_parity(items, cuts), np.arange(len(cuts)) * WORDS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), _ragged(items, cuts), bits], names=["id", "items", "bits"])

    return run


_SETS = "id long, items array<long>, bits array<long>"


def semi_by_id(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in ``ids``: by broadcast if a count proves it small, else by shuffle."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids.hint("merge"), key, "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among ``pairs`` (a, b), confirmed on the whole sets (id, items)."""
    one = sets.select(F.col("id").alias("a"), F.col("items").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("items").alias("sb"))
    shared = pairs.join(two, "b").join(one, "a").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return shared.filter(F.col("shared") * 100 >= (F.size("sa") + F.size("sb") - F.col("shared")) * percent).select("a", "b")


def _ordered(sets: DataFrame) -> DataFrame:
    """(id, comp, n, m, bits, order): the m shingles of a set that another component holds too, rarest first."""
    tokens = sets.select("id", "comp", F.explode("items").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token", "f")
    ranked = tokens.select("id", "token").join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("order"))
    return sets.select("id", "comp", F.size("items").alias("n"), "bits").join(ranked, "id").withColumn("m", F.size("order"))


def _may_link(percent: int):
    """What sets a and b of two components must meet to link; all of it follows from the law.

    They share at most the smaller of n and m, and differ in at least as many shingles as their
    parity bitmaps differ in bits.
    """
    most = F.least("ma", "mb", "na", "nb")
    differ = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in range(WORDS)), F.lit(0))
    size = F.col("na") + F.col("nb")
    return (F.col("ca") != F.col("cb")) & (most * 100 >= (size - most) * percent) & (differ * (100 + percent) <= size * (100 - percent))


def _side(rows: DataFrame, x: str, key: str) -> DataFrame:
    return rows.select(key, F.col("id").alias(x), *(F.col(c).alias(c[0] + x) for c in ("comp", "n", "m")), *(F.get("bits", F.lit(w)).alias(f"{x}{w}") for w in range(WORDS)))


def _pairs_by(key: str, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of rows (key, id, comp, n, m, bits) of one key and two components that may link."""
    mixed = rows.groupBy(key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select(key)
    one, two = _side(rows.join(mixed, key, "left_semi"), "a", key), _side(rows, "b", key)
    return one.join(two, (one[key] == two[key]) & (one.a < two.b) & _may_link(percent)).select("a", "b").distinct()


def _prefix_pairs(ordered: DataFrame, store: Store, percent: int) -> DataFrame:
    """Every pair (a, b) of sets in different components that may link; exact.

    A shingle that only one component holds matches nothing outside it.  With those first and the
    others after them, rarest first, linked sets of two components share one of their first
    n - ceil(percent n / 100) + 1 shingles.
    """
    length = F.col("m") - F.ceil(F.col("n") * percent / 100) + 1
    heads = ordered.withColumn("length", length.cast("int")).filter("length > 0").select("id", "comp", "n", "m", "bits", F.explode(F.slice("order", 1, F.col("length"))).alias("head"))
    heads = store.put(heads.select(F.col("head.token").alias("token"), "id", "comp", "n", "m", "bits"), "heads")
    return _pairs_by("token", heads, percent)


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, comp) of the buckets that still hold several components."""
    placed = with_component(members.select("key", "rep"), found, "rep").select("key", F.col("rep").alias("id"), F.col("component_id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    return placed.join(mixed, "key", "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (smallest id reachable), kept.

    Links have 100 * |A & B| >= percent * |A | B| on whole texts' shingle sets.
    """
    store = Store(docs.sparkSession, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = store.put(texts.mapInArrow(lean(_sketch_batches(shingle)), _SKETCHED), "sketched")
    one_class = sketched.filter("n_shingles > 0").groupBy("n_shingles", "sig1", "sig2")
    classes = store.put(one_class.agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "classes")
    banded = classes.select(F.explode("bands").alias("key"), "rep", F.col("n_shingles").alias("n"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("rep", "n")).alias("first")).filter("c > 1")
    members = store.put(banded.join(buckets, "key").select("key", "rep", "n", F.col("first.rep").alias("pivot"), F.col("first.n").alias("pn")), "members")
    ids = store.put(members.select(F.col("rep").alias("id")).distinct(), "ids")
    sets = store.put(semi_by_id(texts, ids).mapInArrow(lean(_set_batches(shingle)), _SETS), "sets")

    # a star on the smallest id of each bucket
    fits = (F.col("rep") != F.col("pivot")) & (F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent)
    stars = members.filter(fits).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = store.put(_verified(stars, sets, percent), "links1")
    found = components(links, store, "cc1")

    # what is left: the pairs between components of one bucket that may link
    rest = store.put(_mixed(members, found), "rest")
    sizes = rest.groupBy("key").agg(F.count("*").alias("c"))
    narrow = rest.join(sizes.filter(F.col("c") <= PAIRED).select("key"), "key", "left_semi")
    facts = sets.select("id", F.size("items").alias("n"), F.size("items").alias("m"), "bits")
    pairs = _pairs_by("key", narrow.join(facts, "id"), percent)
    if sizes.filter(F.col("c") > PAIRED).limit(1).count():
        wide = rest.join(sizes.filter(F.col("c") > PAIRED).select("key"), "key", "left_semi").select("id", "comp").distinct()
        ordered = store.put(_ordered(sets.join(wide, "id")), "ordered")
        pairs = pairs.union(_prefix_pairs(ordered, store, percent)).distinct()
    pairs = store.put(pairs, "pairs")
    links = store.put(links.union(_verified(pairs, sets, percent)), "links2")
    found = components(links, store, "cc2")
    store.drop("members", "ids", "sets", "rest", "ordered", "heads", "pairs", "links1", "links2")

    reps = with_component(classes.select("n_shingles", "sig1", "sig2", "rep"), found, "rep").drop("rep")
    out = sketched.select("id", "n_shingles", "sig1", "sig2").join(reps, ["n_shingles", "sig1", "sig2"], "left")
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
