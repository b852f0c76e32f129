"""Exact top-k by an impact-ordered, score-at-a-time index.

Vectors are integers, floor(256 x).  For every dimension the index keeps the rows ordered by the size of
their component, cut into segments of equal quantised size (STEP levels up to the dimension's largest).
For a query q the impact of a segment is the most that it can change a score, |q_d| times its level's
size.  Segments are processed by descending impact over all dimensions together, in rounds, for a part of
queries at once (their impact on a part is that on the query they change most); a round's postings
add their exact products to the rows' accumulators, as one matrix product.  What a row still lacks is bounded by Cauchy and Schwarz:
the lengths of what is left of the row and of the query in the row's open dimensions.  That gives each
row a lower and an upper bound.  Processing stops only on proof: when the rows whose upper bound reaches
the k-th best lower bound are few.  They are all the possible members, and they are rescored exactly.

Rows are dealt in blocks of about BLOCK by a hash of their id, each block with its own index, and
queries in parts of PART.  A block and the parts it must answer are rows of one table, sorted so that a
task meets the block first and then streams the parts: nothing is broadcast, nothing is looped over on
the driver, and memory holds one block and one part.  The best k of a query over blocks are the best of
the blocks' best.  Ties go to the smaller id.

Vectors that are null, empty or hold null or non-finite components take no part; neither do vectors
of another length than the query's, nor rows without an id.  With fewer than k candidates all are
returned.  Of rows that share an id and a vector one counts; different vectors of one id are rows of their own,
and none of them is a candidate of the others.  Components of any size are exact: where products do not fit in a double the scores are
computed in integers without a limit and, beyond the range of long, given as its end.  Other columns are
left out, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import give_back, lean
from .store import Store
from .vectors import matrix, usable

LEVELS = 64  # quantised sizes of a dimension's components
BLOCK = 16_384  # rows of a block, about
PART = 256  # queries of a part, about
TASKS = 32  # least tasks that blocks and parts are dealt to, if there are as many pairs
READ = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 1.0)  # rounds end when this share of the postings is read, about
FEW = 0.02  # of a block's rows may be left to rescore
MOST = 100_000  # tasks, at most; more pairs of blocks and shares are queued in them
PROBES = 8  # queries of a part that tell in which round proofs succeed
GROUPS = 256  # of rows, whose best give a bound on the k-th best
EXACT = float(1 << 53)


class Index:
    """The impact-ordered segments of one block of integer vectors (as doubles; ids ascending)."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        # bounds are found in doubles of moderate size, scores from the values themselves
        self.scale = self._moderate(values)
        values = values * self.scale
        n, dims = values.shape
        size = np.abs(values)
        self.unit = np.maximum(size.max(axis=0) / LEVELS, 1e-300) if n else np.ones(dims)
        level = np.minimum(size / self.unit[None, :], LEVELS - 1).astype(np.int8)
        order = np.argsort(-level, axis=0, kind="stable").T
        self.order = order.astype(np.int32)
        self.sorted = np.take_along_axis(values.T, order, axis=1)
        # upto[d, l]: postings of dimension d in segments of level l and more
        counts = np.stack([np.bincount(level[:, d], minlength=LEVELS) for d in range(dims)]) if n else np.zeros((dims, LEVELS), int)
        self.upto = np.concatenate([np.cumsum(counts[:, ::-1], axis=1)[:, ::-1], np.zeros((dims, 1), int)], axis=1)
        self.length2 = (values * values).sum(axis=1)
        self.read = 0  # postings read so far, over all queries

    @staticmethod
    def _moderate(x: np.ndarray) -> float:
        """A power of two that brings large values down to 2^20; 1 for others."""
        most = float(np.abs(x).max(initial=0))
        return 1.0 if most < 1 << 26 else 2.0 ** (20 - int(np.log2(most)))

    def _ends(self, query: np.ndarray, limit: float) -> np.ndarray:
        """How many postings of each dimension have an impact of ``limit`` or more."""
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            level = np.ceil(np.minimum(LEVELS, limit / (np.abs(query) * self.unit)))
        return self.upto[np.arange(len(query)), np.nan_to_num(level, nan=LEVELS).astype(np.int64)]

    def _limits(self, query: np.ndarray) -> list[float]:
        """Impact levels at which the rounds end."""
        impact = np.sort((np.abs(query) * self.unit)[:, None] * np.arange(LEVELS)[None, :], axis=None)[::-1]
        total = self.upto[:, 0].sum()
        out = []
        for share in READ[:-1]:
            lo, hi = 0, len(impact) - 1
            while lo < hi:
                mid = (lo + hi) // 2
                if self._ends(query, impact[mid]).sum() < share * total:
                    lo = mid + 1
                else:
                    hi = mid
            out.append(float(impact[lo]))
        return [*out, 0.0]

    def top(self, query: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, list[int]]:
        """(ids, scores) of the k best rows but those of the id ``skip``."""
        return self.tops(query[None, :], k, np.array([skip]))[0]

    def tops(self, queries: np.ndarray, k: int, skips: np.ndarray) -> list[tuple[np.ndarray, list[int]]]:
        """(ids, scores) for each query of a part: its k best rows but those of its id in ``skips``.

        The part's first queries tell in which round proofs succeed; the others' rounds start there.
        """
        first = 0
        if len(queries) > 4 * PROBES:
            first = self._rounds(queries[:PROBES], k, skips[:PROBES], 0)[1]
        return self._rounds(queries, k, skips, first)[0]

    def _rounds(self, queries: np.ndarray, k: int, skips: np.ndarray, first: int) -> tuple[list[tuple[np.ndarray, list[int]]], int]:
        """The answers, and the round in which half of the queries had theirs."""
        n, dims = self.values.shape
        low, high = np.searchsorted(self.ids, skips, "left"), np.searchsorted(self.ids, skips, "right")
        answers: list = [None] * len(queries)
        for i in np.flatnonzero(n - (high - low) <= k):
            answers[i] = self._scored(np.concatenate([np.arange(low[i]), np.arange(high[i], n)]), queries[i], k)
        left = np.flatnonzero(n - (high - low) > k)
        middle, half = first, len(left) / 2
        if not len(left):
            return answers, middle
        q = queries[left] * np.array([self._moderate(queries[i]) for i in left])[:, None]
        whole2, length2 = (q * q).sum(axis=1), self.length2
        most = np.sqrt(whole2 * length2.max())
        # small integers are exact in single precision
        f = np.float32 if most.max() < 1 << 22 and self.scale == 1 and np.abs(q).max() < 1 << 12 else np.float64
        slack = (1e-9 if f is np.float64 else 1e-5) * (most + 1)
        peak = np.abs(q).max(axis=0)  # the impact of a segment on a part is that on the query that it changes most
        score = np.zeros((len(left), n), f)
        met = np.zeros((n, dims), f)  # the postings that are read
        done = np.zeros(dims, np.int64)
        for nth, limit in enumerate(self._limits(peak)):
            if nth < first:
                continue
            ends = self._ends(peak, limit) if limit > 0 else self.upto[:, 0]
            some = np.flatnonzero(ends > done)
            if len(some):
                fresh = np.zeros((len(some), n), f)
                for c, d in enumerate(some):
                    fresh[c, self.order[d, done[d] : ends[d]]] = self.sorted[d, done[d] : ends[d]]
                    if limit > 0:
                        met[self.order[d, done[d] : ends[d]], d] = 1
                self.read += int((ends - done)[some].sum()) * len(left)
                score += q[:, some].astype(f) @ fresh
                done = np.maximum(done, ends)
            if limit > 0:
                rest = length2 - ((self.values * self.scale) ** 2 * met).sum(axis=1)
                lacks = np.sqrt(np.maximum(0, rest)).astype(f) * np.sqrt(np.maximum(0, whole2.astype(f)[:, None] - (q * q).astype(f) @ met.T))
            else:
                lacks = f(0)
            lower = score - lacks
            for i, j in enumerate(left):
                lower[i, low[j] : high[j]] = -np.inf
            upper = score + lacks
            possible = upper >= (self._bar(lower, k) - slack)[:, None]
            for i, j in enumerate(left):
                possible[i, low[j] : high[j]] = False
            proved = np.count_nonzero(possible, axis=1) <= max(FEW * n, 4 * k) if limit > 0 else np.ones(len(left), bool)
            for i in np.flatnonzero(proved):
                answers[left[i]] = self._scored(np.flatnonzero(possible[i]), queries[left[i]], k)
            left, q, score, whole2, slack = left[~proved], q[~proved], score[~proved], whole2[~proved], slack[~proved]
            if len(left) >= half:
                middle = nth + 1
            if not len(left):
                break
        return answers, min(middle, len(READ) - 1)

    @staticmethod
    def _bar(lower: np.ndarray, k: int) -> np.ndarray:
        """What k rows of each query reach: the k-th best, or that of the best of GROUPS groups of rows, which is no more."""
        m, n = lower.shape
        if n >= 16 * GROUPS and k <= GROUPS // 4:
            lower = lower[:, : n // GROUPS * GROUPS].reshape(m, GROUPS, -1).max(axis=2)
        return np.partition(lower, -k, axis=1)[:, -k].astype(np.float64)

    def _scored(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        """The best k of rows by exact scores, ties to the smaller id."""
        values = self.values[rows]
        if len(rows) and float(np.abs(values).max(initial=0)) * float(np.abs(query).max(initial=0)) * len(query) >= EXACT:
            own = [int(v) for v in query.tolist()]
            score = [sum(int(a) * b for a, b in zip(row, own)) for row in values.tolist()]
        else:
            score = [int(v) for v in (values @ query).tolist()]
        ids = self.ids[rows]
        best = sorted(range(len(rows)), key=lambda i: (-score[i], int(ids[i])))[:k]
        return ids[best], [max(-(1 << 63), min((1 << 63) - 1, score[i])) for i in best]


def _floored(scale: int):
    """(id, dims, vector) as the vector's integers, doubles one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                whole = np.floor(matrix(part.column(1)) * scale)
                whole = np.clip(whole, -1e300, 1e300)
                raw = pa.py_buffer(whole.tobytes())
                ends = pa.py_buffer((np.arange(part.num_rows + 1) * 8 * int(size)).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([int(size)] * part.num_rows, pa.int32()), pa.Array.from_buffers(pa.binary(), part.num_rows, [None, ends, raw])], names=["id", "dims", "vec"])

    return lean(run)


def _packed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The rows of a group as one: ids in order and their vectors."""
    rows = rows.sort_by([("id", "ascending"), ("vec", "ascending")])
    first = rows.slice(0, 1).drop_columns(["id", "vec"])
    first = first.append_column("ids", pa.array([rows.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()))
    return first.append_column("vecs", pa.array([b"".join(rows.column("vec").to_pylist())], pa.binary()))


def _answers(k: int):
    """Tasks' rows (task, ord, dims, ids, vecs): a block at ord -1, then the parts that it answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            for i in range(batch.num_rows):
                order, dims, ids, vecs = (batch.column(c)[i] for c in ("ord", "dims", "ids", "vecs"))
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                vecs = np.frombuffer(vecs.as_buffer(), np.float64).reshape(len(ids), dims.as_py())
                if order.as_py() < 0:
                    index = None  # the former block goes before the next is built
                    index = Index(ids, vecs)
                    continue
                found = [(q, *best) for q, best in zip(ids.tolist(), index.tops(vecs, k, ids))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([q for q, _, _ in found], [len(s) for _, _, s in found]).astype(np.int64)),
                        pa.array(np.concatenate([i for _, i, _ in found]).astype(np.int64)),
                        pa.array([x for _, _, s in found for x in s], pa.int64()),
                    ],
                    names=["query_id", "id", "score"],
                )
                give_back()

    return lean(run)


def top_k(vectors: DataFrame, k: int = 5, *, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by ``every`` its k best rows."""
    spark = vectors.sparkSession
    store = Store(spark, "impact")
    rows = vectors.filter(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda v: v.cast("double")).alias("v"))
    rows = store.put(rows.mapInArrow(_floored(scale), "id long, dims int, vec binary").distinct(), "rows")
    # a few numbers for each vector length: its rows and queries
    query = F.pmod("id", F.lit(every)) == 0
    sizes = {r["dims"]: (r["n"], r["q"]) for r in rows.groupBy("dims").agg(F.count("*").alias("n"), F.count(F.when(query, 1)).alias("q")).collect() if r["q"]}
    tables, base = [], 0
    for dims, (n, q) in sorted(sizes.items()):
        blocks, parts = -(-n // BLOCK), -(-q // PART)
        # each block is given to so many tasks, each with its share of the parts
        shares = min(parts, max(1, -(-TASKS // blocks)))
        own = rows.filter(F.col("dims") == dims)
        packed = own.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(_packed, "dims int, block int, ids binary, vecs binary")
        asked = own.filter(query).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(_packed, "dims int, part int, ids binary, vecs binary")
        share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
        tables.append(packed.withColumn("s", share).select((base + F.col("block").cast("long") * shares + F.col("s")).alias("task"), F.lit(-1).alias("ord"), "dims", "ids", "vecs"))
        block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        tables.append(asked.withColumn("b", block).select((base + F.col("b").cast("long") * shares + F.col("part") % shares).alias("task"), F.col("part").alias("ord"), "dims", "ids", "vecs"))
        base += blocks * shares
    if not tables:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    both = tables[0]
    for t in tables[1:]:
        both = both.union(t)
    tasks = min(base, MOST)
    dealt = both.repartitionById(tasks, F.pmod(F.col("task"), F.lit(tasks)).cast("int")).sortWithinPartitions("task", "ord")
    found = store.put(dealt.mapInArrow(_answers(k), "query_id long, id long, score long"), "found")
    store.drop("rows")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
