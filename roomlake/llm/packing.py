"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

A bin holds no two documents of one source and no two of one duplicate cluster.  Each bin carries a
bitmap of its sources and one of its clusters.  Open bins are kept in the order of what room is left,
and a document goes to the tightest compatible one: the search starts at the first bin with room
enough (the successor of the document's size) and continues until a bin without a conflict is found.
Bins lie in runs of about RUN, each with the AND of its bitmaps: where all bins of a run conflict the
search passes over the run at once.  Documents come largest first, ties by id.

Documents larger than the capacity are cut into pieces: full pieces fill bins of their own, the rest
is packed like a document.  Nothing is dropped.

Rows are dealt by a hash of their id into parts of about PART_BYTES; each is packed on its own, so the
work of a task is bounded and a hot source or cluster is spread evenly.  Only sizes and labels are
moved, never texts.

Null and empty texts take no room but are placed (size 0).  Null sources and null clusters conflict
with nothing; null ids are kept.  Repeated rows are packed like any others.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import near_duplicates
from .store import Store

CAPACITY = 16_384  # bytes of a bin
PART_BYTES = 64 << 20  # of documents packed together, about
RUN = 64  # bins of a run; longer runs are halved


class _Run:
    """Bins next to each other in the order of their room."""

    __slots__ = ("rooms", "every")

    def __init__(self, rooms: list[tuple[int, int]], every: int):
        self.rooms, self.every = rooms, every


class Bins:
    """Open bins in the order of (room, number), with conflict bitmaps."""

    def __init__(self) -> None:
        self.runs: list[_Run] = []
        self.marks: list[int] = []  # bitmap of each bin: sources and clusters
        self.used: list[int] = []  # documents in it

    def _at(self, key: tuple[int, int]) -> int:
        lo, hi = 0, len(self.runs)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.runs[mid].rooms[-1] < key:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def take(self, size: int, marks: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) of the tightest compatible open bin, if any."""
        key = (size, -1)
        r = self._at(key)
        while r < len(self.runs):
            run = self.runs[r]
            if not run.every & marks:
                for i in range(bisect_left(run.rooms, key), len(run.rooms)):
                    room, number = run.rooms[i]
                    if not self.marks[number] & marks:
                        del run.rooms[i]
                        if run.rooms:
                            self._sum(run)
                        else:
                            del self.runs[r]
                        return room, number
            r += 1
        return None

    def _sum(self, run: _Run) -> None:
        every = -1
        for _, number in run.rooms:
            every &= self.marks[number]
        run.every = every

    def put(self, room: int, number: int) -> None:
        """Open a bin with ``room`` left."""
        key = (room, number)
        r = min(self._at(key), len(self.runs) - 1)
        if r < 0:
            self.runs.append(_Run([key], self.marks[number]))
            return
        run = self.runs[r]
        run.rooms.insert(bisect_left(run.rooms, key), key)
        run.every &= self.marks[number]
        if len(run.rooms) > 2 * RUN:
            half = _Run(run.rooms[RUN:], 0)
            del run.rooms[RUN:]
            self.runs.insert(r + 1, half)
            self._sum(run)
            self._sum(half)


def pack(items: list[tuple[int, int, object, object]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, bin, slot, start, length) for items (id, size, source, cluster)."""
    labels: dict[tuple, int] = {}
    seen: dict[tuple, int] = {}
    for _, _, source, cluster in items:
        for key in (("s", source), ("c", cluster)):
            if key[1] is not None:
                seen[key] = seen.get(key, 0) + 1
    # a label that one item has cannot conflict and needs no bit
    for key, n in seen.items():
        if n > 1:
            labels[key] = 1 << len(labels)
    bins, out, order = Bins(), [], []
    for k, (_, size, source, cluster) in enumerate(items):
        marks = labels.get(("s", source), 0) | labels.get(("c", cluster), 0)
        start = 0
        while size - start > capacity:
            number = len(bins.marks)
            bins.marks.append(marks)
            bins.used.append(1)
            out.append((k, number, 0, start, capacity))
            start += capacity
        order.append((-(size - start), items[k][0], k, start, marks))
    for neg, _, k, start, marks in sorted(order, key=lambda x: x[:3]):
        size = -neg
        found = bins.take(size, marks)
        if found is None:
            room, number = capacity, len(bins.marks)
            bins.marks.append(0)
            bins.used.append(0)
        else:
            room, number = found
        bins.marks[number] |= marks
        out.append((k, number, bins.used[number], start, size))
        bins.used[number] += 1
        # a full bin is still open to empty texts; full pieces' bins are closed
        bins.put(room - size, number)
    return out


def packed(rows: DataFrame, *, capacity: int = CAPACITY, part_bytes: int = PART_BYTES, id_col: str = "doc_id", size_col: str = "size", source_col: str = "source", cluster_col: str = "cluster") -> DataFrame:
    """(bin_id, slot, id, start, length, source) of every piece of every row.

    ``rows`` has long ids, sizes in bytes, and source and cluster labels.
    """
    key = F.col(id_col).cast("long")
    slim = rows.select(F.coalesce(key, F.lit(0)).alias("id"), key.isNull().alias("no_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"), F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("string").alias("cluster"))
    total = slim.agg((F.sum("size") + 256 * F.count("*")).alias("b")).first()["b"] or 0
    parts = max(1, -(-total // part_bytes))
    dealt = slim.withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(parts)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("id", "no_id", "size", "source", "cluster")])
        columns = {c: table.column(c).to_pylist() for c in ("id", "size", "source", "cluster")}
        found = np.array(pack(list(zip(columns["id"], columns["size"], columns["source"], columns["cluster"])), capacity), np.int64).reshape(-1, 5)
        rows = table.take(pa.array(found[:, 0]))
        part = int(table.column("part")[0].as_py()) << 32
        return pa.table({"bin_id": pa.array(part | found[:, 1]), "slot": pa.array(found[:, 2].astype(np.int32)), "id": rows.column("id"), "no_id": rows.column("no_id"), "start": pa.array(found[:, 3]), "length": pa.array(found[:, 4]), "source": rows.column("source")})

    out = dealt.groupBy("part").applyInArrow(run, "bin_id long, slot int, id long, no_id boolean, start long, length long, source string")
    return out.select("bin_id", "slot", F.when(~F.col("no_id"), F.col("id")).alias(id_col), "start", "length", "source")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source, cluster): cluster is a hash of the text in lower case with single spaces; null and blank texts have none."""
    plain = F.trim(F.regexp_replace(F.lower(F.col(text_col)), r"\s+", " "))
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"), F.col(source_col).alias("source"), F.when(plain != "", F.md5(plain.cast("binary"))).alias("cluster"))


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source, cluster): cluster is the class of near duplicates, by five-word shingles at 0.8.

    Rows are told apart by a key of this run, written once, so rows without an id and rows that repeat one
    are clustered like any others.  Texts without words have a class of their own.
    """
    store = Store(docs.sparkSession, "packing")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    rows = store.put(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    classes = store.put(near_duplicates(rows, "row", shingle=5, percent=80).select("row", F.col("component_id").alias("cluster")), "classes")
    sizes = rows.select("row", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "source")
    return sizes.join(classes, "row").select("doc_id", "size", "source", "cluster")
