"""K-d tree sharding with DataFrame operations only.

The documents are split recursively until there are as many leaves as shards, whose target is an
equal share of the bytes.  A node of s shards is cut so that its left child, of s // 2 shards, gets
that share of the bytes: at the weighted quantile along the node's widest metadata dimension, width
being the spread of the node's rows relative to that of all rows.

Weighted quantiles are found without sorting: the range of keys of every node is cut into BINS equal
bins, bytes are summed by bin, and the bin that holds the quantile is cut again, until it is one key
or weighs too little to matter.  What reaches the driver is a few numbers for each node, never rows.
Keys are made distinct by a hash of the id in their low bits, so that many rows with one value
(a hot source, groups of copies) can still be divided.

Dimensions: id, log of the size, CRC-32 of the text, CRC-32 of the source.  Null texts weigh the
fixed 16 bytes; null sources count as an empty source, null ids as 0.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Store

ROW_BYTES = 16  # counted for each row besides its text
BINS = 2048  # bins of a range in one pass
TOLERANCE = 2e-4  # of a shard's bytes: a bin that weighs less is not cut further
PASSES = 8
VALUE_BITS = 40  # a key is value << TIE_BITS | tie
TIE_BITS = 20
DIMS = ("d_id", "d_size", "d_text", "d_source")


def _dimensions(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, size, text_crc32, dims...) with every dimension a long key of VALUE_BITS + TIE_BITS bits."""
    raw = F.encode(F.col(text_col), "utf-8")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        F.crc32(F.encode(F.coalesce(F.col(source_col).cast("string"), F.lit("")), "utf-8")).alias("source"),
    )
    tie = F.pmod(F.xxhash64("id"), F.lit(1 << TIE_BITS))
    value = {
        "d_id": F.pmod(F.coalesce("id", F.lit(0)), F.lit(1 << VALUE_BITS)),
        "d_size": F.round(F.log2(F.col("size")) * (1 << 32)).cast("long"),
        "d_text": F.col("text_crc32") * (1 << (VALUE_BITS - 32)),
        "d_source": F.col("source") * (1 << (VALUE_BITS - 32)),
    }
    return rows.select("id", "size", "text_crc32", *((v * (1 << TIE_BITS) + tie).alias(d) for d, v in value.items()))


def _case(node: int, values: dict[int, object], otherwise: object):
    out = None
    for k, v in values.items():
        out = F.when(F.col("node") == k, v) if out is None else out.when(F.col("node") == k, v)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def _cuts(rows: DataFrame, plan: dict[int, tuple[str, int, int, float]]) -> dict[int, int]:
    """For each node (dimension, low, high, bytes wanted on the left) the last key of its left child."""
    low = {n: lo for n, (_, lo, _, _) in plan.items()}
    high = {n: hi for n, (_, _, hi, _) in plan.items()}
    want = {n: w for n, (_, _, _, w) in plan.items()}
    keys = {n: F.col(d) for n, (d, _, _, _) in plan.items()}
    slack = {n: want[n] * TOLERANCE for n in plan}
    cut: dict[int, int] = {}
    for _ in range(PASSES):
        todo = [n for n in plan if n not in cut]
        if not todo:
            break
        width = {n: max(1, -(-(high[n] - low[n] + 1) // BINS)) for n in todo}
        key = _case(0, {n: keys[n] for n in todo}, F.lit(None).cast("long"))
        lo, hi, step = (_case(0, {n: F.lit(x[n]) for n in todo}, F.lit(None).cast("long")) for x in (low, high, width))
        inside = rows.withColumn("key", key).withColumn("bin", F.floor((F.col("key") - lo) / step).cast("int")).filter((F.col("key") >= lo) & (F.col("key") <= hi))
        bins = inside.groupBy("node", "bin").agg(F.sum("size").alias("bytes"))
        # the first bin at which the bytes so far reach what is wanted
        order = Window.partitionBy("node").orderBy("bin")
        wanted = _case(0, {n: F.lit(float(want[n])) for n in todo}, F.lit(0.0))
        reach = bins.withColumn("upto", F.sum("bytes").over(order)).filter(F.col("upto") >= wanted)
        first = reach.groupBy("node").agg(F.min(F.struct("bin", "upto", "bytes")).alias("b")).select("node", "b.*").collect()
        got = {r["node"]: r for r in first}
        for n in todo:
            if n not in got:  # all of it is wanted
                cut[n] = high[n]
                continue
            b = got[n]
            start = low[n] + b["bin"] * width[n]
            before = b["upto"] - b["bytes"]
            if width[n] == 1 or b["bytes"] <= slack[n]:
                near_end = b["upto"] - want[n] <= want[n] - before
                cut[n] = start + width[n] - 1 if near_end else start - 1
            else:
                low[n], high[n], want[n] = start, min(high[n], start + width[n] - 1), want[n] - before
    for n in plan:
        cut.setdefault(n, high[n])
    return cut


def shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, size, text_crc32, shard (0 to n_shards - 1), slot (gapless from 0 in each shard).

    The shards' sizes are nearly equal; a shard is a box of the metadata space, cut at hashed ties.
    """
    spark = docs.sparkSession
    store = Store(spark, "kdshard")
    rows = store.put(_dimensions(docs, id_col, text_col, source_col), "rows")
    ends = [F.min(d).alias(f"lo_{d}") for d in DIMS] + [F.max(d).alias(f"hi_{d}") for d in DIMS]
    whole = rows.agg(*ends).first()
    spread = {d: max(1, (whole[f"hi_{d}"] or 0) - (whole[f"lo_{d}"] or 0)) for d in DIMS}

    # node -> shards below it and the first of them; a leaf has one
    nodes = {1: (n_shards, 0)}
    rows = rows.withColumn("node", F.lit(1))
    while any(count > 1 for count, _ in nodes.values()):
        stats = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()}
        plan, count_left = {}, {}
        for n, (count, _) in nodes.items():
            if count > 1 and n in stats:
                s = stats[n]
                widest = max(DIMS, key=lambda d: ((s[f"hi_{d}"] - s[f"lo_{d}"]) / spread[d], -DIMS.index(d)))
                plan[n] = (widest, s[f"lo_{widest}"], s[f"hi_{widest}"], s["bytes"] * (count // 2) / count)
        cut = _cuts(rows, plan)
        moved, after = {}, {}
        for n, (count, first) in nodes.items():
            if count == 1:
                after[n] = (1, first)
                continue
            left = count // 2
            after[2 * n], after[2 * n + 1] = (left, first), (count - left, first + left)
            if n in plan:
                moved[n] = F.when(F.col(plan[n][0]) <= cut[n], 2 * n).otherwise(2 * n + 1)
        rows = rows.withColumn("node", _case(0, moved, F.col("node")))
        rows = store.put(rows, f"level{max(after)}")
        nodes = after
    rows = rows.select("id", "size", "text_crc32", _case(0, {n: F.lit(first) for n, (_, first) in nodes.items()}, F.lit(0)).cast("int").alias("shard"))

    # slots: rows in the order of (shard, id), numbered within the partitions of that order, then moved
    # by the rows before each partition
    parts = max(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(parts, "shard", "id").sortWithinPartitions("shard", "id").withColumn("at", F.monotonically_increasing_id())
    placed = store.put(placed, "placed").withColumn("part", F.shiftright("at", 33).cast("int")).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    pieces = placed.groupBy("part", "shard").agg(F.count("*").alias("rows"), F.min("at").alias("from"))
    order = Window.partitionBy("shard").orderBy("part")
    starts = pieces.withColumn("start", F.sum("rows").over(order) - F.col("rows") - F.col("from")).select("part", "shard", "start")
    # at most one row for each partition and shard
    out = placed.join(F.broadcast(starts), ["part", "shard"]).withColumn("slot", F.col("at") + F.col("start"))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
