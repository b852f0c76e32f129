"""Embedding near-dedup: cosine threshold pairs by dual traversal of cover trees.

Unit vectors have cosine >= c just when their distance is at most sqrt(2 - 2 c).  Equal directions
are one point with a count.  Points are dealt to blocks by the top of the tree: each goes to the nearest
of PIVOTS sampled centres, and a cell larger than BLOCK is divided again by centres of its own, until all
fit.  Every block gets a cover tree below that: nested nets of centres, each net's radius half that of the
one above, at any width, each node with its covering radius and its number of points.

Two nodes are pruned when their centres are further apart than the threshold and both covering radii;
when every pair within them must link they are counted as a whole and joined at their centres; otherwise
the wider one gives way to its children, all of whose distances are found at once.  Leaves are compared
by exact cosines in double precision.  Pairs of blocks are pruned by the same bound first.

What leaves a task is, for each point, its number of links, and a spanning forest of the links, never
the links themselves; so groups of copies of any size cost no quadratic output.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors of different lengths.  Rows that share an id are one vector: that of the smallest usable one, and one
row comes out; the others of the id are no partners.  Rows without an id come out one by one, link with nothing and
are kept.  Ties cannot arise: links are counted and components named by their smallest id.  Other
columns are left out, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import give_back, lean
from .components import components, with_component
from .store import Store
from .vectors import matrix, usable

PIVOTS = 64  # sampled centres of a cell; a bound on what the driver holds for each
BLOCK = 4096  # rows of a block, at most, where centres can divide them
ROUNDS = 12  # of division; cells that are larger then are divided by their order
LEAF = 16  # points that are compared directly
BUNDLES = 16  # of blocks, if there are as many; a bundle's blocks meet others together, each of which is sent to it once
SHARES = 4  # tasks of a bundle, each with its share of the others
HELD = 64 << 20  # bytes of vectors of a bundle, at most, if it has several blocks
SLACK = 1e-7  # of distance bounds, for rounding


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y)))


def net(x: np.ndarray, radius: float) -> np.ndarray:
    """For each row the row that is its centre: centres are further than ``radius`` apart and cover all within it.

    Rows come in order; one that no centre covers becomes a centre.  Distances are found in runs.
    """
    own = np.full(len(x), -1)
    near = 1 - radius * radius / 2  # as a cosine
    centres = np.zeros(0, np.int64)
    for s in range(0, len(x), 512):
        run = x[s : s + 512]
        if len(centres):
            cos = run @ x[centres].T
            best = cos.argmax(axis=1)
            hit = cos[np.arange(len(run)), best] >= near
            own[s : s + 512][hit] = centres[best[hit]]
        left = np.flatnonzero(own[s : s + 512] < 0)
        among = run[left] @ run[left].T >= near
        np.fill_diagonal(among, True)
        free = np.ones(len(left), bool)
        own[s + left] = s + left
        # only rows near another of the run need an order
        for i in np.flatnonzero(among.sum(axis=1) > 1):
            if free[i]:
                covers = among[i] & free
                own[s + left[covers]] = s + left[i]
                free[covers] = False
        centres = np.concatenate([centres, s + left[own[s + left] == s + left]])
    return own


class Node:
    """Points start..end of a tree, their centre first, within ``radius`` of it; children once it is divided."""

    __slots__ = ("start", "end", "radius", "scale", "starts", "radii", "below")

    def __init__(self, start: int, end: int, radius: float, scale: float):
        self.start, self.end, self.radius, self.scale = start, end, radius, scale
        self.starts: np.ndarray | None = None
        self.radii = np.zeros(0)
        self.below: dict[int, Node] = {}

    def child(self, k: int) -> Node:
        if k not in self.below:
            end = self.starts[k + 1] if k + 1 < len(self.starts) else self.end
            self.below[k] = Node(int(self.starts[k]), int(end), float(self.radii[k]), self.scale)
        return self.below[k]


class Tree:
    """A cover tree of unit vectors, divided where a traversal goes.

    ``perm`` has the places that the points had at first: dividing a node reorders its points.
    """

    def __init__(self, x: np.ndarray, starts: np.ndarray | None = None, radii: np.ndarray | None = None, scale: float = 2.0):
        self.x, self.perm = np.array(x), np.arange(len(x))
        radius = float(_distance(self.x, self.x[0]).max()) if len(x) > 1 else 0.0
        self.root = Node(0, len(x), radius, min(scale, max(radius, 1e-9)) if starts is None else scale)
        if starts is not None and len(starts) > 1:
            self.root.starts, self.root.radii = starts, radii
        self.single = self.x.astype(np.float32)

    def leaf(self, node: Node) -> bool:
        """Whether a node's points are compared directly; a node that is not is divided."""
        if node.starts is not None:
            return False
        if node.end - node.start <= LEAF or node.radius < 1e-6:
            return True
        own = self.x[node.start : node.end]
        scale = node.scale
        while scale > 1e-7:
            scale /= 2
            centre = net(own, scale)
            if (centre != centre[0]).any():
                break
        else:
            node.radius = min(node.radius, 1e-6)
            return True
        n = len(own)
        order = np.lexsort((np.arange(n), centre != np.arange(n), centre))
        far = np.sqrt(np.maximum(0.0, 2 - 2 * (own * own[centre]).sum(axis=1)))[order]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(centre[order]) != 0]))
        self.x[node.start : node.end] = own[order]
        self.single[node.start : node.end] = self.x[node.start : node.end].astype(np.float32)
        self.perm[node.start : node.end] = self.perm[node.start : node.end][order]
        far[starts] = 0.0
        node.starts, node.radii, node.scale = starts + node.start, np.maximum.reduceat(far, starts), scale
        return False


class Links:
    """A spanning forest of the links between the points of two blocks, by whole arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[np.ndarray] = []

    def find(self, i: int) -> int:
        return int(self.root[i])

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Link i[k] and j[k] for all k; of pairs that join the same two trees one is kept."""
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            high, low = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((low, high))
            first = order[np.flatnonzero(np.concatenate([[True], np.diff(high[order]) != 0]))]
            self.root[high[first]] = low[first]  # roots only get smaller, so that no circle arises
            self.edges.append(np.stack([i[first], j[first]], axis=1))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def forest(self) -> np.ndarray:
        return np.concatenate([np.zeros((0, 2), np.int64), *self.edges])


class Work:
    """What a traversal did: node pairs looked at, pruned, counted as a whole, and pairs of points compared."""

    def __init__(self) -> None:
        self.looked = self.pruned = self.whole = self.compared = 0


ROUGH = 1e-5  # of cosines in single precision
PAIRS = 1 << 20  # whose distances are found at once
FEW = 1 << 16  # pairs of points of nodes hardly larger than the threshold that are compared at once
DENSE = 0.05  # share of pairs of children above which bounds are of no use


def _survivors(x: np.ndarray, rx: np.ndarray, y: np.ndarray, ry: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes (centres in single precision, covering radii) that the bound does not prune."""
    out_i, out_j = [], []
    points_x, points_y = rx == 0, ry == 0
    for rows in (points_x, ~points_x):
        for columns in (points_y, ~points_y):
            i, j = np.flatnonzero(rows), np.flatnonzero(columns)
            if not len(i) or not len(j):
                continue
            reach = limit if rx[i[0]] == 0 and ry[j[0]] == 0 else np.minimum(2.0, limit + rx[i][:, None] + ry[j][None, :])
            u, v = np.nonzero(x[i] @ y[j].T >= 1 - reach * reach / 2 - ROUGH)
            out_i.append(i[u]), out_j.append(j[v])
    return np.concatenate([np.zeros(0, int), *out_i]), np.concatenate([np.zeros(0, int), *out_j])


def dual(one: Tree, wx: np.ndarray, two: Tree, wy: np.ndarray, cosine: float, work: Work | None = None) -> tuple[np.ndarray, np.ndarray, Links]:
    """Numbers of links of the trees' points (weighted by counts), and their forest.

    With one tree twice each pair counts once for either side; two's points stand after one's in the forest.
    """
    same = one is two
    at = 0 if same else len(one.x)
    limit = float(np.sqrt(2 - 2 * cosine)) + SLACK
    nx, ny = np.zeros(len(one.x), np.int64), np.zeros(len(two.x), np.int64)
    links, work = Links(at + len(two.x)), work or Work()

    def linked(i: np.ndarray, j: np.ndarray) -> None:
        """Count pairs of places that link."""
        nonlocal nx, ny
        if not len(i):
            return
        a, b = one.perm[i], two.perm[j]
        nx += np.bincount(a, wy[b], len(nx)).astype(np.int64)
        if not same:
            ny += np.bincount(b, wx[a], len(ny)).astype(np.int64)
        links.join(a, b + at)

    def compared(start: int, end: int, q: Node) -> None:
        """Compare one's points start..end with those of a node directly."""
        work.compared += (end - start) * (q.end - q.start)
        step = max(1, PAIRS // (q.end - q.start))
        for s in range(start, end, step):
            i, j = np.nonzero(one.x[s : min(end, s + step)] @ two.x[q.start : q.end].T >= cosine)
            linked(i + s, j + q.start)

    stack = [(one.root, two.root)]
    while stack:
        p, q = stack.pop()
        leaf_p, leaf_q = one.leaf(p), two.leaf(q)
        few = (p.end - p.start) * (q.end - q.start) <= FEW and p.radius + q.radius < 2 * limit
        if leaf_p and leaf_q or few:
            compared(p.start, p.end, q)
            continue
        # the wider node gives way to its children, or both do
        down_p, down_q = not leaf_p and (leaf_q or 2 * p.radius >= q.radius), not leaf_q and (leaf_p or 2 * q.radius >= p.radius)
        a, ra = (p.starts, p.radii) if down_p else (np.array([p.start]), np.array([p.radius]))
        b, rb = (q.starts, q.radii) if down_q else (np.array([q.start]), np.array([q.radius]))
        na, nb = np.diff(np.append(a, p.end)), np.diff(np.append(b, q.end))
        step = max(1, PAIRS // len(b))
        for s in range(0, len(a), step):
            part = slice(s, s + step)
            i, j = _survivors(one.single[a[part]], ra[part], two.single[b], rb, limit)
            work.looked += len(a[part]) * len(b)
            if len(i) > max(4096, DENSE * len(a[part]) * len(b)) and ra[part].max() + rb.max() < 2 * limit:
                # children hardly larger than the threshold, many near each other: bounds prune little, and their points are compared at once
                end = a[s + step] if s + step < len(a) else p.end
                compared(int(a[s]), int(end), q)
                continue
            work.pruned += len(a[part]) * len(b) - len(i)
            i = i + s
            points = (na[i] == 1) & (nb[j] == 1)
            work.compared += int(points.sum())
            u, v = a[i[points]], b[j[points]]
            for c in range(0, len(u), 65_536):
                hit = (one.x[u[c : c + 65_536]] * two.x[v[c : c + 65_536]]).sum(axis=1) >= cosine
                linked(u[c : c + 65_536][hit], v[c : c + 65_536][hit])
            for k, m in zip(i[~points].tolist(), j[~points].tolist()):
                left, right = p.child(k) if down_p else p, q.child(m) if down_q else q
                d = float(_distance(one.x[left.start], two.x[right.start]))
                if d - left.radius - right.radius > limit:
                    work.pruned += 1
                elif d + left.radius + right.radius < limit - 1e-5:  # all pairs link
                    work.whole += 1
                    x, y = one.perm[left.start : left.end], two.perm[right.start : right.end]
                    nx[x] += wy[y].sum()
                    if not same:
                        ny[y] += wx[x].sum()
                    links.join(np.concatenate([np.full(len(y), x[0]), x]), np.concatenate([y, np.full(len(x), y[0])]) + at)
                else:
                    stack.append((left, right))
    return nx, ny, links


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, v) as (id, unit vector as bytes); zero vectors go."""
    for batch in batches:
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        for size in np.unique(sizes):
            part = batch.take(pa.array(np.flatnonzero(sizes == size)))
            m = matrix(part.column(1))
            big = np.abs(m).max(axis=1)
            keep = big > 0
            m = m[keep] / big[keep, None]
            m /= np.sqrt((m * m).sum(axis=1))[:, None]
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep)), pa.array([int(size)] * len(m), pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())], names=["id", "dims", "unit"])


def _cells(points: DataFrame, store: Store) -> DataFrame:
    """``points`` with ``cell``: a block's number; cells are divided by sampled centres until they hold at most BLOCK rows.

    What the driver holds is PIVOTS centres for each cell that is divided, at most one for each BLOCK / PIVOTS rows.
    """
    spark = points.sparkSession
    placed = store.put(points.withColumn("cell", F.col("dims").cast("long")), "cells0")
    following = 1 << 32  # numbers of cells above all vector lengths
    for i in range(1, ROUNDS + 1):
        sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).collect()}
        large = list(sizes)
        if not large:
            break
        inside = placed.filter(F.col("cell").isin(large)) if len(large) <= 1000 else placed.join(F.broadcast(spark.createDataFrame([(c,) for c in large], "cell long")), "cell", "left_semi")
        rank = F.row_number().over(Window.partitionBy("cell").orderBy("h", "rep"))  # a group limit comes before the shuffle
        sample = inside.withColumn("h", F.xxhash64("rep", F.lit(i))).withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).select("cell", "unit").toArrow()
        centres: dict[int, np.ndarray] = {}
        cells = sample.column("cell").to_numpy()
        units = sample.column("unit").to_pylist()
        for c in large:
            # twice as many centres as blocks are needed
            some = np.flatnonzero(cells == c)[: max(2, -(-2 * sizes[c] // BLOCK))]
            centres[c] = np.stack([np.frombuffer(units[k], np.float64) for k in some.tolist()])
        base = {c: following + k * PIVOTS for k, c in enumerate(large)}
        following += len(large) * PIVOTS
        spread = spark.sparkContext.broadcast((centres, base))

        def place(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            centres, base = spread.value
            for batch in batches:
                cell = batch.column("cell").to_numpy().copy()
                for c in np.unique(cell).tolist():
                    if c in base:
                        at = np.flatnonzero(cell == c)
                        rows = np.stack([np.frombuffer(u.as_buffer(), np.float64) for u in batch.column("unit").take(pa.array(at))])
                        cell[at] = base[c] + (rows @ centres[c].T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cell)], names=batch.schema.names)

        placed = store.put(placed.mapInArrow(lean(place), "dims int, unit binary, rep long, copies long, cell long"), f"cells{i}")
        store.drop(f"cells{i - 1}")
    return placed


def _block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """A cell's points as one row, in the order of their tree, with its first net, a centre and the covering radius."""
    rows = rows.sort_by("rep")
    x = np.frombuffer(b"".join(rows.column("unit").to_pylist()), np.float64).reshape(rows.num_rows, -1)
    order = np.roll(np.arange(len(x)), -int((x @ x.mean(axis=0)).argmax()))
    tree = Tree(x[order])
    whole = tree.leaf(tree.root)
    order = order[tree.perm]
    starts = np.zeros(1, np.int64) if whole else tree.root.starts
    radii = np.array([tree.root.radius]) if whole else tree.root.radii
    ints = lambda c: pa.array([rows.column(c).to_numpy()[order].astype(np.int64).tobytes()], pa.binary())
    first = rows.slice(0, 1).select(["cell", "part", "dims"])
    more = {"centre": pa.array([tree.x[0].tobytes()], pa.binary()), "radius": pa.array([tree.root.radius]), "scale": pa.array([tree.root.scale]), "reps": ints("rep"), "w": ints("copies"), "units": pa.array([tree.x.tobytes()], pa.binary()), "starts": pa.array([starts.astype(np.int64).tobytes()], pa.binary()), "radii": pa.array([radii.tobytes()], pa.binary())}
    for name, values in more.items():
        first = first.append_column(name, values)
    give_back()
    return first


def _tree(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, Tree]:
    """(ids, counts, tree) of a row."""
    r, w, starts = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("reps", "w", "starts"))
    x, radii = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64) for c in ("units", "radii"))
    return r, w, Tree(x.reshape(len(r), -1), starts, radii, batch.column("scale")[i].as_py())


def _met(cosine: float):
    """Tasks' rows (task, ord, block, meets): a bundle's blocks at ord -1, then those that some of them (``meets``) are compared with (at ord 0 themselves)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, Tree]] = {}
        task = None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("task")[i].as_py() != task:
                    task, held = batch.column("task")[i].as_py(), {}
                order = batch.column("ord")[i].as_py()
                if order < 0:
                    held[batch.column("g")[i].as_py()] = _tree(batch, i)
                    continue
                other = _tree(batch, i) if order else None
                for g in batch.column("meets")[i].as_py():
                    r1, w1, one = held[g]
                    r2, w2, two = other or held[g]
                    n1, n2, links = dual(one, w1, two, w2, cosine)
                    ids = r1 if order == 0 else np.concatenate([r1, r2])
                    n = n1 if order == 0 else np.concatenate([n1, n2])
                    at = np.flatnonzero(n)
                    e = links.forest()
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[at], ids[e[:, 0]]])), pa.array(np.concatenate([np.full(len(at), -1), ids[e[:, 1]]])), pa.array(np.concatenate([n[at], np.zeros(len(e), np.int64)]))], names=["a", "b", "n"])

    return lean(run)


def _dealt(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (task, ord, block, meets) for _met: blocks (g, size, ...) and the ``pairs`` (g, h) of them that meet.

    Blocks are bundled in an order of their own.  Of two bundles one holds its blocks and gets each block of the
    other once for all that it meets there, so what is sent are about BUNDLES / 2 + SHARES copies of the vectors.
    What the driver holds are two numbers for each block.
    """
    spark = blocks.sparkSession
    sizes = blocks.select("g", "size").orderBy("g").collect()
    target = max(1, min(HELD, -(-sum(r["size"] for r in sizes) // BUNDLES)))
    bundled, bundle, room = [], -1, 0
    for nth, r in enumerate(sizes):
        if room < r["size"] / 2:
            bundle, room = bundle + 1, room + target if bundle >= 0 else target
        room -= r["size"]
        bundled.append((int(r["g"]), bundle, nth))
    shares = SHARES if len(sizes) > 1 else 1
    known = F.broadcast(spark.createDataFrame(bundled, "g long, bundle long, nth long"))
    other = F.broadcast(spark.createDataFrame(bundled, "h long, bundle2 long, nth2 long"))
    rest = [c for c in blocks.columns if c not in ("g", "size")]
    nothing = F.array().cast("array<long>").alias("meets")
    held = blocks.join(known, "g").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    first = held.select((F.col("bundle") * shares + F.col("share")).alias("task"), F.lit(-1).alias("ord"), "g", nothing, *rest)
    empty = [(F.lit(0.0) if c == "scale" else F.lit(b"")).alias(c) for c in rest]
    itself = known.select((F.col("bundle") * shares + F.col("nth") % shares).alias("task"), F.lit(0).alias("ord"), "g", F.array("g").alias("meets"), *empty)
    # bundles take turns in holding
    turn = F.when(F.col("bundle") == F.col("bundle2"), F.col("nth") < F.col("nth2")).otherwise(((F.col("bundle") + F.col("bundle2")) % 2 == 1) == (F.col("bundle") < F.col("bundle2")))
    both = pairs.join(known, "g").join(other, "h").withColumn("turn", turn)
    which = lambda a, b, name: F.when(F.col("turn"), F.col(a)).otherwise(F.col(b)).alias(name)
    asked = both.select(which("bundle", "bundle2", "b"), which("g", "h", "own"), which("h", "g", "sent"), which("nth2", "nth", "n")).groupBy("b", "sent", "n").agg(F.collect_list("own").alias("meets"))
    second = asked.join(blocks.withColumnRenamed("g", "sent"), "sent").select((F.col("b") * shares + F.col("n") % shares).alias("task"), F.lit(1).alias("ord"), F.col("sent").alias("g"), "meets", *rest)
    tasks = max(1, (bundle + 1) * shares)
    return first.union(itself).union(second).repartitionById(tasks, F.col("task").cast("int")).sortWithinPartitions("task", "ord")


def _near_blocks(limit: float):
    """Which pairs (radius, centre, other radius, other centre) of blocks may hold a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for r, c, s, d in zip(*(batch.column(k) for k in ("radius", "centre", "radius2", "centre2"))):
                one, two = np.frombuffer(c.as_buffer(), np.float64), np.frombuffer(d.as_buffer(), np.float64)
                keep.append(float(_distance(one, two)) - r.as_py() - s.as_py() <= limit)
            yield pa.RecordBatch.from_arrays([batch.column("g").filter(pa.array(keep)), batch.column("h").filter(pa.array(keep))], names=["g", "h"])

    return lean(run)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector: id, n_links (others with cosine >= ``cosine``), component_id, kept."""
    spark = vectors.sparkSession
    store = Store(spark, "covertree")
    every = vectors.select(F.col(id_col).cast("long").alias("id"))
    rows = vectors.filter(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    units = store.put(rows.mapInArrow(lean(_unit), "id long, dims int, unit binary").groupBy("id").agg(F.min(F.struct("dims", "unit")).alias("u")).select("id", "u.dims", "u.unit"), "units")
    points = units.groupBy("dims", "unit").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).select("dims", "unit", "rep", "copies")
    placed = _cells(points, store)
    # cells that no centres could divide, and none else, are divided by order
    sizes = placed.groupBy("cell").agg(F.count("*").alias("rows"))
    dealt = placed.join(sizes, "cell").withColumn("part", F.when(F.col("rows") > 4 * BLOCK, F.pmod(F.xxhash64("rep"), F.ceil(F.col("rows") / BLOCK))).otherwise(0).cast("int"))
    blocks = dealt.groupBy("cell", "part").applyInArrow(_block, "cell long, part int, dims int, centre binary, radius double, scale double, reps binary, w binary, units binary, starts binary, radii binary")
    blocks = store.put(blocks.withColumn("g", F.xxhash64("cell", "part")), "blocks")
    # a few numbers and one vector for each block: all pairs of blocks, pruned by their covering radii
    heads = blocks.select("g", "dims", "radius", "centre")
    others = heads.select(F.col("g").alias("h"), F.col("dims").alias("dims2"), F.col("radius").alias("radius2"), F.col("centre").alias("centre2"))
    close = heads.join(others, (F.col("dims") == F.col("dims2")) & (F.col("g") < F.col("h"))).select("g", "radius", "centre", "h", "radius2", "centre2")
    limit = float(np.sqrt(2 - 2 * cosine)) + SLACK
    pairs = store.put(close.mapInArrow(_near_blocks(limit), "g long, h long"), "pairs")
    body = ("scale", "reps", "w", "units", "starts", "radii")
    dealt = _dealt(blocks.select("g", F.length("units").alias("size"), *body), pairs)
    met = store.put(dealt.mapInArrow(_met(cosine), "a long, b long, n long"), "met")
    # a point meets itself (all its copies) once
    counted = met.filter("n > 0").groupBy(F.col("a").alias("rep")).agg((F.sum("n") - 1).alias("n_links"))
    found = components(met.filter("n = 0").select("a", "b"), store)
    known = with_component(placed.select("dims", "unit", "rep").join(counted, "rep"), found, "rep")
    out = units.join(known, ["dims", "unit"]).select("id", "n_links", F.col("component_id").alias("comp"))
    ids = every.filter("id is not null").distinct().union(every.filter("id is null"))
    out = ids.join(out, "id", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "id").alias("component_id"))
    store.drop("blocks", "pairs")
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
