"""What needs loops of joins: connected parts of voxels and masks, chains of merges, first matches in line."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.catalog import RELATIONS, composed, evaluate, over_tables
from ..plans.dialect import DUCK
from ..plans.shared import shared_dir, written

LEAST_POINTS = 10
MERGE_ROUNDS = 3


def label_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b); repeated nodes count once."""
    labels = _labels(edges)
    return nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("component"))


def _labels(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes that have edges: the smallest node reachable.

    Each round takes the smallest label of the neighbours and then the label of that label, so long
    chains halve; a round is a written table in the folder of spark.checkpoint.dir.
    """
    spark = edges.sparkSession
    folder = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{folder}/edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), f"{folder}/labels0")
    for i in range(1, 200):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = lower.select(F.col("node").alias("k"), F.col("next").alias("jump"))
        after = lower.join(jump, lower.next == jump.k, "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("new"), "label")
        after = written(after, f"{folder}/round{i}")
        labels = after.select("node", F.col("new").alias("label"))
        if not after.filter("new <> label").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels


def components_of(voxels: DataFrame) -> DataFrame:
    """(scene_id, iid, component, voxels, points) of each instance's connected parts, named by their smallest point.

    Voxels get numbers of their own first: points may share a number, and so may the first points of voxels.
    """
    keyed = voxels.withColumnRenamed("first_point", "least").withColumn("first_point", F.monotonically_increasing_id())
    keyed = written(keyed, f"{shared_dir(voxels.sparkSession)}/voxels-{uuid.uuid4().hex}")
    edges = evaluate(keyed.sparkSession, "voxel_neighbours", voxels=keyed)
    labels = _labels(edges)
    parts = keyed.join(labels, keyed.first_point == labels.node, "left").groupBy("scene_id", "iid", F.coalesce("label", "first_point").alias("part"))
    return parts.agg(F.min("least").alias("component"), F.count("*").alias("voxels"), F.sum("n").alias("points")).select("scene_id", "iid", "component", "voxels", "points")


def voxel_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(over_tables(spark, sf_dir, "voxels"))


def split_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of instances of 30 points and more: the largest keeps the instance's number."""
    parts = voxel_components(spark, sf_dir).filter(F.col("points") >= LEAST_POINTS)
    of = Window.partitionBy("scene_id", "iid")
    ranked = parts.withColumn("rn", F.row_number().over(of.orderBy(F.desc("points"), "component"))).withColumn("total", F.sum("points").over(of)).filter("total >= 30")
    return ranked.selectExpr("scene_id", "iid", "component", "points", "case when rn = 1 then iid else 1000 * (iid + 1) + rn end as new_iid")


def _key(scene: str, iid: str, category: str) -> Column:
    return F.concat_ws("/", scene, F.col(iid).cast("string"), category)


def _chains(spark: SparkSession, points: DataFrame) -> DataFrame:
    """(node, target, to): instances of points that are merged and where their chains end."""
    near = evaluate(spark, "spatial_merge", points=points)
    pick = Window.partitionBy("scene_id", "small", "category").orderBy(F.desc("share"), "large", "other")
    links = near.withColumn("rn", F.row_number().over(pick)).filter("rn = 1").select(_key("scene_id", "small", "category").alias("node"), _key("scene_id", "large", "other").alias("target"), F.col("large").alias("to"))
    folder = f"{shared_dir(spark)}/merged-{uuid.uuid4().hex}"
    now = written(links, f"{folder}/0")
    for i in range(1, 64):  # pointers double: chains of up to 2^63
        after = now.alias("a").join(now.alias("b"), F.col("a.target") == F.col("b.node"), "left").select("a.node", F.coalesce("b.target", "a.target").alias("target"), F.coalesce("b.to", "a.to").alias("to"), F.col("b.node").isNotNull().alias("moved"))
        after = written(after, f"{folder}/{i}")
        now = after.select("node", "target", "to")
        if not after.filter("moved").limit(1).count():
            break
    return now


def _merged(spark: SparkSession, points: DataFrame) -> DataFrame:
    """(scene_id, gid, iid): points with the instance that theirs is merged into, chains followed to their ends."""
    return points.withColumn("node", _key("scene_id", "iid", "category")).join(_chains(spark, points), "node", "left").select("scene_id", "gid", F.coalesce("to", "iid").alias("iid"))


def merged_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of every instance after instances nearly inside others are merged: (scene_id, iid, points)."""
    points = over_tables(spark, sf_dir, "points")
    instances = points.groupBy("scene_id", "iid", "category").agg(F.count("*").alias("n")).withColumn("node", _key("scene_id", "iid", "category"))
    return instances.join(_chains(spark, points), "node", "left").groupBy("scene_id", F.coalesce("to", "iid").alias("iid")).agg(F.sum("n").alias("points"))


MASK = ["scene_id", "cam", "iid"]


def _numbered_parts(runs: DataFrame) -> DataFrame:
    """Runs (scene_id, cam, iid, y, x0, x1) with their ``line`` in their mask, the mask's number and the ``component`` they are in, dealt out by mask.

    Runs meet by their row and the next; they are numbered, so that what touches need not be looked up again.
    """
    line = Window.partitionBy(*MASK).orderBy("y", "x0")
    runs = runs.filter("x1 >= x0 and iid > 0").select(*MASK, "y", "x0", "x1", F.monotonically_increasing_id().alias("node"))
    runs = runs.withColumn("line", F.row_number().over(line)).withColumn("mask", F.first("node").over(line))
    keyed = written(runs, f"{shared_dir(runs.sparkSession)}/runs-{uuid.uuid4().hex}")
    upper = keyed.select("mask", F.col("x0").alias("xa"), F.col("x1").alias("za"), F.col("node").alias("a"), F.posexplode(F.array(F.col("y"), F.col("y") + 1)).alias("down", "y"))
    lower = keyed.select("mask", "y", F.col("x0").alias("xb"), F.col("x1").alias("zb"), F.col("node").alias("b"))
    edges = upper.join(lower, ["mask", "y"]).filter("case when down = 1 then xa <= zb and xb <= za else za + 1 = xb end").select("a", "b")
    return keyed.join(_labels(edges), "node", "left").withColumn("component", F.coalesce("label", "node")).drop("label", "node").repartition("mask")


def parts_of_masks(runs: DataFrame) -> DataFrame:
    """Runs (scene_id, cam, iid, y, x0, x1) with ``part``: the number of the connected part of their mask they are in, its first in line."""
    return _numbered_parts(runs).withColumn("part", F.min("line").over(Window.partitionBy("mask", "component"))).select(*MASK, "y", "x0", "x1", "part")


def mask_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of the largest connected part of each mask, on the mask: (scene_id, cam, iid, part_px, x, y, snapped).

    The middle is the mean pixel, cut to whole numbers; if the mask does not hold it, the part's nearest pixel
    is taken, the first in line of several.  Of parts of one size the first in line counts.
    """
    return middles_of(over_tables(spark, sf_dir, "mask_runs"))


def middles_of(runs: DataFrame) -> DataFrame:
    """mask_middles of runs; a mask's parts are measured and compared in one pass over its runs."""
    part, size = Window.partitionBy("mask", "component"), F.col("x1") - F.col("x0") + 1
    sums = {"part": F.min("line"), "part_px": F.sum(size), "xx": F.sum((F.col("x0") + F.col("x1")) * size), "yy": F.sum(F.col("y") * size)}
    parts = _numbered_parts(runs).select("*", *(total.over(part).alias(name) for name, total in sums.items()))
    largest = F.max_by(F.struct("part", "part_px", "xx", "yy"), F.struct("part_px", -F.col("part"))).over(Window.partitionBy("mask"))
    met = parts.withColumn("p", largest).select("mask", *MASK, "y", "x0", "x1", F.col("part").alias("of"), "p.part", "p.part_px", F.expr("cast(p.xx div (2 * p.part_px) as int)").alias("mx"), F.expr("cast(p.yy div p.part_px as int)").alias("my"))
    on = F.max((F.col("y") == F.col("my")) & F.col("mx").between(F.col("x0"), F.col("x1"))).alias("on_mask")
    near = F.greatest("x0", F.least("mx", "x1"))
    far = (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")) + (near - F.col("mx")) * (near - F.col("mx"))
    first = F.min(F.when(F.col("of") == F.col("part"), F.struct(far.alias("far"), F.col("y").alias("y"), near.alias("x")))).alias("nearest")
    out = met.groupBy("mask", *MASK, "part_px", "mx", "my").agg(on, first)
    pick = lambda own_, other: F.when(F.col("on_mask"), F.col(own_)).otherwise(F.col(other)).cast("int")
    return out.select(*MASK, "part_px", pick("mx", "nearest.x").alias("x"), pick("my", "nearest.y").alias("y"), (~F.col("on_mask")).alias("snapped"))


def first_matches(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, first): in line, a node joins the earliest node that it is paired with and that joined none; else it stands itself.

    ``pairs`` (early, late) are of comparable nodes, early before late.  All nodes whose earlier partners are decided
    are decided at once, so a round takes a step of every chain; a round is a written table.
    """
    spark = nodes.sparkSession
    folder = f"{shared_dir(spark)}/matches-{uuid.uuid4().hex}"
    pairs = written(pairs.select("early", "late").distinct(), f"{folder}/pairs")
    state = written(pairs.select(F.col("late").alias("node")).distinct().select("node", F.lit(None).cast("boolean").alias("stands")), f"{folder}/state0")
    for i in range(1, 1000):
        # nodes without an earlier partner stand from the start and are in no state
        early = pairs.join(state.select(F.col("node").alias("early"), F.lit(True).alias("known"), "stands"), "early", "left").select("late", F.when(F.col("known").isNull(), True).otherwise(F.col("stands")).alias("stands"))
        seen = early.groupBy(F.col("late").alias("node")).agg(F.coalesce(F.max("stands"), F.lit(False)).alias("joins"), F.max(F.col("stands").isNull()).alias("waits"))
        after = state.join(seen, "node").select("node", F.coalesce("stands", F.when(F.col("joins"), False).when(~F.col("waits"), True)).alias("stands"), F.col("stands").isNull().alias("open"))
        after = written(after, f"{folder}/state{i}")
        state = after.select("node", "stands")
        if not after.filter("stands is null").limit(1).count():
            break
    else:
        raise RuntimeError("matches did not settle")
    standing = pairs.join(state.filter("not stands").select(F.col("node").alias("late")), "late").join(state.filter("not stands").select(F.col("node").alias("early")), "early", "left_anti")
    return nodes.select("node").join(standing.groupBy(F.col("late").alias("node")).agg(F.min("early").alias("first")), "node", "left").select("node", F.coalesce("first", "node").alias("first"))


def merged_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of all views as objects: a detection joins the first object of its label whose first box it overlaps by more than a fifth.

    (scene_id, label, nth, views, score, x, y, z, x0, ..., z1): boxes and middles are of all points, nth is the object's first detection.
    """
    key = lambda n: F.struct("scene_id", "label", F.col(n).alias("nth"))
    rows = written(over_tables(spark, sf_dir, "view_detections"), f"{shared_dir(spark)}/detections-{uuid.uuid4().hex}")
    pairs = evaluate(spark, "detection_pairs", view_detections=rows)
    pairs = pairs.select(key("early").alias("early"), key("late").alias("late"))
    found = first_matches(rows.select(key("nth").alias("node")), pairs)
    met = rows.withColumn("node", key("nth")).join(found, "node").groupBy("scene_id", "label", F.col("first.nth").alias("nth"))
    mean = lambda c: F.round(F.round(F.sum(c), 6) / F.sum("n"), 5)
    boxes = [F.min(f"{a}0").alias(f"{a}0") for a in "xyz"] + [F.max(f"{a}1").alias(f"{a}1") for a in "xyz"]
    return met.agg(F.count("*").alias("views"), F.round(F.round(F.sum("score"), 6) / F.count("*"), 8).alias("score"), *(mean(f"s{a}").alias(a) for a in "xyz"), *boxes)


def merge_rounds(instances: DataFrame, verdict: Callable[[DataFrame], DataFrame], rounds: int = MERGE_ROUNDS) -> DataFrame:
    """``instances`` (columns of the relation instance_sums) after rounds of merges that ``verdict`` confirms, until one confirms none.

    ``verdict`` gives (scene_id, iid_a, iid_b, small, large) of the instances at hand.  In a round pairs come in
    line; one counts unless an earlier one that counts has taken one of its instances away.  Chains of a
    round are followed to their ends, and sums and boxes add up.
    """
    spark = instances.sparkSession
    folder = f"{shared_dir(spark)}/merges-{uuid.uuid4().hex}"
    now = written(instances, f"{folder}/0")
    for i in range(1, rounds + 1):
        pairs = written(verdict(now).withColumn("node", F.struct("scene_id", "iid_a", "iid_b")), f"{folder}/pairs{i}")
        if not pairs.limit(1).count():
            break
        later = pairs.select("scene_id", F.explode(F.array("iid_a", "iid_b")).alias("small"), F.col("node").alias("late"))
        taken = pairs.select("scene_id", "small", F.col("node").alias("early")).join(later, ["scene_id", "small"]).filter("early < late").select("early", "late")
        counted = first_matches(pairs.select("node"), taken).filter("node = first").select("node")
        links = written(pairs.join(counted, "node").select("scene_id", F.col("small").alias("iid"), F.col("large").alias("target")), f"{folder}/links{i}")
        for k in range(64):  # pointers double
            step = links.alias("a").join(links.alias("b"), (F.col("a.scene_id") == F.col("b.scene_id")) & (F.col("a.target") == F.col("b.iid")), "left")
            links = written(step.select("a.scene_id", "a.iid", F.coalesce("b.target", "a.target").alias("target"), F.col("b.iid").isNotNull().alias("moved")), f"{folder}/links{i}-{k}")
            if not links.filter("moved").limit(1).count():
                break
        met = now.join(links.select("scene_id", "iid", "target"), ["scene_id", "iid"], "left").groupBy("scene_id", F.coalesce("target", "iid").alias("iid"))
        sums = [F.sum("n").alias("n"), *(F.round(F.sum(f"s{a}"), 6).alias(f"s{a}") for a in "xyz")]
        boxes = [F.min(f"{a}0").alias(f"{a}0") for a in "xyz"] + [F.max(f"{a}1").alias(f"{a}1") for a in "xyz"]
        now = written(met.agg(*sums, *boxes), f"{folder}/{i}")
    return now


def merged_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances after three rounds of merges of near pairs at most: (scene_id, iid, n, x, y, z, x0, ..., z1)."""
    done = merge_rounds(over_tables(spark, sf_dir, "instance_sums"), lambda now: evaluate(spark, "merge_verdicts", instance_sums=now))
    return done.select("scene_id", "iid", "n", *(F.round(F.col(f"s{a}") / F.col("n"), 5).alias(a) for a in "xyz"), *(f"{a}{k}" for k in "01" for a in "xyz"))


# What the loops come to, in one recursive query each; parts that share their smallest point number are ranked by it and their size.
_PARTS = """voxel_edges as (select v.scene_id, v.iid, v.vx * 4000000 + v.vy * 2000 + v.vz as k, w.vx * 4000000 + w.vy * 2000 + w.vz as l from voxels v join voxels w on v.scene_id = w.scene_id and v.iid = w.iid
    and w.vx between v.vx - 1 and v.vx + 1 and w.vy between v.vy - 1 and v.vy + 1 and w.vz between v.vz - 1 and v.vz + 1),
reached as (select distinct scene_id, iid, k, k as l from voxel_edges union select r.scene_id, r.iid, r.k, e.l from reached r join voxel_edges e on e.scene_id = r.scene_id and e.iid = r.iid and e.k = r.l),
named as (select scene_id, iid, k, min(l) as part from reached group by scene_id, iid, k),
parts as (select v.scene_id, v.iid, min(v.first_point) as component, count(*) as voxels, cast(sum(v.n) as bigint) as points from voxels v
    join named p on p.scene_id = v.scene_id and p.iid = v.iid and p.k = v.vx * 4000000 + v.vy * 2000 + v.vz group by v.scene_id, v.iid, p.part)"""
_CHAINS = """links as (select scene_id, small, category, large, other from (select *, row_number() over (partition by scene_id, small, category order by share desc, large, other) as rn from spatial_merge) a where rn = 1),
chains as (select scene_id, small, category, large, other, 1 as steps from links union select c.scene_id, c.small, c.category, l.large, l.other, c.steps + 1 from chains c join links l on l.scene_id = c.scene_id and l.small = c.large and l.category = c.other),
roots as (select scene_id, small, category, max_by(large, steps) as root from chains group by scene_id, small, category)"""


_MIDDLES = """line as (select *, row_number() over (partition by scene_id, cam, iid order by y, x0) as line from mask_runs where x1 >= x0 and iid > 0),
touch as (select scene_id, cam, iid, ya, xa, yb, xb from touching_runs union all select scene_id, cam, iid, yb, xb, ya, xa from touching_runs),
steps as (select t.scene_id, t.cam, t.iid, a.line as a, b.line as b from touch t join line a on a.scene_id = t.scene_id and a.cam = t.cam and a.iid = t.iid and a.y = t.ya and a.x0 = t.xa
    join line b on b.scene_id = t.scene_id and b.cam = t.cam and b.iid = t.iid and b.y = t.yb and b.x0 = t.xb),
reached as (select scene_id, cam, iid, line as a, line as b from line union select r.scene_id, r.cam, r.iid, r.a, s.b from reached r join steps s on s.scene_id = r.scene_id and s.cam = r.cam and s.iid = r.iid and s.a = r.b),
parted as (select l.*, r.part from line l join (select scene_id, cam, iid, a, min(b) as part from reached group by all) r on r.scene_id = l.scene_id and r.cam = l.cam and r.iid = l.iid and r.a = l.line),
sized as (select scene_id, cam, iid, part, cast(sum(x1 - x0 + 1) as bigint) as part_px, cast(sum((x0 + x1) * (x1 - x0 + 1)) as bigint) as xx, cast(sum(y * (x1 - x0 + 1)) as bigint) as yy from parted group by all),
big as (select *, xx // (2 * part_px) as mx, yy // part_px as my from (select *, row_number() over (partition by scene_id, cam, iid order by part_px desc, part) as rn from sized) a where rn = 1),
cells as (select p.scene_id, p.cam, p.iid, p.y, unnest(range(p.x0, p.x1 + 1)) as x, p.part from parted p),
hit as (select b.scene_id, b.cam, b.iid, count(*) filter (where c.x = b.mx and c.y = b.my) > 0 as on_mask from big b join cells c on c.scene_id = b.scene_id and c.cam = b.cam and c.iid = b.iid group by all),
near as (select b.scene_id, b.cam, b.iid, c.x, c.y, row_number() over (partition by b.scene_id, b.cam, b.iid order by (c.x - b.mx) * (c.x - b.mx) + (c.y - b.my) * (c.y - b.my), c.y, c.x) as rn from big b join cells c on c.scene_id = b.scene_id and c.cam = b.cam and c.iid = b.iid and c.part = b.part)"""
_MIDDLE = """select b.scene_id, b.cam, b.iid, b.part_px, cast(case when h.on_mask then b.mx else n.x end as int) as x, cast(case when h.on_mask then b.my else n.y end as int) as y, not h.on_mask as snapped
    from big b join hit h on h.scene_id = b.scene_id and h.cam = b.cam and h.iid = b.iid join near n on n.scene_id = b.scene_id and n.cam = b.cam and n.iid = b.iid and n.rn = 1"""
_FOLD = """earlier as (select v.scene_id, v.label, v.nth, coalesce(list(p.early order by p.early) filter (where p.early is not null), []) as near from view_detections v left join detection_pairs p on p.scene_id = v.scene_id and p.label = v.label and p.late = v.nth group by all),
fold as (select scene_id, label, nth, [nth] as standing, nth as first from earlier where nth = 1
    union all select e.scene_id, e.label, e.nth, case when list_has_any(f.standing, e.near) then f.standing else list_append(f.standing, e.nth) end,
    case when list_has_any(f.standing, e.near) then list_min(list_intersect(f.standing, e.near)) else e.nth end from fold f join earlier e on e.scene_id = f.scene_id and e.label = f.label and e.nth = f.nth + 1)"""
_FOLDED = """select f.scene_id, f.label, f.first as nth, count(*) as views, round(round(sum(v.score), 6) / count(*), 8) as score, """ + ", ".join(f"round(round(sum(v.s{a}), 6) / sum(v.n), 5) as {a}" for a in "xyz") + ", " + ", ".join([f"min(v.{a}0) as {a}0" for a in "xyz"] + [f"max(v.{a}1) as {a}1" for a in "xyz"]) + """
    from fold f join view_detections v on v.scene_id = f.scene_id and v.label = f.label and v.nth = f.nth group by f.scene_id, f.label, f.first"""


def _merge_rounds() -> tuple[str, str]:
    """The rounds of merges one after another; in each a fold over pairs in line that knows who is gone, and chains to their ends."""
    body = RELATIONS["merge_verdicts"](DUCK)
    parts = ["inst0 as (select * from instance_sums)"]
    for i in range(MERGE_ROUNDS):
        parts += [
            f"pair{i} as (select *, row_number() over (partition by scene_id order by iid_a, iid_b) as k from ({body.replace('instance_sums', f'inst{i}')}) v)",
            f"""fold{i} as (select scene_id, k, small, large, true as counts, [small] as gone from pair{i} where k = 1 union all select p.scene_id, p.k, p.small, p.large, not list_has_any(f.gone, [p.iid_a, p.iid_b]),
    case when list_has_any(f.gone, [p.iid_a, p.iid_b]) then f.gone else list_append(f.gone, p.small) end from fold{i} f join pair{i} p on p.scene_id = f.scene_id and p.k = f.k + 1)""",
            f"chain{i} as (select scene_id, small, large, 1 as steps from fold{i} where counts union all select c.scene_id, c.small, f.large, c.steps + 1 from chain{i} c join fold{i} f on f.counts and f.scene_id = c.scene_id and f.small = c.large)",
            f"root{i} as (select scene_id, small, max_by(large, steps) as root from chain{i} group by scene_id, small)",
            f"inst{i + 1} as (select i.scene_id, coalesce(r.root, i.iid) as iid, cast(sum(i.n) as bigint) as n, " + ", ".join(f"round(sum(s{a}), 6) as s{a}" for a in "xyz") + ", " + ", ".join([f"min({a}0) as {a}0" for a in "xyz"] + [f"max({a}1) as {a}1" for a in "xyz"]) + f" from inst{i} i left join root{i} r on r.scene_id = i.scene_id and r.small = i.iid group by 1, 2)",
        ]
    return ",\n".join(parts), "select scene_id, iid, n, " + ", ".join(f"round(s{a} / n, 5) as {a}" for a in "xyz") + ", " + ", ".join(f"{a}{k}" for k in "01" for a in "xyz") + f" from inst{MERGE_ROUNDS}"


def _recursive(relation: str, more: str, select: str) -> str:
    text = composed(relation, DUCK)
    return f"{text[: text.rindex('select * from')].replace('with ', 'with recursive ', 1).rstrip()},\n{more}\n{select}"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the loops, by recursion."""
    split = f"""select scene_id, iid, component, points, case when rn = 1 then iid else 1000 * (iid + 1) + rn end as new_iid from (
        select *, row_number() over (partition by scene_id, iid order by points desc, component) as rn, sum(points) over (partition by scene_id, iid) as total from parts where points >= {LEAST_POINTS}) a where total >= 30"""
    merged = "select p.scene_id, coalesce(r.root, p.iid) as iid, count(*) as points from points p left join roots r on r.scene_id = p.scene_id and r.small = p.iid and r.category = p.category group by 1, 2"
    more = {"mask_middles": _recursive("touching_runs", _MIDDLES, _MIDDLE), "merged_detections": _recursive("detection_pairs", _FOLD, _FOLDED), "merged_instances": _recursive("instance_sums", *_merge_rounds())}
    return more | {"voxel_components": _recursive("voxels", _PARTS, "select * from parts"), "split_components": _recursive("voxels", _PARTS, split), "merged_points": _recursive("spatial_merge", _CHAINS, merged)}


__all__ = ["components_of", "first_matches", "label_components", "mask_middles", "merge_rounds", "merged_detections", "merged_instances", "merged_points", "oracle_sql", "parts_of_masks", "split_components", "voxel_components"]
