"""A catalog of relations.

A relation is a SELECT over other relations, written once as a function of the dialect.  A query is
composed of a relation and all it needs as common table expressions, so Catalyst sees one plan: filters
reach the scans, unused columns go, joins are chosen by size.  Any relation can be replaced by a
DataFrame: that is how scenes read from files take the place of those derived from tables.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .dialect import SPARK, Spark
from .shared import length, once

Body = Callable[[Spark], str]
RELATIONS: dict[str, Body] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# Shorter bodies for the engine, with the relations in between that they do without.
SHORTER: dict[str, tuple[tuple[str, ...], Body]] = {}
# Written once a session and source, if a query needs them; later ones are made from earlier ones.
SHARED = ("instances", "merge_votes", "seen", "surface_views", "placement_pixels", "placement_views", "pointed", "few_answers", "chosen_questions")
# Settings that relations name as :name; an evaluation may give others.
PARAMETERS: dict[str, object] = {"min_thickness": 0.08, "min_visible": 0.5, "dot_visible": 0.9, "size_visible": 0.6, "shrink": 0.85, "voxel": 0.1, "still": 0.001}


def relation(body: Body) -> Body:
    """Register a relation under the function's name."""
    if body.__name__ in RELATIONS or body.__name__ in TABLES:
        raise ValueError(f"{body.__name__} is registered already")
    RELATIONS[body.__name__] = body
    return body


def shorter(name: str, *between: str) -> Callable[[Body], Body]:
    """Register the engine's body of a relation; it counts unless a relation in between is given."""

    def register(body: Body) -> Body:
        SHORTER[name] = (between, body)
        return body

    return register


def composed(name: str, dialect: Spark, given: Mapping[str, str] | None = None, parameters: Mapping[str, object] | None = None) -> str:
    """The SQL of a relation with all it needs; ``given`` maps names to what stands for them.

    ``parameters`` replace the defaults of PARAMETERS.
    """
    given = given or {}
    settings = PARAMETERS | dict(parameters or {})
    if unknown := set(settings) - set(PARAMETERS):
        raise ValueError(f"no such parameters: {', '.join(sorted(unknown))}")
    order: list[str] = []
    texts: dict[str, str] = {}
    short = {n: body for n, (between, body) in SHORTER.items() if dialect.name == "spark" and not set(between) & set(given)}

    def visit(n: str, path: tuple[str, ...]) -> None:
        if n in texts or n in given:
            return
        if n in path:
            raise ValueError(f"relations in a circle: {' > '.join((*path, n))}")
        texts[n] = re.sub(r"(?<![:\w]):([a-z_]+)\b", lambda m: f"cast({settings[m[1]]!r} as double)" if m[1] in settings else m[0], short.get(n, RELATIONS[n])(dialect).strip())
        for m in dict.fromkeys(re.findall(r"\b(?:from|join)\s+([a-z_][a-z_0-9]*)\b", texts[n], re.I)):
            if m in RELATIONS and m != n:
                visit(m, (*path, n))
        order.append(n)

    visit(name, ())
    heads = [f"{n} as (select * from {source})" for n, source in given.items()]
    return "with " + ",\n".join(heads + [f"{n} as ({texts[n]})" for n in order]) + f"\nselect * from {name}"


# Bytes of the sources for each partition of a shuffle, and what a task reads of a shuffle where partitions are put together.
PARTITION_BYTES, TASK_BYTES, PARTITIONS = 1 << 20, 16 << 20, 8192


def _tasks(spark: SparkSession, text: str, size: int) -> str:
    """Hints of 64 partitions as many as the cluster's cores can share, as shuffles have, and as the sources' bytes ask for.

    The session's shuffles begin with as many, so that what a task holds does not grow with the tables; small ones are put together.
    """
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = min(PARTITIONS, size // PARTITION_BYTES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(shuffles, many)))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    n = max(2 * spark.sparkContext.defaultParallelism, shuffles, many)
    return text.replace("repartition(64,", f"repartition({n},")


def planner(spark: SparkSession) -> SparkSession:
    """A copy of the session that plans without constraint propagation.

    The relations' filters stand where they are needed; inferring more of them from chains of geometry
    takes the optimizer minutes.  The session itself keeps its settings.
    """
    copy = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    copy.conf.set("spark.sql.constraintPropagation.enabled", "false")
    return copy


def _read_bytes(frames: Mapping[str, DataFrame]) -> int:
    """Bytes of what frames are read from; sources of unknown size count nothing."""
    total = 0
    for frame in frames.values():
        leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        total += sum(s for s in sizes if s < 1 << 45)
    return total


def evaluate(spark: SparkSession, name: str, parameters: Mapping[str, object] | None = None, **frames: DataFrame) -> DataFrame:
    """The relation over DataFrames given by name (objects=..., cameras=..., ...)."""
    views = {n: f"roomlake_{n}_{uuid.uuid4().hex}" for n in frames}
    try:
        for n, view in views.items():
            frames[n].createGlobalTempView(view)  # frames may be of other sessions
        copy = planner(spark)
        return copy.sql(_tasks(copy, composed(name, SPARK, {n: f"global_temp.{view}" for n, view in views.items()}, parameters), _read_bytes(frames)))
    finally:
        for view in views.values():
            spark.catalog.dropGlobalTempView(view)


def used_tables(text: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b(?:from|join)\s+{t}\b", text, re.I)]


def over_tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation over the parquet tables of a folder; relations of SHARED that it needs are written once."""
    return _over_tables(planner(spark), sf_dir, name, SHARED[: SHARED.index(name)] if name in SHARED else SHARED)


def _over_tables(spark: SparkSession, sf_dir: str, name: str, share: tuple[str, ...]) -> DataFrame:
    needed = composed(name, SPARK)
    given: dict[str, DataFrame] = {}
    # the last first: what it is made from need not be given as well
    for n in reversed(share):
        if re.search(rf"^(?:with )?{n} as \(", needed, re.M):
            paths = [f"{sf_dir}/{t}.parquet" for t in used_tables(composed(n, SPARK))]
            given[n] = once(spark, n, paths, lambda n=n: _over_tables(spark, sf_dir, n, share[: share.index(n)]))
            needed = composed(name, SPARK, {n: "{" + n + "}" for n in given})
    text = needed
    used = used_tables(text)
    for t in used:
        text = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", text, flags=re.I)
    size = length(spark, [f"{sf_dir}/{t}.parquet" for t in used_tables(composed(name, SPARK))])
    return spark.sql(_tasks(spark, text, size), **given, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
