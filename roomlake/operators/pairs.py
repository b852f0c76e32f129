"""Questions about two, three or more objects in one view.

Where any valid choice would do, the one with the smallest MD5 of its key is taken: uniform over all
valid choices, in any order of rows and partitions.
"""

from __future__ import annotations

from ..functions import geometry as g
from ..plans.catalog import relation
from ..plans.dialect import Spark


def least_per_view(columns: tuple[str, ...], key: str, source: str, first: str = "") -> str:
    """The row of a view with the smallest MD5 of ``key``, by an aggregate: candidates are never sorted.

    A number ``first`` comes before the hash.
    """
    picked = ", ".join(f"min_by({c}, h) as {c}" for c in columns)
    before = f"cast({first} as string), " if first else ""
    return f"select scene_id, cam, {picked} from (select scene_id, cam, {', '.join(columns)}, concat({before}md5({key}), {key}) as h from ({source}) p) q group by scene_id, cam"


PAIR = "from spread_dotted a join dotted b on a.scene_id = b.scene_id and a.cam = b.cam and a.id <> b.id"
KEY = "concat(scene_id, cam, id_a, '|', id_b)"


@relation
def spread_dotted(d: Spark) -> str:
    """Objects that may carry a dot, dealt out by view; a comment to the oracle."""
    return "select /*+ repartition(64, scene_id, cam) */ * from dotted"


@relation
def closest_object(d: Spark) -> str:
    return least_per_view(("id_a", "id_b", "answer", "gap"), KEY, f"""select a.scene_id, a.cam, a.id as id_a, b.id as id_b, case when a.distance <= b.distance then a.label else b.label end as answer, round(abs(a.distance - b.distance), 6) as gap
        {PAIR} where a.label <> b.label and abs(a.distance - b.distance) >= 0.5""")


@relation
def object_distance(d: Spark) -> str:
    far = g.norm("a.cx - b.cx", "a.cy - b.cy", "a.cz - b.cz")
    return least_per_view(("id_a", "id_b", "answer"), KEY, f"select a.scene_id, a.cam, a.id as id_a, b.id as id_b, round({far}, 2) as answer {PAIR} where {far} >= 0.5")


@relation
def depth_difference(d: Spark) -> str:
    """Objects half a metre apart in depth; of different types where a view has such."""
    return least_per_view(("id_a", "id_b", "answer"), f"{KEY}", f"""select a.scene_id, a.cam, a.id as id_a, b.id as id_b, round(abs(a.depth - b.depth), 2) as answer,
        case when a.base_type = b.base_type then 1 else 0 end as later {PAIR} where abs(a.depth - b.depth) >= 0.5""", first="later")


@relation
def relative_direction(d: Spark) -> str:
    right, ahead = g.dot(("(a.cx - b.cx)", "(a.cy - b.cy)"), ("a.rx", "a.ry")), g.dot(("(a.cx - b.cx)", "(a.cy - b.cy)"), ("a.dx2", "a.dy2"))
    up = "(a.cz - b.cz)"
    words = f"concat({g.side(right, 'right', 'left', 0.1)}, ', ', {g.side(up, 'above', 'below', 0.1)}, ', ', {g.side(ahead, 'farther', 'closer', 0.1)})"
    return least_per_view(("id_a", "id_b", "answer"), KEY, f"""select a.scene_id, a.cam, a.id as id_a, b.id as id_b, {words} as answer
        from spread a join visible b on a.scene_id = b.scene_id and a.cam = b.cam and a.id <> b.id where abs({right}) > 0.1 or abs({up}) > 0.1 or abs({ahead}) > 0.1""")


@relation
def camera_object_position(d: Spark) -> str:
    ahead = g.dot(("cx - px", "cy - py"), ("dx2", "dy2"))
    words = f"concat({g.side('across', 'right', 'left', 0.1)}, ', ', {g.side('(cz - pz)', 'above', 'below', 0.1)}, ', ', {g.side(ahead, 'front', 'behind', 0.1)})"
    return f"""select scene_id, cam, id, answer from (select scene_id, cam, id, {words} as answer, row_number() over (partition by scene_id, cam, type order by ord) as rn
        from visible where abs(u - 0.5) >= 0.15 and abs(v - 0.5) >= 0.15) a where rn = 1"""


@relation
def spread(d: Spark) -> str:
    """Visible objects dealt out by view, so that joins of three and four of few rows get many tasks; a comment to the oracle."""
    return "select /*+ repartition(64, scene_id, cam) */ * from visible"


@relation
def depth_ordering(d: Spark) -> str:
    """Three objects with distinct depths: a metre apart in all or by a factor of 1.3."""
    low, high = "least(a.depth, b.depth, c.depth)", "greatest(a.depth, b.depth, c.depth)"
    return least_per_view(("first", "second", "third"), "concat(scene_id, cam, first, '|', second, '|', third)", f"""select a.scene_id, a.cam, a.id as first, b.id as second, c.id as third
        from spread a join visible b on a.scene_id = b.scene_id and a.cam = b.cam and a.depth < b.depth join visible c on a.scene_id = c.scene_id and a.cam = c.cam and b.depth < c.depth
        where {low} > 0 and not ({high} - {low} < 1.0 and {high} / {low} < 1.3)""")


@relation
def route_planning(d: Spark) -> str:
    """Start at one object facing another, go to a third: the turn."""
    one, two = ("(b.cx - a.cx)", "(b.cy - a.cy)"), ("(c.cx - a.cx)", "(c.cy - a.cy)")
    angle = f"degrees(atan2(({one[0]}) * ({two[1]}) - ({one[1]}) * ({two[0]}), {g.dot(one, two)}))"
    apart = " and ".join(f"{g.norm(f'{p}.cx - {q}.cx', f'{p}.cy - {q}.cy')} >= 1.0" for p, q in (("a", "b"), ("a", "c"), ("b", "c")))
    return least_per_view(("start", "facing", "goal", "answer"), "concat(scene_id, cam, start, '|', facing, '|', goal)", f"""select * from (
        select scene_id, cam, start, facing, goal, case when angle between -120 and -60 then 'Turn Right' when angle between 60 and 120 then 'Turn Left' when abs(angle) > 150 then 'Turn Back' end as answer from (
        select a.scene_id, a.cam, a.id as start, b.id as facing, c.id as goal, round({angle}, 9) as angle
        from spread a join visible b on a.scene_id = b.scene_id and a.cam = b.cam and a.label <> b.label join visible c on a.scene_id = c.scene_id and a.cam = c.cam and c.label <> a.label and c.label <> b.label
        where {apart}) t) u where answer is not null""")
