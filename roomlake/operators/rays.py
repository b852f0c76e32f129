"""Visibility: how much of an object other objects hide from a camera.

Nine points of each object (centre and corners) are looked at.  A ray that ends at a point of the image
passes through occluders only where their images hold that point, so points and occluders meet by
tiles of the image: an occluder is in all tiles that its bounding sphere may touch.  Points that have no
place in the image (beside or behind the camera) meet all occluders.  Only occluders whose nearest
point is nearer than the target are tried, and only blocked points leave the join, once for each point.
"""

from __future__ import annotations

from ..functions import geometry as g
from ..plans.catalog import relation
from ..plans.dialect import Spark

WIDE, HIGH = 12, 8  # tiles of an image; one more row or column on each side holds what lies outside
NOWHERE = -1000  # the tile of points without a place in the image


def _tile(fraction: str, n: int) -> str:
    return f"cast(greatest(-1, least({n}, floor(greatest(-9, least(9, {fraction})) * {n}))) as int)"


def _reach(x: str, sign: str, scale: str, flip: str = "") -> str:
    """Where the image of a sphere ends: never nearer to the middle than it does."""
    end = f"({x} {sign} radius)"
    outwards = f"{end} {'>' if sign == '+' else '<'} 0"
    return f"0.5 + {flip}{end} / (case when {outwards} then depth - radius else depth + radius end) / {scale}"


@relation
def occluders(d: Spark) -> str:
    """Objects by the tiles of a camera's image that they may be in; those around or beside a camera in all tiles."""
    big = " or ".join(f"coalesce({s}, 0) / 2 * :shrink >= 1e-6" for s in ("width", "length", "height"))
    flat, tall = "(2 * tan_h)", f"(2 * tan_h / {g.ASPECT!r})"
    span = lambda low, high, n: (f"case when depth - radius <= 0.01 then -1 else {_tile(f'({low}) - 1e-6', n)} end", f"case when depth - radius <= 0.01 then {n} else {_tile(f'({high}) + 1e-6', n)} end")
    u0, u1 = span(_reach("across", "-", flat), _reach("across", "+", flat), WIDE)
    v0, v1 = span(_reach("upward", "+", tall, "-"), _reach("upward", "-", tall, "-"), HIGH)
    every = "scene_id, kind, cam, id, cx, cy, cz, width, length, height" + (", px, py, pz" if d.name == "spark" else "")
    return f"""select {every}, (i.i - 1) * 100 + j.j - 1 as tile from (select *, {u0} as u0, {u1} as u1, {v0} as v0, {v1} as v1 from (
        select *, {g.norm('coalesce(width, 0)', 'coalesce(length, 0)', 'coalesce(height, 0)')} / 2 + 1e-6 as radius from cam_obj where kind <> 'step' and ({big})) a where depth + radius > 0) b
        join {d.sequence(WIDE + 2, 'i')} i on i.i - 1 between u0 and u1 join {d.sequence(HIGH + 2, 'j')} j on j.j - 1 between v0 and v1
        union all select {every}, {NOWHERE} from cam_obj where kind <> 'step' and ({big})"""


@relation
def sight_points(d: Spark) -> str:
    """The points to look at, with their tiles; a comment to the oracle, the hint deals them out in many tasks."""
    s = ("sx", "sy", "sz")
    ahead = g.dot(s, ("fx", "fy", "fz"))
    u, v = f"0.5 + {g.dot(s[:2], ('rx', 'ry'))} / ahead / (2 * tan_h)", f"0.5 - {g.dot(s, ('ux', 'uy', 'uz'))} / ahead / (2 * tan_h / {g.ASPECT!r})"
    keys = "scene_id, kind, cam, tile" if d.name == "spark" else "scene_id, cam, tile"
    return f"""select /*+ repartition(64, {keys}) */ * from (
        select scene_id, kind, cam, id, px, py, pz, k, sx, sy, sz, target, case when ahead > 0.01 then {_tile(u, WIDE)} * 100 + {_tile(v, HIGH)} else {NOWHERE} end as tile from (
        select *, {g.norm(*s)} as target, {ahead} as ahead from (
        select f.*, p.k, f.cx + p.i * coalesce(f.width, 0) / 2 - f.px as sx, f.cy + p.j * coalesce(f.length, 0) / 2 - f.py as sy, f.cz + p.l * coalesce(f.height, 0) / 2 - f.pz as sz
        from frustum f cross join (values (0, 0, 0, 0), (1, -1, -1, -1), (2, -1, -1, 1), (3, -1, 1, -1), (4, -1, 1, 1), (5, 1, -1, -1), (6, 1, -1, 1), (7, 1, 1, -1), (8, 1, 1, 1)) as p(k, i, j, l)) a) b) c"""


def _first_block() -> str:
    """The engine's form of blocked_points: a join that leaves a point at the first occluder that blocks it.

    What belongs to an occluder or a ray alone is found before they meet.  A box whose sphere the ray's line misses is
    passed over by that; a parallel ray's direction is all but zero, so that it is inside a slab always or never.
    """
    axes = (("x", "width"), ("y", "length"), ("z", "height"))
    low, high = (lambda a, s, sign=sign: f"(c{a} {sign} coalesce({s}, 0) / 2 * :shrink)" for sign in "-+")
    sides = ", ".join(f"least({low(a, s)}, {high(a, s)}) - p{a} as {a}0, greatest({low(a, s)}, {high(a, s)}) - p{a} as {a}1, c{a} - p{a} as w{a}" for a, s in axes)
    half = f"{g.norm('coalesce(width, 0)', 'coalesce(length, 0)', 'coalesce(height, 0)')} / 2"
    away = g.dot(("cx - px", "cy - py", "cz - pz"), ("cx - px", "cy - py", "cz - pz"))
    boxes = f"select scene_id, kind, cam, tile, id, {sides}, {away} as w2, {g.norm('cx - px', 'cy - py', 'cz - pz')} - {half} as gap, {half} * {half} * greatest(1, :shrink * :shrink) + 1e-6 * (1 + {away}) as reach2 from occluders"
    flat = {a: f"abs(s{a} / target) < 1e-12" for a, _ in axes}
    rays = "select scene_id, kind, cam, tile, id, k, target, " + ", ".join(f"case when {flat[a]} then 1e-300 else s{a} / target end as d{a}, case when {flat[a]} then 1e-200 else cast(0 as double) end as f{a}" for a, _ in axes) + " from sight_points where target >= 1e-9"
    enter = "greatest(" + ", ".join(f"if(t.d{a} > 0, o.{a}0 - t.f{a}, o.{a}1) / t.d{a}" for a, _ in axes) + ")"
    leave = "least(" + ", ".join(f"if(t.d{a} > 0, o.{a}1 + t.f{a}, o.{a}0) / t.d{a}" for a, _ in axes) + ")"
    along = g.dot(("o.wx", "o.wy", "o.wz"), ("t.dx", "t.dy", "t.dz"))
    return f"""select distinct scene_id, kind, cam, id, k from (select /*+ shuffle_hash(o) */ t.scene_id, t.kind, t.cam, t.id, t.k from ({rays}) t left semi join ({boxes}) o
        on t.scene_id = o.scene_id and t.kind = o.kind and t.cam = o.cam and t.tile = o.tile and t.id <> o.id and o.gap < t.target
        and o.w2 - {along} * {along} <= o.reach2 and {leave} >= greatest({enter}, 0) and ({enter} >= 0 or {leave} < t.target - 1e-3) and {enter} < t.target - 1e-3) a"""


@relation
def blocked_points(d: Spark) -> str:
    parts = []
    for a, s, c in (("x", "width", "cx"), ("y", "length", "cy"), ("z", "height", "cz")):
        half = f"coalesce(o.{s}, 0) / 2 * :shrink"
        parts.append(g.axis_range(f"(o.{c} - {half})", f"(o.{c} + {half})", f"t.p{a}", f"(t.s{a} / t.target)"))
    enter, leave = (f"{f}({', '.join(p[i] for p in parts)})" for i, f in enumerate(("greatest", "least")))
    near = f"sqrt((o.cx - t.px) * (o.cx - t.px) + (o.cy - t.py) * (o.cy - t.py) + (o.cz - t.pz) * (o.cz - t.pz)) - {g.norm('coalesce(o.width, 0)', 'coalesce(o.length, 0)', 'coalesce(o.height, 0)')} / 2 < t.target"
    if d.name == "spark":
        return _first_block()
    return f"""select distinct scene_id, kind, cam, id, k from (
        select t.scene_id, t.kind, t.cam, t.id, t.k, t.target, {enter} as enter, {leave} as leave from sight_points t
        join occluders o on t.scene_id = o.scene_id and t.kind = o.kind and t.cam = o.cam and t.tile = o.tile and t.id <> o.id
        where t.target >= 1e-9 and {near}) a where leave >= greatest(enter, 0) and case when enter >= 0 then enter else leave end < target - 1e-3"""


@relation
def seen(d: Spark) -> str:
    """Objects in the frame with the part of their points that is not hidden."""
    return """select f.*, (9 - coalesce(b.n, 0)) / cast(9 as double) as fraction, coalesce(b.centre, 0) = 0 as centre_clear from frustum f
        left join (select scene_id, kind, cam, id, count(*) as n, max(case when k = 0 then 1 else 0 end) as centre from blocked_points group by scene_id, kind, cam, id) b
        on f.scene_id = b.scene_id and f.kind = b.kind and f.cam = b.cam and f.id = b.id"""


@relation
def visible_fraction(d: Spark) -> str:
    return "select scene_id, cam, id, round(fraction, 6) as fraction, centre_clear from seen"


@relation
def visible(d: Spark) -> str:
    """Objects at least half visible, with a clear centre, to a camera that views are drawn from; cameras in the middle of edges are for pairs of cameras alone."""
    return "select * from seen where kind <> 'edge' and fraction >= :min_visible and centre_clear"


@relation
def visible_objects(d: Spark) -> str:
    return "select scene_id, cam, id from visible"


@relation
def dotted(d: Spark) -> str:
    """What questions with a dot on the object may use: nine tenths visible, 0.2 m at least."""
    return "select * from seen where kind <> 'edge' and fraction >= :dot_visible and centre_clear and longest >= 0.2"


@relation
def shared_views(d: Spark) -> str:
    """Pairs of views of a scene with how many objects both see."""
    return """select a.scene_id, a.cam as cam_a, b.cam as cam_b, count(*) as n from visible a join visible b on a.scene_id = b.scene_id and a.id = b.id and a.cam < b.cam group by a.scene_id, a.cam, b.cam"""


@relation
def jaccard_pairs(d: Spark) -> str:
    """Views that share three objects at least and a fifth of all they see."""
    return """select s.scene_id, cam_a, cam_b, s.n as n_shared, round(s.n / cast(p.n + q.n - s.n as double), 6) as jaccard from shared_views s
        join (select scene_id, cam, count(*) as n from visible group by scene_id, cam) p on s.scene_id = p.scene_id and s.cam_a = p.cam
        join (select scene_id, cam, count(*) as n from visible group by scene_id, cam) q on s.scene_id = q.scene_id and s.cam_b = q.cam
        where s.n >= 3 and s.n / cast(p.n + q.n - s.n as double) >= 0.2"""
