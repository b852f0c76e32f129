"""Cameras around point clouds: steps and turns of each view, matrices, standpoints drawn by hash."""

from __future__ import annotations

from ..functions import geometry as g
from ..plans.catalog import relation
from ..plans.dialect import Spark

# Metres to the side, ahead and up; degrees of a turn; metres that a look moves up.
ASIDE, AHEAD, RAISED, TURN, PITCH = 1.5, 1.0, 0.5, 20, 3.0


@relation
def gold_views(d: Spark) -> str:
    """Segmentation views with their places: the middle of the room, looking at what view_cameras say."""
    return "select v.scene_id, v.name, (r.x_min + r.x_max) / 2 as px, (r.y_min + r.y_max) / 2 as py, r.z_max / 2 as pz, v.lx, v.ly, v.lz from view_cameras v join rooms r on v.scene_id = r.scene_id"


@relation
def splat_cameras(d: Spark) -> str:
    """Thirteen variants of each view: aside (along the look's own length), ahead, to the sides, up and down, turned, raised and lowered looks, ahead and turned."""
    c, s = f"cos(radians({TURN}))", f"sin(radians({TURN}))"
    rows = [("edge_left", 0, -ASIDE, 0, 0, 0, 1), ("edge_right", 0, ASIDE, 0, 0, 0, 1), ("step_forward", AHEAD, 0, 0, 0, 0, 0), ("step_left", 0, -AHEAD, 0, 0, 0, 0), ("step_right", 0, AHEAD, 0, 0, 0, 0), ("step_up", 0, 0, RAISED, 0, 0, 0), ("step_down", 0, 0, -RAISED, 0, 0, 0),
            ("step_yaw_left", 0, 0, 0, -1, 0, 0), ("step_yaw_right", 0, 0, 0, 1, 0, 0), ("step_pitch_up", 0, 0, 0, 0, PITCH, 0), ("step_pitch_down", 0, 0, 0, 0, -PITCH, 0), ("step_forward_yaw_left", AHEAD, 0, 0, -1, 0, 0), ("step_forward_yaw_right", AHEAD, 0, 0, 1, 0, 0)]
    values = ", ".join("('{}', {}, {}, {}, {}, {}, {})".format(n, *(f"cast({x} as double)" for x in r)) for n, *r in rows)
    n3, n2 = g.norm("lx - px", "ly - py", "lz - pz"), g.norm("lx - px", "ly - py")
    return f"""select scene_id, concat(name, '_', variant) as name, variant, round(px + mx, 6) as px, round(py + my, 6) as py, round(pz + up, 6) as pz, round(px + mx + tx, 6) as lx, round(py + my + ty, 6) as ly, round(lz + up + pitch, 6) as lz from (
        select *, ahead * fx + aside * fy as mx, ahead * fy - aside * fx as my, case when turn = 0 then lx - px else (lx - px) * {c} - (ly - py) * turn * {s} end as tx, case when turn = 0 then ly - py else (lx - px) * turn * {s} + (ly - py) * {c} end as ty from (
        select c.*, v.*, (lx - px) / case when v.whole = 1 then {n3} else {n2} end as fx, (ly - py) / case when v.whole = 1 then {n3} else {n2} end as fy
        from gold_views c cross join (values {values}) as v(variant, ahead, aside, up, turn, pitch, whole) where {n2} >= 1e-9) a) b"""


@relation
def camera_groups(d: Spark) -> str:
    """Cameras of one base: the name before _edge_ or _step_; pairs of them with how far they are apart."""
    base = lambda x: f"split_part(split_part({x}, '_edge_', 1), '_step_', 1)"
    return f"""select a.scene_id, {base('a.name')} as base, a.name as cam_a, b.name as cam_b, round({g.norm('a.px - b.px', 'a.py - b.py', 'a.pz - b.pz')}, 6) as apart
        from splat_cameras a join splat_cameras b on a.scene_id = b.scene_id and {base('a.name')} = {base('b.name')} and a.name < b.name"""


@relation
def camera_axes_flipped(d: Spark) -> str:
    """Cameras of Y-down space in Z-up space: place and look, floor at 1.5."""
    return "select scene_id, name, -px as px, -pz as py, -py + 1.5 as pz, -lx as lx, -lz as ly, -ly + 1.5 as lz from splat_cameras"


@relation
def box_axes_flipped(d: Spark) -> str:
    """Boxes of instances of Y-down space as objects in Z-up space: floor middle and sides."""
    return "select scene_id, iid, -x as x, -z as y, round(1.5 - y1, 6) as z, round(x1 - x0, 6) as width, round(z1 - z0, 6) as length, round(y1 - y0, 6) as height from instances"


@relation
def camera_matrices(d: Spark) -> str:
    """Camera to world of each view, Y up: right, up, backwards and place, by rows."""
    n = g.norm("lx - px", "ly - py", "lz - pz")
    # with Y up: right = ahead x up = (-fz, 0, fx)
    return f"""select scene_id, name, round(rx, 6) as m00, round(rz, 6) as m20, round(-rz * fy, 6) as m01, round(rz * fx - rx * fz, 6) as m11, round(rx * fy, 6) as m21, round(-fx, 6) as m02, round(-fy, 6) as m12, round(-fz, 6) as m22, px as m03, py as m13, pz as m23 from (
        select *, -fz / flat as rx, fx / flat as rz from (select *, {g.norm('fx', 'fz')} as flat from (
        select scene_id, name, px, py, pz, (lx - px) / {n} as fx, (ly - py) / {n} as fy, (lz - pz) / {n} as fz from gold_views) a) b where flat > 1e-8) c"""


# The least cosine within the field of view, and the width of the cells of directions.
FIELD, SIDE = "(round(cos(radians(41)), 12) - 1e-9)", 1 / 32


@relation
def direction_cells(d: Spark) -> str:
    """Directions by cubes: the cube's middle, its directions and their number; those that are no numbers apart."""
    cube = ", ".join(f"cast(floor({t} / {SIDE}) as bigint) as k{t[1]}" for t in ("tx", "ty", "tz"))
    return f"""select scene_id, cam, odd, {', '.join(f'(k{a} + 0.5D) * {SIDE} as m{a}' for a in 'xyz')}, count(*) as n, collect_list(struct(tx, ty, tz)) as members from (
        select scene_id, cam, tx, ty, tz, isnan(tx + ty + tz) as odd, {cube} from directions) a group by scene_id, cam, odd, kx, ky, kz"""


@relation
def look_targets(d: Spark) -> str:
    """Of each distance class (under 1 m, under 2 m, further) around an upper corner camera the object that brings most others into the field of view; the first wins ties.

    The engine compares one by one only directions of cells that the edge of the field of view goes through.
    """
    cos = f"({g.dot(('a.tx', 'a.ty', 'a.tz'), ('b.tx', 'b.ty', 'b.tz'))})"
    if d.name == "spark":
        middle, reach = f"({g.dot(('a.tx', 'a.ty', 'a.tz'), ('c.mx', 'c.my', 'c.mz'))})", 0.5 * 3**0.5 * SIDE * 1.001 + 1e-6
        own = "scene_id, cam, class, id, ord, cx, cy, cz, pz"
        return f"""select scene_id, cam, class, id, n, round(cx, 6) as tx, round(cy, 6) as ty, round(greatest(pz - 1.0, least(cz, pz - 0.1)), 6) as tz from (
            select *, row_number() over (partition by scene_id, cam, class order by n desc, ord) as rn from (
            select {own}, cast(sum(case when whole then n else 1 end) as bigint) as n from (
            select a.*, a.whole or {cos} >= {FIELD} as counts from (
            select a.*, c.n, {middle} >= {FIELD} + {reach!r} and not c.odd as whole, explode(case when {middle} >= {FIELD} + {reach!r} and not c.odd then array(c.members[0]) else c.members end) as b
            from directions a join direction_cells c on a.scene_id = c.scene_id and a.cam = c.cam and (c.odd or {middle} >= {FIELD} - {reach!r})) a) e where counts group by {own}) t) u where rn = 1"""
    return f"""select scene_id, cam, class, id, n, round(cx, 6) as tx, round(cy, 6) as ty, round(greatest(pz - 1.0, least(cz, pz - 0.1)), 6) as tz from (
        select *, row_number() over (partition by scene_id, cam, class order by n desc, ord) as rn from (
        select a.scene_id, a.cam, a.class, a.id, a.ord, a.cx, a.cy, a.cz, a.pz, count(*) as n from directions a join directions b on a.scene_id = b.scene_id and a.cam = b.cam
        where {cos} >= {FIELD} group by a.scene_id, a.cam, a.class, a.id, a.ord, a.cx, a.cy, a.cz, a.pz) t) u where rn = 1"""


@relation
def directions(d: Spark) -> str:
    """Unit vectors from the upper corner cameras to all objects further than 0.1 m."""
    flat = g.norm("cx - px", "cy - py")
    return f"""select /*+ repartition(64, scene_id, cam) */ scene_id, cam, id, ord, cx, cy, cz, pz, (cx - px) / distance as tx, (cy - py) / distance as ty, (cz - pz) / distance as tz, case when {flat} < 1.0 then 'near' when {flat} < 2.0 then 'mid' else 'far' end as class
        from cam_obj where kind = 'corner' and cam not like '%mid%' and distance > 0.1"""
