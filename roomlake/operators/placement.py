"""Surfaces, what stands on them, where things fit."""

from __future__ import annotations

from ..functions import geometry as g
from ..plans.catalog import relation
from ..plans.dialect import Spark

# Words in the types of surfaces.
SURFACES = ("table", "desk", "shelf", "counter", "bench", "nightstand", "dresser", "stand", "cabinet", "sideboard", "console")
# Seats are used at half their height.
SEATS = ("armchair", "chair", "sofa", "couch", "recliner", "throne")


@relation
def surface_boxes(d: Spark) -> str:
    word = d.matches("replace(lower(type), '-', '_')", "|".join(SURFACES))
    seat = d.matches("lower(type)", "|".join(SEATS))
    return f"""select *, z + height as top, case when {seat} then z + height * 0.5 else z + height end as usable from solid
        where width > 0 and length > 0 and height > 0 and ({word} or (width * length > 4 * height * greatest(width, length) and height >= 0.1))"""


@relation
def surfaces(d: Spark) -> str:
    return "select scene_id, id, round(top, 6) as top, round(usable, 6) as usable from surface_boxes"


@relation
def on_surface(d: Spark) -> str:
    return """select s.scene_id, s.id as surface, o.id as occupant, o.x, o.y, o.width, o.length from surface_boxes s join solid o on s.scene_id = o.scene_id and s.id <> o.id
        and abs(o.z - s.top) <= 0.15 and abs(o.x - s.x) < (o.width + s.width) / 2 and abs(o.y - s.y) < (o.length + s.length) / 2"""


@relation
def objects_on_surface(d: Spark) -> str:
    return "select scene_id, surface, occupant from on_surface"


@relation
def probes(d: Spark) -> str:
    """A grid of places in the central four fifths of every surface."""
    return f"""select s.scene_id, s.id as surface, i.i * 9 + j.j as place, s.x + (i.i / cast(8 as double) - 0.5) * 0.8 * s.width as x, s.y + (j.j / cast(8 as double) - 0.5) * 0.8 * s.length as y, s.usable, s.x as sx, s.y as sy, s.width as sw, s.length as sl
        from surface_boxes s cross join {d.sequence(9, 'i')} i cross join {d.sequence(9, 'j')} j"""


@relation
def feasible(d: Spark) -> str:
    """Places where an object that is no surface fits on a surface beside what stands there; only pairs that fit at the centre are tried."""
    return """select m.scene_id, m.id, p.surface, p.place, p.x, p.y, p.usable from (select o.*, s.id as surface from solid o
        join surface_boxes s on o.scene_id = s.scene_id and o.width <= s.width and o.length <= s.length
        where o.is_solid and not exists (select 1 from surface_boxes b where b.scene_id = o.scene_id and b.id = o.id)) m
        join probes p on m.scene_id = p.scene_id and m.surface = p.surface and abs(p.x - p.sx) + m.width / 2 <= p.sw / 2 and abs(p.y - p.sy) + m.length / 2 <= p.sl / 2
        where not exists (select 1 from on_surface o where o.scene_id = p.scene_id and o.surface = p.surface and o.occupant <> m.id and abs(o.x - p.x) < (o.width + m.width) / 2 and abs(o.y - p.y) < (o.length + m.length) / 2)"""


@relation
def placement_feasible(d: Spark) -> str:
    return "select scene_id, id, surface, count(*) as places from feasible group by scene_id, id, surface"


@relation
def object_placement(d: Spark) -> str:
    """One feasible place for each object and surface, by hash."""
    return """select scene_id, id, surface, round(x, 6) as x, round(y, 6) as y, round(usable, 6) as z from (select *, row_number() over (partition by scene_id, id, surface order by md5(concat(id, surface, cast(place as string))), place) as rn from feasible) a where rn = 1"""


@relation
def free_space(d: Spark) -> str:
    """Places on surfaces that nothing covers."""
    return """select p.scene_id, p.surface, count(*) as free_places from probes p where not exists (select 1 from on_surface o where o.scene_id = p.scene_id and o.surface = p.surface
        and abs(o.x - p.x) < o.width / 2 and abs(o.y - p.y) < o.length / 2) group by p.scene_id, p.surface"""


@relation
def compatibility_probes(d: Spark) -> str:
    """Places beside an object, on the camera's left or right, for another to move to."""
    return f"""select t.*, v.side, v.extra, t.bx + v.s * t.rx * (t.half_b + t.aw / 2 + 0.05 + abs(v.extra)) + v.extra * t.dx2 as nx, t.by_ + v.s * t.ry * (t.half_b + t.aw / 2 + 0.05 + abs(v.extra)) + v.extra * t.dy2 as ny from (
        select a.scene_id, a.cam, a.id as moved, b.id as target, b.cx as bx, b.cy as by_, a.rx, a.ry, a.dx2, a.dy2, greatest(b.width, b.length) / 2 as half_b, greatest(a.width, a.length) as aw, a.u as ua, b.u as ub,
        {g.dot(('(a.cx - b.cx)', '(a.cy - b.cy)'), ('a.rx', 'a.ry'))} as along from visible a join visible b on a.scene_id = b.scene_id and a.cam = b.cam and a.id <> b.id) t
        cross join (values ('left of', -1, 0.0), ('left of', -1, 0.3), ('left of', -1, -0.3), ('left of', -1, 0.6), ('left of', -1, -0.6), ('right of', 1, 0.0), ('right of', 1, 0.3), ('right of', 1, -0.3), ('right of', 1, 0.6), ('right of', 1, -0.6)) as v(side, s, extra)
        where not (v.s * t.along > 1.5) and not (v.s * (t.ua - t.ub) > 0.03)"""


ROOM_INSIDE = "p.nx - p.aw / 2 >= r.x_min and p.nx + p.aw / 2 <= r.x_max and p.ny - p.aw / 2 >= r.y_min and p.ny + p.aw / 2 <= r.y_max"
CELL = 0.5  # width of the cells of a floor by which places and what may touch them meet


@relation
def touched_probes(d: Spark) -> str:
    """Places inside the room that a third object touches: both are in all cells of the floor that they may reach, and a place leaves the join at the first that touches it."""
    cell = lambda x: f"cast(floor(({x}) / {CELL}) as int)"
    span = lambda c, half, low, high, n: f"explode(sequence({cell(f'greatest({c} - {half}, {low}) - 1e-6')}, {cell(f'least({c} + {half}, {high}) + 1e-6')})) as {n}"
    places = f"select p.*, r.x_min, r.x_max, r.y_min, r.y_max from compatibility_probes p join rooms r on p.scene_id = r.scene_id where {ROOM_INSIDE}"
    things = "select * from (select o.scene_id, o.id, o.cx, o.cy, greatest(o.width, o.length) / 2 as reach, r.x_min, r.x_max, r.y_min, r.y_max from solid o join rooms r on o.scene_id = r.scene_id) t where cx + reach >= x_min - 1e-6 and cx - reach <= x_max + 1e-6 and cy + reach >= y_min - 1e-6 and cy - reach <= y_max + 1e-6"
    in_cells = lambda source, columns, x, y, half: f"select {columns}, kx, {span(y, half, 'y_min', 'y_max', 'ky')} from (select *, {span(x, half, 'x_min', 'x_max', 'kx')} from ({source}) s) t"
    return f"""select distinct scene_id, cam, moved, target, side, extra from (select /*+ shuffle_hash(o) */ p.scene_id, p.cam, p.moved, p.target, p.side, p.extra
        from ({in_cells(places, 'scene_id, cam, moved, target, side, extra, nx, ny, aw', 'nx', 'ny', 'aw / 2')}) p left semi join ({in_cells(things, 'scene_id, id, cx, cy, reach', 'cx', 'cy', 'reach')}) o
        on o.scene_id = p.scene_id and o.kx = p.kx and o.ky = p.ky and o.id <> p.moved and o.id <> p.target and {g.norm('o.cx - p.nx', 'o.cy - p.ny')} < o.reach + p.aw / 2) a"""


@relation
def spatial_compatibility(d: Spark) -> str:
    """Whether an object can move to one side of another inside the room without touching a third: all ordered pairs of a view."""
    if d.name == "spark":
        return f"""select scene_id, cam, moved, target, side, case when max(case when inside and touched is null then 1 else 0 end) = 1 then 'Yes' else 'No' end as answer from (
            select p.scene_id, p.cam, p.moved, p.target, p.side, {ROOM_INSIDE} as inside, t.extra as touched from compatibility_probes p join rooms r on p.scene_id = r.scene_id
            left join touched_probes t on t.scene_id = p.scene_id and t.cam = p.cam and t.moved = p.moved and t.target = p.target and t.side = p.side and t.extra = p.extra) a group by scene_id, cam, moved, target, side"""
    return f"""select scene_id, cam, moved, target, side, case when max(case when inside and touched = 0 then 1 else 0 end) = 1 then 'Yes' else 'No' end as answer from (
        select p.scene_id, p.cam, p.moved, p.target, p.side, p.extra, p.nx - p.aw / 2 >= r.x_min and p.nx + p.aw / 2 <= r.x_max and p.ny - p.aw / 2 >= r.y_min and p.ny + p.aw / 2 <= r.y_max as inside,
        sum(case when o.id is null then 0 else 1 end) as touched from compatibility_probes p join rooms r on p.scene_id = r.scene_id
        left join solid o on o.scene_id = p.scene_id and o.id <> p.moved and o.id <> p.target and {g.norm('o.cx - p.nx', 'o.cy - p.ny')} < greatest(o.width, o.length) / 2 + p.aw / 2
        group by p.scene_id, p.cam, p.moved, p.target, p.side, p.extra, p.nx, p.ny, p.aw, r.x_min, r.x_max, r.y_min, r.y_max) a group by scene_id, cam, moved, target, side"""
