"""Walls and their openings: boxes, joins, the exported plan and the routes of its parts."""

from __future__ import annotations

from ..plans.catalog import relation
from ..plans.dialect import Spark

# How near doors are one, the frame's width, what is added to a door's width and height.
SAME, FRAME, SCALE, OFFSET = 0.01, 0.1, 1.0, 0.0


@relation
def wall_frames(d: Spark) -> str:
    """Walls with length, direction and the normal that points into the room."""
    return """select *, case when nx0 * (room_x - (x0 + x1) / 2) + ny0 * (room_y - (y0 + y1) / 2) >= 0 then nx0 else -nx0 end as nx, case when nx0 * (room_x - (x0 + x1) / 2) + ny0 * (room_y - (y0 + y1) / 2) >= 0 then ny0 else -ny0 end as ny from (
        select *, -dy as nx0, dx as ny0 from (select *, (x1 - x0) / len as dx, (y1 - y0) / len as dy from (
        select *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as len from walls) a where len > 0) b) c"""


@relation
def wall_boxes(d: Spark) -> str:
    """Boxes of walls: half as thick, moved inwards by a quarter of the thickness; turned only where the wall runs along Y, as oblique ones stay along X."""
    return """select scene_id, wall_id, round((x0 + x1) / 2 + nx * thickness / 4, 6) as cx, round((y0 + y1) / 2 + ny * thickness / 4, 6) as cy, round(height / 2, 6) as cz,
        round(case when abs(dx) < 0.001 then thickness / 2 else len end, 6) as width, round(case when abs(dx) < 0.001 then len else thickness / 2 end, 6) as length, height from wall_frames"""


@relation
def placed_openings(d: Spark) -> str:
    """Openings on their walls: the middle of each, at its part of the wall's length."""
    return """select o.scene_id, o.wall_id, o.ord, o.kind, o.width, o.height, o.sill, w.dx, w.dy, w.nx, w.ny, w.thickness, w.x0 + (w.x1 - w.x0) * o.position as cx, w.y0 + (w.y1 - w.y0) * o.position as cy
        from openings o join wall_frames w on o.scene_id = w.scene_id and o.wall_id = w.wall_id"""


@relation
def openings_once(d: Spark) -> str:
    """Openings without doors whose middle is within 0.01 m, in x and in y, of an earlier door's: by equality on cells of that width and those beside them."""
    cell = lambda c: f"cast(floor(round({c} / {SAME}, 6)) as bigint)"
    near = f"""select a.scene_id, a.wall_id, a.ord from (select p.*, {cell('cx')} + i.i - 1 as kx, {cell('cy')} + j.j - 1 as ky from placed_openings p cross join {d.sequence(3, 'i')} i cross join {d.sequence(3, 'j')} j where kind = 'door') a
        join (select *, {cell('cx')} as kx, {cell('cy')} as ky from placed_openings where kind = 'door') b on a.scene_id = b.scene_id and a.kx = b.kx and a.ky = b.ky and b.ord < a.ord
        where abs(a.cx - b.cx) <= {SAME} and abs(a.cy - b.cy) <= {SAME}"""
    return f"select p.* from placed_openings p where not exists (select 1 from ({near}) n where n.scene_id = p.scene_id and n.wall_id = p.wall_id and n.ord = p.ord)"


@relation
def wall_openings(d: Spark) -> str:
    """The names of each wall's doors and windows, each opening once."""
    return "select scene_id, wall_id, ord, kind, concat(kind, '_', wall_id, '_', cast(cast(round(cx * 100, 0) as bigint) as string), '_', cast(cast(round(cy * 100, 0) as bigint) as string)) as uid from openings_once"


def _flat(width: str) -> str:
    """Sides of a box along its wall."""
    return f"round(case when abs(dx) < 0.001 then thickness else {width} end, 6) as width, round(case when abs(dx) < 0.001 then {width} else thickness end, 6) as length"


@relation
def door_boxes(d: Spark) -> str:
    return f"select scene_id, wall_id, ord, round(cx, 6) as cx, round(cy, 6) as cy, round(height / 2, 6) as cz, {_flat(f'width * {SCALE} + {OFFSET}')}, round(height * {SCALE} + {OFFSET}, 6) as height from openings_once where kind = 'door'"


@relation
def door_frames(d: Spark) -> str:
    """Boxes beside and over each door, outside of it."""
    side = f"(width / 2 + {FRAME} / 2)"
    return f"""select scene_id, wall_id, ord, v.part, round(cx + v.s * dx * {side}, 6) as cx, round(cy + v.s * dy * {side}, 6) as cy, round(case when v.s = 0 then height + {FRAME} / 2 else height / 2 end, 6) as cz,
        {_flat(f'case when v.s = 0 then width + 2 * {FRAME} else {FRAME} end')}, round(case when v.s = 0 then {FRAME} else height end, 6) as height
        from openings_once cross join (values ('left', -1), ('right', 1), ('top', 0)) as v(part, s) where kind = 'door'"""


@relation
def window_boxes(d: Spark) -> str:
    return f"select scene_id, wall_id, ord, round(cx, 6) as cx, round(cy, 6) as cy, round(sill + height / 2, 6) as cz, {_flat('width')}, round(height, 6) as height from openings_once where kind = 'window'"


@relation
def opening_cuts(d: Spark) -> str:
    """What is cut out of walls: the boxes of doors, windows and plain openings."""
    return f"select scene_id, wall_id, ord, kind, round(cx, 6) as cx, round(cy, 6) as cy, round(coalesce(sill, 0) + height / 2, 6) as cz, {_flat('width')}, round(height, 6) as height from openings_once"


@relation
def hinges(d: Spark) -> str:
    """The axis that a door turns about: its edge towards the wall's start, from the floor up."""
    return "select scene_id, wall_id, ord, round(cx - dx * width / 2, 6) as hx, round(cy - dy * width / 2, 6) as hy, cast(0 as double) as z0, round(height, 6) as z1 from openings_once where kind = 'door'"


@relation
def plan_parts(d: Spark) -> str:
    """A plan's boxes in line: floors, walls, windows, ceilings, objects, then doors with their frames; plain openings are no parts."""
    names = lambda kind: f"concat('{kind}_', wall_id, '_', cast(ord as string))"
    return f"""select scene_id, 0 as step, 'floor_0' as part, cx, cy, cz, width, length, height from floor_boxes where part = 'floor'
        union all select scene_id, 1, concat('wall_room_', wall_id), cx, cy, cz, width, length, height from wall_boxes
        union all select scene_id, 2, {names('window')}, cx, cy, cz, width, length, height from window_boxes
        union all select scene_id, 3, 'ceiling_0', cx, cy, cz, width, length, height from floor_boxes where part = 'ceiling'
        union all select scene_id, 4, id, round(cx, 6), round(cy, 6), round(cz, 6), width, length, height from solid where is_solid
        union all select scene_id, 5, {names('door')}, cx, cy, cz, width, length, height from door_boxes
        union all select scene_id, 6, concat('door_', wall_id, '_', cast(ord as string), '_', part, '_frame'), cx, cy, cz, width, length, height from door_frames"""


@relation
def plan_routes(d: Spark) -> str:
    """How a simulation takes each part: walls, windows, floors and ceilings never move, doors turn in their frames, all else is tracked."""
    return """select scene_id, part, case when part like 'wall#_room#_%' escape '#' or part like 'window#_%' escape '#' or part like 'floor#_%' escape '#' or part like 'ceiling#_%' escape '#' then 'static'
        when part like 'door#_%#_frame' escape '#' then 'frame' when part like 'door#_%' escape '#' then 'door' else 'track' end as route from plan_parts"""


@relation
def door_pairs(d: Spark) -> str:
    """Doors with their frames: the same place in the order of names, three parts to a frame."""
    return """select f.scene_id, f.part as frame, e.part as door from (select scene_id, part, row_number() over (partition by scene_id order by part) as nth from plan_routes where route = 'frame') f
        join (select scene_id, part, row_number() over (partition by scene_id order by part) as nth from plan_routes where route = 'door') e on f.scene_id = e.scene_id and cast(floor((f.nth + 2) / 3) as bigint) = e.nth"""


@relation
def rotated_corners(d: Spark) -> str:
    """The corners of objects' boxes after their turn about Z, then X and Y by none: T Rz Ry Rx on each vertex."""
    c, s = "cos(radians(rotation_z))", "sin(radians(rotation_z))"
    return f"""select o.scene_id, o.id, c.k, round(o.x + {c} * c.i * o.width / 2 - {s} * c.j * o.length / 2, 6) as x, round(o.y + {s} * c.i * o.width / 2 + {c} * c.j * o.length / 2, 6) as y, round(o.z + case when c.l > 0 then o.height else 0 end, 6) as z
        from (select scene_id, id, x, y, z, width, length, height, rotation_z + ord % 8 * 45 as rotation_z from objects) o
        cross join (values (0, -1, -1, -1), (1, -1, -1, 1), (2, -1, 1, -1), (3, -1, 1, 1), (4, 1, -1, -1), (5, 1, -1, 1), (6, 1, 1, -1), (7, 1, 1, 1)) as c(k, i, j, l)"""
