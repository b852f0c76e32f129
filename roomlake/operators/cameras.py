"""Camera generators, camera frames, projection of objects into views."""

from __future__ import annotations

from ..functions import geometry as g
from ..plans.catalog import relation
from ..plans.dialect import Spark

PAD = 0.12
FOV = 82.0


@relation
def corner_cameras(d: Spark) -> str:
    """Four corners at two heights, looking at the middle of the room."""
    return f"""select r.scene_id, concat('corner_', v.suffix) as name, v.ord, 'corner' as kind,
        case when v.i = 0 then x_min + {PAD} else x_max - {PAD} end as px, case when v.j = 0 then y_min + {PAD} else y_max - {PAD} end as py,
        case when v.top = 1 then z_max - 0.15 else z_max / 2 end as pz, (x_min + x_max) / 2 as lx, (y_min + y_max) / 2 as ly, z_max * 0.35 as lz, cast({FOV} as double) as hfov
        from rooms r cross join (values ('0', 0, 0, 0, 1), ('mid_0', 1, 0, 0, 0), ('1', 2, 1, 0, 1), ('mid_1', 3, 1, 0, 0), ('2', 4, 0, 1, 1), ('mid_2', 5, 0, 1, 0), ('3', 6, 1, 1, 1), ('mid_3', 7, 1, 1, 0)) as v(suffix, ord, i, j, top)"""


@relation
def edge_cameras(d: Spark) -> str:
    """The middles of the four walls."""
    return f"""select r.scene_id, concat('edge_', v.wall) as name, v.ord, 'edge' as kind,
        case v.wall when 'east' then x_max - {PAD} when 'west' then x_min + {PAD} else (x_min + x_max) / 2 end as px,
        case v.wall when 'south' then y_min + {PAD} when 'north' then y_max - {PAD} else (y_min + y_max) / 2 end as py,
        z_max - 0.15 as pz, (x_min + x_max) / 2 as lx, (y_min + y_max) / 2 as ly, z_max * 0.35 as lz, cast({FOV} as double) as hfov, v.wall as edge_direction
        from rooms r cross join (values ('south', 8), ('east', 9), ('north', 10), ('west', 11)) as v(wall, ord)"""


@relation
def stepped_cameras(d: Spark) -> str:
    """Half a metre ahead, left or right of the upper corner cameras, kept inside the room."""
    return f"""select scene_id, concat(base, '_step_', dir) as name, ord, 'step' as kind, nx as px, ny as py, pz, lx + nx - px as lx, ly + ny - py as ly, lz, hfov, dir as step_direction, base as step_from from (
        select c.scene_id, c.name as base, 100 + c.ord * 3 + v.k as ord, v.dir, px, py, pz, lx, ly, lz, hfov,
        greatest(r.x_min + {PAD}, least(r.x_max - {PAD}, px + 0.5 * (v.f * (lx - px) + v.r * (ly - py)) / {g.norm('lx - px', 'ly - py')})) as nx,
        greatest(r.y_min + {PAD}, least(r.y_max - {PAD}, py + 0.5 * (v.f * (ly - py) - v.r * (lx - px)) / {g.norm('lx - px', 'ly - py')})) as ny
        from corner_cameras c join rooms r on c.scene_id = r.scene_id cross join (values ('forward', 0, 1, 0), ('left', 1, 0, -1), ('right', 2, 0, 1)) as v(dir, k, f, r)
        where c.name not like '%mid%') a"""


@relation
def cameras(d: Spark) -> str:
    """All cameras; generated ones unless a table of them is given."""
    return """select scene_id, name, ord, kind, px, py, pz, lx, ly, lz, hfov, cast(null as string) as edge_direction, cast(null as string) as step_direction, cast(null as string) as step_from from corner_cameras
        union all select scene_id, name, ord, kind, px, py, pz, lx, ly, lz, hfov, edge_direction, null, null from edge_cameras
        union all select scene_id, name, ord, kind, px, py, pz, lx, ly, lz, hfov, null, step_direction, step_from from stepped_cameras"""


@relation
def scan_cameras(d: Spark) -> str:
    return "select scene_id, name, kind, round(px, 6) as px, round(py, 6) as py, round(pz, 6) as pz, round(lx, 6) as lx, round(ly, 6) as ly, round(lz, 6) as lz, hfov, edge_direction, step_direction, step_from from cameras"


@relation
def cam_frame(d: Spark) -> str:
    """Unit vectors of every camera, once: ahead (3D), right (flat) and up; null where it looks straight up or down."""
    return f"""select *, -fz * dx2 as ux, -fz * dy2 as uy, hl / len as uz, {g.half_tangent('hfov')} as tan_h from (
        select *, (lx - px) / len as fx, (ly - py) / len as fy, (lz - pz) / len as fz, (lx - px) / hl as dx2, (ly - py) / hl as dy2, (ly - py) / hl as rx, -(lx - px) / hl as ry from (
        select *, case when {g.norm('lx - px', 'ly - py', 'lz - pz')} >= 1e-9 then {g.norm('lx - px', 'ly - py', 'lz - pz')} end as len,
        case when {g.norm('lx - px', 'ly - py')} >= 1e-9 then {g.norm('lx - px', 'ly - py')} end as hl from cameras) a) b"""


@relation
def cam_obj(d: Spark) -> str:
    """Every object of a scene as every camera of it sees it, nothing hidden yet."""
    return f"""select *, case when depth > 0.01 then 0.5 + across / depth / (2 * tan_h) end as u, case when depth > 0.01 then 0.5 - upward / depth / (2 * tan_h / {g.ASPECT!r}) end as v from (
        select o.*, c.name as cam, c.ord as cam_ord, c.kind, c.px, c.py, c.pz, c.tan_h, c.fx, c.fy, c.fz, c.dx2, c.dy2, c.rx, c.ry, c.ux, c.uy, c.uz,
        {g.norm('cx - px', 'cy - py', 'cz - pz')} as distance, {g.dot(('cx - px', 'cy - py', 'cz - pz'), ('fx', 'fy', 'fz'))} as depth,
        {g.dot(('cx - px', 'cy - py'), ('rx', 'ry'))} as across, {g.dot(('cx - px', 'cy - py', 'cz - pz'), ('ux', 'uy', 'uz'))} as upward
        from solid o join cam_frame c on o.scene_id = c.scene_id) a"""


@relation
def enrich(d: Spark) -> str:
    return "select scene_id, cam, id, round(distance, 6) as distance from cam_obj"


@relation
def depth(d: Spark) -> str:
    return "select scene_id, cam, id, round(coalesce(depth, 0), 6) as depth from cam_obj"


@relation
def project_fraction(d: Spark) -> str:
    return "select scene_id, cam, id, round(u, 6) as u, round(v, 6) as v from cam_obj"


@relation
def project_pixel(d: Spark) -> str:
    """Pixels of a 1920 x 1080 image, clamped to it; none for what is behind the camera."""
    return f"""select scene_id, cam, id, cast(greatest(0, least(1919, {d.rint('greatest(-9, least(9, u)) * 1920')})) as int) as x_px, cast(greatest(0, least(1079, {d.rint('greatest(-9, least(9, v)) * 1080')})) as int) as y_px
        from cam_obj where u is not null"""


@relation
def frustum(d: Spark) -> str:
    """Solid objects between 0.3 and 15 m away with their centre in the frame of a camera that is no step."""
    return "select * from cam_obj where kind <> 'step' and is_solid and distance between 0.3 and 15 and u between 0 and 1 and v between 0 and 1"


@relation
def frustum_filter(d: Spark) -> str:
    return "select scene_id, cam, id from frustum"


def corners(source: str, more: str = "") -> str:
    """The eight corners of the boxes of rows of cam_obj."""
    w, l, h = (f"coalesce(nullif({x}, 0), 0.3) / 2" for x in ("width", "length", "height"))
    at = ("cx + i * hw - px", "cy + j * hl - py", "cz + k * hh - pz")
    return f"""select scene_id, cam, kind, id, base_type, label, tan_h, {more}(i + 1) * 2 + (j + 1) + cast((k + 1) / 2 as int) as k, {g.dot(at, ('fx', 'fy', 'fz'))} as ahead, {g.dot(at[:2], ('rx', 'ry'))} as side, {g.dot(at, ('ux', 'uy', 'uz'))} as rise from (
        select o.*, c.i, c.j, c.k, {w} as hw, {l} as hl, {h} as hh from {source} o
        cross join (values (-1, -1, -1), (-1, -1, 1), (-1, 1, -1), (-1, 1, 1), (1, -1, -1), (1, -1, 1), (1, 1, -1), (1, 1, 1)) as c(i, j, k)) a"""


@relation
def box_corners(d: Spark) -> str:
    """The eight corners of every box in every view; a missing or zero side counts as 0.3 m."""
    return corners("cam_obj")


@relation
def bbox2d_raw(d: Spark) -> str:
    """Boxes in thousandths of the image; nothing where a corner is behind the camera."""
    clip = lambda x: d.trunc(f"greatest(-30000, least(30000, {x} * 1000))")
    return f"""select * from (select scene_id, cam, kind, id, base_type, label, greatest(0, {clip('u0')}) as x1, greatest(0, {clip('v0')}) as y1, least(1000, {clip('u1')}) as x2, least(1000, {clip('v1')}) as y2 from (
        select scene_id, cam, kind, id, base_type, label, min(ahead) as nearest, min(u) as u0, max(u) as u1, min(v) as v0, max(v) as v1 from (
        select *, case when ahead > 0.01 then 0.5 + side / ahead / (2 * tan_h) end as u, case when ahead > 0.01 then 0.5 - rise / ahead / (2 * tan_h / {g.ASPECT!r}) end as v from box_corners) a
        group by scene_id, cam, kind, id, base_type, label) b where nearest > 0.01) c where x2 - x1 >= 10 and y2 - y1 >= 10"""


@relation
def bbox2d(d: Spark) -> str:
    return "select scene_id, cam, id, x1, y1, x2, y2 from bbox2d_raw"
