"""Exported stages: prims become rooms and objects, replies of a judge of views become verdicts, meshes are turned."""

from __future__ import annotations

from ..plans.catalog import relation
from ..plans.dialect import Spark

# Words in the names of prims that are no furniture.
STRUCTURE = ("room_geometry", "wall", "floor", "ceiling", "ground_plane", "ground", "body_link", "collision")
CEILING = 2.7  # metres; stages do not say
LEAST = 0.05  # metres an object measures in each direction
ROOT = "/World/scene"


@relation
def stage_rooms(d: Spark) -> str:
    """Rooms as minima and maxima: a room's prim stands in its centre, the scale of its floor is half its extent.

    A floor without a scale gives no room, a room with several floors one for each.
    """
    return f"""select r.scene_id, {d.before('r.name', '_room_geometry_')} as room, round(r.x - f.scale_x, 6) as x_min, round(r.y - f.scale_y, 6) as y_min,
        round(r.x + f.scale_x, 6) as x_max, round(r.y + f.scale_y, 6) as y_max, cast({CEILING} as double) as z_max
        from prims r join prims b on b.scene_id = r.scene_id and b.parent = r.path join prims f on f.scene_id = b.scene_id and f.parent = b.path
        where r.name like '%room!_geometry%' escape '!' and r.name not like '%body!_link%' escape '!' and f.name like '%floor!_collision%' escape '!'
        and f.scale_x is not null and f.scale_y is not null"""


@relation
def stage_objects(d: Spark) -> str:
    """Furniture of a stage: active prims right below its geometry (below the scene, where a stage has none) that are no structure.

    Prims without bounds are left out, and those too thin in any direction.  The type is the name without
    one number at its end; the base is the lowest point.
    """
    return f"""select p.scene_id, p.name as id, {d.replace_pattern('p.name', '_[0-9]+$', '')} as type, round((p.x_min + p.x_max) / 2, 6) as x, round((p.y_min + p.y_max) / 2, 6) as y, round(p.z_min, 6) as z,
        round(p.x_max - p.x_min, 4) as width, round(p.y_max - p.y_min, 4) as length, round(p.z_max - p.z_min, 4) as height, cast(0 as double) as rotation_z
        from prims p left join (select distinct scene_id from prims where path = '{ROOT}/Geometry') g on g.scene_id = p.scene_id
        where p.parent = case when g.scene_id is null then '{ROOT}' else '{ROOT}/Geometry' end and p.active and not {d.matches('lower(p.name)', '|'.join(STRUCTURE))}
        and p.x_max - p.x_min >= {LEAST} and p.y_max - p.y_min >= {LEAST} and p.z_max - p.z_min >= {LEAST}"""


@relation
def stage_room_objects(d: Spark) -> str:
    """The rooms of a stage that an object's centre lies in, borders included."""
    return """select o.scene_id, r.room, o.id from stage_objects o join stage_rooms r on o.scene_id = r.scene_id
        and o.x between r.x_min and r.x_max and o.y between r.y_min and r.y_max"""


@relation
def reply_bodies(d: Spark) -> str:
    """What stands in the first fence of a view's last reply, else all of it; null where that is no JSON."""
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    return f"""select scene_id, cam, ord, {d.valid_json('body')} as body from (
        select scene_id, cam, ord, trim(case when {d.matches('reply', fence)} then {d.extracted('reply', fence)} else reply end) as body from (
        select *, row_number() over (partition by scene_id, cam order by nth desc) as rn from view_replies) r where rn = 1) a"""


@relation
def view_filter(d: Spark) -> str:
    """Verdicts on views: quality in capitals, UNKNOWN where a reply says none or is no JSON; what a reply leaves out is null."""
    flag = lambda key: f"case when {d.json_text('body', key)} is not null then lower({d.json_text('body', key)}) not in ('false', '0', '0.0', '') end as {key}"
    return f"""select scene_id, cam, ord, upper(coalesce({d.json_text('body', 'quality')}, 'unknown')) as quality, {flag('poor_lighting')}, {flag('large_occlusion')},
        coalesce({d.json_text('body', 'reason')}, '') as reason from reply_bodies"""


@relation
def judged_views(d: Spark) -> str:
    """Verdicts in words."""
    word = lambda flag: f"coalesce(cast({flag} as string), 'unsaid') as {flag}"
    return f"select scene_id, cam, quality, {word('poor_lighting')}, {word('large_occlusion')}, reason from view_filter"


@relation
def judged_cameras(d: Spark) -> str:
    """Cameras without those that are judged bad; those without a verdict stay."""
    return """select c.scene_id, c.name as cam from cameras c where not exists (
        select 1 from view_filter v where v.scene_id = c.scene_id and v.cam = c.name and v.quality = 'BAD')"""


@relation
def judged_counts(d: Spark) -> str:
    """Views of each verdict in a scene."""
    return """select scene_id, count(*) as views, count(case when quality = 'GOOD' then 1 end) as good, count(case when quality = 'BAD' then 1 end) as bad,
        count(case when poor_lighting then 1 end) as dark, count(case when large_occlusion then 1 end) as hidden from view_filter group by scene_id"""


@relation
def mesh_corners(d: Spark) -> str:
    """The corners of meshes after turns about x, then y, then z (degrees), moved to where they stand."""
    turned = """select *, y0 * cos(radians(rx)) - z0 * sin(radians(rx)) as y1, y0 * sin(radians(rx)) + z0 * cos(radians(rx)) as z1 from (
        select m.*, v.corner, v.a * m.width / 2 as x0, v.b * m.length / 2 as y0, v.c * m.height as z0 from mesh_poses m
        cross join (values (0, -1, -1, 0), (1, 1, -1, 0), (2, 1, 1, 0), (3, -1, 1, 0), (4, -1, -1, 1), (5, 1, -1, 1), (6, 1, 1, 1), (7, -1, 1, 1)) as v(corner, a, b, c)) p"""
    return f"""select scene_id, id, corner, round(x + x2 * cos(radians(rz)) - y1 * sin(radians(rz)), 6) as x, round(y + x2 * sin(radians(rz)) + y1 * cos(radians(rz)), 6) as y, round(z + z2, 6) as z from (
        select *, x0 * cos(radians(ry)) + z1 * sin(radians(ry)) as x2, z1 * cos(radians(ry)) - x0 * sin(radians(ry)) as z2 from ({turned}) q) s"""


@relation
def mesh_bounds(d: Spark) -> str:
    """The box around each turned mesh."""
    return """select scene_id, id, min(x) as x_min, min(y) as y_min, min(z) as z_min, max(x) as x_max, max(y) as y_max, max(z) as z_max from mesh_corners group by scene_id, id"""
