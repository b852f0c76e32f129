"""Scene scans: objects, their labels and boxes, rooms."""

from __future__ import annotations

from ..functions import text
from ..plans.catalog import relation
from ..plans.dialect import Spark

# Fixed value: the type that is nothing physical.
NON_SOLID = "lighting"


@relation
def scan_objects(d: Spark) -> str:
    return "select scene_id, id, ord, type, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(width, 6) as width, round(length, 6) as length, round(height, 6) as height, rotation_z from objects"


@relation
def normalize_type(d: Spark) -> str:
    return f"select scene_id, id, {text.normalized_type(d, 'type')} as base_type from objects"


@relation
def clean_label(d: Spark) -> str:
    return f"select scene_id, id, {text.clean_label(d, 'type')} as label from objects"


@relation
def object_label(d: Spark) -> str:
    return f"select scene_id, id, {text.object_label(d, index='ord')} as label from objects"


@relation
def solid(d: Spark) -> str:
    """Objects with a centre, a label and a longest side; solid ones are physical and nowhere thinner than :min_thickness."""
    return f"""select scene_id, id, ord, type, {text.normalized_type(d, 'type')} as base_type, {text.object_label(d, index='ord')} as label, x, y, z, width, length, height,
        x as cx, y as cy, z + coalesce(height, 0) / 2 as cz, greatest(coalesce(width, 0), coalesce(length, 0), coalesce(height, 0)) as longest,
        coalesce(least(width, length, height) > 0 and width is not null and length is not null and height is not null and least(width, length, height) >= :min_thickness and lower(coalesce(type, '')) <> '{NON_SOLID}', false) as is_solid from objects"""


@relation
def solid_filter(d: Spark) -> str:
    return "select scene_id, id, round(longest, 6) as longest from solid where is_solid"


@relation
def centroid(d: Spark) -> str:
    return "select scene_id, id, round(cx, 6) as cx, round(cy, 6) as cy, round(cz, 6) as cz, round(longest, 6) as longest from solid"


@relation
def scene_bounds(d: Spark) -> str:
    return """select scene_id, round(min(x - width / 2), 6) as x_min, round(min(y - length / 2), 6) as y_min, round(max(x + width / 2), 6) as x_max,
        round(max(y + length / 2), 6) as y_max, round(max(z + height), 6) as z_max from objects group by scene_id"""


@relation
def room_size(d: Spark) -> str:
    return "select scene_id, round((x_max - x_min) * (y_max - y_min), 2) as area from rooms"


@relation
def room_pick(d: Spark) -> str:
    """The room that holds most objects, first room on ties: quarters of each scene's room."""
    return """select scene_id, room_name, n from (select scene_id, room_name, n, row_number() over (partition by scene_id order by n desc, room_ord) as rn from (
        select q.scene_id, q.room_name, q.room_ord, count(o.id) as n from (
        select r.scene_id, v.room_ord, concat('room_', cast(v.room_ord as string)) as room_name, x_min + (x_max - x_min) / 2 * v.i as x0, y_min + (y_max - y_min) / 2 * v.j as y0,
        x_min + (x_max - x_min) / 2 * (v.i + 1) as x1, y_min + (y_max - y_min) / 2 * (v.j + 1) as y1
        from rooms r cross join (values (0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)) as v(room_ord, i, j)) q
        left join objects o on o.scene_id = q.scene_id and o.x between q.x0 and q.x1 and o.y between q.y0 and q.y1
        group by q.scene_id, q.room_name, q.room_ord) a) b where rn = 1"""


@relation
def room_objects(d: Spark) -> str:
    return "select o.scene_id, o.id from objects o join rooms r on o.scene_id = r.scene_id and o.x between r.x_min and r.x_max and o.y between r.y_min and r.y_max"


@relation
def name_unique(d: Spark) -> str:
    """Objects whose label no other object of the scene has, at least 0.3 m long."""
    return "select scene_id, id, label from (select scene_id, id, label, longest, count(*) over (partition by scene_id, label) as n from solid) a where n = 1 and longest >= 0.3"


@relation
def first_per_label(d: Spark) -> str:
    return "select scene_id, label, id from (select scene_id, label, id, row_number() over (partition by scene_id, label order by ord) as rn from solid) a where rn = 1"


@relation
def hash_seed(d: Spark) -> str:
    return f"select scene_id, id, {d.seed('concat(scene_id, id)')} as seed from objects"


@relation
def view_verdicts(d: Spark) -> str:
    """Objects without those an external judge calls bad; without a verdict they stay."""
    return "select o.scene_id, o.id, coalesce(v.poor_lighting, false) as poor_lighting from objects o left join verdicts v on v.scene_id = o.scene_id and v.entity = o.id where coalesce(v.quality, 'GOOD') <> 'BAD'"


@relation
def iou3d_pairs(d: Spark) -> str:
    """Pairs of boxes of a scene that meet, with intersection over union."""
    side = lambda a, s: f"greatest(0, least(p.{a} + p.{s} / 2, q.{a} + q.{s} / 2) - greatest(p.{a} - p.{s} / 2, q.{a} - q.{s} / 2))"
    inter = f"{side('x', 'width')} * {side('y', 'length')} * greatest(0, least(p.z + p.height, q.z + q.height) - greatest(p.z, q.z))"
    both = "p.width * p.length * p.height + q.width * q.length * q.height"
    return f"""select scene_id, id_a, id_b, round(case when volumes - inter < 1e-8 then 0 else inter / (volumes - inter) end, 6) as iou from (
        select p.scene_id, p.id as id_a, q.id as id_b, {inter} as inter, {both} as volumes from objects p join objects q on p.scene_id = q.scene_id and p.id < q.id
        and abs(p.x - q.x) < (p.width + q.width) / 2 and abs(p.y - q.y) < (p.length + q.length) / 2 and p.z < q.z + q.height and q.z < p.z + p.height) a where inter > 0"""
