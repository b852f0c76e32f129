"""Further generators, boxes, axes, masks and choices."""

from __future__ import annotations

from ..functions import geometry as g
from ..plans.catalog import relation
from ..plans.dialect import Spark
from .masks import HEIGHT, WIDTH

# Names that say nothing about a scene's contents.
GENERIC = ("object", "objects", "thing", "things", "item", "items", "room", "wall", "floor", "ceiling", "background")


@relation
def view_cameras(d: Spark) -> str:
    """Twelve views around the middle of a room, looking 15 degrees down."""
    az = "(v.i * 30)"
    return f"""select r.scene_id, concat('view_', cast(v.i as string)) as name, cast({az} as int) as azimuth, round((x_min + x_max) / 2 + cos(radians({az})) * cos(radians(-15)), 6) as lx,
        round((y_min + y_max) / 2 + sin(radians({az})) * cos(radians(-15)), 6) as ly, round(z_max / 2 + sin(radians(-15)), 6) as lz from rooms r cross join {d.sequence(12, 'i')} v"""


@relation
def orbit_cameras(d: Spark) -> str:
    """Eight cameras around a scene at two and a half times its largest side, 25 degrees up."""
    return f"""select b.scene_id, v.i as k, round((x_min + x_max) / 2 + far * cos(radians(25)) * cos(radians(v.i * 45)), 5) as px, round((y_min + y_max) / 2 + far * cos(radians(25)) * sin(radians(v.i * 45)), 5) as py, round(z_max / 2 + far * sin(radians(25)), 5) as pz
        from (select *, 2.5 * greatest(x_max - x_min, y_max - y_min, z_max) as far from scene_bounds) b cross join {d.sequence(8, 'i')} v"""


@relation
def room_corner_cameras(d: Spark) -> str:
    """Four cameras under a ceiling of 2.7 m."""
    return """select r.scene_id, v.k, case when v.i = 0 then x_min + 0.12 else x_max - 0.12 end as px, case when v.j = 0 then y_min + 0.12 else y_max - 0.12 end as py, 2.55 + 0 * z_max as pz, (x_min + x_max) / 2 as lx, (y_min + y_max) / 2 as ly, 0.945 + 0 * z_max as lz
        from rooms r cross join (values (0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)) as v(k, i, j)"""


@relation
def floor_boxes(d: Spark) -> str:
    """Slabs a tenth of a metre thick under and over each room."""
    return """select scene_id, v.part, (x_min + x_max) / 2 as cx, (y_min + y_max) / 2 as cy, case when v.part = 'floor' then -0.05 + 0 * z_max else z_max + 0.05 end as cz, x_max - x_min as width, y_max - y_min as length, 0.1 + 0 * z_max as height
        from rooms cross join (values ('floor'), ('ceiling')) as v(part)"""


@relation
def axes_flipped(d: Spark) -> str:
    """Points of Y-down space in Z-up space, and back again."""
    return "select gid, qx, qy, qz, -qx as bx, -(qz - 1.5) as by_, -qy as bz from (select gid, -x as qx, -z as qy, -y + 1.5 as qz from points) a"


@relation
def palette(d: Spark) -> str:
    """Colours a golden ratio of the circle apart, at saturation 0.65 and value 0.95, in bytes."""
    six = "(hue * 6 - floor(hue * 6))"
    p, q, t, v = "0.95 * (1 - 0.65)", f"0.95 * (1 - 0.65 * {six})", f"0.95 * (1 - 0.65 * (1 - {six}))", "0.95"
    part = lambda xs: "cast(floor(round(255 * case cast(floor(hue * 6) as int) " + " ".join(f"when {i} then {x}" for i, x in enumerate(xs)) + " end, 6)) as int)"
    return f"""select k, hue, {part((v, q, p, p, t, v))} as red, {part((t, v, v, q, p, p))} as green, {part((p, p, t, v, v, q))} as blue from (
        select i as k, round(i * 0.618033988749895 - floor(i * 0.618033988749895), 9) as hue from {d.sequence(64, 'i')} n) a"""


@relation
def rotation_angles(d: Spark) -> str:
    """Angles of unit quaternions, from their real part."""
    return "select event_id, round(degrees(2 * acos(least(abs(w), 1))), 5) as angle from (select event_id, cast(event_id % 100 as double) / 99 as w from events) a"


@relation
def merged_names(d: Spark) -> str:
    """Names of several lists, in lower case, each once, without generic ones."""
    known = ", ".join(f"'{x}'" for x in GENERIC)
    return f"select distinct name from (select lower(trim(p_brand)) as name from part union all select lower(trim(p_type)) from part union all select lower(trim(p_name)) from part) a where name <> '' and name not in ({known})"


@relation
def mask_cells(d: Spark) -> str:
    """Pixels of each cell of a 20 x 20 grid of a view, empty cells too; the engine reads the runs once and adds each view's empty grid."""
    if d.name == "spark":
        grid = "flatten(transform(sequence(0L, 19L), i -> transform(sequence(0L, 19L), j -> struct(i as cy, j as cx, 0L as px))))"
        return f"""select scene_id, cam, c.cy, c.cx, sum(c.px) as px from (select scene_id, cam, explode(concat(cells, {grid})) as c from (
            select scene_id, cam, collect_list(case when cy between 0 and 19 and cx between 0 and 19 and px > 0 then struct(cy, cx, px) end) as cells from (
            select scene_id, cam, cast(floor(y / {HEIGHT / 20}) as bigint) as cy, cast(floor((x0 + x1) / 2 / {WIDTH / 20}) as bigint) as cx, sum(case when x1 >= x0 then cast(x1 - x0 + 1 as bigint) else 0L end) as px
            from mask_runs group by 1, 2, 3, 4) a group by scene_id, cam) b) e group by scene_id, cam, c.cy, c.cx"""
    return f"""select c.scene_id, c.cam, i.i as cy, j.j as cx, coalesce(m.px, 0) as px from (select distinct scene_id, cam from mask_runs) c cross join {d.sequence(20, 'i')} i cross join {d.sequence(20, 'j')} j
        left join (select scene_id, cam, cast(floor(y / {HEIGHT / 20}) as int) as cy, cast(floor((x0 + x1) / 2 / {WIDTH / 20}) as int) as cx, sum(x1 - x0 + 1) as px from mask_runs where x1 >= x0 group by 1, 2, 3, 4) m on m.scene_id = c.scene_id and m.cam = c.cam and m.cy = i.i and m.cx = j.j"""


@relation
def integral_image(d: Spark) -> str:
    """Sums of all cells above and to the left."""
    return """select scene_id, cam, cy, cx, cast(sum(row_sum) over (partition by scene_id, cam, cx order by cy) as bigint) as total from (
        select scene_id, cam, cy, cx, sum(px) over (partition by scene_id, cam, cy order by cx) as row_sum from mask_cells) a"""


@relation
def eroded_cells(d: Spark) -> str:
    """Cells around which three by three cells are nearly empty: where a kernel fits."""
    return """select scene_id, cam, cy, cx from (select *, sum(three) over (partition by scene_id, cam, cx order by cy rows between 1 preceding and 1 following) as nine, count(*) over (partition by scene_id, cam, cx order by cy rows between 1 preceding and 1 following) as high from (
        select *, sum(px) over (partition by scene_id, cam, cy order by cx rows between 1 preceding and 1 following) as three, count(*) over (partition by scene_id, cam, cy order by cx rows between 1 preceding and 1 following) as wide from mask_cells) a) b where wide = 3 and high = 3 and nine < 60"""


@relation
def small_masks(d: Spark) -> str:
    """Instances that fill less than 15 % of a view."""
    return f"select scene_id, cam, iid, round(px / cast({WIDTH * HEIGHT} as double), 6) as share from mask_sums where px < 0.15 * {WIDTH * HEIGHT}"


@relation
def merge_roots(d: Spark) -> str:
    """Where chains of merges end, however long: targets are larger, so that chains end."""
    return """with recursive chase(scene_id, node, target) as (select scene_id, node, target from merge_votes
        union all select c.scene_id, c.node, m.target from chase c join merge_votes m on c.scene_id = m.scene_id and c.target = m.node)
        select scene_id, node, target as root from chase c where not exists (select 1 from merge_votes m where m.scene_id = c.scene_id and m.node = c.target)"""


@relation
def best_view(d: Spark) -> str:
    """The camera that looks most straight at each object; the first wins ties."""
    return "select scene_id, id, cam, round(depth / distance, 6) as cosine from (select *, row_number() over (partition by scene_id, id order by round(depth / distance, 9) desc, cam_ord) as rn from cam_obj where kind <> 'step' and distance > 0.3) a where rn = 1"


@relation
def interleaved(d: Spark) -> str:
    """Camera pairs in turn from each kind of pair."""
    return """select scene_id, cam_a, cam_b, row_number() over (partition by scene_id order by turn, kind_a, kind_b) as place from (
        select *, row_number() over (partition by scene_id, kind_a, kind_b order by md5(concat(cam_a, cam_b)), cam_a, cam_b) as turn from camera_pairs where kind_a <> 'step' and kind_b <> 'step') a"""


@relation
def direction_choices(d: Spark) -> str:
    """The right direction and three wrong ones at least two steps from it, in hashed order."""
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(g.DIRECTIONS))
    return f"""select scene_id, cam_a, cam_b, answer, {d.joined(d.collected('choice', 'h'), '|')} as choices from (
        select scene_id, cam_a, cam_b, answer, choice, md5(concat(cam_a, cam_b, choice, '#')) as h from (
        select q.scene_id, q.cam_a, q.cam_b, q.answer, c.choice, row_number() over (partition by q.scene_id, q.cam_a, q.cam_b order by case when c.choice = q.answer then 0 else 1 end, md5(concat(q.cam_a, q.cam_b, c.choice))) as rn
        from camera_relative_position q join (values {names}) as a(k, name) on a.name = q.answer
        join (values {names}) as c(k, choice) on c.k = a.k or least(abs(c.k - a.k), 8 - abs(c.k - a.k)) >= 2) t where rn <= 4) u group by scene_id, cam_a, cam_b, answer"""
