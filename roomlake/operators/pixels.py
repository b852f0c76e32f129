"""Pixels that answer questions: masks of what has none, points on masks, context views, what splat views see."""

from __future__ import annotations

from ..functions import geometry as g
from ..plans.catalog import relation, shorter
from ..plans.dialect import Spark
from .cameras import corners
from .masks import HEIGHT, LEAST_SEEN, WIDTH

# Types whose answer is a place in the image, and the role of the object that it lies on.
POINTED = {"object_grounding": "a", "csr_referring": "b", "object_placement": "b", "free_space": "a", "comparative_grounding": "b", "ordinal_grounding": "a"}
# Points of an answer; the border that masks' middles keep to, the least depth and the largest side of what splat views see.
POINTS, BORDER, LEAST_DEPTH, LARGEST = 16, 0.05, 0.3, 2.0
# Types that may show a second view, and how many of the first view's objects that must see.
CONTEXT = ("imagination_oc", "imagination_oo", "csr_multi_step")
SHARED_OBJECTS = 2


@relation
def surface_views(d: Spark) -> str:
    """The view of each surface, by hash of those that see it."""
    return "select scene_id, surface, min_by(cam, h) as cam from (select s.scene_id, s.id as surface, v.cam, concat(md5(concat(s.scene_id, s.id, v.cam)), v.cam) as h from surface_boxes s join visible v on v.scene_id = s.scene_id and v.id = s.id) a group by scene_id, surface"


def _pixels(d: Spark, source: str, boxes: str = "box_corners", own: str = "p.*") -> str:
    """Corners of boxes ahead of the camera in pixels inside the image."""
    u, v = "0.5 + b.side / b.ahead / (2 * b.tan_h)", f"0.5 - b.rise / b.ahead / (2 * b.tan_h / {g.ASPECT!r})"
    px = lambda x, n: f"greatest(0, least({n - 1}, cast({d.rint(f'greatest(-9, least(9, {x})) * {n}')} as int)))"
    met = f"{boxes} b join {source} p on p.scene_id = b.scene_id and p.cam = b.cam and p.id = b.id" if source else f"{boxes} b"
    return f"select {own}, b.k, {px(u, WIDTH)} as x, {px(v, HEIGHT)} as y from {met} where b.ahead > 0.01"


def _pixels_of(d: Spark, source: str, more: str = "") -> str:
    """The engine's form of _pixels: only the boxes asked for get corners; ``more`` is a column of the source."""
    extra = f", p.{more}" if more else ""
    boxes = corners(f"(select v.*{extra} from cam_obj v join {source} p on p.scene_id = v.scene_id and p.cam = v.cam and p.id = v.id)", f"{more}, " if more else "")
    return _pixels(d, "", f"({boxes})", f"b.scene_id, b.cam, {f'b.{more}, ' if more else ''}b.id")


def _hull(d: Spark, points: str, keys: tuple[str, ...]) -> str:
    """The convex hull of three pixels at least as runs: a row reaches as far as the lines between the pixels do."""
    x = "case when p.y = q.y then {0} else p.x + (q.x - p.x) * (r.y - p.y) / cast(q.y - p.y as double) end"
    own, same = ", ".join(keys), lambda t: " and ".join(f"{t}.{k} = r.{k}" for k in keys)
    if d.name == "spark":  # a group's points and lines stay in its task, and a line meets its own rows only
        last = f"y0 + {HEIGHT - 1}"
        return f"""select {own}, y, cast(floor(round(min(low), 6) + 0.5) as int) as x0, cast(floor(round(max(high), 6) + 0.5) as int) as x1 from (
            select {own}, r.y, {x.format('least(p.x, q.x)')} as low, {x.format('greatest(p.x, q.x)')} as high from (
            select *, explode(sequence(least(p.y, q.y), least(greatest(p.y, q.y), {last}))) as y from (
            select {own}, y0, p, explode(filter(ps, q -> q.k >= p.k)) as q from (
            select {own}, y0, ps, explode(ps) as p from (select {own}, collect_list(struct(k, x, y)) as ps, min(y) as y0 from {points} where {' and '.join(f'{k} is not null' for k in keys)} group by {own} having count(*) >= 3) e) f) g where least(p.y, q.y) <= {last}) r) a group by {own}, y"""
    return f"""select {own}, y, cast(floor(round(min(low), 6) + 0.5) as int) as x0, cast(floor(round(max(high), 6) + 0.5) as int) as x1 from (
        select {', '.join(f'r.{k}' for k in keys)}, r.y, {x.format('least(p.x, q.x)')} as low, {x.format('greatest(p.x, q.x)')} as high from (
        select {', '.join(f'e.{k}' for k in keys)}, cast(e.y0 + n.i as int) as y from (select {own}, min(y) as y0, max(y) as y1 from {points} group by {own} having count(*) >= 3) e
        join {d.sequence(HEIGHT, 'i')} n on e.y0 + n.i <= e.y1) r
        join {points} p on {same('p')} join {points} q on {same('q')}
        where p.k <= q.k and (r.y between p.y and q.y or r.y between q.y and p.y)) a group by {own}, y"""


@relation
def surface_corners(d: Spark) -> str:
    return _pixels(d, "(select scene_id, cam, surface as id from surface_views)")


@shorter("surface_corners", "box_corners")
def _surface_corners(d: Spark) -> str:
    return _pixels_of(d, "(select scene_id, cam, surface as id from surface_views)")


@relation
def surface_runs(d: Spark) -> str:
    """Pixels of each surface in its view; those of its box where no masks are given."""
    return _hull(d, "surface_corners", ("scene_id", "cam", "id"))


@relation
def surface_tops(d: Spark) -> str:
    return "select * from surface_corners where k % 2 = 1"


@relation
def upward_runs(d: Spark) -> str:
    """Pixels whose normal points up; those of the tops of surfaces where no normals are given."""
    return f"select distinct scene_id, cam, y, x0, x1 from ({_hull(d, 'surface_tops', ('scene_id', 'cam', 'id'))}) a"


@relation
def occupant_corners(d: Spark) -> str:
    return _pixels(d, "(select w.scene_id, w.cam, w.surface, o.occupant as id from surface_views w join on_surface o on o.scene_id = w.scene_id and o.surface = w.surface)")


@shorter("occupant_corners", "box_corners")
def _occupant_corners(d: Spark) -> str:
    return _pixels_of(d, "(select w.scene_id, w.cam, w.surface, o.occupant as id from surface_views w join on_surface o on o.scene_id = w.scene_id and o.surface = w.surface)", "surface")


@relation
def occupant_runs(d: Spark) -> str:
    """Pixels of what stands on a surface, in the surface's view."""
    return _hull(d, "occupant_corners", ("scene_id", "cam", "surface", "id"))


@relation
def empty_surface_runs(d: Spark) -> str:
    """Pixels of a surface that face up and that nothing on it covers, as runs as long as can be: by a sweep along each row."""
    ends = lambda runs, up, block: f"select scene_id, cam, surface, y, case when s.way = 1 then x0 else x1 + 1 end as x, s.way * {up} as up, s.way * {block} as block from {runs} cross join (values (1), (-1)) as s(way)"
    top = """(select s.scene_id, s.cam, s.id as surface, s.y, greatest(s.x0, u.x0) as x0, least(s.x1, u.x1) as x1 from surface_runs s
        join upward_runs u on u.scene_id = s.scene_id and u.cam = s.cam and u.y = s.y and u.x0 <= s.x1 and s.x0 <= u.x1) t"""
    line = "partition by scene_id, cam, surface, y order by x"
    return f"""select scene_id, cam, surface, y, min(x) as x0, max(last_x) as x1 from (
        select *, sum(fresh) over ({line}) as island from (
        select *, case when x = lag(last_x) over ({line}) + 1 then 0 else 1 end as fresh from (
        select scene_id, cam, surface, y, x, next_x - 1 as last_x from (
        select scene_id, cam, surface, y, x, lead(x) over ({line}) as next_x, sum(up) over ({line}) as up, sum(block) over ({line}) as block from (
        select scene_id, cam, surface, y, x, sum(up) as up, sum(block) as block from ({ends(top, 1, 0)} union all {ends('occupant_runs o', 0, 1)}) e group by scene_id, cam, surface, y, x) f) h
        where up > 0 and block = 0 and next_x is not null) j) k) l group by scene_id, cam, surface, y, island"""


@relation
def empty_surfaces(d: Spark) -> str:
    return "select scene_id, cam, surface, cast(sum(x1 - x0 + 1) as bigint) as px, min(x0) as x0, min(y) as y0, max(x1) as x1, max(y) as y1 from empty_surface_runs group by scene_id, cam, surface"


@relation
def placement_pairs(d: Spark) -> str:
    """Objects that are no surface with the surfaces that are as large."""
    return """select o.scene_id, o.id, s.id as surface, o.width, o.length from solid o join surface_boxes s on o.scene_id = s.scene_id and o.width <= s.width and o.length <= s.length
        where o.is_solid and not exists (select 1 from surface_boxes b where b.scene_id = o.scene_id and b.id = o.id)"""


@relation
def footprint_kernels(d: Spark) -> str:
    """An object's footprint in pixels at the middle of a surface's top, in the surface's view."""
    def at(x: str, y: str) -> tuple[str, str, str]:
        to = (f"{x} - c.px", f"{y} - c.py", "s.top - c.pz")
        ahead = g.dot(to, ("c.fx", "c.fy", "c.fz"))
        return ahead, f"{g.dot(to[:2], ('c.rx', 'c.ry'))} / {ahead} / (2 * c.tan_h)", f"{g.dot(to, ('c.ux', 'c.uy', 'c.uz'))} / {ahead} / (2 * c.tan_h / {g.ASPECT!r})"

    mid, right, front = at("s.x", "s.y"), at("(s.x + p.width / 2)", "s.y"), at("s.x", "(s.y + p.length / 2)")
    return f"""select scene_id, cam, surface, id, cast(greatest(1, {d.rint('round(h, 6)')}) as int) as kh, cast(greatest(1, {d.rint('round(w, 6)')}) as int) as kw from (
        select p.scene_id, v.cam, p.surface, p.id, abs({front[2]} - {mid[2]}) * {2 * HEIGHT} as h, abs({right[1]} - {mid[1]}) * {2 * WIDTH} as w
        from placement_pairs p join surface_views v on v.scene_id = p.scene_id and v.surface = p.surface join surface_boxes s on s.scene_id = p.scene_id and s.id = p.surface
        join cam_frame c on c.scene_id = v.scene_id and c.name = v.cam where {mid[0]} > 0.01 and {right[0]} > 0.01 and {front[0]} > 0.01) a"""


@relation
def placement_runs(d: Spark) -> str:
    """Where an object's footprint fits wholly into the empty pixels of a surface: the middles, as runs.

    Runs shrink by the kernel's width; a middle needs all rows of the kernel, which a sweep along its row counts.
    """
    return _fits(d, "footprint_kernels", "id")


def _fits(d: Spark, kernels: str, id_: str) -> str:
    line = f"partition by scene_id, cam, surface, {id_}, kh, y order by x"
    rows_ = """(select k.scene_id, k.cam, k.surface, k.{i}, k.kh, r.y + cast(floor(k.kh / 2) as int) - n.i as y, r.x0 + cast(floor(k.kw / 2) as int) as x0, r.x1 - (k.kw - 1 - cast(floor(k.kw / 2) as int)) as x1
        from {k} k join empty_surface_runs r on r.scene_id = k.scene_id and r.cam = k.cam and r.surface = k.surface join {n} n on n.i < k.kh where r.x1 - r.x0 + 1 >= k.kw) t""".format(n=d.sequence(HEIGHT, "i"), k=kernels, i=id_)
    own = f"scene_id, cam, surface, {id_}, kh, y"
    return f"""select scene_id, cam, surface, {id_}, cast(y as int) as y, x as x0, next_x - 1 as x1 from (
        select {own}, x, lead(x) over ({line}) as next_x, sum(n) over ({line}) as n from (
        select {own}, x, sum(n) as n from (select {own}, case when s.way = 1 then x0 else x1 + 1 end as x, s.way as n from {rows_} cross join (values (1), (-1)) as s(way)) e group by {own}, x) f) h where n = kh and next_x is not null"""


@relation
def placement_pixels(d: Spark) -> str:
    """Of each object and surface how many middles fit and one of them by hash, every pixel as likely."""
    own = "scene_id, cam, surface, id"
    return f"""select r.scene_id, r.cam, r.surface, r.id, r.total as valid, cast(r.x0 + r.pick - r.before as int) as x, r.y, round((r.x0 + r.pick - r.before) / cast({WIDTH} as double), 3) as u, round(r.y / cast({HEIGHT} as double), 3) as v from (
        select *, {d.seed("concat('fit', scene_id, cam, surface, id)")} % total as pick from (
        select *, cast(sum(x1 - x0 + 1) over (partition by {own}) as bigint) as total, cast(sum(x1 - x0 + 1) over (partition by {own} order by y, x0) - (x1 - x0 + 1) as bigint) as before from placement_runs) a) r
        where r.pick >= r.before and r.pick <= r.before + r.x1 - r.x0"""


@relation
def kernel_shapes(d: Spark) -> str:
    """Each object's kernel on a surface: objects of one shape fit at the same pixels. (An id that several rows share has all their kernels.)"""
    return """select scene_id, cam, surface, id, kernels, array_join(transform(kernels, s -> concat(s.kh, 'x', s.kw)), ',') as shape from (
        select scene_id, cam, surface, id, array_sort(collect_list(struct(kh, kw))) as kernels from footprint_kernels group by scene_id, cam, surface, id) a"""


@relation
def shape_runs(d: Spark) -> str:
    """placement_runs of each shape."""
    return _fits(d, "(select scene_id, cam, surface, shape, s.kh, s.kw from (select *, explode(kernels) as s from (select distinct scene_id, cam, surface, shape, kernels from kernel_shapes) e) f)", "shape")


@shorter("placement_pixels", "placement_runs")
def _placement_pixels(d: Spark) -> str:
    own = "scene_id, cam, surface, shape"
    return f"""select scene_id, cam, surface, id, total as valid, cast(x0 + pick - before as int) as x, y, round((x0 + pick - before) / cast({WIDTH} as double), 3) as u, round(y / cast({HEIGHT} as double), 3) as v from (
        select o.*, r.total, r.before, r.x0, r.x1, r.y, {d.seed("concat('fit', o.scene_id, o.cam, o.surface, o.id)")} % r.total as pick from kernel_shapes o join (
        select *, cast(sum(x1 - x0 + 1) over (partition by {own}) as bigint) as total, cast(sum(x1 - x0 + 1) over (partition by {own} order by y, x0) - (x1 - x0 + 1) as bigint) as before from shape_runs) r
        on r.scene_id = o.scene_id and r.cam = o.cam and r.surface = o.surface and r.shape = o.shape) p where pick >= before and pick <= before + x1 - x0"""


@relation
def placement_views(d: Spark) -> str:
    """Places for objects on surfaces in a view: a pixel where the footprint fits, or else a place that fits by the boxes and is in the frame."""
    at = ("p.x - c.px", "p.y - c.py", "p.z - c.pz")
    ahead = g.dot(at, ("c.fx", "c.fy", "c.fz"))
    return f"""select scene_id, cam, id, surface, u, v, 'pixels' as way from placement_pixels union all
        select scene_id, cam, id, surface, round(u, 3), round(v, 3), 'boxes' from (
        select p.scene_id, w.cam, p.id, p.surface, 0.5 + {g.dot(at[:2], ('c.rx', 'c.ry'))} / {ahead} / (2 * c.tan_h) as u, 0.5 - {g.dot(at, ('c.ux', 'c.uy', 'c.uz'))} / {ahead} / (2 * c.tan_h / {g.ASPECT!r}) as v
        from object_placement p join surface_views w on w.scene_id = p.scene_id and w.surface = p.surface join cam_frame c on c.scene_id = w.scene_id and c.name = w.cam where {ahead} > 0.01
        and not exists (select 1 from placement_pixels x where x.scene_id = p.scene_id and x.surface = p.surface and x.id = p.id)) a where u between 0 and 1 and v between 0 and 1"""


@relation
def free_space_views(d: Spark) -> str:
    """Surfaces with free places, in a view that sees them."""
    return "select f.scene_id, w.cam, f.surface, f.free_places from free_space f join surface_views w on w.scene_id = f.scene_id and w.surface = f.surface"


@relation
def pointed(d: Spark) -> str:
    """What questions about a place in the image point at, in their views."""
    roles = " union all ".join(f"select scene_id, cam, {role} as id from keyed_answers where qtype = '{t}' and cam is not null" for t, role in POINTED.items())
    return f"select distinct scene_id, cam, id from ({roles}) a"


@relation
def corner_pixels(d: Spark) -> str:
    """The corners, in pixels, of what questions point at."""
    return _pixels(d, "pointed")


@shorter("corner_pixels", "box_corners")
def _corner_pixels(d: Spark) -> str:
    return _pixels_of(d, "pointed")


@relation
def hull_runs(d: Spark) -> str:
    """The hulls of what questions point at."""
    return _hull(d, "corner_pixels", ("scene_id", "cam", "id"))


@relation
def object_runs(d: Spark) -> str:
    """The runs of pixels of what is pointed at: of its mask, or of its box's hull where it has none in the view."""
    instances, runs = "instance_map m", "mask_runs r"
    if d.name == "spark":  # masks of scenes in which nothing is pointed at are not made
        there = "where scene_id in (select scene_id from pointed)"
        instances, runs = f"(select * from instance_map {there}) m", f"(select * from mask_runs {there}) r"
    own = f"""select p.scene_id, p.cam, p.id, r.y, r.x0, r.x1 from pointed p join {instances} on m.scene_id = p.scene_id and m.object_id = p.id
        join {runs} on r.scene_id = p.scene_id and r.cam = p.cam and r.iid = m.iid where r.x1 >= r.x0"""
    return f"""select scene_id, cam, id, y, x0, x1, 'mask' as source from ({own}) a
        union all select h.scene_id, h.cam, h.id, h.y, h.x0, h.x1, 'hull' from hull_runs h where not exists (select 1 from ({own}) o where o.scene_id = h.scene_id and o.cam = h.cam and o.id = h.id)"""


@relation
def answer_masks(d: Spark) -> str:
    """Pixels and boxes of the masks that answer questions."""
    return "select scene_id, cam, id, source, count(*) as n_runs, cast(sum(x1 - x0 + 1) as bigint) as px, min(x0) as x0, min(y) as y0, max(x1) as x1, max(y) as y1 from object_runs group by scene_id, cam, id, source"


@relation
def answer_points(d: Spark) -> str:
    """Sixteen different pixels of each such mask (all of a smaller one): one by hash from each sixteenth of its pixels in line."""
    key = "concat('t', s.scene_id, s.cam, s.id, cast(n.i as string))"
    least, most = f"cast(floor(n.i * s.px / {POINTS}) as bigint)", f"cast(floor((n.i + 1) * s.px / {POINTS}) as bigint)"
    return f"""select t.scene_id, t.cam, t.id, t.k, cast(r.x0 + t.nth - r.before as int) as x, r.y, round((r.x0 + t.nth - r.before) / cast({WIDTH} as double), 3) as u, round(r.y / cast({HEIGHT} as double), 3) as v from (
        select s.scene_id, s.cam, s.id, n.i as k, {least} + {d.seed(key)} % ({most} - {least}) as nth from answer_masks s join {d.sequence(POINTS, 'i')} n on {most} > {least}) t
        join (select *, sum(x1 - x0 + 1) over (partition by scene_id, cam, id order by y, x0) - (x1 - x0 + 1) as before from object_runs) r
        on r.scene_id = t.scene_id and r.cam = t.cam and r.id = t.id and t.nth >= r.before and t.nth <= r.before + r.x1 - r.x0"""


@shorter("answer_points", "object_runs", "answer_masks")
def _answer_points(d: Spark) -> str:
    """Runs are read once: a run knows how many pixels its mask has and how many are before it, and so which points are its own."""
    least, most = f"cast(floor(k * px / {POINTS}) as bigint)", f"cast(floor((k + 1) * px / {POINTS}) as bigint)"
    key = "concat('t', scene_id, cam, id, cast(k as string))"
    there = f"filter(sequence(0, {POINTS - 1}), k -> {most} > {least} and {most} > before and {least} <= before + x1 - x0)"
    return f"""select scene_id, cam, id, t.k, cast(x0 + t.nth - before as int) as x, y, round((x0 + t.nth - before) / cast({WIDTH} as double), 3) as u, round(y / cast({HEIGHT} as double), 3) as v from (
        select *, explode(transform({there}, k -> struct(cast(k as bigint) as k, {least} + {d.seed(key)} % ({most} - {least}) as nth))) as t from (
        select *, cast(sum(x1 - x0 + 1) over (partition by scene_id, cam, id) as bigint) as px, sum(x1 - x0 + 1) over (partition by scene_id, cam, id order by y, x0) - (x1 - x0 + 1) as before from object_runs) r) s
        where t.nth >= before and t.nth <= before + x1 - x0"""


@relation
def point_answers(d: Spark) -> str:
    """The points of each mask as a text: (u, v) in three places, in line."""
    one = lambda x: f"cast(cast({x} as decimal(6, 3)) as string)"
    text = f"concat('(', {one('u')}, ', ', {one('v')}, ')')"
    return f"select scene_id, cam, id, concat('[', {d.joined(d.collected(text, 'k'), ', ')}, ']') as answer from answer_points group by scene_id, cam, id"


@relation
def context_views(d: Spark) -> str:
    """A second view for half of the questions that may show one, by hash: a corner camera that sees two of the first view's objects at least."""
    types = ", ".join(f"'{t}'" for t in CONTEXT)
    return f"""select qkey, min_by(cam_b, h) as context from (select k.qkey, s.other as cam_b, concat(md5(concat(k.qkey, s.other)), s.other) as h from keyed_answers k join (
        select a.scene_id, a.cam, b.cam as other from visible a join visible b on a.scene_id = b.scene_id and a.id = b.id and a.cam <> b.cam and b.kind = 'corner' group by a.scene_id, a.cam, b.cam having count(*) >= {SHARED_OBJECTS}) s
        on s.scene_id = k.scene_id and s.cam = k.cam where k.qtype in ({types}) and {d.seed("concat(k.qkey, '/context')")} % 2 = 0) t group by qkey"""


@relation
def splat_visible(d: Spark) -> str:
    """What a splat view sees: 200 pixels of a mask with its middle off the border, a middle ahead and in the image, no side over two metres."""
    u, v = f"s.twice_x / cast(2 * s.px as double) / {WIDTH}", f"s.sum_y / cast(s.px as double) / {HEIGHT}"
    inside = lambda x: f"round({x}, 9) between {BORDER} and {1 - BORDER}"
    n, flat = g.norm("lx - px", "ly - py", "lz - pz"), g.norm("lx - px", "ly - py")
    at = ("i.x - c.px", "i.y - c.py", "i.z - c.pz")
    ahead, across, up = g.dot(at, ("c.fx", "c.fy", "c.fz")), g.dot(at[:2], ("c.fy", "-c.fx")), at[2]
    return f"""select scene_id, cam, iid, category, round(depth, 6) as depth from (
        select s.scene_id, s.cam, s.iid, i.category, {ahead} as depth, {across} / c.flat as side, ({up} - c.fz * ({ahead})) / c.flat as rise from mask_sums s
        join (select scene_id, iid, min(category) as category, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z, min(x) as x0, min(y) as y0, min(z) as z0, max(x) as x1, max(y) as y1, max(z) as z1 from points group by scene_id, iid) i
        on i.scene_id = s.scene_id and i.iid = s.iid
        join (select scene_id, name, px, py, pz, (lx - px) / {n} as fx, (ly - py) / {n} as fy, (lz - pz) / {n} as fz, {flat} / {n} as flat from gold_views) c on c.scene_id = s.scene_id and c.name = concat('view_', substr(s.cam, 5))
        where s.px >= {LEAST_SEEN} and {inside(u)} and {inside(v)} and greatest(i.x1 - i.x0, i.y1 - i.y0, i.z1 - i.z0) <= {LARGEST}) a
        where depth >= {LEAST_DEPTH} and abs(side / depth) <= 1 and abs(rise / depth) <= {HEIGHT / WIDTH}"""


# Words in the names of what belongs to a building; the least side of an object.
STRUCTURAL = ("room_geometry", "wall", "floor", "ceiling", "ground_plane", "ground", "body_link", "collision")
LEAST_SIDE = 0.05


@relation
def movable_prims(d: Spark) -> str:
    """Objects of a stage: none of the building, no side under five centimetres; the type is the name without its number, sides in tenths of a millimetre."""
    building = d.matches("lower(type)", "|".join(STRUCTURAL))
    kind = d.replace_pattern("type", "_[0-9]+$", "")
    return f"""select scene_id, id, {kind} as type, x, y, z, round(width, 4) as width, round(length, 4) as length, round(height, 4) as height from (
        select scene_id, id, type, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, width, length, height from objects) a where not {building} and least(width, length, height) >= {LEAST_SIDE}"""


PICKED = 5  # scenes of a selection
SCENE_SEED = 42


@relation
def scene_pick(d: Spark) -> str:
    """The first scenes by name, and the first as a seed shuffles them."""
    every = "(select distinct scene_id from objects) s"
    return f"""select 'first' as way, scene_id from (select scene_id from {every} order by scene_id limit {PICKED}) a
        union all select 'shuffled', scene_id from (select scene_id from {every} order by md5(concat('{SCENE_SEED}', scene_id)), scene_id limit {PICKED}) b"""


@relation
def view_detections(d: Spark) -> str:
    """What each view detects, in line: a label's points there, their middle, box and score; nothing under five points; derived from points by number."""
    return f"""select scene_id, category as label, row_number() over (partition by scene_id, category order by view, iid) as nth, view, n, sx, sy, sz, x0, y0, z0, x1, y1, z1, score from (
        select p.scene_id, p.category, p.iid, p.gid % 4 as view, count(*) as n, round(sum(p.x), 6) as sx, round(sum(p.y), 6) as sy, round(sum(p.z), 6) as sz, min(p.x) as x0, min(p.y) as y0, min(p.z) as z0, max(p.x) as x1, max(p.y) as y1, max(p.z) as z1,
        round(0.5 + cast(count(*) % 50 as double) / 100, 6) as score from points p group by p.scene_id, p.category, p.iid, p.gid % 4) a where n >= 5"""


@relation
def detection_pairs(d: Spark) -> str:
    """Detections of a label whose boxes overlap by more than a fifth of their union: the earlier and the later."""
    side = lambda a: f"greatest(0, least(p.{a}1, q.{a}1) - greatest(p.{a}0, q.{a}0))"
    volume = lambda t: f"({t}.x1 - {t}.x0) * ({t}.y1 - {t}.y0) * ({t}.z1 - {t}.z0)"
    inter = f"{side('x')} * {side('y')} * {side('z')}"
    return f"""select scene_id, label, early, late from (select p.scene_id, p.label, p.nth as early, q.nth as late, {inter} as inter, {volume('p')} + {volume('q')} as volumes from view_detections p join view_detections q on p.scene_id = q.scene_id and p.label = q.label and p.nth < q.nth) a
        where volumes - inter >= 1e-8 and round(inter / (volumes - inter), 9) > 0.2"""


@relation
def touching_runs(d: Spark) -> str:
    """Runs of a mask that touch: above each other, or side by side; runs are told by their row and start."""
    one = "scene_id, cam, iid, y, x0, x1"
    return f"""select a.scene_id, a.cam, a.iid, a.y as ya, a.x0 as xa, b.y as yb, b.x0 as xb from (select {one} from mask_runs where x1 >= x0 and iid > 0) a
        join (select {one} from mask_runs where x1 >= x0 and iid > 0) b on a.scene_id = b.scene_id and a.cam = b.cam and a.iid = b.iid and a.y + 1 = b.y and a.x0 <= b.x1 and b.x0 <= a.x1
        union all select a.scene_id, a.cam, a.iid, a.y, a.x0, b.y, b.x0 from (select {one} from mask_runs where x1 >= x0 and iid > 0) a
        join (select {one} from mask_runs where x1 >= x0 and iid > 0) b on a.scene_id = b.scene_id and a.cam = b.cam and a.iid = b.iid and a.y = b.y and a.x1 + 1 = b.x0"""
