"""Instance masks as runs of pixels: all sums over pixels come from the ends of runs."""

from __future__ import annotations

from ..plans.catalog import relation, shorter
from ..plans.dialect import Spark

WIDTH, HEIGHT = 320, 200


# Pixels that a mask needs for questions in general, to be visible, to be a name, to be an area.
LEAST_MASK, LEAST_SEEN, LEAST_NAMED, LEAST_AREA = 5000, 200, 1000, 10_000
# Our images are smaller than those the numbers above are for.
FULL = 1296 * 968


def scaled(px: int) -> int:
    """A number of pixels of a full image, for an image of ours."""
    return max(1, round(px * WIDTH * HEIGHT / FULL))


@relation
def mask_sums(d: Spark) -> str:
    return """select scene_id, cam, iid, sum(x1 - x0 + 1) as px, sum((x0 + x1) * (x1 - x0 + 1)) as twice_x, sum(y * (x1 - x0 + 1)) as sum_y, min(x0) as x0, min(y) as y0, max(x1) as x1, max(y) as y1,
        count(distinct y) as n_rows, sum(distinct y) as sum_rows from mask_runs where x1 >= x0 and iid > 0 group by scene_id, cam, iid"""


@relation
def mask_counts(d: Spark) -> str:
    return "select scene_id, cam, iid, px from mask_sums"


@relation
def mask_visible(d: Spark) -> str:
    """Objects with 200 pixels at least in a view."""
    return f"select s.scene_id, s.cam, m.object_id, s.px from mask_sums s join instance_map m on s.scene_id = m.scene_id and s.iid = m.iid where s.px >= {LEAST_SEEN}"


@relation
def mask_large(d: Spark) -> str:
    """Objects whose masks are large enough for questions in general."""
    return f"select s.scene_id, s.cam, m.object_id, s.px from mask_sums s join instance_map m on s.scene_id = m.scene_id and s.iid = m.iid where s.px >= {scaled(LEAST_MASK)}"


@relation
def mask_objects(d: Spark) -> str:
    """Every instance of a view with its object; those of no object get none, and objects without an instance -1."""
    return """select s.scene_id, s.cam, s.iid, m.object_id from mask_sums s left join instance_map m on s.scene_id = m.scene_id and s.iid = m.iid"""


@relation
def object_instances(d: Spark) -> str:
    """Every object of a scene with its instance number, -1 where it has none."""
    return "select o.scene_id, o.id, coalesce(m.iid, -1) as iid from objects o left join instance_map m on o.scene_id = m.scene_id and o.id = m.object_id"


@relation
def mask_bbox(d: Spark) -> str:
    """Boxes of masks, four pixels wider, inside the image, and in thousandths of it."""
    return f"""select scene_id, cam, iid, greatest(0, x0 - 4) as x0, greatest(0, y0 - 4) as y0, least({WIDTH - 1}, x1 + 4) as x1, least({HEIGHT - 1}, y1 + 4) as y1,
        cast(floor(x0 * 1000 / cast({WIDTH} as double)) as int) as x0_1000, cast(floor(y0 * 1000 / cast({HEIGHT} as double)) as int) as y0_1000,
        cast(floor(x1 * 1000 / cast({WIDTH} as double)) as int) as x1_1000, cast(floor(y1 * 1000 / cast({HEIGHT} as double)) as int) as y1_1000 from mask_sums"""


@relation
def mask_bbox1000(d: Spark) -> str:
    """Boxes in thousandths of masks of 100 pixels at least, ten thousandths wide and high at least."""
    return "select b.scene_id, b.cam, b.iid, x0_1000, y0_1000, x1_1000, y1_1000 from mask_bbox b join mask_sums s on b.scene_id = s.scene_id and b.cam = s.cam and b.iid = s.iid where s.px >= 100 and x1_1000 - x0_1000 >= 10 and y1_1000 - y0_1000 >= 10"


@relation
def mask_centroid(d: Spark) -> str:
    return f"""select scene_id, cam, iid, round(twice_x / cast(2 * px as double) / {WIDTH}, 6) as u, round(sum_y / cast(px as double) / {HEIGHT}, 6) as v, round(sum_rows / cast(n_rows as double) / {HEIGHT}, 6) as row_v from mask_sums where px >= 10"""


@relation
def mask_middle_rows(d: Spark) -> str:
    """Instances of 200 pixels whose distinct rows lie around the middle half of a view."""
    return f"select scene_id, cam, iid, round(sum_rows / cast(n_rows as double) / {HEIGHT}, 6) as row_v from mask_sums where px >= {LEAST_SEEN} and sum_rows / cast(n_rows as double) / {HEIGHT} between 0.25 and 0.75"


@relation
def best_camera(d: Spark) -> str:
    """The view with most pixels of an instance, 500 at least."""
    return "select scene_id, iid, cam, px from (select *, row_number() over (partition by scene_id, iid order by px desc, cam) as rn from mask_sums where px >= 500) a where rn = 1"


@relation
def mask_kinds(d: Spark) -> str:
    """What the masks' objects are called; derived: instances share names by twos."""
    return "select scene_id, cam, m.iid, m.object_id, concat('kind ', cast(cast(floor(m.iid / 2) as bigint) as string)) as label, s.px from (select scene_id, cam, iid, px from mask_sums) s join instance_map m using (scene_id, iid)"


@relation
def name_unique_in_view(d: Spark) -> str:
    """Objects whose label exactly one object of the view has that shows 1000 pixels of a full image."""
    return f"select scene_id, cam, object_id, label from (select *, count(*) over (partition by scene_id, cam, label) as n from mask_kinds where px >= {scaled(LEAST_NAMED)}) a where n = 1"


@relation
def name_first_in_view(d: Spark) -> str:
    """The first object of each label of a view, for questions that mark what they mean."""
    return "select scene_id, cam, label, object_id from (select *, row_number() over (partition by scene_id, cam, label order by iid) as rn from mask_kinds) a where rn = 1"


@relation
def csr_masks(d: Spark) -> str:
    """Objects of a label of their own in a view that fill less than 15 % of it."""
    return f"select scene_id, cam, object_id, label, round(px / cast({WIDTH * HEIGHT} as double), 6) as share from (select *, count(*) over (partition by scene_id, cam, label) as n from mask_kinds) a where n = 1 and px < 0.15 * {WIDTH * HEIGHT}"


@relation
def mask_fragments(d: Spark) -> str:
    """Masks that are no objects: too small, or thin strips with holes."""
    box = "(x1 - x0 + 1) * (y1 - y0 + 1)"
    long, short = "greatest(x1 - x0 + 1, y1 - y0 + 1)", "least(x1 - x0 + 1, y1 - y0 + 1)"
    return f"select scene_id, cam, iid, case when px < 500 then 'small' else 'strip' end as reason from mask_sums where px < 500 or ({long} > 6 * {short} and px < 0.3 * {box})"


@relation
def object_object_mv(d: Spark) -> str:
    """Two objects that two views share: their sides in the second view from mask centroids, and near or far by their boxes' distance in it."""
    u, v = f"(twice_x / cast(2 * px as double) / {WIDTH})", f"(sum_y / cast(px as double) / {HEIGHT})"
    apart = "sqrt((ua - ub) * (ua - ub) + (va - vb) * (va - vb))"
    of = lambda more="": f"(select scene_id, cam, iid{more} from mask_sums where px >= {LEAST_SEEN})"
    return f"""select scene_id, cam_a, cam_b, id_a, id_b, concat(case when ua > ub then 'right' else 'left' end, ', ', case when va < vb then 'above' else 'below' end, case when {apart} < 0.1 then ', near' when {apart} > 0.2 then ', far' else '' end) as answer from (
        select p.scene_id, p.cam as cam_a, q.cam as cam_b, q.iid as id_a, r.iid as id_b, q.u as ua, r.u as ub, q.v as va, r.v as vb
        from {of()} p join {of(f', {u} as u, {v} as v')} q on p.scene_id = q.scene_id and p.iid = q.iid and p.cam < q.cam
        join {of(f', {u} as u, {v} as v')} r on r.scene_id = q.scene_id and r.cam = q.cam and r.iid > q.iid
        join {of()} s on s.scene_id = p.scene_id and s.cam = p.cam and s.iid = r.iid) a where abs(ua - ub) > 0.03 and abs(va - vb) > 0.03"""


@relation
def mask_pairs(d: Spark) -> str:
    """The engine's form of object_object_mv: masks meet once in the second view, and the first views are those that both have.

    Rows are dealt out by scene and the last part of the second view's name, in as many tasks as the sources ask for: pairs are many times the masks.
    """
    u, v = f"(twice_x / cast(2 * px as double) / {WIDTH})", f"(sum_y / cast(px as double) / {HEIGHT})"
    apart = "sqrt((ua - ub) * (ua - ub) + (va - vb) * (va - vb))"
    seen = f"""select /*+ repartition(64, scene_id, tail) */ *, collect_set(cam) over (partition by scene_id, iid) as cams from (
        select scene_id, cam, iid, {u} as u, {v} as v, substring_index(cam, '/', -1) as tail from mask_sums where px >= {LEAST_SEEN}) s"""
    return f"""select scene_id, tail, cam_b, id_a, id_b, explode(cams) as cam_a, concat(case when ua > ub then 'right' else 'left' end, ', ', case when va < vb then 'above' else 'below' end, case when {apart} < 0.1 then ', near' when {apart} > 0.2 then ', far' else '' end) as answer from (
        select q.scene_id, q.tail, q.cam as cam_b, q.iid as id_a, r.iid as id_b, q.u as ua, r.u as ub, q.v as va, r.v as vb, filter(array_intersect(q.cams, r.cams), c -> c < q.cam) as cams
        from ({seen}) q join ({seen}) r on r.scene_id = q.scene_id and r.tail = q.tail and r.cam <= q.cam and r.cam >= q.cam and r.iid > q.iid) a where abs(ua - ub) > 0.03 and abs(va - vb) > 0.03"""


@shorter("object_object_mv", "mask_sums")
def _object_object_mv(d: Spark) -> str:
    return "select scene_id, cam_a, cam_b, id_a, id_b, answer from mask_pairs"


@relation
def ground_truth_points(d: Spark) -> str:
    """Sixteen pixels of each mask, by hash of run and place in it."""
    run = "concat('p', scene_id, cam, cast(y as string), '/', cast(x0 as string))"
    return f"""select scene_id, cam, iid, y, x from (select scene_id, cam, iid, y, x0 + cast({d.seed(run)} % (x1 - x0 + 1) as int) as x, row_number() over (partition by scene_id, cam, iid order by md5({run}), y, x0) as rn
        from mask_runs where x1 >= x0 and iid > 0) a where rn <= 16"""


@relation
def view_pixels(d: Spark) -> str:
    """Pixels of instances and their part of each view; black ones show nothing."""
    return f"select scene_id, cam, sum(case when iid > 0 then x1 - x0 + 1 else 0 end) as px, round(sum(case when iid > 0 then x1 - x0 + 1 else 0 end) / cast({WIDTH * HEIGHT} as double), 6) as share from mask_runs where x1 >= x0 group by scene_id, cam"


@relation
def black_images(d: Spark) -> str:
    """Views whose mean pixel is under 5 of 255, a lit pixel counting 255."""
    return "select scene_id, cam from view_pixels where share * 255 < 5"


@relation
def scored_masks(d: Spark) -> str:
    """Masks as a detector gives them, which may overlap: each run again, shifted, with a score; derived."""
    return """select scene_id, cam, y, x0 + s.i * 5 as x0, least(319, x1 + s.i * 5) as x1, iid * 2 + s.i as mask, 0.30 + cast((iid * 7 + s.i * 3) % 20 as double) / 40 as score, iid % 3 = 0 as ambiguous
        from mask_runs cross join (values (0), (1)) as s(i) where x1 >= x0 and iid > 0 and x0 + s.i * 5 <= 319"""


@relation
def pixel_labels(d: Spark) -> str:
    """Of overlapping masks the one of highest score at each pixel: doubtful labels lose 0.15, 0.35 is the least, the earlier mask wins ties."""
    return f"""select scene_id, cam, y, x, mask from (select scene_id, cam, y, x, mask, row_number() over (partition by scene_id, cam, y, x order by round(score, 9) desc, mask) as rn from (
        select m.scene_id, m.cam, m.y, m.x0 + n.i as x, m.mask, m.score - case when m.ambiguous then 0.15 else 0 end as score from scored_masks m join {d.sequence(64, 'i')} n on m.x0 + n.i <= m.x1) a where score >= 0.35) b where rn = 1"""


@relation
def pixel_segments(d: Spark) -> str:
    """pixel_labels as runs between ends of masks: all pixels of such a run have the same masks."""
    runs = "(select scene_id, cam, y, x0, x1, mask, round(score, 9) as score from (select scene_id, cam, y, x0, x1, mask, score - case when ambiguous then 0.15 else 0 end as score from scored_masks) a where score >= 0.35 and x0 <= x1)"
    line = "partition by scene_id, cam, y order by x"
    return f"""select scene_id, cam, y, x0, x1, max_by(mask, struct(score, -mask)) as mask from (
        select s.scene_id, s.cam, s.y, s.x0, s.x1, r.mask, r.score from (select scene_id, cam, y, x as x0, lead(x) over ({line}) - 1 as x1 from (select distinct scene_id, cam, y, explode(array(x0, x1 + 1)) as x from {runs} e) f) s
        join {runs} r on r.scene_id = s.scene_id and r.cam = s.cam and r.y = s.y and r.x0 <= s.x0 and s.x1 <= r.x1) t group by scene_id, cam, y, x0, x1"""


@relation
def mask_argmax(d: Spark) -> str:
    if d.name == "spark":  # no pixels are made
        return "select scene_id, cam, mask, cast(sum(x1 - x0 + 1) as bigint) as px, min(x0) as x0, max(x1) as x1 from pixel_segments group by scene_id, cam, mask"
    return "select scene_id, cam, mask, count(*) as px, min(x) as x0, max(x) as x1 from pixel_labels group by scene_id, cam, mask"
