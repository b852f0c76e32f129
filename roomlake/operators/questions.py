"""Questions about single objects and groups, their choices, templates, limits."""

from __future__ import annotations

from ..functions import geometry as g
from ..functions import text
from ..plans.catalog import relation
from ..plans.dialect import Spark

PER_VIEW = 5
# Types that say nothing.
UNINFORMATIVE = ("object", "mesh", "prim", "xform", "scope", "material", "light", "lighting")


def _diverse(columns: str, source: str, where: str = "true") -> str:
    """PER_VIEW objects of a view in the order of a hash, each type once before any twice."""
    key = "md5(concat(scene_id, cam, id))"
    return f"""select {columns} from (select *, row_number() over (partition by scene_id, cam order by case when in_type > 1 then 1 else 0 end, h, id) as pick from (
        select *, {key} as h, row_number() over (partition by scene_id, cam, base_type order by {key}, id) as in_type from {source} where {where}) a) b where pick <= {PER_VIEW}"""


@relation
def depth_estimation(d: Spark) -> str:
    return _diverse("scene_id, cam, id, round(depth, 2) as answer", "dotted")


@relation
def distance_estimation(d: Spark) -> str:
    return _diverse("scene_id, cam, id, round(distance, 2) as answer", "dotted")


@relation
def object_size(d: Spark) -> str:
    return _diverse("scene_id, cam, id, round(round(longest, 2) * 100, 1) as answer", "seen", "kind <> 'edge' and fraction >= :size_visible and centre_clear and width > 0 and length > 0 and height > 0")


@relation
def object_count(d: Spark) -> str:
    return "select scene_id, cam, base_type, count(*) as answer from visible group by scene_id, cam, base_type having count(*) >= 2 or max(longest) >= 0.5"


@relation
def unique_types(d: Spark) -> str:
    return "select * from (select *, count(*) over (partition by scene_id, cam, base_type) as in_view from visible) a where in_view = 1"


@relation
def object_grounding(d: Spark) -> str:
    return "select scene_id, cam, id, base_type, round(u, 3) as u, round(v, 3) as v from unique_types"


@relation
def grounding_bbox(d: Spark) -> str:
    return "select b.scene_id, b.cam, b.id, x1, y1, x2, y2 from bbox2d_raw b join unique_types t on b.scene_id = t.scene_id and b.cam = t.cam and b.id = t.id where b.x2 - b.x1 >= 30 and b.y2 - b.y1 >= 30"


@relation
def object_category(d: Spark) -> str:
    known = ", ".join(f"'{x}'" for x in UNINFORMATIVE)
    return f"select scene_id, cam, id, label as answer from visible where type <> '' and lower(base_type) not in ({known})"


@relation
def size_qualitative(d: Spark) -> str:
    """Small, medium and large in turn, without sizes close to a border."""
    sized = "case when longest < 0.4 then 'small' when longest < 1.2 then 'medium' else 'large' end"
    return f"""select scene_id, cam, id, answer from (select *, row_number() over (partition by scene_id, cam order by turn, answer) as pick from (
        select *, row_number() over (partition by scene_id, cam, answer order by md5(concat(scene_id, cam, id)), id) as turn from (
        select scene_id, cam, id, {sized} as answer from visible where not (abs(longest - 0.4) < 0.1) and not (abs(longest - 1.2) < 0.1)) a) b) c where pick <= {PER_VIEW}"""


@relation
def targets_anchors(d: Spark) -> str:
    """Types with several visible objects, and objects whose type is the only one of its scene."""
    return f"""select t.scene_id, t.cam, t.base_type, t.id, t.u, t.v, t.cx, t.cy, t.cz, a.id as anchor, {g.norm('t.cx - a.cx', 't.cy - a.cy', 't.cz - a.cz')} as apart, a.u as anchor_u
        from (select * from (select *, count(*) over (partition by scene_id, cam, base_type) as n from visible) x where n >= 2) t
        join (select * from (select v.*, s.n_scene from visible v join (select scene_id, base_type, count(*) as n_scene from solid group by scene_id, base_type) s on v.scene_id = s.scene_id and v.base_type = s.base_type) y where n_scene = 1) a
        on t.scene_id = a.scene_id and t.cam = a.cam and t.base_type <> a.base_type"""


@relation
def comparative_grounding(d: Spark) -> str:
    """The object of a type nearest to an anchor, and the one furthest from it, half a metre before the next."""
    one = lambda which, order, gap: f"""select scene_id, cam, base_type, anchor, id, '{which}' as which, round({gap}, 6) as gap from (
        select *, row_number() over w as rn, lead(apart) over w as next_apart from targets_anchors window w as (partition by scene_id, cam, base_type, anchor order by apart {order}, id)) a
        where rn = 1 and {gap} >= 0.5"""  # noqa: E731
    return one("nearest", "asc", "next_apart - apart") + " union all " + one("farthest", "desc", "apart - next_apart")


@relation
def csr_referring(d: Spark) -> str:
    """The one object of a type on one side of an anchor: left or right in the image, closest or farthest in depth."""
    return """select scene_id, cam, base_type, anchor, side, id from (
        select *, count(*) over (partition by scene_id, cam, base_type, anchor, side) as on_side from (
        select *, case when u < anchor_u - 0.03 then 'left' when u > anchor_u + 0.03 then 'right' end as side from targets_anchors) a where side is not null) b where on_side = 1
        union all select scene_id, cam, base_type, anchor, side, id from (
        select t.*, s.side, row_number() over (partition by scene_id, cam, base_type, anchor, s.side order by s.f * apart, id) as rn, count(*) over (partition by scene_id, cam, base_type, anchor, s.side) as n,
        lead(apart) over (partition by scene_id, cam, base_type, anchor, s.side order by s.f * apart, id) as next_apart from targets_anchors t cross join (values ('closest', 1), ('farthest', -1)) as s(side, f)) c
        where rn = 1 and n >= 2 and abs(next_apart - apart) >= 0.5"""


@relation
def ordinal_grounding(d: Spark) -> str:
    """Objects of a type in a row, from the left, at most five, clear gaps between all of them."""
    return """select scene_id, cam, base_type, id, place, n - place + 1 as place_from_right from (
        select *, row_number() over (partition by scene_id, cam, base_type order by u, id) as place, least(count(*) over (partition by scene_id, cam, base_type), 5) as n,
        min(gap) over (partition by scene_id, cam, base_type) as least_gap, count(*) over (partition by scene_id, cam, base_type) as every_one from (
        select *, u - lag(u) over (partition by scene_id, cam, base_type order by u, id) as gap from visible) a) b where every_one >= 2 and least_gap >= 0.08 and place <= 5"""


@relation
def letter_mcq(d: Spark) -> str:
    """Three choices in hashed order, the answer's letter with them."""
    return f"""select scene_id, cam, id, answer, {text.letter('place')} as letter, {d.joined('choices', '|')} as choices from (
        select scene_id, cam, id, answer, max(case when choice = answer then place end) as place, {d.collected(f"concat({text.letter('place')}, '. ', choice)", 'place')} as choices from (
        select q.scene_id, q.cam, q.id, q.answer, c.choice, row_number() over (partition by q.scene_id, q.cam, q.id order by md5(concat(q.scene_id, q.cam, q.id, c.choice)), c.choice) as place
        from size_qualitative q cross join (values ('small'), ('medium'), ('large')) as c(choice)) a group by scene_id, cam, id, answer) b"""


# Our own words for questions; <a> is a label.
TEMPLATES = (
    ("object_size", 0, "How long is the longest side of the <a>, in centimetres?"),
    ("object_size", 1, "Measure the <a>: how many centimetres is its largest dimension?"),
    ("object_size", 2, "What is the greatest extent of the <a> in centimetres?"),
    ("object_category", 0, "What kind of object is marked?"),
    ("object_category", 1, "Name the object under the mark."),
)


@relation
def templates(d: Spark) -> str:
    return "select * from (values " + ", ".join(f"('{q}', {i}, {d.text(t)})" for q, i, t in TEMPLATES) + ") as t(qtype, k, template)"


@relation
def template_pick(d: Spark) -> str:
    """A wording for each question, by hash."""
    return f"""select q.scene_id, q.cam, q.id, replace(t.template, '<a>', v.label) as question, q.answer from object_size q join visible v on q.scene_id = v.scene_id and q.cam = v.cam and q.id = v.id
        join (select qtype, count(*) as n from templates group by qtype) m on m.qtype = 'object_size'
        join templates t on t.qtype = m.qtype and t.k = {d.seed('concat(q.scene_id, q.cam, q.id)')} % m.n"""


@relation
def dedup_cap(d: Spark) -> str:
    """Each question and answer once in a scene, each object in two questions at most."""
    return """select scene_id, cam, id, question, answer from (select *, row_number() over (partition by scene_id, id order by md5(concat(cam, question)), cam) as nth from (
        select *, row_number() over (partition by scene_id, question, answer, cam order by id) as copy from template_pick) a where copy = 1) b where nth <= 2"""
