"""Question records: every type's answers as one table, with wordings, choices, letters and limits.

Each type brings rows (scene, view, objects by role, answer); labels, and words of a detail, fill a wording
that a hash picks.  Types with choices draw wrong ones by hash from a pool: named directions (at least two
steps of eight from the right one), products of words, orders of three labels, or the other labels of the
view.  Questions about a place in the image are answered by points on the object's mask (pixels.py).
"""

from __future__ import annotations

from itertools import permutations, product

from ..functions import geometry as g
from ..functions import text
from ..plans.catalog import relation, shorter
from ..plans.dialect import Spark
from .pixels import CONTEXT, POINTED, SHARED_OBJECTS

PER_ENTITY = 2  # questions about one object
WRONG = 3  # wrong choices
# Types whose question alone, without the answer, tells duplicates.
BY_QUESTION = ("room_size", "object_placement")


def _number(x: str, places: int = 2) -> str:
    return f"cast(cast(round({x}, {places}) as decimal(18, {places})) as string)"


# number, name, relation, view, second view, roles a b c (columns of ids, or none), answer, pool of choices, wordings
NONE = "cast(null as string)"
TYPES = (
    (0, "closest_object", "closest_object", "cam", NONE, ("id_a", "id_b", NONE), "answer", "", ("Which is nearer to the camera: the <a> or the <b>?", "Of the <a> and the <b>, which one is closer?", "Is the <a> or the <b> the nearer one?")),
    (1, "depth_estimation", "depth_estimation", "cam", NONE, ("id", NONE, NONE), _number("answer"), "", ("How deep in the view is the <a>, in metres?", "Give the depth of the <a> in metres.", "At what depth does the <a> stand?")),
    (2, "distance_estimation", "distance_estimation", "cam", NONE, ("id", NONE, NONE), _number("answer"), "", ("How far is the <a> from the camera, in metres?", "Give the camera's distance to the <a>.", "How many metres away is the <a>?")),
    (3, "object_distance", "object_distance", "cam", NONE, ("id_a", "id_b", NONE), _number("answer"), "", ("How far apart are the <a> and the <b>?", "Give the distance between the <a> and the <b> in metres.", "How many metres lie between the <a> and the <b>?")),
    (4, "relative_direction", "relative_direction", "cam", NONE, ("id_a", "id_b", NONE), "answer", "sides", ("Seen from the camera, where is the <a> relative to the <b>?", "Where does the <a> lie with respect to the <b>?", "Give the direction of the <a> from the <b>.")),
    (5, "camera_object_position", "camera_object_position", "cam", NONE, ("id", NONE, NONE), "answer", "places", ("Where is the <a> relative to the camera?", "Give the place of the <a> from the camera's view.", "On which sides of the camera is the <a>?")),
    (6, "depth_ordering", "depth_ordering", "cam", NONE, ("first", "second", "third"), "'@abc'", "orders", ("Put the <a>, the <b> and the <c> in order from near to far.", "Which order by depth is right for <a>, <b> and <c>?", "Order <a>, <b> and <c> by their depth, nearest first.")),
    (7, "object_size", "object_size", "cam", NONE, ("id", NONE, NONE), _number("answer", 1), "", ("How long is the longest side of the <a>, in centimetres?", "Measure the <a>: how many centimetres is its largest dimension?", "What is the greatest extent of the <a> in centimetres?")),
    (8, "object_count", "object_count", "cam", NONE, (NONE, NONE, NONE), "cast(answer as string)", "", ("Count the visible objects of the kind <d>.", "How many of the kind <d> can be seen?", "Give the number of visible objects of the kind <d>.")),
    (9, "room_size", "room_size", NONE, NONE, (NONE, NONE, NONE), _number("area"), "", ("What is the floor area of the room?", "How many square metres does the room have?", "Give the size of the room in square metres.")),
    (10, "object_grounding", "object_grounding", "cam", NONE, ("id", NONE, NONE), f"concat('[(', {_number('u', 3)}, ', ', {_number('v', 3)}, ')]')", "", ("Point at the <a>.", "Where in the image is the <a>?", "Give the image position of the <a>.")),
    (11, "camera_relative_position", "camera_relative_position", "cam_a", "cam_b", (NONE, NONE, NONE), "answer", "octants", ("From the first camera, where is the second?", "In which direction does the second camera lie?", "Where was the second picture taken from, seen from the first?")),
    (12, "camera_facing_direction", "camera_facing_direction", "cam_a", "cam_b", (NONE, NONE, NONE), "answer", "winds", ("The first camera faces north: where does the second face?", "With the first view to the north, which way does the second look?", "Which way is the second camera turned if the first looks north?")),
    (13, "camera_motion", "camera_motion", "cam_a", "cam_b", (NONE, NONE, NONE), "answer", "moves", ("How did the camera move between the two pictures?", "Which way did the camera go?", "Name the camera's movement.")),
    (14, "viewpoint_change", "viewpoint_change", "cam_a", "cam_b", (NONE, NONE, NONE), "answer", "", ("Describe the change from the first view to the second.", "How do the two camera poses differ?", "Give the movement and the turn between the views.")),
    (15, "imagination_oc", "imagination_oc", "cam", NONE, ("stand", "face", "id"), "answer", "places", ("Stand at the <a> and face the <b>: where is the <c>?", "From the <a>, looking at the <b>, where would the <c> be?", "Imagine being at the <a>, turned to the <b>. Where is the <c>?")),
    (15, "imagination_oo", "imagination_oo", "cam", NONE, ("stand", "id_a", "id_b"), "answer", "imagined", ("From the <a>, where is the <b> relative to the <c>?", "Standing at the <a>, how does the <b> lie to the <c>?", "Imagine standing at the <a>: where is the <b> with respect to the <c>?")),
    (16, "csr_referring", "csr_referring", "cam", NONE, ("anchor", "id", NONE), "side", "", ("Point at the <b> that is <d> the <a>.", "Which <b> is <d> the <a>? Mark it.", "Mark the <b> <d> the <a>.")),
    (17, "object_placement", "placement_views", "cam", NONE, ("id", "surface", NONE), f"concat('[(', {_number('u', 3)}, ', ', {_number('v', 3)}, ')]')", "", ("Where on the <b> would the <a> fit?", "Find a free place for the <a> on the <b>.", "Mark a place on the <b> that can take the <a>.")),
    (18, "free_space", "free_space_views", "cam", NONE, ("surface", NONE, NONE), "cast(free_places as string)", "", ("Mark free places on the <a>.", "Where on the <a> is room for more?", "Point at what is empty of the <a>.")),
    (19, "spatial_compatibility", "spatial_compatibility", "cam", NONE, ("moved", "target", NONE), "answer", "yes", ("Can the <a> be put <d> the <b>?", "Would the <a> fit <d> the <b>?", "Is there room for the <a> <d> the <b>?")),
    (20, "object_matching_mv", "object_matching_mv", "cam_a", "cam_b", ("id", NONE, NONE), "concat(cast(x1 as string), ' ', cast(y1 as string), ' ', cast(x2 as string), ' ', cast(y2 as string))", "boxes", ("Find the <a> of the first view in the second.", "Which box in the second picture is the <a>?", "Where is the <a> in the other view?")),
    (21, "depth_difference", "depth_difference", "cam", NONE, ("id_a", "id_b", NONE), _number("answer"), "", ("By how many metres do the <a> and the <b> differ in depth?", "Give the difference in depth of the <a> and the <b>.", "How much deeper is one of <a> and <b> than the other?")),
    (22, "grounding_bbox", "grounding_bbox", "cam", NONE, ("id", NONE, NONE), "concat(cast(x1 as string), ' ', cast(y1 as string), ' ', cast(x2 as string), ' ', cast(y2 as string))", "", ("Draw a box around the <a>.", "Give the bounding box of the <a>.", "Which box holds the <a>?")),
    (23, "object_category", "object_category", "cam", NONE, ("id", NONE, NONE), "answer", "labels", ("What kind of object is marked?", "Name the object under the mark.", "What is it that the mark shows?")),
    (24, "size_qualitative", "size_qualitative", "cam", NONE, ("id", NONE, NONE), "answer", "sizes", ("Is the <a> small, medium or large?", "How large is the <a>, in a word?", "Choose a size for the <a>.")),
    (25, "comparative_grounding", "comparative_grounding", "cam", NONE, ("anchor", "id", NONE), "which", "", ("Point at the <b> that is <d> the <a>.", "Of all of its kind, mark the <b> <d> the <a>.", "Which <b> is <d> the <a>?")),
    (26, "ordinal_grounding", "ordinal_grounding", "cam", NONE, ("id", NONE, NONE), "cast(place as string)", "", ("Counted from the left, point at the <a> number <d>.", "Mark the <a> that is number <d> from the left.", "Which is the <a> number <d> of the row, from the left?")),
    (27, "object_object_mv", "object_object_mv", "cam_a", "cam_b", (NONE, NONE, NONE), "answer", "case when answer like '%,%,%' then 'far_sides' else 'mv_sides' end", ("In the second view, where is the first object relative to the other?", "How do the two shared objects lie in the second picture?", "Give the place of the one to the other in the second view.")),
    (28, "camera_region", "camera_region", "cam", NONE, (NONE, NONE, NONE), "answer", "octants", ("In which direction from the camera is the area?", "Where does the area lie, seen from the camera?", "Give the direction of the area.")),
    (29, "object_region", "object_region", "cam", NONE, ("id", NONE, NONE), "answer", "cardinals", ("Where is the <a> in its relation to the area?", "In which direction from the area is the <a>?", "Give the direction of the <a> from the area.")),
    (30, "region_region", "region_region", "cam", NONE, (NONE, NONE, NONE), "answer", "cardinals", ("In which direction is one area from the other?", "How do the two areas lie to each other?", "Give the direction between the areas.")),
    (31, "route_planning", "route_planning", "cam", NONE, ("start", "facing", "goal"), "answer", "turns", ("Starting at the <a>, facing the <b>: how to turn for the <c>?", "At the <a> and turned to the <b>, which way is the <c>?", "From the <a>, looking at the <b>, turn which way to reach the <c>?")),
    (16, "csr_multi_step", "csr_multi_step", "cam", NONE, ("stand", "face", "id"), "answer", "diagonals", ("From the <a>, facing the <b>: in which quarter is the <c>?", "Stand at the <a>, look at the <b>, and say where the <c> is.", "At the <a> and turned to the <b>, where does the <c> lie?")),
)
KEYS = {"object_count": "base_type", "camera_region": "area", "object_region": "area", "region_region": "concat(area_a, ' ', area_b)", "spatial_compatibility": "side", "comparative_grounding": "case which when 'nearest' then 'closest to' else 'farthest from' end", "csr_referring": "case side when 'left' then 'to the left of' when 'right' then 'to the right of' when 'closest' then 'closest to' else 'farthest from' end", "object_object_mv": "concat(cast(id_a as string), ' ', cast(id_b as string))", "ordinal_grounding": "cast(place as string)"}


def pools() -> list[tuple[str, str]]:
    """The fixed pools: (name, choice)."""
    joined = lambda *axes: [", ".join(x) for x in product(*axes) if any(x)]
    out = {
        "octants": list(g.DIRECTIONS),
        "cardinals": list(g.CARDINALS),
        "winds": list(g.CARDINALS[::2]),
        "yes": ["Yes", "No"],
        "mv_sides": joined(("right", "left"), ("above", "below")),
        "far_sides": joined(("right", "left"), ("above", "below"), ("near", "far")),
        "moves": ["Forward", "Back", "Left", "Right"],
        "turns": ["Turn Right", "Turn Left", "Turn Back"],
        "sizes": ["small", "medium", "large"],
        "diagonals": ["front-left", "front-right", "back-left", "back-right"],
        "sides": joined(("right", "left", ""), ("above", "below", ""), ("farther", "closer", "")),
        "places": joined(("right", "left", ""), ("above", "below", ""), ("front", "behind", "")),
        "imagined": joined(("right", "left"), ("above", "below"), ("closer", "farther")),
        "orders": ["".join(p) for p in permutations("abc")],
    }
    return [(name, choice) for name, choices in out.items() for choice in choices]


def _answers(types: tuple) -> str:
    parts = []
    for number, name, source, cam, cam_b, roles, answer, pool, _ in types:
        a, b, c = roles
        detail = KEYS.get(name, "''")
        parts.append(f"select {number} as number, '{name}' as qtype, scene_id, {cam} as cam, {cam_b} as cam_b, {a} as a, {b} as b, {c} as c, {detail} as detail, {answer} as answer, {pool if pool.startswith('case') else repr(pool)} as pool from {source}")
    return " union all ".join(parts)


@relation
def answers(d: Spark) -> str:
    """The answers of all types."""
    return _answers(TYPES)


@relation
def wordings(d: Spark) -> str:
    """Three wordings of each type, our own; <a>, <b> and <c> are labels."""
    rows = ", ".join(f"('{t[1]}', {k}, {d.text(w)})" for t in TYPES for k, w in enumerate(t[8]))
    return f"select * from (values {rows}) as t(qtype, k, wording)"


@relation
def choice_pools(d: Spark) -> str:
    """The fixed pools; choices of a ring of eight directions have their place in it."""
    rows = [(p, c, g.DIRECTIONS.index(c) if p == "octants" else g.CARDINALS.index(c) if p == "cardinals" else -1) for p, c in pools()]
    return "select * from (values " + ", ".join(f"('{p}', '{c}', {k})" for p, c, k in rows) + ") as t(pool, choice, ring)"


QKEY = "concat(qtype, '/', q.scene_id, '/', coalesce(cam, ''), '/', coalesce(cam_b, ''), '/', coalesce(a, ''), '/', coalesce(b, ''), '/', coalesce(c, ''), '/', detail)"


def _keyed(source: str) -> str:
    labels = " ".join(f"left join solid o{r} on o{r}.scene_id = q.scene_id and o{r}.id = q.{r}" for r in "abc")
    return f"""select number, qtype, q.scene_id, cam, cam_b, a, b, c, detail, pool, {QKEY} as qkey, oa.label as label_a, ob.label as label_b, oc.label as label_c,
        case when pool = 'orders' then concat(oa.label, ', ', ob.label, ', ', oc.label) else answer end as answer from {source} q {labels}"""


@relation
def keyed_answers(d: Spark) -> str:
    """Answers with a key, the labels of their objects, and the order of three put in words."""
    return _keyed("answers")


def _worded(d: Spark, source: str) -> str:
    return f"""select q.*, replace(replace(replace(replace(w.wording, '<a>', coalesce(label_a, 'object')), '<b>', coalesce(label_b, 'object')), '<c>', coalesce(label_c, 'object')), '<d>', detail) as question
        from {source} q join wordings w on w.qtype = q.qtype and w.k = {d.seed('q.qkey')} % 3"""


@relation
def questions_worded(d: Spark) -> str:
    """Questions: a wording by hash, filled with labels."""
    return _worded(d, "keyed_answers")


def _wrong(keyed: str) -> str:
    order = "replace(replace(replace(concat(substr(p.choice, 1, 1), ', ', substr(p.choice, 2, 1), ', ', substr(p.choice, 3, 1)), 'a', '@1'), 'b', '@2'), 'c', '@3')"
    named = f"replace(replace(replace({order}, '@1', q.label_a), '@2', q.label_b), '@3', q.label_c)"
    box = "concat(cast(x.x1 as string), ' ', cast(x.y1 as string), ' ', cast(x.x2 as string), ' ', cast(x.y2 as string))"
    steps = "abs(p.ring - r.ring)"
    every = f"""select q.qkey, q.answer, p.choice from {keyed} q join choice_pools p on p.pool = q.pool left join choice_pools r on r.pool = q.pool and r.choice = q.answer
        where q.pool <> 'orders' and (p.ring < 0 or r.ring is null or least({steps}, 8 - {steps}) >= 2)
        union all select q.qkey, q.answer, {named} from {keyed} q join choice_pools p on p.pool = q.pool where q.pool = 'orders'
        union all select q.qkey, q.answer, v.label from {keyed} q join (select distinct scene_id, cam, label from visible) v on v.scene_id = q.scene_id and v.cam = q.cam where q.pool = 'labels'
        union all select q.qkey, q.answer, {box} from {keyed} q join bbox2d_raw x on x.scene_id = q.scene_id and x.cam = q.cam_b where q.pool = 'boxes'"""
    return f"""select qkey, choice from (select qkey, choice, row_number() over (partition by qkey order by md5(concat(qkey, choice)), choice) as rn from (
        select distinct qkey, choice from ({every}) e where choice <> answer) a) b where rn <= {WRONG}"""


@relation
def wrong_choices(d: Spark) -> str:
    """Three wrong choices of each question at most, by hash: from its pool, other orders, other labels, or other boxes of the view."""
    return _wrong("keyed_answers")


def _lettered(d: Spark, wrong: str, keyed: str) -> str:
    return f"""select qkey, max(case when correct = 1 then {text.letter('place')} end) as letter, {d.joined(d.collected(f"concat({text.letter('place')}, '. ', choice)", 'place'), '|')} as choices, count(*) as n_choices from (
        select *, row_number() over (partition by qkey order by md5(concat('order', qkey, choice)), choice) as place from (
        select qkey, choice, 0 as correct from {wrong} union all select distinct k.qkey, k.answer, 1 from {keyed} k join (select distinct qkey from {wrong}) w on w.qkey = k.qkey) a) b group by qkey"""


@relation
def lettered(d: Spark) -> str:
    """Choices of each question in hashed order with the letter of the right one."""
    return _lettered(d, "wrong_choices", "keyed_answers")


@relation
def question_records(d: Spark) -> str:
    """Every question once in a scene (by wording, answer and views), an object in two of a type at most; with choices the answer is a letter, about a place in the image it is points."""
    plain = ", ".join(f"'{t}'" for t in BY_QUESTION)
    same = f"concat(question, case when qtype in ({plain}) then '' else answer end, coalesce(case when cam_b is not null then cam end, ''), '/', coalesce(cam_b, ''))"
    on_mask = ", ".join(f"'{t}'" for t in POINTED)
    target = "case qtype " + " ".join(f"when '{t}' then {role}" for t, role in POINTED.items()) + " end"
    return f"""select w.number, w.qtype, w.scene_id, w.cam, w.cam_b, v.context, w.a, w.b, w.c, w.detail, w.question, w.choices,
        case when w.letter is not null then w.letter when w.qtype in ({on_mask}) then coalesce(p.answer, w.answer) else w.answer end as answer, w.answer as answer_text from (select *, {target} as target from (
        select *, row_number() over (partition by scene_id, qtype, coalesce(a, qkey) order by md5(qkey), qkey) as of_object from (
        select q.*, l.choices, l.letter, row_number() over (partition by q.scene_id, q.qtype, {same} order by md5(q.qkey), q.qkey) as copy from questions_worded q left join lettered l on l.qkey = q.qkey) x where copy = 1) y where of_object <= {PER_ENTITY}) w
        left join point_answers p on p.scene_id = w.scene_id and p.cam = w.cam and p.id = w.target left join context_views v on v.qkey = w.qkey"""


@relation
def question_objects(d: Spark) -> str:
    """The objects of each record by role: label, middle, distance from its camera and sides."""
    one = lambda r: f"select number, qtype, scene_id, cam, detail, question, '{r}' as role, {r} as id from question_records where {r} is not null"
    return f"""select q.number, q.qtype, q.scene_id, q.cam, q.detail, q.question, q.role, q.id, o.label, round(o.cx, 6) as x, round(o.cy, 6) as y, round(o.cz, 6) as z, round(o.width, 6) as width, round(o.length, 6) as length, round(o.height, 6) as height, round(c.distance, 6) as distance
        from ({' union all '.join(map(one, 'abc'))}) q join solid o on o.scene_id = q.scene_id and o.id = q.id left join cam_obj c on c.scene_id = q.scene_id and c.cam = q.cam and c.id = q.id"""


@relation
def type_counts(d: Spark) -> str:
    return "select number, qtype, count(*) as n, count(distinct scene_id) as scenes, sum(case when choices is null then 0 else 1 end) as with_choices from question_records group by number, qtype"


# The engine's forms: questions are chosen before they get choices, and those on two masks of two views, by far the most, never leave the tasks of their second view.
PAIRED = next(t for t in TYPES if t[1] == "object_object_mv")
BETWEEN = ("answers", "keyed_answers", "questions_worded", "wrong_choices", "lettered", "object_object_mv")


def _named(names: tuple[str, ...]) -> tuple:
    return tuple(t for t in TYPES if t[1] in names)


@shorter("pointed", "answers", "keyed_answers")
def pointed(d: Spark) -> str:
    roles = " union all ".join(f"select scene_id, {cam} as cam, {roles['abc'.index(POINTED[name])]} as id from {source}" for _, name, source, cam, _, roles, *_ in _named(tuple(POINTED)))
    return f"select distinct scene_id, cam, id from ({roles}) a where cam is not null"


@shorter("context_views", "answers", "keyed_answers")
def context_views(d: Spark) -> str:
    """Only the questions that may show a second view are answered; a scene's pairs of views are few."""
    return f"""select qkey, min_by(cam_b, h) as context from (select k.qkey, s.other as cam_b, concat(md5(concat(k.qkey, s.other)), s.other) as h from (select scene_id, cam, {QKEY} as qkey from ({_answers(_named(CONTEXT))}) q) k join (
        select a.scene_id, a.cam, b.cam as other from visible a join visible b on a.scene_id = b.scene_id and a.id = b.id and a.cam <> b.cam and b.kind = 'corner' group by a.scene_id, a.cam, b.cam having count(*) >= {SHARED_OBJECTS}) s
        on s.scene_id = k.scene_id and s.cam = k.cam where {d.seed("concat(k.qkey, '/context')")} % 2 = 0) t group by qkey"""


@relation
def few_answers(d: Spark) -> str:
    """keyed_answers of all types but those on two masks of two views."""
    return _keyed(f"({_answers(tuple(t for t in TYPES if t != PAIRED))})")


def _same() -> str:
    plain = ", ".join(f"'{t}'" for t in BY_QUESTION)
    return f"concat(question, case when qtype in ({plain}) then '' else answer end, coalesce(case when cam_b is not null then cam end, ''), '/', coalesce(cam_b, ''))"


@relation
def chosen_questions(d: Spark) -> str:
    """The questions of few_answers that are records."""
    return f"""select number, qtype, scene_id, cam, cam_b, a, b, c, detail, qkey, answer, question from (
        select *, row_number() over (partition by scene_id, qtype, coalesce(a, qkey) order by md5(qkey), qkey) as of_object from (
        select q.*, row_number() over (partition by scene_id, qtype, {_same()} order by md5(qkey), qkey) as copy from ({_worded(d, "few_answers")}) q) x where copy = 1) y where of_object <= {PER_ENTITY}"""


@relation
def chosen_answers(d: Spark) -> str:
    return "select k.* from few_answers k left semi join chosen_questions c on c.qkey = k.qkey"


@relation
def chosen_wrong(d: Spark) -> str:
    return _wrong("chosen_answers")


@relation
def chosen_lettered(d: Spark) -> str:
    return _lettered(d, "chosen_wrong", "chosen_answers")


@relation
def paired_questions(d: Spark) -> str:
    """The questions on two masks of two views that are records: each wording, answer and pair of views once; all such are alike in the last part of the second view's name, by which mask_pairs is dealt out."""
    number, name, *_, pool, words = PAIRED
    qkey = QKEY.replace("q.scene_id", "scene_id").replace("qtype", f"'{name}'")
    for role in "abc":
        qkey = qkey.replace(f"coalesce({role}, '')", "''")
    wording = "case k " + " ".join(f"when {k} then {d.text(w)}" for k, w in enumerate(words)) + " end"
    return f"""select {number} as number, '{name}' as qtype, scene_id, m.cam as cam, m.cam_b as cam_b, m.detail as detail, m.qkey as qkey, m.answer as answer, {pool.replace('answer', 'm.answer')} as pool, {wording} as question from (
        select scene_id, tail, k, same, min(struct(h, qkey, cam, cam_b, detail, answer)) as m from (
        select *, (cast(conv(right(h, 8), 16, 10) as bigint) & 2147483647) % 3 as k, concat(answer, cam, '/', cam_b) as same from (
        select *, md5(qkey) as h from (select *, {qkey} as qkey from (select scene_id, tail, cam_a as cam, cam_b, answer, {KEYS[name]} as detail from mask_pairs) e) a) b) c group by scene_id, tail, k, same) f"""


@relation
def paired_records(d: Spark) -> str:
    """Their choices and letters, found within the row."""
    fixed = {p: [c for q, c in pools() if q == p] for p in ("far_sides", "mv_sides")}
    pool = "case pool " + " ".join(f"when '{p}' then array({', '.join(map(d.text, cs))})" for p, cs in fixed.items()) + " end"
    wrong = f"transform(slice(array_sort(transform(filter({pool}, c -> c <> answer), c -> struct(md5(concat(qkey, c)) as h, c as c))), 1, {WRONG}), w -> w.c)"
    return f"""select number, qtype, scene_id, cam, cam_b, detail, question, answer, array_join(transform(line, (c, i) -> concat({text.letter('(i + 1)')}, '. ', c)), '|') as choices, {text.letter('array_position(line, answer)')} as letter from (
        select *, transform(array_sort(transform(concat({wrong}, array(answer)), c -> struct(md5(concat('order', qkey, c)) as h, c as c))), s -> s.c) as line from paired_questions) a"""


@shorter("question_records", *BETWEEN)
def _records(d: Spark) -> str:
    on_mask = ", ".join(f"'{t}'" for t in POINTED)
    target = "case w.qtype " + " ".join(f"when '{t}' then w.{role}" for t, role in POINTED.items()) + " end"
    return f"""select w.number, w.qtype, w.scene_id, w.cam, w.cam_b, v.context, w.a, w.b, w.c, w.detail, w.question, l.choices,
        case when l.letter is not null then l.letter when w.qtype in ({on_mask}) then coalesce(p.answer, w.answer) else w.answer end as answer, w.answer as answer_text from chosen_questions w left join chosen_lettered l on l.qkey = w.qkey
        left join point_answers p on p.scene_id = w.scene_id and p.cam = w.cam and p.id = {target} left join context_views v on v.qkey = w.qkey
        union all select number, qtype, scene_id, cam, cam_b, {NONE}, {NONE}, {NONE}, {NONE}, detail, question, choices, letter, answer from paired_records"""


@shorter("question_objects", *BETWEEN, "question_records")
def _objects(d: Spark) -> str:
    roles = ", ".join(f"struct('{r}' as role, {r} as id)" for r in "abc")
    return f"""select q.number, q.qtype, q.scene_id, q.cam, q.detail, q.question, q.role, q.id, o.label, round(o.cx, 6) as x, round(o.cy, 6) as y, round(o.cz, 6) as z, round(o.width, 6) as width, round(o.length, 6) as length, round(o.height, 6) as height, round(c.distance, 6) as distance
        from (select number, qtype, scene_id, cam, detail, question, r.role, r.id from (select *, explode(array({roles})) as r from chosen_questions) e where r.id is not null) q
        join solid o on o.scene_id = q.scene_id and o.id = q.id left join cam_obj c on c.scene_id = q.scene_id and c.cam = q.cam and c.id = q.id"""


@shorter("type_counts", *BETWEEN, "question_records")
def _counts(d: Spark) -> str:
    """Records are counted before they get choices; whether they have any is enough."""
    return """select number, qtype, count(*) as n, count(distinct scene_id) as scenes, sum(case when w.qkey is null then 0 else 1 end) as with_choices from chosen_questions c left join (select distinct qkey from chosen_wrong) w on w.qkey = c.qkey group by number, qtype
        union all select number, qtype, sum(n), count(*), sum(n) from (select number, qtype, scene_id, count(*) as n from paired_questions group by number, qtype, scene_id) a group by number, qtype"""
