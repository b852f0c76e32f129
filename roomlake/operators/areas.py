"""Functional areas of a view, and where things lie relative to them."""

from __future__ import annotations

from ..functions import geometry as g
from ..functions import text
from ..plans.catalog import relation
from ..plans.dialect import Spark

# Keyword, area; the first keyword that a type contains decides.
AREAS = (
    ("bed", "sleeping area"),
    ("bunk_bed", "sleeping area"),
    ("desk", "working area"),
    ("writing_desk", "working area"),
    ("office_chair", "working area"),
    ("sofa", "seating area"),
    ("couch", "seating area"),
    ("armchair", "seating area"),
    ("chair", "seating area"),
    ("seat", "seating area"),
    ("bench", "seating area"),
    ("recliner", "seating area"),
    ("dining_table", "dining area"),
    ("table", "dining area"),
    ("kitchen_counter", "cooking area"),
    ("stove", "cooking area"),
    ("oven", "cooking area"),
    ("wardrobe", "storage area"),
    ("dresser", "storage area"),
    ("bookcase", "storage area"),
    ("bookshelf", "storage area"),
    ("shelf", "storage area"),
    ("sideboard", "storage area"),
    ("cabinet", "storage area"),
    ("tv", "entertainment area"),
    ("monitor", "entertainment area"),
    ("nightstand", "bedside area"),
    ("bedside_table", "bedside area"),
)
SPREAD = 3.0


@relation
def area_keywords(d: Spark) -> str:
    return "select * from (values " + ", ".join(f"({i}, '{k}', '{a}')" for i, (k, a) in enumerate(AREAS)) + ") as t(ord_, word, area)"


@relation
def anchors(d: Spark) -> str:
    """Visible objects that name an area: the first keyword in line that their type contains."""
    what = "replace(" + text.without_room(d, "lower(v.base_type)") + ", ' ', '_')"
    return f"""select * from (select v.*, k.area, row_number() over (partition by v.scene_id, v.cam, v.id order by k.ord_) as nth from visible v
        join area_keywords k on instr({what}, k.word) > 0) a where nth = 1"""


@relation
def areas(d: Spark) -> str:
    """Areas with their middle; those whose anchors lie further than 3 m from it are none."""
    return f"""select scene_id, cam, area, min(px) as px, min(py) as py, min(dx2) as dx2, min(dy2) as dy2, min(rx) as rx, min(ry) as ry, min(mx) as ax, min(my) as ay, count(*) as n from (
        select *, avg(round(cx, 9)) over (partition by scene_id, cam, area) as mx, avg(round(cy, 9)) over (partition by scene_id, cam, area) as my from anchors) a
        group by scene_id, cam, area having count(*) < 2 or max({g.norm('cx - mx', 'cy - my')}) <= {SPREAD}"""


@relation
def identify_areas(d: Spark) -> str:
    return "select scene_id, cam, area, round(ax, 6) as ax, round(ay, 6) as ay, n from areas"


@relation
def camera_region(d: Spark) -> str:
    """The direction of each area from the camera, one of eight."""
    right, ahead = g.dot(("ax - px", "ay - py"), ("rx", "ry")), g.dot(("ax - px", "ay - py"), ("dx2", "dy2"))
    return f"select scene_id, cam, area, {g.named(d, g.octant(d, right, ahead), g.DIRECTIONS)} as answer from areas where {g.norm('ax - px', 'ay - py')} >= 0.5"


def _compass(d: Spark, source: str, columns: str, dx: str, dy: str) -> str:
    """Directions within 22 degrees of one of eight, turned by a reference that a hash chooses."""
    right, ahead = g.dot((dx, dy), ("rx", "ry")), g.dot((dx, dy), ("dx2", "dy2"))
    turned = d.pmod("way + turn", "8")
    return f"""select {columns}, {g.named(d, f'cast({turned} as int)', g.CARDINALS)} as answer, {g.named(d, 'cast(turn as int)', g.CARDINALS)} as reference from (
        select *, {d.seed(f"concat({', '.join(columns.split(', '))})")} % 8 as turn from (
        select *, {g.octant(d, 'to_right', 'to_front')} as way from (select *, {right} as to_right, {ahead} as to_front from {source}) a where {g.norm(dx, dy)} >= 0.5) b
        where {g.off_octant('to_right', 'to_front', 'way')} <= 22) c"""


@relation
def object_areas(d: Spark) -> str:
    return """select o.scene_id, o.cam, o.id, o.label, o.cx, o.cy, o.rx, o.ry, o.dx2, o.dy2, a.area, a.ax, a.ay from visible o
        join name_unique u on o.scene_id = u.scene_id and o.id = u.id join areas a on o.scene_id = a.scene_id and o.cam = a.cam"""


@relation
def object_region(d: Spark) -> str:
    return _compass(d, "object_areas", "scene_id, cam, id, area", "cx - ax", "cy - ay")


@relation
def area_pairs(d: Spark) -> str:
    return "select a.scene_id, a.cam, a.area as area_a, b.area as area_b, a.ax, a.ay, b.ax as bx, b.ay as by_, a.rx, a.ry, a.dx2, a.dy2 from areas a join areas b on a.scene_id = b.scene_id and a.cam = b.cam and a.area <> b.area"


@relation
def region_region(d: Spark) -> str:
    return _compass(d, "area_pairs", "scene_id, cam, area_a, area_b", "ax - bx", "ay - by_")
