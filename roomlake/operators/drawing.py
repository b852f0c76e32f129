"""What is drawn on images, as rows: dots, boxes, edges; and the choice of views by outside verdicts."""

from __future__ import annotations

from ..functions import geometry as g
from ..plans.catalog import relation
from ..plans.dialect import Spark

IMAGE_W, IMAGE_H = 1920, 1080
# The least radius of a dot and its part of an image's shorter side.
RADIUS = max(6, round(0.018 * IMAGE_H))
COLOURS = ("red", "blue", "green", "orange", "purple", "yellow")


def _pixel(d: Spark, x: str, n: int) -> str:
    return f"cast(greatest(0, least({n - 1}, {d.rint(f'greatest(-9, least(9, {x})) * {n}')})) as int)"


def _dots(d: Spark, name: str, source: str, roles: tuple[tuple[str, str], ...]) -> str:
    """Dots of a question's objects at their projected middles; questions with an object behind the camera get none."""
    parts = [f"select q.scene_id, q.cam, '{name}' as qtype, {i} as nth, '{colour}' as colour, q.{column} as id, v.u, v.v from {source} q join cam_obj v on v.scene_id = q.scene_id and v.cam = q.cam and v.id = q.{column} where v.u is not null" for i, (column, colour) in enumerate(roles)]
    return f"""select scene_id, cam, qtype, nth, colour, id, {_pixel(d, 'u', IMAGE_W)} as x_px, {_pixel(d, 'v', IMAGE_H)} as y_px, {RADIUS} as radius from (
        select *, count(*) over (partition by scene_id, cam, qtype) as shown from ({' union all '.join(parts)}) a) b where shown = {len(roles)}"""


@relation
def two_dots(d: Spark) -> str:
    return _dots(d, "closest_object", "closest_object", (("id_a", "blue"), ("id_b", "red")))


@relation
def one_dot(d: Spark) -> str:
    """A dot on the first object of each view that a question is about."""
    return _dots(d, "depth_estimation", "(select scene_id, cam, min(id) as id from depth_estimation group by scene_id, cam)", (("id", "red"),))


@relation
def three_dots(d: Spark) -> str:
    return _dots(d, "depth_ordering", "depth_ordering", (("first", "red"), ("second", "blue"), ("third", "green")))


@relation
def drawn_boxes(d: Spark) -> str:
    """Rectangles of objects, numbered and coloured in line in each view: their projected boxes, clamped to the image."""
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(COLOURS))
    return f"""select scene_id, cam, id, nth, c.colour, x1, y1, x2, y2 from (select b.*, row_number() over (partition by scene_id, cam order by id) as nth from bbox_pixels b) a
        join (values {names}) as c(k, colour) on c.k = (a.nth - 1) % {len(COLOURS)}"""


@relation
def bbox_pixels(d: Spark) -> str:
    """Boxes of visible objects in pixels of a 1920 x 1080 image, clamped to it."""
    clip = lambda x, n: f"cast(greatest(0, least({n - 1}, {d.rint(f'greatest(-9, least(9, {x})) * {n}')})) as int)"
    return f"""select scene_id, cam, id, {clip('u0', IMAGE_W)} as x1, {clip('v0', IMAGE_H)} as y1, {clip('u1', IMAGE_W)} as x2, {clip('v1', IMAGE_H)} as y2 from (
        select scene_id, cam, id, min(ahead) as nearest, min(0.5 + side / ahead / (2 * tan_h)) as u0, max(0.5 + side / ahead / (2 * tan_h)) as u1, min(0.5 - rise / ahead / (2 * tan_h / {g.ASPECT!r})) as v0, max(0.5 - rise / ahead / (2 * tan_h / {g.ASPECT!r})) as v1
        from numbered_corners where ahead <> 0 group by scene_id, cam, id) a where nearest > 0.01"""


@relation
def box_edges(d: Spark) -> str:
    """The twelve edges of visible objects' boxes in the image: lines between corners that differ in one axis, both in front of the camera."""
    at = lambda c, x, y: f"0.5 {x} {c}.{y} / {c}.ahead / (2 * {c}.tan_h{'' if x == '+' else f' / {g.ASPECT!r}'})"
    return f"""select p.scene_id, p.cam, p.id, p.k as corner_a, q.k as corner_b, {_pixel(d, at('p', '+', 'side'), IMAGE_W)} as xa, {_pixel(d, at('p', '-', 'rise'), IMAGE_H)} as ya, {_pixel(d, at('q', '+', 'side'), IMAGE_W)} as xb, {_pixel(d, at('q', '-', 'rise'), IMAGE_H)} as yb
        from numbered_corners p join numbered_corners q on p.scene_id = q.scene_id and p.cam = q.cam and p.id = q.id and q.k - p.k in (1, 2, 4) and (cast(floor(p.k / (q.k - p.k)) as int)) % 2 = 0
        where p.ahead > 0.01 and q.ahead > 0.01"""


@relation
def numbered_corners(d: Spark) -> str:
    """The corners of visible objects' boxes, numbered by the sides they lie on."""
    return "select c.* from box_corners c join visible s on c.scene_id = s.scene_id and c.cam = s.cam and c.id = s.id"


@relation
def view_results(d: Spark) -> str:
    """Views in line with an outside judge's words read from fenced JSON; what cannot be read counts as good."""
    fenced = "concat('Here: ```json', chr(10), props, chr(10), '```')"
    inner = d.between(fenced, "```json", "```")
    return f"select event_id, coalesce({d.json_text(inner, 'page')}, 'none') as page, coalesce({d.json_text(inner, 'quality')}, 'GOOD') as quality from events order by event_id"


@relation
def random_view_stats(d: Spark) -> str:
    """Opacity and sharpness of rendered views; derived."""
    return "select event_id as view, user_id as scene, 0.98 + cast(event_id % 41 as double) / 2000 as alpha, cast(event_id * 7 % 60 as double) as sharpness from events"


@relation
def sharp_views(d: Spark) -> str:
    """Rendered views that are solid and sharp: alpha of 0.995 and a Laplacian variance of 10 at least."""
    return "select scene, view from random_view_stats where alpha >= 0.995 and sharpness >= 10"


@relation
def picked_views(d: Spark) -> str:
    """At most 64 sharp views of a scene, in line, numbered anew; rounds of 320 drawn views, five at most."""
    return "select scene, view, rn - 1 as number from (select scene, view, row_number() over (partition by scene order by view) as rn from sharp_views) a where rn <= 64"


@relation
def kept_instances(d: Spark) -> str:
    """Instances without those an outside judge removes; without a word they stay."""
    return "select i.scene_id, i.iid, i.category from instances i left join (select distinct page_id + 1 as iid, 'remove' as word from pages where page_id < 40 and page_id % 11 = 3) v on v.iid = i.iid where coalesce(v.word, 'keep') <> 'remove'"


@relation
def movable_types(d: Spark) -> str:
    """Types that a judge lets move, or all of a scene's where it names none."""
    return """select distinct s.scene_id, s.base_type from solid s left join (select scene_id, count(*) as n from verdicts where quality = 'GOOD' group by scene_id) v on v.scene_id = s.scene_id
        left join verdicts w on w.scene_id = s.scene_id and w.entity = s.id and w.quality = 'GOOD' where v.n is null or w.entity is not null"""


@relation
def plausible_sizes(d: Spark) -> str:
    """Objects without those whose longest side a judge finds wrong for their type: judged in batches of twenty, sides over 2.9 m are."""
    return "select scene_id, id, batch from (select scene_id, id, longest, cast(floor((row_number() over (partition by scene_id order by ord) - 1) / 20) as bigint) as batch from solid) a where longest <= 2.9"
