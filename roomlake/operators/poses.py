"""Questions about cameras and imagined standpoints."""

from __future__ import annotations

from ..functions import geometry as g
from ..functions import text
from ..plans.catalog import relation
from ..plans.dialect import Spark
from .pairs import least_per_view


@relation
def camera_pairs(d: Spark) -> str:
    """Ordered pairs of cameras of a room with the second's place and heading in the first's frame."""
    move = ("(b.px - a.px)", "(b.py - a.py)")
    look = ("b.dx2", "b.dy2")
    pitch = lambda c: f"degrees(atan2({c}.fz, {g.norm(f'{c}.fx', f'{c}.fy')}))"
    return f"""select a.scene_id, a.name as cam_a, b.name as cam_b, a.kind as kind_a, b.kind as kind_b, b.step_from, b.step_direction, {g.norm(*move, 'b.pz - a.pz')} as apart, {g.dot(move, ('a.dx2', 'a.dy2'))} as ahead,
        {g.dot(move, ('a.rx', 'a.ry'))} as to_right, b.pz - a.pz as up, {g.dot(look, ('a.rx', 'a.ry'))} as face_right, {g.dot(look, ('a.dx2', 'a.dy2'))} as face_ahead,
        round(degrees(atan2({g.dot(look, ('a.rx', 'a.ry'))}, {g.dot(look, ('a.dx2', 'a.dy2'))})), 6) as heading, round({pitch('b')} - {pitch('a')}, 6) as pitch
        from cam_frame a join cam_frame b on a.scene_id = b.scene_id and a.name <> b.name where a.dx2 is not null and b.dx2 is not null"""


@relation
def camera_relative_position(d: Spark) -> str:
    return f"""select scene_id, cam_a, cam_b, {g.named(d, g.octant(d, 'round(to_right, 9)', 'round(ahead, 9)'), g.DIRECTIONS)} as answer from camera_pairs
        where kind_a = 'edge' and kind_b = 'edge' and abs(up) <= 0.1 and apart >= 0.2"""


@relation
def camera_facing_direction(d: Spark) -> str:
    """The second camera's cardinal, the first facing north."""
    return "select scene_id, cam_a, cam_b, case when heading > 0 then 'East' else 'West' end as answer from camera_pairs where kind_a = 'edge' and kind_b = 'edge' and abs(heading) between 75 and 105"


@relation
def camera_motion(d: Spark) -> str:
    """The main axis of a step, measured again; short or vertical ones are left out."""
    most = "greatest(abs(ahead), abs(to_right), abs(up))"
    return f"""select scene_id, cam_a, cam_b, case when abs(ahead) = {most} then case when ahead > 0 then 'Forward' else 'Back' end else case when to_right > 0 then 'Right' else 'Left' end end as answer
        from camera_pairs where cam_a = step_from and apart >= 0.05 and abs(up) < {most}"""


@relation
def viewpoint_change(d: Spark) -> str:
    words = text.five_degrees("round(to_right, 6)", "round(up, 6)", "round(ahead, 6)", "heading", "pitch")
    # half a turn is to the right
    pairs = "(select scene_id, cam_a, cam_b, kind_a, kind_b, apart, ahead, to_right, up, pitch, case when heading <= -179.99999 then heading + 360 else heading end as heading from camera_pairs) p"
    return f"select scene_id, cam_a, cam_b, {words} as answer from {pairs} where kind_a <> 'step' and kind_b <> 'step' and (abs(heading) > 5 or abs(pitch) > 5 or apart >= 0.2)"


@relation
def imagined(d: Spark) -> str:
    """Standing at one object, at camera height, facing another: position and axes."""
    x, y, z = "(b.cx - a.cx)", "(b.cy - a.cy)", "(b.cz - a.pz)"
    n = g.norm(x, y, z)
    return f"""select *, wy / nullif(flat, 0) as sx, -wx / nullif(flat, 0) as sy from (select *, {g.norm('wx', 'wy')} as flat from (
        select a.scene_id, a.cam, a.id as stand, b.id as face, a.label as stand_label, b.label as face_label, a.cx as qx, a.cy as qy, a.pz as qz, {x} / {n} as wx, {y} / {n} as wy, {z} / {n} as wz
        from spread a join visible b on a.scene_id = b.scene_id and a.cam = b.cam and a.label <> b.label where {n} >= 1e-6) p where abs(wz) <= 0.866) q where flat >= 1e-6"""


@relation
def imagined_relations(d: Spark) -> str:
    """What a third object is to an imagined observer, clear on all three axes."""
    to = ("(c.cx - i.qx)", "(c.cy - i.qy)", "(c.cz - i.qz)")
    right, ahead, up = g.dot(to[:2], ("i.sx", "i.sy")), g.dot(to, ("i.wx", "i.wy", "i.wz")), to[2]
    return f"""select i.scene_id, i.cam, i.stand, i.face, c.id, c.label, c.u, c.v, {right} as right_, {ahead} as ahead, {up} as up, {g.norm(*to)} as far from imagined i
        join visible c on i.scene_id = c.scene_id and i.cam = c.cam and c.label <> i.stand_label and c.label <> i.face_label"""


@relation
def imagination_oc(d: Spark) -> str:
    words = f"concat({g.side('right_', 'right', 'left', 0.3)}, ', ', {g.side('up', 'above', 'below', 0.3)}, ', ', {g.side('ahead', 'front', 'behind', 0.3)})"
    return least_per_view(("stand", "face", "id", "answer"), "concat(scene_id, cam, stand, '|', face, '|', id)", f"""select scene_id, cam, stand, face, id, {words} as answer
        from imagined_relations where abs(right_) > 0.3 and abs(up) > 0.3 and abs(ahead) > 0.3""")


FIRST = 8  # standpoints of a view that imagination_oo tries before all others


@relation
def imagined_order(d: Spark) -> str:
    """Standpoints of a view by hash."""
    key = "concat(scene_id, cam, stand, '|', face)"
    return f"select *, row_number() over (partition by scene_id, cam order by md5({key}), {key}) as nth from imagined"


def _imagined_pairs(standpoints: str) -> str:
    """For each view the first standpoint in line with a valid pair of objects and, of its pairs, the one with the smallest MD5."""
    to = lambda o: (f"({o}.cx - i.qx)", f"({o}.cy - i.qy)", f"({o}.cz - i.qz)")
    side = lambda o: g.dot(to(o)[:2], ("i.sx", "i.sy"))
    right, up, near = f"({side('a')} - {side('b')})", f"({to('a')[2]} - {to('b')[2]})", f"({g.norm(*to('b'))} - {g.norm(*to('a'))})"
    words = f"concat({g.side('right_', 'right', 'left', 0.3)}, ', ', {g.side('up', 'above', 'below', 0.3)}, ', ', {g.side('near', 'closer', 'farther', 0.3)})"
    other = lambda o: f"{o}.scene_id = i.scene_id and {o}.cam = i.cam and {o}.label <> i.stand_label and {o}.label <> i.face_label"
    key = "concat(scene_id, cam, stand, '|', face, '|', id_a, '|', id_b)"
    valid = f"""select i.scene_id, i.cam, i.nth, i.stand, i.face, a.id as id_a, b.id as id_b, {right} as right_, {up} as up, {near} as near
        from {standpoints} i join visible a on {other('a')} join visible b on {other('b')} and a.label <> b.label where abs({right}) > 0.3 and abs({up}) > 0.3 and abs({near}) > 0.3"""
    columns = ("stand", "face", "id_a", "id_b", "answer")
    best = f"""select scene_id, cam, nth, {', '.join(f'min_by({c}, h) as {c}' for c in columns)} from (
        select scene_id, cam, nth, stand, face, id_a, id_b, {words} as answer, concat(md5({key}), {key}) as h from ({valid}) p) q group by scene_id, cam, nth"""
    return f"select scene_id, cam, {', '.join(f'min_by({c}, nth) as {c}' for c in columns)} from ({best}) r group by scene_id, cam"


@relation
def imagined_first(d: Spark) -> str:
    return _imagined_pairs(f"(select * from imagined_order where nth <= {FIRST})")


@relation
def imagined_rest(d: Spark) -> str:
    """Views where none of the first standpoints has a valid pair: all their others."""
    return _imagined_pairs(f"(select o.* from imagined_order o where nth > {FIRST} and not exists (select 1 from imagined_first f where f.scene_id = o.scene_id and f.cam = o.cam))")


@relation
def imagination_oo(d: Spark) -> str:
    """One object relative to another from an imagined standpoint: side, height, nearness.

    The standpoint is the first by hash with any valid pair; trying a few first only saves work."""
    return "select * from imagined_first union all select * from imagined_rest"


@relation
def csr_multi_step(d: Spark) -> str:
    """The diagonal in which a third object lies for an imagined observer."""
    return least_per_view(("stand", "face", "id", "answer"), "concat(scene_id, cam, stand, '|', face, '|', id)", """select scene_id, cam, stand, face, id, concat(case when ahead > 0 then 'front' else 'back' end, '-', case when right_ > 0 then 'right' else 'left' end) as answer
        from imagined_relations where abs(right_) > 0.3 and abs(ahead) > 0.3 and u between 0.02 and 0.98 and v between 0.02 and 0.98""")


@relation
def visibility_map(d: Spark) -> str:
    return "select scene_id, cam, count(*) as n, min(id) as first_id, max(id) as last_id from visible group by scene_id, cam"


@relation
def object_matching_mv(d: Spark) -> str:
    """An object seen in two views, its box in the second among three other boxes there."""
    return """select scene_id, cam_a, cam_b, id, x1, y1, x2, y2, others from (
        select a.scene_id, a.cam as cam_a, b.cam as cam_b, a.id, x.x1, x.y1, x.x2, x.y2, n.n - 1 as others, row_number() over (partition by a.scene_id, a.cam, b.cam order by md5(concat(a.id, a.cam, b.cam)), a.id) as rn
        from visible a join visible b on a.scene_id = b.scene_id and a.id = b.id and a.cam <> b.cam
        join bbox2d_raw x on x.scene_id = b.scene_id and x.cam = b.cam and x.id = b.id
        join (select v.scene_id, v.cam, count(*) as n from visible v join bbox2d_raw y on y.scene_id = v.scene_id and y.cam = v.cam and y.id = v.id group by v.scene_id, v.cam) n on n.scene_id = b.scene_id and n.cam = b.cam
        where n.n >= 4) t where rn = 1"""
