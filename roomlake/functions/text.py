"""Labels and names."""

from __future__ import annotations

from ..plans.dialect import Spark

# The room prefixes that labels lose.
ROOM_PREFIXES = ("bedroom", "kitchen", "living_room", "bathroom", "hallway", "dining_room", "office", "laundry", "garage", "closet", "pantry", "study")
# The shorter list that area matching uses.
AREA_ROOM_PREFIXES = ("bedroom", "bathroom", "hallway", "closet", "garage", "laundry")


def normalized_type(d: Spark, x: str) -> str:
    """A type without one trailing number: chair_5 and chair5 are chair."""
    return d.replace_pattern(x, r"_?\d+$", "")


def clean_label(d: Spark, x: str) -> str:
    """A type as people say it: no number, no room, spaces for underscores."""
    bare = d.replace_pattern(normalized_type(d, x), f"^({'|'.join(ROOM_PREFIXES)})_", "")
    return f"replace({bare}, '_', ' ')"


def object_label(d: Spark, type_: str = "type", id_: str = "id", index: str = "object_index") -> str:
    """The label of an object: by its type, else by its id, else by its index."""
    return f"case when {type_} <> '' then {clean_label(d, type_)} when {id_} <> '' then {clean_label(d, id_)} else concat('object_', coalesce(cast({index} as string), '?')) end"


def without_room(d: Spark, x: str) -> str:
    """A type without its room, by the rule of area matching."""
    one = d.replace_pattern(x, f"^({'|'.join(AREA_ROOM_PREFIXES)})_", "")
    two = d.replace_pattern(x, "^(living|dining)_room_", "")
    return f"case when {d.matches(x, f'^({chr(124).join(AREA_ROOM_PREFIXES)})_')} then {one} else {two} end"


def letter(position: str) -> str:
    """A for 1, B for 2, ..."""
    return f"chr(cast(64 + {position} as int))"


def five_degrees(right: str, up: str, forward: str, yaw: str, pitch: str) -> str:
    """A pose change in words and rounded numbers; what is not negative gets the first word of a pair."""
    metres = lambda x, a, b: f"concat(case when {x} >= 0 then '{a}' else '{b}' end, ':', cast(cast(round(abs({x}), 1) as decimal(9,1)) as string))"
    degrees = lambda x, a, b: f"concat(case when {x} >= 0 then '{a}' else '{b}' end, ':', cast(cast(round(abs({x}), 0) as int) as string))"
    return "concat(" + ", ',', ".join((metres(right, "move_right", "move_left"), metres(up, "move_up", "move_down"), metres(forward, "move_forward", "move_backward"), degrees(yaw, "rotate_right", "rotate_left"), degrees(pitch, "rotate_up", "rotate_down"))) + ")"
