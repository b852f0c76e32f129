"""The few places where the engines that read our SQL write things differently."""

from __future__ import annotations


class Spark:
    """Spark SQL, the engine."""

    name = "spark"

    def trunc(self, x: str) -> str:
        return f"cast({x} as int)"

    def rint(self, x: str) -> str:
        return f"rint({x})"

    def pmod(self, x: str, n: str) -> str:
        return f"pmod({x}, {n})"

    def seed(self, text: str) -> str:
        """The low 31 bits of the MD5 of a text."""
        return f"(cast(conv(right(md5({text}), 8), 16, 10) as bigint) & 2147483647)"

    def matches(self, x: str, pattern: str) -> str:
        return f"rlike({x}, {self.text(pattern)})"

    def replace_pattern(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, '{by}')"

    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def strings(self, xs: list[str]) -> str:
        return f"array({', '.join(xs)})"

    def joined(self, xs: str, by: str) -> str:
        return f"array_join({xs}, '{by}')"

    def collected(self, value: str, order: str) -> str:
        """Values of a group as an array, by ``order``."""
        return f"transform(array_sort(collect_list(struct({order} as o, {value} as v))), s -> s.v)"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def item(self, array: str, i: int) -> str:
        return f"{array}[{i}]"

    def sequence(self, n: int, name: str) -> str:
        """A table of 0..n-1."""
        return f"(select id as {name} from range({n}))"

    def between(self, x: str, start: str, end: str) -> str:
        """What stands between two marks of a text."""
        return f"split_part(split_part({x}, '{start}', 2), '{end}', 1)"

    def json_text(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def valid_json(self, x: str) -> str:
        """The text where it is JSON, else null."""
        return f"case when try_parse_json({x}) is not null then {x} end"

    def before(self, x: str, mark: str) -> str:
        """What stands before a mark of a text; all of it where there is none."""
        return f"split_part({x}, '{mark}', 1)"

    def extracted(self, x: str, pattern: str) -> str:
        """The first group of a pattern."""
        return f"regexp_extract({x}, {self.text(pattern)}, 1)"


class Duck(Spark):
    """DuckDB, the oracle."""

    name = "duckdb"

    def trunc(self, x: str) -> str:
        return f"cast(trunc({x}) as int)"

    def rint(self, x: str) -> str:
        return f"round_even({x}, 0)"

    def pmod(self, x: str, n: str) -> str:
        return f"((({x}) % ({n})) + ({n})) % ({n})"

    def seed(self, text: str) -> str:
        return f"(('0x' || right(md5({text}), 8))::bigint & 2147483647)"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.text(pattern)})"

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def strings(self, xs: list[str]) -> str:
        return f"[{', '.join(xs)}]"

    def joined(self, xs: str, by: str) -> str:
        return f"array_to_string({xs}, '{by}')"

    def collected(self, value: str, order: str) -> str:
        return f"list({value} order by {order})"

    def percentile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def item(self, array: str, i: int) -> str:
        return f"{array}[{i + 1}]"

    def sequence(self, n: int, name: str) -> str:
        return f"(select range as {name} from range({n}))"

    def json_text(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def valid_json(self, x: str) -> str:
        return f"case when json_valid({x}) then {x} end"


SPARK, DUCK = Spark(), Duck()
