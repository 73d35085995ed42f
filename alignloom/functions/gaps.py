"""Piecewise-linear gap costs as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Knots and costs that the established tables share.
_KNOTS = (1, 2, 3, 11, 111, 2111, 12111, 32111, 72111, 152111, 252111)
_LOOSE = (325, 360, 400, 450, 600, 1100, 3600, 7600, 15600, 31600, 56600)
_MEDIUM = (350, 425, 450, 600, 900, 2900, 22900, 57900, 117900, 217900, 317900)
_CHEAP = (0, 30, 300)
#: The cost where extrapolation falls below zero.
OVERFLOW = 0x3FFFFFFF


@dataclass(frozen=True)
class GapTable:
    """Costs at the knots for gaps on the query, on the target, on both; small: the knot where extrapolated knots begin."""

    small: int
    positions: tuple[int, ...]
    query: tuple[float, ...]
    target: tuple[float, ...]
    both: tuple[float, ...]

    def __post_init__(self):
        if self.small not in self.positions:
            raise ValueError("smallSize is none of the positions")
        if len(self.positions) - self.positions.index(self.small) < 2:
            raise ValueError("a gap table needs two knots from smallSize on")
        if not len(self.positions) == len(self.query) == len(self.target) == len(self.both):
            raise ValueError("a gap table's rows differ in length")


#: The established tables (cost models by name).
TABLES = {
    "loose": GapTable(111, _KNOTS, _LOOSE, _LOOSE, (625, 660, 700, 750, 900, 1400, 4000, 8000, 16000, 32000, 57000)),
    "medium": GapTable(111, _KNOTS, _MEDIUM, _MEDIUM, (750, 825, 850, 1000, 1300, 3300, 23300, 58300, 118300, 218300, 318300)),
    "cheap": GapTable(100, (1, 100, 1000), _CHEAP, _CHEAP, _CHEAP),
    "rnaDna": GapTable(
        111, (1, 2, 3, 11, 31, 111, 2111, 12111, 32111, 72111, 152111, 252111), (325, 360, 400, 450, 600, 800, 1100, 3600, 7600, 15600, 31600, 56600),
        (200, 210, 220, 250, 300, 400, 500, 600, 800, 1200, 2000, 4000), (625, 660, 700, 750, 900, 1100, 1400, 4000, 8000, 16000, 32000, 57000),
    ),
}
TABLES["original"] = TABLES["medium"]


def parsed(text: str) -> GapTable:
    """A gap table from its text: lines of a tag (any case) and values, # comments."""
    rows = {}
    for line in text.splitlines():
        words = line.split("#")[0].split()
        if words:
            rows[words[0].lower()] = words[1:]
    try:
        n = int(rows["tablesize"][0]) if "tablesize" in rows else len(rows["position"])
        table = GapTable(int(rows["smallsize"][0]), tuple(map(int, rows["position"])), *(tuple(map(float, rows[k])) for k in ("qgap", "tgap", "bothgap")))
    except (KeyError, IndexError) as missing:
        raise ValueError(f"the gap table lacks {missing}") from None
    if n != len(table.positions):
        raise ValueError("tableSize does not match the position list")
    return table


def _list(values) -> str:
    return f"array({', '.join(f'CAST({v} AS DOUBLE)' for v in values)})"


def cost_sql(dq: str, dt: str, table: GapTable | str = "loose", truncate=lambda e: f"CAST({e} AS BIGINT)") -> str:
    """SQL for the cost of a gap of dq on the query and dt on the target; negative gaps count as none.

    One CASE finds the segment, the line's numbers come from lists by segment and side: the
    code that Spark makes of a CASE with a line in each arm of each side is too long to be compiled.
    truncate: how the engine cuts a double toward zero; Spark's cast does.
    """
    table = TABLES[table] if isinstance(table, str) else table
    q, t = f"greatest({dq}, 0)", f"greatest({dt}, 0)"
    x, p, sides = f"({q} + {t})", table.positions, (table.query, table.target, table.both)
    arms = [f"WHEN {x} <= 0 THEN 0", f"WHEN {x} <= {p[0]} THEN 1", *(f"WHEN {x} < {after} THEN {i}" for i, after in enumerate(p[1:], 2))]
    last = len(p) + 1
    segment = f"CASE {' '.join(arms)} ELSE {last} END"
    start, width = f"array({', '.join(f'{v}L' for v in (0, 0, *p))})", _list((1, 1, *(b - a for a, b in zip(p, p[1:])), 1))
    value = _list(v for s in sides for v in (0, int(s[0]), *s))
    rise = _list(v for s in sides for v in (0, 0, *(b - a for a, b in zip(s, s[1:])), (s[-1] - s[-2]) / (p[-1] - p[-2])))
    place = f"({segment} + CASE WHEN {t} = 0 THEN 0 WHEN {q} = 0 THEN {last + 1} ELSE {2 * (last + 1)} END)"
    line = truncate(f"({value}[{place}] + {rise}[{place}] * CAST({x} - {start}[{segment}] AS DOUBLE) / {width}[{segment}])")
    return f"CASE WHEN {line} < 0 AND {segment} = {last} THEN CAST({OVERFLOW} AS BIGINT) ELSE {line} END"


def cost(dq: Column, dt: Column, table: GapTable | str = "loose") -> Column:
    """cost_sql() of two columns."""
    table = TABLES[table] if isinstance(table, str) else table
    zero = F.lit(0).cast("bigint")
    q, t = F.greatest(dq, zero), F.greatest(dt, zero)

    def side(x, values):
        p = table.positions
        out = F.when(x <= 0, zero).when(x <= p[0], F.lit(int(values[0])).cast("bigint"))
        for i in range(1, len(p)):
            line = F.lit(float(values[i - 1])) + F.lit(float(values[i] - values[i - 1])) * (x - p[i - 1]).cast("double") / F.lit(float(p[i] - p[i - 1]))
            out = out.when(x < p[i], line.cast("bigint"))
        beyond = (F.lit(float(values[-1])) + F.lit(float((values[-1] - values[-2]) / (p[-1] - p[-2]))) * (x - p[-1]).cast("double")).cast("bigint")
        return out.when(beyond < 0, F.lit(OVERFLOW).cast("bigint")).otherwise(beyond)

    return F.when(t == 0, side(q, table.query)).when(q == 0, side(t, table.target)).otherwise(side(q + t, table.both))
