"""Many total types from few passes: each from the smallest stored type that has its columns.

The types form a lattice by their grouping columns. Those that no other type covers come from the log, in one pass with as
many copies of a row as there are of them. All others are rolled up from a stored type, the one with the fewest rows. How
many rows a type would have is measured by one sketch per type, over the stored rows of a type that covers it
and not over the log. Types that wait for the same level are rolled up together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import GROUP_COLUMNS, MEASURES, TOTAL_TYPES
from ..session import materialize
from .totals import TOTAL_COLUMNS, roll_up, totals_all


# Rows that a further stored type must save.
WORTH = 2_000_000


def covers(wide: str, narrow: str) -> bool:
    """Whether a type's rows can be rolled up to another's."""
    return set(TOTAL_TYPES[narrow]) < set(TOTAL_TYPES[wide])


def roots(tipos: Sequence[str]) -> list[str]:
    """Types that no other of them covers."""
    return [t for t in tipos if not any(covers(other, t) for other in tipos)]


def spanning_plan(tipos: Sequence[str], sizes: Mapping[str, int], worth: int = WORTH) -> dict[str, str]:
    """For each type but the roots: the type to roll it up from.

    The smallest root that covers it, or a smaller type on the way that saves passing over ``worth`` rows at least, as
    such a type has to be stored. Of equal ones the first by name.
    """
    tops = roots(tipos)
    plan = {}
    for tipo in tipos:
        if tipo in tops:
            continue
        wide = [t for t in tipos if covers(t, tipo)]
        top = min((t for t in wide if t in tops), key=lambda t: (sizes[t], t))
        least = min(wide, key=lambda t: (sizes.get(t, sizes[top]), t))
        plan[tipo] = least if sizes.get(least, sizes[top]) + worth <= sizes[top] else top
    return plan


def levels(plan: Mapping[str, str]) -> list[list[str]]:
    """The planned types in steps: each after the type it comes from."""

    def depth(tipo: str) -> int:
        return 1 + depth(plan[tipo]) if tipo in plan else 0

    found: list[list[str]] = []
    for tipo in plan:
        while len(found) < depth(tipo):
            found.append([])
        found[depth(tipo) - 1].append(tipo)
    return found


def measured_sizes(stored: DataFrame, tipos: Sequence[str], tops: Sequence[str], worth: int = WORTH) -> dict[str, int]:
    """Numbers of rows: counted for the stored types; where these are large, estimated by a sketch for those they cover.

    A sketch combines on the map side, so a number per type and task is all that moves.
    """
    counted = stored.agg(*[F.count(F.when(F.col("TIPO") == t, 1)).alias(t) for t in tops]).first().asDict()
    wanted = []
    for tipo in tipos:
        wide = [t for t in tops if covers(t, tipo)]
        if tipo not in tops and min(counted[t] for t in wide) >= worth:
            key = F.when(F.col("TIPO") == wide[0], F.xxhash64("TS", *TOTAL_TYPES[tipo]))
            wanted.append(F.approx_count_distinct(key).alias(tipo))
    return counted | (stored.agg(*wanted).first().asDict() if wanted else {})


def totals_by_lattice(conn: DataFrame, tipos: Sequence[str], worth: int = WORTH) -> DataFrame:
    """The rows of :func:`totals_all`, by the plan with the fewest rows to pass over.

    Types that others come from are written to the scratch folder, by type; the rest are rolled up where they are used.
    """
    tops = roots(tipos)
    if len(tops) == len(tipos):
        return totals_all(conn, tipos)
    first = materialize(totals_all(conn, tops), by=["TIPO"])
    plan = spanning_plan(tipos, measured_sizes(first, tipos, tops, worth), worth)
    at, parts = {tipo: first for tipo in tops}, [first]
    for step in levels(plan):
        kept = [t for t in step if t in plan.values()]
        parts += _rolled_up(at, plan, [t for t in step if t not in kept])
        if kept:
            parts.append(materialize(reduce(DataFrame.union, _rolled_up(at, plan, kept)), by=["TIPO"]))
            at |= {tipo: parts[-1] for tipo in kept}
    return _all(parts)


def _rolled_up(at: Mapping[str, DataFrame], plan: Mapping[str, str], tipos: Sequence[str]) -> list[DataFrame]:
    """One pass for each type that some of these come from."""
    parents = dict.fromkeys(plan[t] for t in tipos)
    return [
        roll_up(at[parent].where(F.col("TIPO") == parent), [t for t in tipos if plan[t] == parent])
        for parent in parents
    ]


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    rows = [part.select("TIPO", "TS", *GROUP_COLUMNS, "COUNT", *MEASURES) for part in parts]
    return reduce(DataFrame.union, rows).select(*TOTAL_COLUMNS)
