"""k-means on several features by Lloyd's iterations, each one aggregation of the rows.

From stated starts to a fixed point, so the result is the same every time and can be checked. Rows equally near to
two centres go to the first of them; a cluster without rows keeps its centre.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Centre = tuple[float, ...]


@dataclass(frozen=True)
class Fit:
    """Centres in ascending order, with the rows and the squared error of each; ``rounds`` until nothing moved."""

    columns: tuple[str, ...]
    centres: tuple[Centre, ...]
    rows: tuple[int, ...]
    errors: tuple[float, ...]
    rounds: int

    @property
    def wssse(self) -> float:
        return sum(self.errors)


def usable(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null in the features."""
    return rows.dropna(subset=list(columns))


def extremes(points: DataFrame, columns: Sequence[str]) -> list[Centre]:
    """The least and the greatest row by the features in their order: the starts of two clusters."""
    row = F.struct(*columns)
    found = points.agg(F.min(row).alias("low"), F.max(row).alias("high")).first()
    if found["low"] is None:
        return []
    ends = [tuple(float(x) for x in found[name]) for name in ("low", "high")]
    return ends if ends[0] != ends[1] else ends[:1]


def _error(columns: Sequence[str], centre: Centre) -> Column:
    parts = [F.col(c).cast("double") - F.lit(x) for c, x in zip(columns, centre)]
    total = parts[0] * parts[0]
    for part in parts[1:]:
        total = total + part * part
    return total


def _nearest(columns: Sequence[str], centres: Sequence[Centre]) -> Column:
    """Label and squared error of the nearest centre, the first of equally near ones."""
    options = [F.struct(_error(columns, c).alias("error"), F.lit(i).alias("label")) for i, c in enumerate(centres)]
    return F.least(*options) if len(options) > 1 else options[0]


def lloyd(points: DataFrame, columns: Sequence[str], starts: Sequence[Centre]) -> Fit:
    """Iterate until no centre moves, or the squared error falls no further.

    The error falls from round to round and there are finitely many divisions, so it ends. Sums of whole numbers
    are exact; as many rows as clusters reach the driver.
    """
    columns = list(columns)
    centres, last, rounds = [tuple(c) for c in starts], float("inf"), 0
    if not centres:
        return Fit(tuple(columns), (), (), (), 0)
    while True:
        near = points.select(*columns, _nearest(columns, centres).alias("_near"))
        found = near.groupBy(F.col("_near.label").alias("label")).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("_near.error").alias("error"),
            *[F.sum(c).cast("double").alias(f"s{i}") for i, c in enumerate(columns)],
        )
        of = {row["label"]: row for row in found.collect()}
        moved = [
            tuple(of[i][f"s{j}"] / of[i]["n"] for j in range(len(columns))) if i in of else centre
            for i, centre in enumerate(centres)
        ]
        error = sum(row["error"] for row in of.values())
        if moved == centres or error >= last:
            break
        centres, last, rounds = moved, error, rounds + 1
    order = sorted(range(len(centres)), key=lambda i: centres[i])
    return Fit(
        tuple(columns),
        tuple(centres[i] for i in order),
        tuple(of[i]["n"] if i in of else 0 for i in order),
        tuple(of[i]["error"] if i in of else 0.0 for i in order),
        rounds,
    )


def score_points(points: DataFrame, fit: Fit) -> DataFrame:
    """Add PREDICTION and the squared distance to the own centre (SQ_ERROR). Labels ascend with the centres."""
    near = points.withColumn("_near", _nearest(fit.columns, fit.centres))
    return near.withColumns({"PREDICTION": F.col("_near.label"), "SQ_ERROR": F.col("_near.error")}).drop("_near")


def fit_table(points: DataFrame, fit: Fit) -> DataFrame:
    """By label: the centre's features, its rows and squared error (WSSSE), as a small table."""
    rows = [(i, *c, n, e) for i, (c, n, e) in enumerate(zip(fit.centres, fit.rows, fit.errors))]
    features = ", ".join(f"{c} double" for c in fit.columns)
    return points.sparkSession.createDataFrame(rows, f"PREDICTION int, {features}, ROWS bigint, WSSSE double")
