"""k-means detection: training, scoring, quality and the hosts involved.

Two clusters of one feature are a cut between two values of COUNT, so the best one is found without iterations: from
running sums over the distinct counts. A count c takes c log rows, so a log of N rows has fewer than sqrt(2 N) of
them, however many feature rows there are: that bounds what one task sorts for a kind.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import case, lookup_join

_WHOLE = "decimal(38,0)"


def with_vector(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows)


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    """How many rows (WEIGHT) have a COUNT, by further columns."""
    return rows.groupBy(*by, "COUNT").agg(F.count(F.lit(1)).alias("WEIGHT"))


def best_cuts(points: DataFrame, kind_column: str) -> DataFrame:
    """The split of a histogram's COUNTs in two with the least squared error, for each kind.

    One row per kind: CUT, the greatest COUNT of the lower part (null where there is one COUNT only), and LOWER and
    UPPER, with ROWS, CENTRE and WSSSE of the part. Of equally good splits the lowest counts. A split explains
    (n s1 - n1 s)^2 / (n1 n2) of the error, up to a factor; the numerator is exact, so splits that mirror each
    other are equal.
    """
    upto = Window.partitionBy(kind_column).orderBy("COUNT").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(kind_column)
    value, weight = F.col("COUNT").cast(_WHOLE), F.col("WEIGHT").cast(_WHOLE)
    sums = {"n": weight, "s": weight * value, "q": weight * value * value}
    running = points.where(F.col("COUNT").isNotNull()).select(
        kind_column,
        "COUNT",
        *[F.sum(x).over(upto).cast(_WHOLE).alias(f"{name}1") for name, x in sums.items()],
        *[F.sum(x).over(whole).cast(_WHOLE).alias(name) for name, x in sums.items()],
    )
    rest = {f"{name}2": F.col(name) - F.col(f"{name}1") for name in sums}
    apart = (F.col("n") * F.col("s1") - F.col("n1") * F.col("s")).cast("double")
    gain = F.when(F.col("n1") < F.col("n"), apart * apart / (F.col("n1").cast("double") * F.col("n2").cast("double")))
    split = running.withColumns(rest).withColumn("gain", F.coalesce(gain, F.lit(-1.0)))
    order = F.struct("gain", -F.col("COUNT"))
    best = split.groupBy(kind_column).agg(F.max_by(F.struct("*"), order).alias("b"))

    def part(number: int) -> Column:
        n, s, q = (F.col(f"b.{name}{number}").cast(_WHOLE) for name in sums)
        error = (n * q - s * s).cast("double") / n.cast("double")
        return F.struct(
            n.cast("bigint").alias("ROWS"), (s.cast("double") / n.cast("double")).alias("CENTRE"), error.alias("WSSSE")
        )

    split_up = F.col("b.gain") >= 0
    return best.select(
        kind_column,
        F.when(split_up, F.col("b.COUNT")).alias("CUT"),
        part(1).alias("LOWER"),
        F.when(split_up, part(2)).alias("UPPER"),
    )


def train_kinds(
    features: DataFrame, kind_column: str, kinds: Sequence[str]
) -> dict[str, list[float]]:
    """The ascending centres of each service or protocol that has rows, out of one aggregation.

    Where all rows have one COUNT there is one centre. Two numbers a kind reach the driver.
    """
    points = histogram(features.where(F.col(kind_column).isin(*kinds)), kind_column)
    found = best_cuts(points, kind_column).collect()
    return {
        row[kind_column]: [part["CENTRE"] for part in (row["LOWER"], row["UPPER"]) if part]
        for row in found
    }


def train(features: DataFrame) -> list[float]:
    """The ascending centres of all rows."""
    return train_kinds(features.withColumn("_kind", F.lit("all")), "_kind", ["all"]).get("all", [])


def centres_of(model: KMeansModel) -> list[float]:
    """Centres of a one-feature model in ascending order.

    The position is the cluster label used everywhere: the highest label has
    the highest COUNT, whatever order the model was fitted in.
    """
    return sorted(float(centre[0]) for centre in model.clusterCenters())


def _label(centres: Sequence[float]) -> Column:
    # Of ascending centres the nearest one is the number of midpoints passed.
    passed = [
        (F.col("COUNT") > (low + high) / 2).cast("int")
        for low, high in zip(centres, centres[1:])
    ]
    return sum(passed, F.lit(0))


def score(
    features: DataFrame, centres: Sequence[float], min_count: int | None = None
) -> DataFrame:
    """Add PREDICTION, the row's own CENTRE and all centres (CENTROID).

    A model with one centre labels every row 0. ``min_count`` keeps the label
    of smaller rows at 0, for data without any attack in it, which two clusters
    split all the same.
    """
    return _scored(features, _label(centres), F.lit(list(centres)), min_count)


def score_kinds(
    features: DataFrame,
    kind_column: str,
    centres: Mapping[str, Sequence[float]],
    min_count: int | None = None,
) -> DataFrame:
    """Score each service or protocol with its own centres, in one pass.

    Rows of kinds without centres are left out.
    """
    kind = F.col(kind_column)
    label = case((kind == name, _label(values)) for name, values in centres.items())
    all_centres = case((kind == name, F.lit(list(v))) for name, v in centres.items())
    known = features.where(kind.isin(*centres))
    return _scored(known, label, all_centres, min_count)


def _scored(
    features: DataFrame, label: Column, centres: Column, min_count: int | None
) -> DataFrame:
    if min_count is not None:
        label = F.when(F.col("COUNT") < min_count, 0).otherwise(label)
    return (
        features.withColumn("PREDICTION", label.cast("int"))
        .withColumn("CENTROID", centres)
        .withColumn("CENTRE", F.element_at("CENTROID", F.col("PREDICTION") + 1))
    )


def wssse(scored: DataFrame) -> DataFrame:
    """Within-set sum of squared errors of scored rows, as one row."""
    error = F.col("COUNT") - F.col("CENTRE")
    return scored.agg(F.sum(error * error).alias("WSSSE"))


def centre_sizes(scored: DataFrame) -> DataFrame:
    """The centres in use, with label and number of rows."""
    return scored.groupBy("PREDICTION", "CENTRE").agg(F.count(F.lit(1)).alias("ROWS"))


def fit_of_kinds(scored: DataFrame, kind_column: str) -> DataFrame:
    """By kind and label: the centre, its rows and their sum of squared errors (WSSSE)."""
    error = F.col("COUNT") - F.col("CENTRE")
    return scored.groupBy(kind_column, "PREDICTION", "CENTRE").agg(
        F.count(F.lit(1)).alias("ROWS"), F.sum(error * error).alias("WSSSE")
    )


def silhouette(scored: DataFrame, kind_column: str) -> DataFrame:
    """Silhouette of the scored rows of each kind (KIND), by squared distance; null where there is one cluster.

    The mean squared distance of x to a cluster of n rows with centre m and squared error e is
    e / n + (x - m)^2, so the histogram of the counts is all that is passed over. A row alone in its cluster counts 0.
    """
    points = histogram(scored, kind_column, "PREDICTION").where(F.col("COUNT").isNotNull())
    value, weight = F.col("COUNT").cast(_WHOLE), F.col("WEIGHT").cast(_WHOLE)
    sums = points.groupBy(kind_column, "PREDICTION").agg(
        F.sum(weight).cast(_WHOLE).alias("n"),
        F.sum(weight * value).cast(_WHOLE).alias("s"),
        F.sum(weight * value * value).cast(_WHOLE).alias("q"),
    )
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    cluster = F.struct(
        "PREDICTION",
        n.cast("double").alias("n"),
        (s.cast("double") / n.cast("double")).alias("m"),
        ((n * q - s * s).cast("double") / n.cast("double")).alias("e"),
    )
    # As many rows as kinds, each with as many entries as centres.
    clusters = sums.groupBy(kind_column).agg(F.collect_list(cluster).alias("_clusters"))
    own = F.filter("_clusters", lambda c: c["PREDICTION"] == F.col("PREDICTION"))[0]
    others = F.filter("_clusters", lambda c: c["PREDICTION"] != F.col("PREDICTION"))
    x = F.col("COUNT").cast("double")

    def away(c: Column) -> Column:
        return c["e"] / c["n"] + (x - c["m"]) * (x - c["m"])

    inside = own["n"] * away(own) / (own["n"] - 1)
    outside = F.array_min(F.transform(others, away))
    value = (
        F.when(own["n"] == 1, 0.0)
        .when(inside < outside, 1 - inside / outside)
        .when(inside > outside, outside / inside - 1)
        .otherwise(0.0)
    )
    each = points.join(F.broadcast(clusters), kind_column).withColumn(
        "_value", F.when(F.size("_clusters") > 1, value * F.col("WEIGHT"))
    )
    mean = F.sum("_value") / F.sum(F.when(F.col("_value").isNotNull(), F.col("WEIGHT")))
    return each.groupBy(F.col(kind_column).alias("KIND")).agg(mean.alias("SILHOUETTE"))


def attackers(scored: DataFrame, kind_column: str) -> DataFrame:
    """Distinct sources of the rows in the attack cluster, by kind."""
    return _hosts(scored, kind_column, "ID_ORIG_H")


def victims(scored: DataFrame, kind_column: str) -> DataFrame:
    """Distinct targets of the rows in the attack cluster, by kind."""
    return _hosts(scored, kind_column, "ID_RESP_H")


def _hosts(scored: DataFrame, kind_column: str, host: str) -> DataFrame:
    attack = scored.where(F.col("PREDICTION") == 1)
    return attack.select(kind_column, host).distinct()


def victim_history(scored: DataFrame, kind_column: str, **join: int) -> DataFrame:
    """All scored rows whose target is a victim of the same kind.

    ``join`` goes to :func:`lookup_join`.
    """
    hosts = victims(scored, kind_column)
    on = [kind_column, "ID_RESP_H"]
    return lookup_join(scored, hosts, on, "left_semi", **join)
