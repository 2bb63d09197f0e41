"""The DDoS and the port-scan detection jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame

from ..operators.clusters import fit_of_kinds, score_kinds, train_kinds
from ..operators.features import ddos_features, scan_features
from ..operators.totals import tag_run
from ..session import configure, materialize
from ..sinks import has_model, load_model, read_results, save_model, write_results
from ..sources.tables import bucket_start, select_conn, select_touched

DDOS_SERVICES = ["http", "ssh"]
SCAN_PROTOS = ["tcp", "udp"]


def run_ddos(
    raw: DataFrame,
    since: str | datetime,
    run_ts: datetime,
    table: str,
    models: str,
    services: Sequence[str] = DDOS_SERVICES,
    retrain: bool = False,
    min_count: int | None = None,
    arrived: bool = False,
) -> DataFrame | None:
    """Score the traffic per minute of some services, from the minute of ``since`` on, and store the rows.

    With ``arrived``, the minutes of records taken in after ``since`` are scored anew.
    """
    return _detect(
        raw, since, run_ts, table, models, services, retrain, min_count, arrived,
        kind_column="SERVICE", features_of=ddos_features, grain="minute",
    )


def run_scan(
    raw: DataFrame,
    since: str | datetime,
    run_ts: datetime,
    table: str,
    models: str,
    protos: Sequence[str] = SCAN_PROTOS,
    retrain: bool = False,
    min_count: int | None = None,
    arrived: bool = False,
) -> DataFrame | None:
    """Score the traffic per hour of some protocols, from the hour of ``since`` on, and store the rows.

    With ``arrived``, the hours of records taken in after ``since`` are scored anew.
    """
    return _detect(
        raw, since, run_ts, table, models, protos, retrain, min_count, arrived,
        kind_column="PROTO", features_of=scan_features, grain="hour",
    )


def _detect(
    raw: DataFrame,
    since: str | datetime,
    run_ts: datetime,
    table: str,
    models: str,
    kinds: Sequence[str],
    retrain: bool,
    min_count: int | None,
    arrived: bool,
    kind_column: str,
    features_of: Callable[[DataFrame, Sequence[str]], DataFrame],
    grain: str,
) -> DataFrame | None:
    """Score with the stored models; missing ones are trained and stored.

    All kinds share one pass over the log. With all models there, features go
    straight into the scored table; training first writes them out once. The
    first bucket is whole, as a part of it would hide an attack. Returns how well the
    stored rows fit, see :func:`fit_of_kinds`, or None without a model of any kind.
    """
    spark = configure(raw.sparkSession)
    if arrived:
        rows = select_touched(raw, since, run_ts, grain)
    else:
        rows = select_conn(raw, since, grain)
    features = features_of(rows, kinds)
    untrained = [
        kind for kind in kinds if retrain or not has_model(spark, f"{models}/{kind}")
    ]
    if untrained:
        features = materialize(features)
        for kind, fitted in train_kinds(features, kind_column, untrained).items():
            save_model(spark, fitted, f"{models}/{kind}")
    centres = {
        kind: load_model(spark, f"{models}/{kind}")
        for kind in kinds
        if has_model(spark, f"{models}/{kind}")
    }
    if not centres:
        return None
    scored = score_kinds(features, kind_column, centres, min_count)
    tagged = tag_run(scored, bucket_start(since, grain), run_ts)
    write_results(tagged, table, run_ts, by=[kind_column])
    return fit_of_kinds(read_results(spark, table, run_ts=run_ts), kind_column)
