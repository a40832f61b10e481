"""Telemetry of a run as one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternlog.schemas import OPEN_STATUSES


def telemetry_kpis(
    observations: DataFrame,
    anomalies: DataFrame,
    catalog: DataFrame,
    sources: DataFrame,
    analyses: DataFrame | None = None,
    quarantined: DataFrame | None = None,
    metrics: DataFrame | None = None,
    progress: DataFrame | None = None,
) -> DataFrame:
    """Counts and rate; each table is read once, the counts meet as labelled rows.

    ``metrics`` has one row per micro-batch with ``late_rows``, the events that came too late to be counted; ``progress`` the reports
    of running queries with ``reported`` and ``consumer_lag``, of which the newest counts.
    """

    def count(df: DataFrame, **values: Column) -> DataFrame:
        pairs = [F.struct(F.lit(label).alias("label"), F.col(label).alias("value")) for label in values]
        totals = df.agg(*[value.cast("double").alias(label) for label, value in values.items()])
        return totals.select(F.inline(F.array(*pairs)))

    seconds = F.unix_micros(F.max("event_ts")) / 1e6 - F.unix_micros(F.min("event_ts")) / 1e6
    rows = [
        count(observations, lines=F.count(F.lit(1)), seconds=F.greatest(seconds, F.lit(1.0))),
        count(anomalies, active=F.count_if(F.col("status").isin(*OPEN_STATUSES))),
        count(catalog, templates=F.count(F.lit(1))),
        count(sources, sources=F.count(F.lit(1))),
    ]
    if analyses is not None:
        rows.append(count(analyses, errors=F.count("error")))
    if quarantined is not None:
        rows.append(count(quarantined, warnings=F.count(F.lit(1))))
    if metrics is not None:
        rows.append(count(metrics, dropped=F.sum("late_rows")))
    if progress is not None:
        rows.append(count(progress, lag=F.max_by("consumer_lag", "reported")))
    table = reduce(DataFrame.unionByName, rows)

    def pick(label: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("label") == label, F.col("value"))), F.lit(0.0))

    return table.agg(
        F.round(pick("lines") / pick("seconds"), 2).alias("ingestion_rate_lps"),
        pick("lines").cast("bigint").alias("total_lines_read"),
        pick("dropped").cast("bigint").alias("dropped_events"),
        pick("lag").cast("bigint").alias("consumer_lag"),
        pick("active").cast("bigint").alias("active_anomalies_count"),
        pick("templates").cast("bigint").alias("templates_count"),
        pick("sources").cast("bigint").alias("sources_count"),
        pick("errors").cast("bigint").alias("analysis_error_count"),
        (pick("dropped") > 0).alias("data_loss_warning"),
        pick("warnings").cast("bigint").alias("parsing_warnings_count"),
    )
