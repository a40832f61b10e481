"""Job ``retain``: tables and a time in, kept tables and a report out."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_HOURS = 24
AGGREGATE_MONTHS = 6
# A month of retention has this many days.
MONTH_DAYS = 30


def _ago(now: Column, hours: int) -> Column:
    return now - F.expr(f"INTERVAL {hours} HOURS")


def expired(now: Column, sample_hours: int = SAMPLE_HOURS, months: int = AGGREGATE_MONTHS) -> dict[str, Column]:
    """Per table the test that a row has outlived its window."""
    samples, aggregates = _ago(now, sample_hours), _ago(now, months * MONTH_DAYS * 24)

    def before(column: str, cutoff: Column) -> Column:
        return F.coalesce(F.col(column) < cutoff, F.lit(False))

    return {
        "samples": before("expires_at", now) | before("created_at", samples),
        "analyses": before("created_at", aggregates),
        "feedback": before("created_at", aggregates),
        "embeddings": before("created_at", aggregates) | before("expires_at", now),
        "anomalies": before("detected_at", aggregates),
        "buckets": before("bucket_end", aggregates),
        "templates": before("last_seen", aggregates),
    }


def retain(
    tables: dict[str, DataFrame], now: datetime, sample_hours: int = SAMPLE_HOURS, months: int = AGGREGATE_MONTHS
) -> dict[str, DataFrame]:
    """Tables without expired rows; evidence and raw answers older than the sample window are blanked."""
    moment = F.lit(now).cast("timestamp")
    tests = expired(moment, sample_hours, months)
    kept = {name: df.where(~tests[name]) for name, df in tables.items()}
    cutoff = _ago(moment, sample_hours)
    if "anomalies" in kept:
        none = F.array().cast("array<string>")
        old = F.when(F.col("detected_at") < cutoff, none).otherwise(F.col("sample_evidence"))
        kept["anomalies"] = kept["anomalies"].withColumn("sample_evidence", old)
    if "analyses" in kept:
        recent = F.when(F.col("created_at") >= cutoff, F.col("raw_response"))
        kept["analyses"] = kept["analyses"].withColumn("raw_response", recent)
    return kept


def drop_expired_days(
    spark: SparkSession, path: str, now: datetime, hours: int = AGGREGATE_MONTHS * MONTH_DAYS * 24, column: str = "day"
) -> list[str]:
    """Delete the whole partitions of a table stored by day whose last moment has outlived the window; their days are returned.

    No row is read. A day that the window cuts through stays until all of it has expired. Folders that are not named
    after a day, and a table that does not exist, are left alone.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    gone = []
    for status in system.listStatus(folder):
        name, _, value = status.getPath().getName().partition("=")
        try:
            day = date.fromisoformat(value) if name == column else None
        except ValueError:
            continue
        end = None if day is None else datetime(day.year, day.month, day.day) + timedelta(days=1)
        if status.isDirectory() and end is not None and end <= now - timedelta(hours=hours):
            system.delete(status.getPath(), True)
            gone.append(value)
    return sorted(gone)


def retention_report(
    tables: dict[str, DataFrame], now: datetime, sample_hours: int = SAMPLE_HOURS, months: int = AGGREGATE_MONTHS
) -> DataFrame:
    """One row with the number of rows each table loses."""
    moment = F.lit(now).cast("timestamp")
    tests = expired(moment, sample_hours, months)
    counts = [
        df.agg(F.count_if(tests[name]).alias("deleted")).select(F.lit(name).alias("name"), "deleted")
        for name, df in tables.items()
    ]
    union = reduce(DataFrame.unionByName, counts)
    columns = [
        F.coalesce(F.sum(F.when(F.col("name") == name, F.col("deleted"))), F.lit(0)).alias(f"{name}_deleted")
        for name in tests
    ]
    run = F.sha2(F.concat_ws("|", moment.cast("string"), F.lit(sample_hours), F.lit(months)), 256)
    return union.agg(*columns).select(
        run.alias("id"), moment.alias("run_at"), *[f"{name}_deleted" for name in tests],
        F.lit("completed").alias("status"),
    )
