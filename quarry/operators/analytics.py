"""Operational analytics: counts, pages, latest rows, metric summaries, webhook classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Equal ranges that a metric's values are counted in at once, and the number of values that are put in order in the end.
RANGES, FEW = 4096, 10_000


def metric_summaries(events: DataFrame, names: list[str] | None = None, since=None) -> DataFrame:
    """Per metric: count, sum, avg, min, max and p95 of the events since then; the 95th percentile is exact."""
    rows = events.filter("value IS NOT NULL")
    if names is not None:
        rows = rows.filter(F.col("name").isin(names))
    if since is not None:
        rows = rows.filter(F.col("recorded_at") >= since)
    totals = rows.groupBy("name").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    place = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(0.95)).cast("long"))
    return totals.join(_at_place(rows, totals.select("name", place.alias("place"), "low", "high", "n")), "name")


def _at_place(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, p95): each metric's value at its place (from 0) in order.

    Values are counted in equal ranges between two ends; the range that holds the place gives the ends of the next count, which
    are its own smallest and largest value, until few values are between them. So one far value costs one more
    count, and no task orders more than ``FEW`` values, or as many as are equal. One row a metric comes to the driver.
    """
    spark, bounds = rows.sparkSession, [tuple(r) + (0,) for r in wanted.collect()]
    schema = "name string, place long, low double, high double, times long, before long"
    value, half = F.col("value").cast("double"), lambda c: F.col(c) / 2  # halves, so that no difference overflows
    while True:
        ends = F.broadcast(spark.createDataFrame(bounds, schema).withColumnRenamed("times", "held"))
        inside = rows.select("name", value.alias("value")).join(ends, "name").filter("value >= low AND value <= high")
        wide = [b for b in bounds if b[4] > FEW and b[2] < b[3]]
        if not wide:
            break
        part = F.least(F.lit(RANGES - 1.0), F.floor(F.nanvl(F.try_divide(half("value") - half("low"), half("high") - half("low")), F.lit(1.0)) * RANGES))
        sums = inside.filter(F.col("name").isin([b[0] for b in wide])).groupBy("name", "place", "before", part.cast("int").alias("part")).agg(F.count("*").alias("times"), F.min("value").alias("low"), F.max("value").alias("high"))
        upto = F.col("before") + F.sum("times").over(Window.partitionBy("name").orderBy("part"))  # at most RANGES rows a metric
        held = sums.withColumn("upto", upto).filter("upto > place AND upto - times <= place").select("name", "place", "low", "high", "times", (F.col("upto") - F.col("times")).alias("before"))
        closer = {r["name"]: tuple(r) for r in held.collect()}
        bounds = [closer.get(b[0], b) for b in bounds]
    counts = inside.groupBy("name", "value", "place", "before").agg(F.count("*").alias("times"))
    upto = F.col("before") + F.sum("times").over(Window.partitionBy("name").orderBy("value"))
    return counts.withColumn("upto", upto).filter(F.col("upto") > F.col("place")).groupBy("name").agg(F.min("value").alias("p95"))


def metric_windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Per metric and window of time: count, sum, avg, min, max; runs on streams as well."""
    return events.groupBy("name", F.window("recorded_at", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def counts_by(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def numbered(rows: DataFrame, *order) -> DataFrame:
    """Adds the place, from 1, of each of a few ranked rows; they are sorted in one task."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of the ordered rows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_with_total(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """The page, each row with the number of all rows in ``total``."""
    return page(rows, order, number, size).withColumn("total", F.lit(rows.count()))


def with_child_count(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Adds how many children each parent has; children are counted before they meet the parents."""
    return parents.join(children.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def latest(rows: DataFrame, by: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each group; aggregated before the shuffle, so a large group costs no sort."""
    others = [c for c in rows.columns if c not in by]
    newest = F.max_by(F.struct(*others), F.struct(at, tie))
    return rows.groupBy(*by).agg(newest.alias("row")).select(*by, "row.*")


def sessions(rows: DataFrame, by: str, at: str, gap_seconds: int) -> DataFrame:
    """Runs of events of a key with less than the gap between them: first, last and number of events."""
    w = F.session_window(at, f"{gap_seconds} seconds").alias("s")
    return rows.groupBy(by, w).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).drop("s")


def delivery_status(seen: Column, event: Column, body_ok: Column, project: Column, signed: Column, branch_ok: Column, after: Column) -> Column:
    """The first of the reasons, in order, for which a delivery is not processed."""
    return (
        F.when(seen, "duplicate").when(event != "push", "ignored").when(~body_ok, "failed").when(project.isNull(), "failed").when(~signed, "failed")
        .when(~branch_ok, "ignored").when(after.isNull() | after.rlike("^0*$"), "ignored").otherwise("processed")
    )


def health(jobs: DataFrame, repositories: DataFrame, since) -> DataFrame:
    """Queue depth, failures since then, failed repositories, and whether all is well."""
    q = jobs.agg(F.count_if(F.col("status").isin("waiting", "active", "delayed", "queued", "running")).alias("queue_depth"), F.count_if((F.col("status") == "failed") & (F.col("at") >= since)).alias("recent_failures"))
    r = repositories.agg(F.count_if(F.col("status") == "failed").alias("failed_repositories"))
    row = r.first()  # one number
    failed = F.lit(row["failed_repositories"]).cast("long")
    return q.withColumn("failed_repositories", failed).withColumn("status", F.when((F.col("recent_failures") == 0) & (failed == 0), "healthy").otherwise("degraded"))


def queue_depth(jobs: DataFrame) -> DataFrame:
    """One row: jobs that wait or run, and jobs that failed."""
    return jobs.agg(F.count_if(F.col("status").isin("queued", "running", "waiting", "active", "delayed")).alias("queue_depth"), F.count_if(F.col("status") == "failed").alias("failed"))


def index_status(jobs: DataFrame) -> DataFrame:
    """Per project its waiting jobs, and the newest job (by at, job_id) with its time."""
    return jobs.groupBy("project_id").agg(F.count_if(F.col("status") == "queued").alias("queued"), F.max("at").alias("last_at"), F.max_by("job_id", F.struct("at", "job_id")).alias("last_job"))


def first_deliveries(deliveries: DataFrame, keys: list[str], delivery: str) -> DataFrame:
    """The first delivery of each id; streams use ``quarry.streaming.events.once``."""
    return deliveries.groupBy(*keys).agg(F.min(delivery).alias(delivery))


def project_stats(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per project its files, and the number, the indexed ones and the size of their jobs; jobs are summed up by file before they meet the files."""
    each = jobs.groupBy("file_id").agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.sum("size").alias("size"))
    zero = lambda n: F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n)
    rows = files.select("project_id", "file_id").join(each, "file_id", "left").groupBy("project_id")
    return rows.agg(F.count("*").alias("files"), zero("indexed"), zero("jobs"), F.round(F.coalesce(F.sum("size"), F.lit(0.0)), 2).alias("size"))
