"""Readers and writers: day files, snapshots, last-wins upserts, quarantine, publishing with a marker."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def scan_day_files(spark: SparkSession, path: str, schema: StructType, since: str, until: str) -> DataFrame:
    """JSON lines of files named YYYY-MM-DD.jsonl from since to until, each with its day; only those files are listed and read. Lines that aren't
    objects come as _corrupt_record (count them with bad_lines)."""
    first, last = (date.fromisoformat(x) for x in (since, until))
    days = [(first + timedelta(k)).isoformat() for k in range((last - first).days + 1)]
    # Days share prefixes of months; a glob of their alternatives lists the folder once.
    rows = spark.read.schema(StructType([*schema.fields, StructField("_corrupt_record", StringType())])).option("columnNameOfCorruptRecord", "_corrupt_record").json(path, pathGlobFilter="{" + ",".join(f"{d}.jsonl" for d in days) + "}")
    return rows.withColumn("day", F.regexp_extract(F.col("_metadata.file_name"), "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1))


def bad_lines(rows: DataFrame) -> DataFrame:
    """day, lines, bad: how many lines of a day aren't objects."""
    return rows.groupBy("day").agg(F.count("*").alias("lines"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("bad"))


def scan_snapshot(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Records of {source, pulled_at, records} envelopes, each with its place; and the files that are no snapshots, for the caller to refuse. Files
    without records give none."""
    raw = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    sound = F.col("source").isNotNull() & F.col("pulled_at").isNotNull() & F.col("records").isNotNull()
    return raw.filter(sound).select("source", "pulled_at", F.posexplode("records").alias("place", "record")), raw.filter(~sound).select("file")


def scan_forecast(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The forecast of a folder and the closures beside it."""
    return spark.read.parquet(f"{path}/forecast.parquet"), spark.read.parquet(f"{path}/closures.parquet")


def scan_history(rows: DataFrame, issued_s: int, buckets: int, bucket_s: int = 600) -> DataFrame:
    """The rows of the `buckets` buckets that ended by issued_s; an error if a bucket is missing or the last is unfinished. rows: t (a bucket's
    start in seconds). The filter reaches the scan, and one aggregate checks what it finds."""
    held = rows.filter((F.col("t") >= issued_s - buckets * bucket_s) & (F.col("t") < issued_s))
    found, newest = held.agg(F.count_distinct("t"), F.max("t")).first()
    if newest is not None and newest + bucket_s > issued_s:
        raise ValueError("the history holds an unfinished bucket")
    if found != buckets:
        raise ValueError(f"{buckets} completed buckets are needed, {found} were found")
    return held


def backfill(spark: SparkSession, day: str, path: str, schema: StructType, job: Callable[[DataFrame, str], DataFrame], table: str) -> None:
    """Rebuilds one past day: the job over that day's file alone, into that day's partition; other days stay."""
    rows = scan_day_files(spark, path, schema, day, day)
    out = job(rows, day).withColumn("day", F.lit(day))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(table)


def active_at(df: DataFrame, start: Column, end: Column, t: Column) -> DataFrame:
    return df.filter((start <= t) & (end.isNull() | (end >= t)))


def active_or_upcoming(df: DataFrame, start: Column, end: Column, now: Column, days: int = 30, status: str | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Rows that end now or later and start within the days; rows of a status in `without` go."""
    kept = df.filter((end.isNull() | (end >= now)) & (start <= now + F.expr(f"interval {days} days")))
    return kept.filter(F.col(status).isNull() | ~F.col(status).isin(*without)) if status and without else kept


def latest_n(df: DataFrame, time: str, n: int, not_after: Column, tie: str) -> DataFrame:
    """The n newest rows that aren't of the future."""
    return df.filter(F.col(time) <= not_after).orderBy(F.desc(time), tie).limit(n)


def last_wins(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """old with rows of new put in by key; of one key the highest version stays, new before old among equals."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "__new")


def upsert_doc(old: DataFrame, new: DataFrame, key: str, sets: list[str], now: Column) -> DataFrame:
    """first_seen_at from the first write on, last_ingested_at of the last, set-valued columns united and sorted."""
    o, n = old.select(*(F.col(c).alias(f"o_{c}") for c in old.columns)), new
    both = o.join(n, F.col(f"o_{key}") == F.col(key), "full")
    values = [F.coalesce(key, f"o_{key}").alias(key)]
    for c in new.columns:
        if c != key:
            mine, past = F.col(c), F.col(f"o_{c}") if c in old.columns else F.lit(None)
            values.append((F.array_sort(F.array_union(F.coalesce(past, F.array()), F.coalesce(mine, F.array()))) if c in sets else F.coalesce(mine, past)).alias(c))
    seen = F.coalesce(F.col("o_first_seen_at") if "first_seen_at" in old.columns else F.lit(None).cast("timestamp"), now).alias("first_seen_at")
    last = F.when(F.col(key).isNotNull(), now).otherwise(F.col("o_last_ingested_at") if "last_ingested_at" in old.columns else F.lit(None).cast("timestamp")).alias("last_ingested_at")
    return both.select(*values, seen, last)


def archive_missing(current: DataFrame, pulled: DataFrame, key: str, complete: bool, window: Column | None = None, reason: str = "missing_from_pull") -> DataFrame:
    """current with archived and archived_reason: rows inside the window (null: all) that a complete pull no longer has. An incomplete pull archives nothing."""
    if not complete:
        return current.withColumn("archived", F.lit(False)).withColumn("archived_reason", F.lit(None).cast("string"))
    here = pulled.select(F.col(key).alias("__key")).distinct().withColumn("__here", F.lit(True))
    inside = F.lit(True) if window is None else F.coalesce(window, F.lit(False))
    out = current.join(here, F.col(key) == F.col("__key"), "left").withColumn("archived", F.col("__here").isNull() & inside)
    return out.withColumn("archived_reason", F.when(F.col("archived"), reason)).drop("__key", "__here")


def of_path(spark: SparkSession, path: str):
    """A path and its file system, as Spark sees them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = of_path(spark, path)
    return files.exists(place)


def claimed(spark: SparkSession, path: str, owner: str) -> str:
    """Who holds the claim of a path: owner, if it was free. The file is created without overwriting, which only one of several callers can do."""
    place, files = of_path(spark, path)
    if not files.exists(place):
        try:
            out = files.create(place, False)
            out.write(owner.encode())
            out.close()
        except Py4JJavaError:  # another one was first
            if not files.exists(place):
                raise
    lines = spark.read.text(path).collect()  # one line
    return lines[0][0] if lines else ""


def upsert_batch(table: str, key: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts a batch into a table partitioned by date: the partitions of the batch are rewritten, last wins. The merge
    is staged first, so that a batch that is run again finds what it needs."""

    def batch(new: DataFrame, batch_id: int) -> None:
        spark = new.sparkSession
        days = [r["date"] for r in new.select("date").distinct().collect()]  # a day each
        old = spark.read.parquet(table) if exists(spark, table) else new.limit(0)
        merged = last_wins(old.filter(F.col("date").isin(*days)), new, key, version)
        staged = f"{table}-batch-{batch_id}"
        merged.write.mode("overwrite").parquet(staged)
        spark.read.schema(merged.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(table)
        place, files = of_path(spark, staged)
        files.delete(place, True)

    return batch


def quarantine(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with their list of errors."""
    marked = df.withColumn("errors", errors)
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def publish(df: DataFrame, table: str, runs: str, run_id: str) -> None:
    """Replaces the partition of a run, then writes its ready marker; readers keep to runs with a marker."""
    spark = df.sparkSession
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(table)
    spark.createDataFrame([(run_id,)], "run_id string").write.mode("append").parquet(runs)


def read_published(spark: SparkSession, table: str, runs: str) -> DataFrame:
    return spark.read.parquet(table).join(spark.read.parquet(runs).distinct(), "run_id", "left_semi")
