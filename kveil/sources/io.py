"""Readers and writers. Schemas are given, never inferred."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kveil.functions.fields import SECURITY_EVENTS
from kveil.sources import schemas


class Lanes(NamedTuple):
    """Records that could be read, and the lines that could not with the reason why."""

    good: DataFrame
    rejected: DataFrame


EMPTY, TOO_LONG, BROKEN, NO_OBJECT, BAD_FIELD, INCOMPLETE = "empty", "too_long", "broken", "no_object", "bad_field", "incomplete"
# What the line-wise form of a request must hold to count as one.
REQUIRED = ("ts",)
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_corrupt_record"}


def judge_lines(
    lines: DataFrame, schema: str, required: tuple[str, ...] = REQUIRED, value: str = "value", max_bytes: int | None = None
) -> DataFrame:
    """Add ``rec``, the record of a text line, and ``reason``, null if the line is exactly one whole JSON object of ``schema``.

    A line may be empty, longer than ``max_bytes``, no JSON (also a cut line, or two
    objects on one line), JSON but no object, an object with a field of another type, or
    one that lacks a required field. It is never half read: with a reason there is no record.
    """
    line = F.btrim(F.col(value).cast("string"), F.lit(" \t\r\n"))
    # As the only item of a list a line must be whole: nothing may follow the first object.
    items = F.json_array_length(F.concat(F.lit("["), line, F.lit("]")))
    parsed = F.from_json(line, f"{schema}, _corrupt_record STRING", STRICT)
    is_object = line.startswith("{")
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col("_parsed")[name].isNull()
    reason = (
        F.when(F.coalesce(line, F.lit("")) == "", EMPTY)
        .when(F.octet_length(line) > max_bytes if max_bytes else F.lit(False), TOO_LONG)
        .when(F.coalesce(items, F.lit(0)) != 1, BROKEN)
        .when(~is_object, NO_OBJECT)
        .when(F.col("_parsed").isNull() | F.col("_parsed._corrupt_record").isNotNull(), F.when(F.try_parse_json(line).isNull(), BROKEN).otherwise(BAD_FIELD))
        .when(missing, INCOMPLETE)
    )
    judged = lines.withColumn("_parsed", parsed).withColumn("reason", reason)
    return judged.withColumn("rec", F.when(F.col("reason").isNull(), F.col("_parsed").dropFields("_corrupt_record"))).drop("_parsed")


def split_lines(
    lines: DataFrame, schema: str, required: tuple[str, ...] = REQUIRED, value: str = "value", max_bytes: int | None = None
) -> Lanes:
    """The records of text lines, and the rejected lines with their reason; other columns stay with the rejected lines."""
    judged = judge_lines(lines, schema, required, value, max_bytes)
    return Lanes(judged.where("reason IS NULL").select("rec.*"), judged.where("reason IS NOT NULL").drop("rec"))


def rejected_counts(rejected: DataFrame, value: str = "value") -> DataFrame:
    """Lines and bytes by reason."""
    return rejected.groupBy("reason").agg(
        F.count("*").alias("lines"), F.coalesce(F.sum(F.octet_length(F.col(value).cast("string"))), F.lit(0)).alias("bytes")
    )


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def beacon_lanes(spark: SparkSession, path: str, max_bytes: int | None = None) -> Lanes:
    """Beacon log as JSON lines, one beacon per line; what is no beacon is set aside."""
    return split_lines(_file_lines(spark, path), schemas.BEACON, max_bytes=max_bytes)


def read_beacons(spark: SparkSession, path: str) -> DataFrame:
    """The beacons of a log; ``beacon_lanes`` also has the lines that are none."""
    return beacon_lanes(spark, path).good


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def stream_beacons(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The beacons of a growing log; ``jobs.lane_stream`` also keeps and counts the other lines."""
    return split_lines(stream_lines(spark, path, files_per_trigger), schemas.BEACON).good


def parse_beacon_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Beacons out of a message column, such as the value of a Kafka source."""
    return split_lines(messages, schemas.BEACON, value=value).good


def request_lanes(spark: SparkSession, path: str) -> Lanes:
    return split_lines(_file_lines(spark, path), schemas.TRACKER_REQUEST)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Tracker-request log as JSON lines."""
    return request_lanes(spark, path).good


def page_request_lanes(spark: SparkSession, path: str) -> Lanes:
    return split_lines(_file_lines(spark, path), schemas.PAGE_REQUEST, required=("page_host", "url"))


def read_page_requests(spark: SparkSession, path: str) -> DataFrame:
    return page_request_lanes(spark, path).good


def read_dimension(spark: SparkSession, name: str, path: str | None = None, **jdbc: str) -> DataFrame:
    """Account table from parquet, or over JDBC with filters and columns pushed down."""
    if path:
        return spark.read.parquet(path)
    return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()


def parse_json_list(df: DataFrame, value: str, schema: str = schemas.FEED_EVENT) -> DataFrame:
    """Records of a JSON text column; rows that are no JSON object are dropped."""
    is_object = F.try_parse_json(F.col(value)).isNotNull() & F.ltrim(F.col(value)).startswith("{")
    parsed = F.when(is_object, F.from_json(F.col(value), schema))
    others = [c for c in df.columns if c != value]
    return df.select(*others, parsed.alias("rec")).where("rec IS NOT NULL").select(*others, "rec.*")


def write_by_day(df: DataFrame, path: str, day: str = "day") -> None:
    """Overwrite only the days (or the values of another partition column) that ``df`` holds."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(day).parquet(path)
    )


def append_security_events(events: DataFrame, path: str) -> None:
    select_security_events(events).write.mode("append").parquet(path)


def select_security_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(SECURITY_EVENTS))


def write_clean_requests(requests: DataFrame, path: str) -> None:
    """Hand anonymised requests to a downstream forwarder as files."""
    requests.write.mode("append").parquet(path)
