"""Tables from a stream of pages, and counts of headers as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtable.functions import text as T
from loomtable.sources import html as H


def pages(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON lines with url, html and ts (event time)."""
    return spark.readStream.schema("url string, html string, ts timestamp").json(path)


def tables(stream: DataFrame, restrict: list[str] | None = None) -> DataFrame:
    """Tables of the stream's pages: stateless, so no watermark is needed."""
    return H.tables(stream, restrict)


def header_counts(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tables per header and window of event time; state of windows older than the watermark is dropped."""
    header = F.regexp_extract_all("html", F.lit("<th[^>]*>([^<]*)</th>"), F.lit(1))
    df = stream.withWatermark("ts", late).select("ts", T.header_id(header).alias("header_id"), F.array_join(header, "|").alias("header"))
    return df.groupBy(F.window("ts", window), "header_id").agg(F.count("*").alias("n"), F.min("header").alias("header"))
