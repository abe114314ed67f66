"""Readers and writers of tables and pages in files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = "struct<text: string, surfaceLinks: array<struct<offset: int, endOffset: int, surface: string, linkType: string, target: struct<href: string, title: string, url: string>>>>"
JSONL = f"_id string, pgId string, tableId int, pgTitle string, sectionTitle string, tableCaption string, aboutURI string, numCols int, numDataRows int, numHeaderRows int, tableHeaders array<array<{CELL}>>, tableData array<array<{CELL}>>"


def read_jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    """Tables from JSON lines (files, globs, folders) with an explicit schema; lines that are no JSON or have no ``tableData`` are left out."""
    df = spark.read.schema(JSONL + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(list(paths))
    return from_legacy(df.filter("tableData IS NOT NULL"))


def from_legacy(df: DataFrame) -> DataFrame:
    """The JSON form to ``tables``: texts of cells by row; links of body cells apart."""
    texts = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)), lambda r: F.transform(r, lambda x: F.coalesce(x["text"], F.lit(""))))
    links = F.flatten(F.transform("tableData", lambda r, ri: F.flatten(F.transform(r, lambda x, ci: F.transform(F.coalesce(x["surfaceLinks"], F.array().cast("array<struct<offset: int, endOffset: int, surface: string, linkType: string, target: struct<href: string, title: string, url: string>>>")), lambda k: F.struct(ri.alias("ri"), ci.alias("ci"), k["offset"].alias("start"), k["endOffset"].alias("end"), F.coalesce(k["target"]["url"], k["target"]["href"]).alias("href")))))))
    out = df.select(F.coalesce("_id", F.concat_ws("#", "pgId", F.col("tableId").cast("string"))).alias("table_id"), F.col("pgTitle").alias("pg_title"), F.col("sectionTitle").alias("section_title"), F.col("tableCaption").alias("caption"), F.col("aboutURI").alias("about_uri"), texts("tableHeaders").alias("head"), texts("tableData").alias("body"), links.alias("links"))
    return out.withColumn("num_cols", F.coalesce(F.array_max(F.transform("body", lambda r: F.size(r))), F.lit(0))).withColumn("num_rows", F.size("body"))


def write_jsonl(tables: DataFrame, path: str) -> DataFrame:
    """Writes tables as JSON lines and returns what was written, read back (so later steps don't compute it again)."""
    cell = lambda c: F.transform(c, lambda r: F.transform(r, lambda t: F.struct(t.alias("text"))))
    has = lambda c, out: (F.col(c) if c in tables.columns else F.lit(None).cast("string")).alias(out)
    tables.select(F.col("table_id").alias("_id"), has("pg_title", "pgTitle"), has("section_title", "sectionTitle"), has("caption", "tableCaption"), has("about_uri", "aboutURI"), cell("head").alias("tableHeaders"), cell("body").alias("tableData")).write.mode("overwrite").json(path)
    return read_jsonl(tables.sparkSession, path)


def read_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Each CSV file as one table without header, named by its file; rows may be ragged, fields may hold line breaks."""

    def run(batches):
        import csv
        import io

        for batch in batches:
            ids, bodies = [], []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                ids.append(path.rsplit("/", 1)[-1].removesuffix(".csv"))
                bodies.append(list(csv.reader(io.StringIO(raw.decode("utf-8-sig", "replace"), newline=""))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(bodies, pa.list_(pa.list_(pa.string())))], names=["table_id", "body"])

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    out = files.mapInArrow(run, "table_id string, body array<array<string>>")
    return out.withColumn("head", F.array().cast("array<array<string>>")).withColumn("num_cols", F.coalesce(F.array_max(F.transform("body", lambda r: F.size(r))), F.lit(0))).withColumn("num_rows", F.size("body"))


def load(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV files if all names end so, else JSON lines."""
    return read_csv(spark, *paths) if paths and all(p.endswith(".csv") for p in paths) else read_jsonl(spark, *paths)


def line_pages(spark: SparkSession, *paths: str, title: str | None = None) -> DataFrame:
    """Pages (url, html, about) from lines of a URL, white space and the page as a JSON string; ``title``: a pattern whose first group in the URL is the page's entity."""
    lines = spark.read.text(list(paths))
    url = F.regexp_extract("value", r"^(\S+)\s", 1)
    html = F.try_variant_get(F.try_parse_json(F.regexp_extract("value", r"^\S+\s+(.*)$", 1)), "$", "string")
    about = F.regexp_extract(url, title, 1) if title else F.lit(None).cast("string")
    return lines.select(url.alias("url"), html.alias("html"), F.nullif(about, F.lit("")).alias("about")).filter("url <> '' AND html IS NOT NULL")


def warc_pages(spark: SparkSession, *paths: str) -> DataFrame:
    """Pages of the response records of (gzipped or plain) WARC files; ``?about=...`` at the end of a URL is the page's entity."""

    def run(batches):
        import gzip

        for batch in batches:
            rows = []
            for raw in batch.column("content").to_pylist():
                data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                at = data.find(b"WARC/")
                while at >= 0:
                    end = data.find(b"\r\n\r\n", at)
                    if end < 0:
                        break
                    fields = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
                    size = int(fields.get("Content-Length", 0))
                    block = data[end + 4 : end + 4 + size]
                    if fields.get("WARC-Type") == "response":
                        rows.append((fields.get("WARC-Target-URI", ""), block.partition(b"\r\n\r\n")[2].decode("utf-8", "replace")))
                    at = data.find(b"WARC/", end + 4 + size)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["target", "html"])

    files = spark.read.format("binaryFile").load(list(paths)).select("content")
    out = files.mapInArrow(run, "target string, html string")
    about = F.nullif(F.regexp_extract("target", r"[?]about=(.*)$", 1), F.lit(""))
    return out.select(F.regexp_replace("target", r"[?]about=.*$", "").alias("url"), "html", about.alias("about"))


def read_wdc(spark: SparkSession, *paths: str) -> DataFrame:
    """Column-major JSON tables (``relation``) with the header in the first row; others are left out."""
    inner = "relation array<array<string>>, headerPosition string, url string, pageTitle string, title string, tableNum int"
    raw = spark.read.schema(f"{inner}, table struct<{inner.replace(' array', ': array').replace(' string', ': string').replace(' int', ': int')}>").json(list(paths))
    pick = lambda c: F.coalesce(F.col(c), F.col(f"table.{c}")).alias(c)
    df = raw.select(*[pick(c) for c in ("relation", "headerPosition", "url", "pageTitle", "title", "tableNum")]).filter("headerPosition = 'FIRST_ROW' AND size(relation) > 0")
    rows = F.transform(F.sequence(F.lit(0), F.array_max(F.transform("relation", lambda c: F.size(c))) - 1), lambda i: F.transform("relation", lambda c: F.coalesce(F.get(c, i), F.lit(""))))
    df = df.withColumn("rows", rows)
    return df.select(
        F.concat_ws("#", "url", F.coalesce("tableNum", F.lit(0)).cast("string")).alias("table_id"), F.col("pageTitle").alias("pg_title"), F.col("title").alias("caption"), F.slice("rows", 1, 1).alias("head"),
        F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))).alias("body"), F.size("relation").alias("num_cols"), (F.size("rows") - 1).alias("num_rows"), F.parse_url("url", F.lit("HOST")).alias("domain"),
    )


def to_wdc(tables: DataFrame) -> DataFrame:
    """(table_id, json): tables in the column-major form."""
    rows = F.concat("head", "body")
    relation = F.transform(F.sequence(F.lit(0), F.col("num_cols") - 1), lambda i: F.transform(rows, lambda r: F.coalesce(F.get(r, i), F.lit(""))))
    return tables.filter("num_cols > 0").select("table_id", F.to_json(F.struct(relation.alias("relation"), F.lit("FIRST_ROW").alias("headerPosition"), F.lit(True).alias("hasHeader"))).alias("json"))


def write_submission(best: DataFrame, path: str) -> None:
    """Targets with their predictions as quoted CSV without header; targets without one are left out."""
    best.filter("uri IS NOT NULL").write.mode("overwrite").option("quoteAll", True).csv(path)


def preview(tables: DataFrame, n_tables: int = 5, n_rows: int = 5, n_chars: int = 40) -> str:
    """The first tables by id as HTML, cut to a few rows and characters: a bounded look from the driver."""
    import html

    out = []
    for t in tables.orderBy("table_id").limit(n_tables).collect():
        row = lambda r, tag: "<tr>" + "".join(f"<{tag}>{html.escape((c or '')[:n_chars])}</{tag}>" for c in r) + "</tr>"
        out.append(f"<h3>{html.escape(t['table_id'])}</h3><table>" + "".join(row(r, "th") for r in t["head"]) + "".join(row(r, "td") for r in t["body"][:n_rows]) + "</table>")
    return "\n".join(out)


def save(df: DataFrame, path: str) -> DataFrame:
    """Any relation of a step (annotations, signatures of a matcher) as Parquet, read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
