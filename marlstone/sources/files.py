"""Reading sources from files and columns: (raw_source, source_format, content, error)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import errors
from marlstone.functions import text as fn

RAW_MARKDOWN, RAW_HTML = "raw:markdown", "raw:html"


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """One row a file. Files of other kinds have an error and no content."""
    rows = spark.read.text(list(paths), wholetext=True).withColumn("raw_source", F.col("_metadata.file_path"))
    kind = fn.file_kind(F.col("raw_source"))
    return rows.select("raw_source", kind["kind"].alias("source_format"), F.when(kind["error"].isNull(), F.col("value")).alias("content"), kind["error"].alias("error"))


def raw_markdown(frame: DataFrame, text: str) -> DataFrame:
    return frame.select(F.lit(RAW_MARKDOWN).alias("raw_source"), F.lit("Markdown").alias("source_format"), F.col(text).alias("content"), F.lit(None).cast("string").alias("error"))


def raw_html(frame: DataFrame, html: str) -> DataFrame:
    return frame.select(F.lit(RAW_HTML).alias("raw_source"), F.lit("Html").alias("source_format"), F.col(html).alias("content"), F.lit(None).cast("string").alias("error"))


def fetched(frame: DataFrame, url: str, content_type: str, body: str, status: str, limit: int) -> DataFrame:
    """Sources of a table of fetched bodies; error pages and bodies above the limit have an error."""
    kind = fn.detect_format(F.col(content_type), fn.url_extension(F.col(url)), F.col(body))
    error = F.when(~F.col(status).between(200, 299), F.concat(F.lit("network error: fetching '"), F.col(url), F.lit("' returned HTTP "), F.col(status))).when(
        F.octet_length(body) > limit, F.concat(F.lit("network error: response from '"), F.col(url), F.lit(f"' exceeded the {limit}-byte limit"))
    )
    return frame.select(F.col(url).alias("raw_source"), kind["kind"].alias("source_format"), F.when(error.isNull(), F.col(body)).alias("content"), error.alias("error"))


def read_one(path: str) -> tuple[str, str]:
    """(content, format) of one file; errors are raised."""
    ext = Path(path).suffix.lower().lstrip(".")
    if ext == "pdf":
        raise errors.NotImplementedFormat(errors.PDF_NOT_IMPLEMENTED)
    if ext not in ("md", "html", "htm"):
        raise errors.InvalidInput(errors.unsupported_extension(ext))
    return Path(path).read_text(encoding="utf-8"), "Markdown" if ext == "md" else "Html"
