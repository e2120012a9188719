"""Landed tables: media information, note contents and fetched blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text_basics import present

MEDIA_ANSWER = """media_type INT, url_info STRUCT<url STRING, headers MAP<STRING, STRING>>,
    notebook_ext_info STRUCT<notebook_id STRING>, update_time STRING, create_time STRING, title STRING"""


def media_info(answers: DataFrame) -> DataFrame:
    """Flat media information from landed answers (media_id, payload)."""
    data = F.from_json("payload", f"data STRUCT<{_struct(MEDIA_ANSWER)}>")["data"]
    parsed = answers.select("media_id", data.alias("info")).where(F.col("info").isNotNull())
    return parsed.select(
        "media_id",
        F.col("info.media_type").alias("media_type"),
        F.col("info.notebook_ext_info.notebook_id").alias("notebook_id"),
        F.col("info.url_info.url").alias("url"),
        F.col("info.url_info.headers").alias("headers"),
        F.col("info.update_time").alias("update_time"),
    )


def _struct(columns: str) -> str:
    import pyspark.sql.types as T

    return T.StructType.fromDDL(columns).simpleString()[len("struct<") : -1]


def export_url(payload: Column | str, primary: Column | str | None = None) -> Column:
    """Alternative download address of an answer, else the primary one."""
    found = present(F.get_json_object(payload, "$.data.media_content_url_info.url"))
    return found if primary is None else F.coalesce(found, F.col(primary) if isinstance(primary, str) else primary)


def note_contents(answers: DataFrame) -> DataFrame:
    """Note bodies; an answer without content is an empty body."""
    return answers.select("doc_id", F.coalesce("content", F.lit("")).alias("content"))


def binary_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a landing folder as ``path, length, body``; bytes are only read when used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.col("content").alias("body"))


def export_documents(documents: DataFrame, folder: str, shards: int) -> None:
    """Documents as a parquet dataset spread by path."""
    documents.repartition(shards, "path").write.mode("errorifexists").parquet(folder)
