"""The tables of a run as real files of a vault."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.bodies import last_writes
from ..sources.vault_files import KEEP, REPLACE, write_files
from .run import SyncResult


def write_vault(result: SyncResult, root: str) -> None:
    """Documents and originals replace what stands at their path, images that are there stay.

    Originals come in order, so of several for one path the last counts.
    """
    write_files(result.documents.select("path", F.encode("content", "UTF-8").alias("body")), root, REPLACE)
    write_files(result.attachment_files, root, KEEP)
    originals = last_writes(result.original_files.withColumnRenamed("path", "file_path"))
    write_files(originals.withColumnRenamed("file_path", "path"), root, REPLACE)
