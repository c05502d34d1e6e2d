"""Resumable batches: files are a stream, progress lives in the stream's checkpoint, writes are idempotent."""

from __future__ import annotations

import shutil
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CROSSREF
from ..sources.files import decoded


def run(spark: SparkSession, path: str, out: str, checkpoint: str, match: Callable[[DataFrame], DataFrame], files_per_batch: int = 100, tei: bool = False) -> int:
    """Match all files not yet done and return how many batches ran; a second call finds nothing to do.

    ``match`` gets (source_file, message) of JSON files, or with ``tei`` (source_file, tei) of XML files as text.
    Each batch overwrites its own folder, so one that is repeated after a failure leaves no double rows.
    """
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.xml" if tei else "*.json").option("maxFilesPerTrigger", files_per_batch).load(path)
    named = raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), decoded(F.col("content")).alias("tei"))
    docs = named if tei else named.select("source_file", F.from_json("tei", CROSSREF).alias("j")).select("source_file", "j.message")
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.append(number)

    q = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(done)


def progress(checkpoint: str) -> dict[str, int]:
    """How many batches a stream's checkpoint has begun and finished."""
    count = lambda what: sum(p.name.isdigit() for p in Path(checkpoint, what).glob("*")) if Path(checkpoint, what).exists() else 0
    return {"begun": count("offsets"), "finished": count("commits")}


def archive(checkpoint: str) -> str | None:
    """Sets a checkpoint aside under a dated name, so that the next run begins anew; None where there is none."""
    at = Path(checkpoint)
    if not at.exists():
        return None
    to = at.with_name(f"{at.name}-{time.strftime('%Y%m%d-%H%M%S')}-{time.time_ns() % 1_000_000}")
    shutil.move(at, to)
    return str(to)
