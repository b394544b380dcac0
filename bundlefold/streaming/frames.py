"""Streaming queries over frames and over arriving archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..sources.container import ContainerSource


def frame_stream(spark: SparkSession, path: str, per_batch: int = 0) -> DataFrame:
    """The frames of a container as they are written: each is given once it is whole. Offsets are frame numbers, so a
    query that starts again goes on where it stopped. A batch is all that have come, or per_batch frames at most."""
    spark.dataSource.register(ContainerSource)
    return spark.readStream.format("container").option("table", "frames").option("framesPerBatch", per_batch).load(path)


def running_totals(frames: DataFrame) -> DataFrame:
    """Frames, raw bytes and encoded bytes so far, by archive: what a trailer is checked against."""
    return frames.groupBy("archive").agg(F.count("*").alias("frames"), F.sum("raw_len").alias("raw_bytes"), F.sum("encoded_len").alias("encoded_bytes"))


def running_trailers(frames: DataFrame) -> DataFrame:
    """Totals so far and the digest of all frames' hashes, by archive: what a trailer holds, for streams and tables. The
    state keeps 16 bytes a frame."""

    @F.udf("string", useArrow=True)
    def digest(hashes):
        return codecs.archive_digest_of([h["frame_hash"] for h in hashes]).hex()

    ordered = F.array_sort(F.collect_list(F.struct("bundle_id", "frame_hash"))).alias("hashes")
    totals = frames.groupBy("archive").agg(F.count("*").alias("frames"), F.sum("raw_len").alias("raw_bytes"), F.sum("encoded_len").alias("encoded_bytes"), ordered)
    return totals.select("archive", "frames", "raw_bytes", "encoded_bytes", digest("hashes").alias("archive_hash_hex"))


def arrivals(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """Files that arrive in a folder: path, length and time."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return stream.select("path", "length", "modificationTime")


def arrival_rate(files: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Files and bytes that arrived in each window of time; what is later than `late` isn't counted."""
    return files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window)).agg(F.count("*").alias("archives"), F.sum("length").alias("bytes"))
