"""Streams of files: per-file stages and codes of a fixed codebook as row functions, whole corpora by
micro-batch, and session totals as a streaming aggregation."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from laconic.config import Settings
from laconic.operators.codebook import apply_codebooks
from laconic.plans.compression import compress, per_file_stages
from laconic.plans.session import totals


def stream_stages(files: DataFrame, settings: Settings = Settings(), python: bool = True) -> DataFrame:
    """Stages 1 to 3 of a stream of files: adds s0 to s3, without state."""
    return per_file_stages(files, settings, python)


def stream_codes(files: DataFrame, codebooks: DataFrame, content: str = "s3") -> DataFrame:
    """Applies fixed codebooks to a stream: a stream-static join on corpus_id, without state."""
    return apply_codebooks(files, codebooks, content, "s4")


def compress_batches(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, settings: Settings = Settings()):
    """Compresses each micro-batch as closed corpora and hands its files to sink(files, batch_id)."""
    run = lambda batch, k: sink(compress(batch, settings).files, k)
    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_totals(events: DataFrame, delay: str | None = None, *by: str) -> DataFrame:
    """Session totals of a stream of events; delay, if given, is the watermark on ts."""
    return totals(events.withWatermark("ts", delay) if delay else events, *by)
