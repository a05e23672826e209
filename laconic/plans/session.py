"""Session events of compressions: totals, running totals and lines of a summary, in batch or stream.

An event is (ts, files, original_tokens, compressed_tokens, original_chars, compressed_chars).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laconic.plans.compression import savings_pct

EVENT = "ts timestamp, files array<string>, original_tokens bigint, compressed_tokens bigint, original_chars bigint, compressed_chars bigint"
_SUMS = ("original_tokens", "compressed_tokens", "original_chars", "compressed_chars")


def record(events: DataFrame, path: str) -> None:
    """Append events to a table."""
    events.write.mode("append").parquet(path)


def totals(events: DataFrame, *by: str) -> DataFrame:
    """Sums, saved tokens and per cent, and the number of events; of a stream too."""
    sums = events.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in _SUMS))
    return sums.withColumn("saved_tokens", F.col("original_tokens") - F.col("compressed_tokens")).withColumn("saved_pct", savings_pct(F.col("original_tokens"), F.col("compressed_tokens")))


def running(events: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Adds event_no and the sums so far, for each session in by."""
    past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = events.withColumn("event_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    for c in _SUMS[:2]:
        out = out.withColumn(f"running_{c}", F.sum(c).over(past))
    return out


def files_shown(files: Column) -> Column:
    """The first three names and how many more there are."""
    more = F.size(files) - 3
    return F.concat(F.array_join(F.slice(files, 1, 3), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def event_lines(numbered: DataFrame) -> DataFrame:
    """Adds line: what the summary says of each event."""
    pct = F.round(F.coalesce(savings_pct(F.col("original_tokens"), F.col("compressed_tokens")), F.lit(0.0))).cast("int")
    return numbered.withColumn("line", F.concat(F.lit("  #"), F.col("event_no"), F.lit(": "), files_shown(F.col("files")), F.lit(" | "), F.col("original_tokens"), F.lit(" -> "), F.col("compressed_tokens"), F.lit(" tokens ("), pct, F.lit("% saved)")))


def summary(events: DataFrame) -> str:
    """The session's report; its length is that of the session."""
    t = totals(events).first()
    if not t or not t["events"]:
        return "Nothing was compressed in this session."
    head = f"Session: {t['events']} compressions, {t['original_tokens']:,} -> {t['compressed_tokens']:,} tokens ({t['original_chars']:,} -> {t['compressed_chars']:,} chars), {t['saved_tokens']:,} saved ({t['saved_pct']:.1f}%)"
    numbered = running(events.withColumn("_s", F.lit(1)), ("_s",), ("ts",))
    return "\n".join([head, *(r["line"] for r in event_lines(numbered).orderBy("event_no").toLocalIterator())])
