"""The three tool functions for assistants: read files compressed, compress a folder, report the session.

serve() offers them over the protocol library where that is installed.
"""

import os
import time
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from laconic.config import TOOL_SETTINGS
from laconic.plans.compression import compress
from laconic.plans.session import EVENT, summary
from laconic.sources import load_files, with_extensions

PREAMBLE = "Codes like [D1] stand for the patterns listed under [CODEBOOK]; [same as f:a-b] and [delta from f] refer to other files below."


class Session:
    """Compressions of one session, and the functions that add to them."""

    def __init__(self, spark: SparkSession, settings=TOOL_SETTINGS):
        self.spark, self.settings, self.events = spark, settings, []

    def _run(self, files, target: str | None, shorten: bool, stages: bool) -> str:
        home = os.path.expanduser("~")
        done = compress(files, replace(self.settings, target_files=(target,) if target else ()))
        rows, stats = done.files.orderBy("filename").collect(), done.stats.collect()
        before, after = sum(s["original_chars"] for s in stats), sum(s["compressed_chars"] for s in stats)
        tokens = [sum(s[c] or 0 for s in stats) for c in ("original_tokens", "compressed_tokens")]
        self.events.append((time.time(), [r["filename"] for r in rows], *tokens, before, after))
        show = lambda n: "~" + n[len(home) :] if shorten and n.startswith(home) else n
        parts = [PREAMBLE]
        for r in rows:
            parts += [f"--- {show(r['filename'])} ---", r["compressed"] or ""]
        pct = 100 * (1 - after / before) if before else 0.0
        by_stage = {k: sum(s["stage_savings"][k] for s in stats) for k in (stats[0]["stage_savings"] if stats else {})}
        more = "".join(f" | {k}: {v:,}" for k, v in by_stage.items() if v > 0) if stages else ""
        counted = f" | {tokens[0]:,} -> {tokens[1]:,} tokens" if tokens[0] else ""
        parts.append(f"\n[{len(rows)} files | {before:,} -> {after:,} chars, {pct:.0f}% saved{counted}{more}]")
        return "\n".join(parts)

    def read_compressed(self, paths: list[str], target: str | None = None) -> str:
        """Files and folders, compressed together in the order given; target stays as it is.

        What isn't there or can't be read has a line that says so in place of its text.
        """
        named = [os.path.abspath(os.path.expanduser(p)) for p in paths]
        files = load_files(self.spark, *named)
        whole = F.col("corpus_id").isin(*(p for p in named if not os.path.isdir(p)))
        full = F.when(whole, F.col("corpus_id")).otherwise(F.concat("corpus_id", F.lit("/"), "filename"))
        order = F.shiftleft(F.array_position(F.array(*map(F.lit, named)), F.col("corpus_id")).cast("long"), 48) + F.col("file_idx")
        said = F.when(F.col("status") == "missing", F.concat(F.lit("[not found: "), full, F.lit("]"))).otherwise(F.concat(F.lit("["), F.col("status"), F.lit("]")))
        text = F.when(F.col("status") == "read", F.col("content")).otherwise(said)
        rows = files.select(F.lit("paths").alias("corpus_id"), order.alias("file_idx"), full.alias("filename"), text.alias("content"))
        return self._run(rows, os.path.abspath(os.path.expanduser(target)) if target else None, True, False)

    def compress_context(self, folder: str, extensions: list[str] | None = None, target: str | None = None) -> str:
        """A folder's files with the given suffixes."""
        folder = os.path.abspath(os.path.expanduser(folder))
        if not os.path.isdir(folder):
            return f"[not a folder: {folder}]"
        return self._run(with_extensions(load_files(self.spark, folder).filter("status = 'read'"), extensions or []), target, False, True)

    def session_savings(self) -> str:
        from datetime import datetime, timezone

        rows = [(datetime.fromtimestamp(t, timezone.utc), *x) for t, *x in self.events]
        return summary(self.spark.createDataFrame(rows, EVENT))


def serve(spark: SparkSession) -> None:
    """Serve the functions over stdio; needs the optional protocol library."""
    from mcp.server.fastmcp import FastMCP

    server, own = FastMCP("laconic"), Session(spark)
    for tool in (own.read_compressed, own.compress_context, own.session_savings):
        server.tool()(tool)
    server.run()
