"""python -m laconic compress PATH [-o FILE] [--stats] ... | stats PATH"""

import argparse
import contextlib
import sys

from pyspark.sql import SparkSession

from laconic.config import Settings
from laconic.plans.compression import STAGES, compress, summary
from laconic.sources import joined_parts, load_files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="laconic", description="Shorten a tree of sources and texts.")
    parser.add_argument("command", choices=("compress", "stats"))
    parser.add_argument("path")
    parser.add_argument("-o", "--output")
    parser.add_argument("-t", "--target", action="append", default=[], help="a file to keep as it is")
    parser.add_argument("--stats", action="store_true")
    parser.add_argument("--no-codebook", action="store_true")
    parser.add_argument("--no-comments", action="store_true", help="leave comments alone")
    parser.add_argument("--min-pattern-length", type=int, default=30)
    parser.add_argument("--min-pattern-freq", type=int, default=3)
    given = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    settings = Settings(
        target_files=tuple(given.target), include_codebook=not given.no_codebook, min_pattern_length=given.min_pattern_length,
        min_pattern_frequency=given.min_pattern_freq, stages=STAGES[1:] if given.no_comments else STAGES,
    )
    loaded = load_files(spark, given.path)
    for r in loaded.filter("status <> 'read'").select("filename", "status").toLocalIterator():
        print(f"{r['filename']}: {r['status']}", file=sys.stderr)
    files = loaded.filter("status = 'read'")
    if files.isEmpty():
        print(f"nothing to compress in {given.path}", file=sys.stderr)
        return 1
    done = compress(files, settings)
    if given.command == "compress":
        with open(given.output, "w", encoding="utf-8") if given.output else contextlib.nullcontext(sys.stdout) as out:
            for k, r in enumerate(joined_parts(done.files).orderBy("filename").toLocalIterator()):
                out.write("\n" * (k > 0) + r["part"])
            if not given.output:
                out.write("\n")
    if given.stats or given.command == "stats":
        print(summary(done.stats.first()), file=sys.stderr if given.command == "compress" else sys.stdout)
    if given.command == "stats":
        for r in files.selectExpr("filename", "length(content) n").orderBy("filename").toLocalIterator():
            print(f"  {r['filename']}: {r['n']:,} chars")
    return 0


if __name__ == "__main__":
    sys.exit(main())
