"""Sources and sinks of file trees."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from laconic.functions.languages import SECRET_NAMES, SKIPPED_FOLDERS, SUFFIXES

#: Bytes of a file that is read, at most, and tasks that list and read a path, about.
MOST_BYTES, TASKS = 1_000_000, 256

SCHEMA = "corpus_id string, file_idx long, filename string, size long, status string, content string"


def admits(relative: str, size: int, most: int = MOST_BYTES) -> bool:
    """Whether a file under a root is read: suffix, secret names, hidden and vendor folders, size."""
    *folders, name = relative.split("/")
    suffix = os.path.splitext(name)[1].lower()
    hidden = any(p.startswith(".") or p in SKIPPED_FOLDERS for p in [*folders, name])
    return suffix in SUFFIXES and name not in SECRET_NAMES and not hidden and size <= most


class _Files(InputPartition):
    """Entries (corpus, rank, relative name, whether a folder) that a task lists and reads."""

    def __init__(self, entries):
        self.entries = entries


def _entries(folder: str, relative: str) -> list[tuple[str, bool]]:
    """(relative name, whether a folder) of what a folder holds, by name; hidden and vendor folders are left out."""
    try:
        with os.scandir(folder) as found:
            names = sorted((e.name, e.is_dir()) for e in found)
    except OSError:
        return [(relative, False)] if relative else []  # told as unreadable
    join = lambda n: f"{relative}/{n}" if relative else n
    return [(join(n), d) for n, d in names if not (d and (n.startswith(".") or n in SKIPPED_FOLDERS))]


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.paths = list(dict.fromkeys(p for p in options.get("paths", options.get("path", "")).split("\n") if p))
        self.targets = set(filter(None, options.get("exclude", "").split("\n")))
        self.most = int(options.get("mostBytes", MOST_BYTES))

    def partitions(self):
        parts = []
        for path in self.paths:
            entries = [("", True)] if os.path.isdir(path) else [("", False)]
            while len(entries) < TASKS and any(d for _, d in entries):
                entries = [x for r, d in entries for x in (_entries(os.path.join(path, r) if r else path, r) if d else [(r, d)])]
            ranked = [(path, k, r, d) for k, (r, d) in enumerate(entries)]
            step = max(1, -(-len(ranked) // TASKS))
            parts += [_Files(ranked[k : k + step]) for k in range(0, len(ranked), step)]
        return parts or [_Files([])]

    def read(self, partition):
        for corpus, rank, relative, is_folder in partition.entries:
            k, waiting = 0, [(relative, is_folder)]
            while waiting:
                name, folder = waiting.pop()
                full = os.path.join(corpus, name) if name else corpus
                if folder:
                    waiting += reversed(_entries(full, name))
                    continue
                row = self._row(corpus, name, full)
                if row is not None:
                    yield corpus, rank << 32 | k, *row
                    k += 1

    def _row(self, corpus: str, name: str, full: str):
        shown = name or os.path.basename(corpus)
        try:
            if not name and not os.path.exists(full):
                return corpus, 0, "missing", None
            size = os.path.getsize(full)
            if not admits(shown, size, self.most) or shown in self.targets:
                return None
            with open(full, "rb") as f:
                text = f.read().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
        except OSError as error:
            return shown, 0, f"unreadable: {error.strerror}", None
        return shown, size, "read", text


class TreeSource(DataSource):
    """spark.read.format("srctree"): option paths, one root or file a line; exclude, one name a line; mostBytes.

    Names that begin with _ are listed too, unlike in Spark's own file sources. A path that isn't
    there is a row with status missing; a file or folder that can't be read has status unreadable and
    the reason. The driver lists folders only until there are entries for TASKS tasks; these list
    the rest. file_idx ascends with the names, folder by folder, and may leave numbers out.
    """

    @classmethod
    def name(cls):
        return "srctree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _TreeReader(self.options)


def load_files(spark: SparkSession, *paths: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows of SCHEMA for files under the paths; each path is a corpus."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("srctree").option("paths", "\n".join(paths)).option("exclude", "\n".join(exclude)).load()


def with_extensions(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """Files whose name ends with one of the suffixes, by case."""
    return files.filter(F.exists(F.array(*map(F.lit, suffixes)), lambda s: F.endswith("filename", s))) if suffixes else files


def in_memory(spark: SparkSession, files: dict[str, str], corpus_id: str = "memory") -> DataFrame:
    """A corpus from a dict, in its order."""
    rows = [(corpus_id, k, name, text) for k, (name, text) in enumerate(files.items())]
    return spark.createDataFrame(rows, "corpus_id string, file_idx long, filename string, content string")


def joined_parts(files: DataFrame, content: str = "compressed") -> DataFrame:
    """Rows (corpus_id, filename, part): the concatenated text of a corpus in parts, to be joined by newlines in
    the order of names. A file has a header line unless it is alone."""
    alone = files.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("corpus_id", F.lit(True).alias("_alone"))
    head = F.when(F.col("_alone"), F.lit("")).otherwise(F.concat(F.lit("--- "), F.col("filename"), F.lit(" ---\n")))
    return files.join(alone, "corpus_id", "left").select("corpus_id", "filename", F.concat(head, F.col(content)).alias("part"))


def write_joined(files: DataFrame, path: str, content: str = "compressed") -> None:
    """Writes the parts in order as text, a folder a corpus; its files, in order of name, are the concatenation."""
    parts = joined_parts(files, content).repartitionByRange("corpus_id", "filename").sortWithinPartitions("corpus_id", "filename")
    parts.select("corpus_id", F.col("part").alias("value")).write.partitionBy("corpus_id").text(path)


def joined_text(files: DataFrame, content: str = "compressed") -> DataFrame:
    """Rows (corpus_id, text): joined_parts() as one value, for a corpus that is one prompt."""
    named = F.array_sort(F.collect_list(F.struct("filename", "part")))
    return joined_parts(files, content).groupBy("corpus_id").agg(F.array_join(F.transform(named, lambda f: f["part"]), "\n").alias("text"))
