"""Text expressions with the semantics of Python strings: Unicode blanks, lines cut at \\n only."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A blank character, and blanks within a line, under (?U).
BLANK = r"[\s\x1c-\x1f]"
INLINE = r"[\s\x1c-\x1f&&[^\n]]*"


def strip(x: Column) -> Column:
    """Without blanks at both ends."""
    return F.regexp_replace(x, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def rstrip(x: Column) -> Column:
    """Without blanks at the end."""
    return F.regexp_replace(x, rf"(?U){BLANK}+\z", "")


def lines(x: Column) -> Column:
    """Array of lines; an empty text has one empty line."""
    return F.split(x, "\n", -1)


def unlines(x: Column) -> Column:
    return F.array_join(x, "\n")


def quoted(x: str) -> str:
    """A literal inside a Java pattern."""
    return "\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def quoted_column(x: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def any_of(words) -> str:
    """Alternatives of literals for a pattern."""
    return "|".join(map(quoted, words))


def universal_newlines(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def normalized(x: Column) -> Column:
    """The whole text stripped, then every line."""
    return unlines(F.transform(lines(strip(x)), strip))


def block_hash(block: Column) -> Column:
    """md5 of an array of lines without their outer blanks."""
    return F.md5(unlines(F.transform(block, strip)))


def shorten_home(path: Column, home: str) -> Column:
    """A path with the home folder written ~."""
    return F.when(F.startswith(path, F.lit(home)), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 20))).otherwise(path)


def approx_tokens(x: Column) -> Column:
    """Rough number of tokens: runs of letters or digits by fours, and other signs."""
    return F.regexp_count(x, F.lit(r"[\p{L}\p{N}]{1,4}|[^\p{L}\p{N}\s]")).cast("long")


_coders: dict = {}


def _coder(ranks_path: str | None, pattern: str | None):
    """The worker's coder of a ranks file, kept for the batches that follow; None without the library or file."""
    if (ranks_path, pattern) not in _coders:
        try:
            import base64

            import tiktoken

            with open(ranks_path or "", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            found = tiktoken.Encoding("own", pat_str=pattern or r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=ranks, special_tokens={})
        except (ImportError, OSError):
            found = None
        _coders[ranks_path, pattern] = found
    return _coders[ranks_path, pattern]


def count_tokens(ranks_path: str | None, pattern: str | None = None):
    """A function of text to its number of tokens, by a tiktoken ranks file; null without the library or file."""
    import pandas as pd

    @F.pandas_udf("long")
    def count(x: pd.Series) -> pd.Series:
        coder = _coder(ranks_path, pattern)
        if coder is None:
            return pd.Series([None] * len(x), dtype="Int64")
        return x.map(lambda t: None if t is None else len(coder.encode_ordinary(t))).astype("Int64")

    return count
