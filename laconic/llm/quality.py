"""Operator 3, quality rules: base rules on words, and character n-gram perplexity within bands.

The language model is modified Kneser-Ney over the characters of a text, whose words are joined by
single blanks: n-grams reach over blanks, so the order of words counts. There is a model for each
language and half of the documents, counted by Spark over all documents. The halves are drawn by a
hash of the text, and a document is scored by the model of the other half, so neither it nor a copy of
it speaks for itself. A model is made in one task, as sorted arrays of 64-bit hashes with
log-probability and back-off. Each language has a lower and an upper bound of perplexity, from the
documents known to be good where there are enough of them, else from the quartiles of all; a document
outside is rejected.

A model is a broadcast of its own, read by the tasks that meet its language. It has every n-gram of its
half with its own count, so it grows with the distinct n-grams; the order is fixed. Only a caller of
train() who names a number of buckets gets counts pooled in as many.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laconic.llm.common import table, typed, utf8, written

#: Characters of the longest n-gram; buckets of pooled() unless told otherwise.
ORDER, BUCKETS = 5, 1 << 22
#: Quantiles of good documents that bound a band, and how many there must be.
GOOD, LEAST_GOOD = (0.005, 0.995), 100
#: Interquartile ranges from the quartiles to the band's ends where good documents are too few (the usual fence of far outliers), and the least range.
FENCE, LEAST_RANGE = 3.0, 0.02
#: Base rules: fewest words, and largest share of words in repeated three-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Words whose numbers a worker remembers, bytes of text handled at a time, and n-grams that a task counts before it sends them.
REMEMBERED, STEP_BYTES, SENT = 1_000_000, 4 << 20, 500_000

SYMBOLS = b"#*$%&|<>"
BEGIN, END = "\x02", "\x03"
#: Between a language and its half.
SPLIT = "\x1f"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def spelt(words: list[bytes], order: int) -> str:
    """A text as the model sees it: its words, single blanks, and what comes before and after."""
    return BEGIN * (order - 1) + b" ".join(words).decode("utf-8", "replace") + END


def _steps(batch: pa.RecordBatch):
    """Slices of a batch with about STEP_BYTES of text each, as lists of texts and other columns."""
    data = utf8(batch.column(0))
    first = size = 0
    for k, x in enumerate(data):
        size += len(x)
        if size >= STEP_BYTES or k + 1 == len(data):
            yield data[first : k + 1], batch.slice(first, k + 1 - first)
            first, size = k + 1, 0


def _codes(text: str) -> np.ndarray:
    """Code points of a text, digits alike."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    codes[(codes >= 48) & (codes < 58)] = 48
    return codes


def _hash(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of character codes."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        h = h * _FACTOR + codes[:, k].astype(np.uint64) + np.uint64(1)
    return h


def _distinct(codes: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of spelt texts laid end to end: positions of predicted characters, the number of each one's n-gram,
    and for each number a position where that n-gram ends."""
    starts = np.concatenate([[0], ends[:-1]])
    predicted = np.ones(len(codes), bool)
    predicted[(starts[:, None] + np.arange(order - 1)).ravel()] = False
    at = np.flatnonzero(predicted)
    h = np.zeros(len(at), np.uint64)
    for k in range(order - 1, -1, -1):
        h = h * _FACTOR + codes[at - k]
    number, found = pd.factorize(h)
    where = np.zeros(len(found), np.int64)
    where[number[::-1]] = at[::-1]
    return at, number, where


def _by_key(data: list[list[bytes]], keys: list[str], order: int) -> Iterator[tuple[str, list[int], np.ndarray, np.ndarray]]:
    """For each key: which texts have it, and their spelt texts' codes and ends."""
    groups: dict[str, list[int]] = {}
    for k, key in enumerate(keys):
        groups.setdefault(key, []).append(k)
    for key, own in groups.items():
        forms = [spelt(data[k], order) for k in own]
        yield key, own, _codes("".join(forms)), np.cumsum([len(x) for x in forms])


def count_grams(docs: DataFrame, text_col: str, key_col: str, order: int = ORDER) -> DataFrame:
    """Rows (key, gram, n): each character of all texts with the order-1 characters before it."""

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def sums(key: str) -> tuple[np.ndarray, np.ndarray]:
            grams, n = (np.concatenate(x) for x in zip(*held[key]))
            number, _ = pd.factorize(_hash(grams))
            where = np.zeros(int(number.max()) + 1, np.int64)
            where[number] = np.arange(len(number))
            return grams[where], np.bincount(number, n, len(where)).astype(np.int64)

        def sent(key: str):
            grams, n = sums(key)
            text = np.ascontiguousarray(grams, "<u4").tobytes().decode("utf-32-le", "surrogatepass")
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(n), pa.string()), pa.array([text[k : k + order] for k in range(0, len(text), order)], pa.string()), pa.array(n)], names=["key", "gram", "n"])

        for batch in batches:
            for data, part in _steps(batch):
                words = [x.split() for x in data]
                for key, _, codes, ends in _by_key(words, part.column(1).to_pylist(), order):
                    _, number, where = _distinct(codes, ends, order)
                    own = held.setdefault(key, [])
                    own.append((codes[where[:, None] + np.arange(1 - order, 1)], np.bincount(number)))
                    if len(own) > 8:
                        held[key] = [sums(key)]
                        if len(held[key][0][1]) > SENT:
                            yield from sent(key)
                            del held[key]
        for key in held:
            yield from sent(key)

    rows = docs.select(F.col(text_col), F.col(key_col)).mapInArrow(run, "key string, gram string, n long")
    return rows.groupBy("key", "gram").agg(F.sum("n").alias("n"))


def pooled(grams: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (key, gram, n), at most buckets for each key: n-grams of one bucket together, under the most frequent."""
    place = F.pmod(F.xxhash64("gram"), F.lit(buckets))
    most = F.max(F.struct("n", "gram"))
    return grams.groupBy("key", place.alias("_b")).agg(most.alias("_m"), F.sum("n").alias("n")).select("key", "_m.gram", "n")


class KneserNey:
    """One model: for each n, sorted hashes with log-probabilities, and of contexts with back-offs."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        """codes: a row for each n-gram of the longest kind, and how often it occurs."""
        self.order = order = codes.shape[1]
        found = {order: (codes, counts)}
        for n in range(order - 1, 0, -1):
            tails = found[n + 1][0][:, 1:]
            _, at, times = np.unique(_hash(tails), return_index=True, return_counts=True)
            found[n] = tails[at], times
        vocabulary = len(found[1][0]) + 1
        self.unseen = 0.0
        self.hashes, self.logs, self.contexts, self.backoffs = {}, {}, {}, {}
        lower = None
        for n in range(1, order + 1):
            codes, counts = found[n]
            own = _hash(codes)
            times = np.bincount(np.minimum(counts, 4), minlength=5)[1:5].astype(float) if len(counts) else np.zeros(4)
            y = times[0] / max(1.0, times[0] + 2 * times[1])
            cut = [0.0, *(min(k, max(0.1 * k, k - (k + 1) * y * times[k] / max(1.0, times[k - 1]))) for k in (1, 2, 3))]
            cut = np.array(cut)[np.minimum(counts, 3)]
            context, inverse = np.unique(_hash(codes[:, :-1]), return_inverse=True)
            total, freed = np.bincount(inverse, counts, len(context)), np.bincount(inverse, cut, len(context))
            share = freed / np.maximum(total, 1)
            if n == 1:
                base = np.full(len(codes), 1.0 / vocabulary)
                self.unseen = float(np.log(max(share[0] if len(share) else 1.0, 1e-6) / vocabulary))
            else:
                at = np.searchsorted(lower[0], tails := _hash(codes[:, 1:]))
                at = np.minimum(at, max(0, len(lower[0]) - 1))
                base = np.where(lower[0][at] == tails, lower[1][at], 1.0 / vocabulary) if len(lower[0]) else np.full(len(codes), 1.0 / vocabulary)
            p = (counts - cut) / np.maximum(total[inverse], 1) + share[inverse] * base
            sort = np.argsort(own)
            lower = (own[sort], p[sort])
            self.hashes[n], self.logs[n] = own[sort], np.log(np.maximum(p[sort], 1e-12)).astype(np.float32)
            self.contexts[n], self.backoffs[n] = context, np.log(np.maximum(share, 1e-12)).astype(np.float32)

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log-probability of each n-gram's last character after the others; rows of codes, distinct."""
        log, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for n in range(self.order, 0, -1):
            own = grams[open_, self.order - n :]
            before, h, keys = _hash(own[:, :-1]), _hash(own), self.hashes[n]
            at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            hit = keys[at] == h if len(keys) else np.zeros(len(own), bool)
            log[open_[hit]] += self.logs[n][at[hit]]
            open_, before, keys = open_[~hit], before[~hit], self.contexts[n]
            if n > 1:
                at = np.minimum(np.searchsorted(keys, before), max(0, len(keys) - 1))
                known = keys[at] == before if len(keys) else np.zeros(len(before), bool)
                log[open_[known]] += self.backoffs[n][at[known]]
            else:
                log[open_] += self.unseen
        return log


def train(docs: DataFrame, text_col: str, key_col: str, order: int = ORDER, buckets: int | None = None) -> dict[str, Broadcast]:
    """A broadcast model for each key, from all of docs and all their n-grams, pooled only where buckets
    are asked for. The driver holds one model at a time."""

    def run(group: pa.Table) -> pa.Table:
        text = "".join(group.column("gram").to_pylist())
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, order)
        model = KneserNey(codes, group.column("n").to_numpy())
        arrays = [x[n].tobytes() for n in range(1, order + 1) for x in (model.hashes, model.logs, model.contexts, model.backoffs)]
        return pa.table({"key": [group.column("key")[0].as_py()], "unseen": [model.unseen], "arrays": pa.array([arrays], pa.list_(pa.binary()))})

    grams = count_grams(docs, text_col, key_col, order)
    if buckets is not None:
        grams = pooled(grams, buckets)
    rows = grams.groupBy("key").applyInArrow(run, "key string, unseen double, arrays array<binary>")
    models = {}
    for row in rows.toLocalIterator():
        model = KneserNey.__new__(KneserNey)
        kinds = (np.uint64, np.float32, np.uint64, np.float32)
        columns = [{n: np.frombuffer(row["arrays"][4 * (n - 1) + k], t) for n in range(1, order + 1)} for k, t in enumerate(kinds)]
        model.order, model.unseen = order, row["unseen"]
        model.hashes, model.logs, model.contexts, model.backoffs = columns
        models[row["key"]] = docs.sparkSession.sparkContext.broadcast(model)
    return models


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k


def repeated_words(numbers: np.ndarray) -> int:
    """Words in three-word windows that the text has twice or more."""
    if len(numbers) < 4:
        return 0
    x = numbers.astype(np.uint64)
    if numbers.max() < 1 << 21:
        keys = (x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:]
    else:
        pairs = np.unique((x[:-1] << np.uint64(32)) | x[1:], return_inverse=True)[1].astype(np.uint64)
        keys = (pairs[:-1] << np.uint64(32)) | x[2:]
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    often = np.zeros(len(numbers) - 2, bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    hit = np.zeros(len(numbers), bool)
    for k in range(3):
        hit[k : len(often) + k] |= often
    return int(hit.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def halves(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """docs with _own, the language and half that a text is counted in, and _other, those it is scored by."""
    half = F.pmod(F.xxhash64(F.col(text_col)), F.lit(2))
    named = lambda x: F.concat(F.coalesce(F.col(lang_col).cast("string"), F.lit("")), F.lit(SPLIT), x.cast("string"))
    return docs.withColumns({"_own": named(half), "_other": named(1 - half)})


def _model_of(models: dict[str, Broadcast], key: str) -> Broadcast | None:
    """The model of a language's half, or of its other half where no document is in that."""
    lang, _, half = key.rpartition(SPLIT)
    return models.get(key) or models.get(f"{lang}{SPLIT}{1 - int(half)}")


def log_means(words: list[list[bytes]], keys: list[str], models: dict[str, Broadcast], order: int = ORDER) -> list[float | None]:
    """Mean log-probability of the characters of each text; null without words or a model."""
    means: list[float | None] = [None] * len(words)
    for key, own, codes, ends in _by_key(words, keys, order):
        of = _model_of(models, key)
        if of is None:
            continue
        at, number, where = _distinct(codes, ends, order)
        log = of.value.score(codes[where[:, None] + np.arange(1 - order, 1)])
        total = np.concatenate([[0], np.cumsum(log[number])])
        bounds = np.searchsorted(at, np.concatenate([[0], ends]))
        for k, a, b in zip(own, bounds[:-1].tolist(), bounds[1:].tolist()):
            if words[k]:
                means[k] = float((total[b] - total[a]) / (b - a))
    return means


def measure(docs: DataFrame, models: dict[str, Broadcast], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_mean), a row of halves()."""

    def run(batches):
        numbers = _Numbers()
        for batch in batches:
            for data, part in _steps(batch):
                if len(numbers) > REMEMBERED:
                    numbers.clear()
                words, out = [x.split() for x in data], []
                for text, own in zip(data, words):
                    joined = b"".join(own)
                    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
                    repeated = repeated_words(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
                    out.append((len(own), len(joined.decode("utf-8", "replace")), symbols, duplicate_lines(text), repeated))
                columns = list(zip(*out)) if out else [[]] * 5
                means = log_means(words, part.column(3).to_pylist(), models)
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), *(pa.array(x, pa.int64()) for x in columns), pa.array(means, pa.float64())], names=[id_col, "lang", *COUNTS, "log_mean"])

    schema = f"`{id_col}` {typed(docs, id_col)}, lang string, {', '.join(f'{c} long' for c in COUNTS)}, log_mean double"
    return docs.select(text_col, F.col(lang_col).cast("string"), id_col, "_other").mapInArrow(run, schema)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bands(rows: DataFrame, good: DataFrame | None, id_col: str) -> DataFrame:
    """Rows (_lang, _least, _most): each language's bounds of log_mean, of rows that pass the base rules."""
    known = F.lit(False)
    if good is not None:
        rows = rows.join(good.select(F.col(id_col).alias("_good")).distinct(), F.col(id_col) == F.col("_good"), "left")
        known = F.col("_good").isNotNull()
    measured = F.when(known, F.col("log_mean"))
    quartiles, ends = F.percentile_approx("log_mean", [0.25, 0.75], 10_000), F.percentile_approx(measured, list(GOOD), 10_000)
    found = rows.filter("NOT base_failed").groupBy("lang").agg(quartiles.alias("q"), ends.alias("e"), F.count(measured).alias("n"))
    wide = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_RANGE))
    end = lambda k, sign: F.when(F.col("n") >= LEAST_GOOD, F.col("e")[k]).otherwise(F.col("q")[k] + sign * FENCE * wide)
    return found.select(F.col("lang").alias("_lang"), end(0, -1).alias("_least"), end(1, 1).alias("_most"))


def judge(docs: DataFrame, good: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (id, the five counts, base_failed, kept, perplexity, low, high), one for each row of docs.

    good has the ids of documents known to be good, which set the bands. Null and empty texts have no
    words and fail the base rules. A null language is one of its own. Bands come from documents that
    pass the base rules; a language of which none does has no band and its documents stay failed.
    Repeated rows each get a row; other columns are ignored.
    """
    docs = halves(docs.select(*dict.fromkeys((id_col, text_col, lang_col))), text_col, lang_col)
    models = train(docs, text_col, "_own")
    rows = written(measure(docs, models, id_col, text_col, lang_col), "quality")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    within = bands(rows, good, id_col)
    placed = rows.join(within, rows["lang"].eqNullSafe(within["_lang"]), "left")
    inside = F.coalesce(F.col("log_mean").between(F.col("_least"), F.col("_most")), F.lit(False))
    return placed.select(id_col, *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), F.exp(-F.col("log_mean")).alias("perplexity"), F.exp(-F.col("_most")).alias("low"), F.exp(-F.col("_least")).alias("high"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, the five counts, base_failed, kept. Labelled documents of quality 1 set the bands."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return judge(table(spark, sf_dir, "documents"), good).select("doc_id", *COUNTS, "base_failed", "kept")
