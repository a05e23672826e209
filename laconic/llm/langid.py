"""Operator 6, language ID: script ranges narrow candidates, Viterbi labels spans of words.

Training counts letter n-grams of words by language in Spark, over a bounded sample of labelled
rows: about SAMPLE_PER_LANG documents of each language, drawn by a hash of text, copies once. The model has one
row for each n-gram seen in the sample, so its size is bounded by the sample, and is broadcast.
"""

from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laconic.llm.common import crc_mod, table, texts, typed

#: Labelled documents a language that are fitted on, about; letters of the longest n-gram.
SAMPLE_PER_LANG, ORDER = 1500, 4
#: Log-likelihood that a change of language costs; what a word can add for one language over another.
SWITCH, MOST = 12.0, 8.0
#: Share of a language's sample letters that makes a script one of its own.
SCRIPT_SHARE = 0.01
#: Chunks that a worker remembers, about; characters labelled at a time.
REMEMBERED, STEP_CHARS = 300_000, 10_000_000

UNDETERMINED = "und"

SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF),
    ("telugu", 0xC00, 0xC7F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
NAMES = [*dict.fromkeys(x[0] for x in SCRIPTS), "other"]
_FIRST, _LAST = (np.array([x[k] for x in SCRIPTS]) for k in (1, 2))
_NUMBER = np.array([NAMES.index(x[0]) for x in SCRIPTS])
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """Numbers in NAMES of letters' scripts by their ranges."""
    k = np.searchsorted(_FIRST, codes, side="right") - 1
    return np.where((k >= 0) & (codes <= _LAST[k]), _NUMBER[k], len(NAMES) - 1)


def words_of(chunk: str) -> list[str]:
    """The lower-case runs of letters in a chunk."""
    chunk = chunk.lower()
    return [chunk] if chunk.isalpha() else ["".join(g) for letters, g in groupby(chunk, str.isalpha) if letters]


def gram_keys(words: list[str], order: int = ORDER):
    """For each n, the positions of n-grams in the joined words (each in its boundaries) and their keys.

    A position is that of an n-gram's last character. Single letters have their code point as key, and
    boundaries are none. Returns the words' starts as well.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) if words else np.zeros(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    inner = (place > 0) & (place < np.repeat(sizes, sizes) - 1)
    found = {1: (at := np.flatnonzero(inner), codes[at])}
    key = codes
    for n in range(2, order + 1):
        key = key[:-1] * _FACTOR + codes[n - 1 :] if len(key) else key
        at = np.flatnonzero(place >= n - 1)
        found[n] = (at, key[at - n + 1])
    return starts, len(codes), found


def count_grams(labelled: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """Rows (lang, size, key, n) over all of labelled: summed in each task, then by key."""

    def run(batches):
        for batch in batches:
            words: dict[str, Counter] = {}
            for text, lang in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(text.split())
            for lang, chunks in words.items():
                own: Counter = Counter()
                for chunk, n in chunks.items():
                    for word in words_of(chunk):
                        own[word] += n
                starts, size, found = gram_keys(list(own))
                weight = np.repeat(np.fromiter(own.values(), float, len(own)), np.diff(np.append(starts, size)))
                for n, (at, keys) in found.items():
                    unique, inverse = np.unique(keys, return_inverse=True)
                    times = np.bincount(inverse, weight[at], len(unique)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(unique), pa.string()), pa.array(np.full(len(unique), n, np.int32)), pa.array(unique.view(np.int64)), pa.array(times)], names=["lang", "size", "key", "n"])

    return labelled.select(text_col, F.col(label_col).cast("string")).mapInArrow(run, "lang string, size int, key long, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities of n-grams by language, centred over languages; unseen ones say nothing."""

    def __init__(self, counts: pa.Table):
        lang = np.array(counts.column("lang").to_pylist(), object)
        size, key, n = (counts.column(c).to_numpy() for c in ("size", "key", "n"))
        self.langs = sorted(set(lang.tolist()))
        at = np.searchsorted(np.array(self.langs, object), lang) if self.langs else np.zeros(0, np.int64)
        self.keys, self.logs, script = {}, {}, np.zeros((len(NAMES), max(1, len(self.langs))))
        for k in range(1, ORDER + 1):
            own = size == k
            self.keys[k], inverse = np.unique(key[own].astype(np.int64).view(np.uint64), return_inverse=True)
            seen = np.zeros((len(self.keys[k]), max(1, len(self.langs))))
            np.add.at(seen, (inverse, at[own]), n[own])
            if k == 1:
                np.add.at(script, scripts_of(self.keys[1].astype(np.int64)), seen)
            log = np.log((seen + 0.5) / (seen.sum(0, keepdims=True) + 0.5 * len(seen)))
            self.logs[k] = (log - log.mean(1, keepdims=True)).astype(np.float32)
        self.own = script >= np.maximum(1, SCRIPT_SHARE * script.sum(0, keepdims=True))
        self.own[~self.own.any(1)] = True

    def score(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of chunks for each language, at most MOST apart, and their letters."""
        split = [words_of(c) for c in chunks]
        words = [w for ws in split for w in ws]
        many = np.fromiter(map(len, split), np.int64, len(split))
        letters = np.fromiter((sum(map(len, ws)) for ws in split), np.int64, len(split))
        score = np.zeros((len(chunks), max(1, len(self.langs))), np.float32)
        some = np.flatnonzero(many)
        if len(some):
            starts, size, found = gram_keys(words)
            total = np.zeros((size, score.shape[1]), np.float32)
            for n, (at, keys) in found.items():
                known = self.keys[n]
                if n > 1 and len(known):
                    row = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    hit = known[row] == keys
                    total[at[hit]] += self.logs[n][row[hit]]
            first = np.cumsum(many)[some] - many[some]
            sums = np.add.reduceat(total, starts[first], axis=0)
            sums = np.maximum(sums - sums.max(1, keepdims=True), -MOST)
            leading = np.array([ord(words[k][0]) for k in first.tolist()], np.int64)
            sums = np.where(self.own[scripts_of(leading)], sums, -MOST)
            score[some] = sums - sums.mean(1, keepdims=True)
        return score, letters


class _Scores(dict):
    """Numbers of chunks; their scores and letters are rows of arrays, after settle()."""

    def __init__(self, model: Model):
        self.model, self.new = model, []
        self.rows, self.letters = np.zeros((0, max(1, len(model.langs))), np.float32), np.zeros(0, np.int64)

    def __missing__(self, chunk):
        self.new.append(chunk)
        k = self[chunk] = len(self)
        return k

    def settle(self) -> None:
        parts = [self.model.score(self.new[k : k + 20_000]) for k in range(0, len(self.new), 20_000)]
        self.rows = np.concatenate([self.rows, *(p[0] for p in parts)])
        self.letters = np.concatenate([self.letters, *(p[1] for p in parts)])
        self.new = []


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word of many documents at once; a change costs penalty.

    scores has a row for each word; a document is lengths[k] rows from starts[k] on.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    state = np.zeros((len(starts), scores.shape[1]), np.float32)
    came = np.zeros(scores.shape, np.int8 if scores.shape[1] < 128 else np.int32)
    own = np.arange(scores.shape[1], dtype=came.dtype)[None, :]
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
    for t, n in enumerate(active.tolist()):
        at, v = starts[:n] + t, state[:n]
        if t:
            best = v.argmax(1)
            changed = v[np.arange(n), best] - penalty
            moves = changed[:, None] > v
            came[at] = np.where(moves, best[:, None], own)
            np.maximum(v, changed[:, None], out=v)
        v += scores[at]
    label = np.zeros(len(scores), came.dtype)
    now = state.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        label[at] = now[:n]
        now[:n] = came[at, now[:n]] if t else now[:n]
    return label


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fits the model on about per_lang documents a language; null labels and texts are left out."""
    labelled = labelled.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, F.col(label_col).cast("string").alias("_lang"))
    sizes = labelled.groupBy("_lang").count()
    draw = F.pmod(F.xxhash64(text_col), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(F.broadcast(sizes), "_lang").filter(draw * F.col("count") < per_lang).select(text_col, "_lang").distinct()
    return Model(count_grams(sample, text_col, "_lang").toArrow())


class Labeller:
    """A worker's use of a model: batches of texts to languages, shares and spans."""

    def __init__(self, model: Model, penalty: float = SWITCH):
        self.model, self.penalty, self.scores = model, penalty, _Scores(model)

    def label(self, batch: list[str]) -> tuple[list[str], np.ndarray, pa.Array]:
        """Languages, shares and spans of texts; by halves where they are over STEP_CHARS together."""
        if len(batch) > 1 and sum(map(len, batch)) > STEP_CHARS:
            halves = [self.label(batch[: len(batch) // 2]), self.label(batch[len(batch) // 2 :])]
            return halves[0][0] + halves[1][0], np.concatenate([h[1] for h in halves]), pa.concat_arrays([h[2] for h in halves])
        if len(self.scores) > REMEMBERED:
            self.scores = _Scores(self.model)
        langs, get = self.model.langs, self.scores.__getitem__
        words = [np.fromiter(map(get, x.split()), np.int32) if langs else np.zeros(0, np.int32) for x in batch]
        lengths = np.array([len(x) for x in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        flat = np.concatenate([*words, np.zeros(0, np.int32)])
        self.scores.settle()
        label = viterbi(self.scores.rows[flat], starts, lengths, self.penalty)
        share = np.zeros((len(words), max(1, len(langs))))
        np.add.at(share, (np.repeat(np.arange(len(words)), lengths), label), self.scores.letters[flat])
        total, best = share.sum(1), share.argmax(1)
        pred = [langs[b] if t else UNDETERMINED for b, t in zip(best.tolist(), total.tolist())]
        fresh = np.ones(len(flat), bool)
        fresh[1:] = label[1:] != label[:-1]
        fresh[starts[lengths > 0]] = True
        first = np.flatnonzero(fresh)
        doc = np.searchsorted(starts + lengths, first, side="right")
        some = total[doc] > 0
        size = np.diff(np.append(first, len(flat)))
        at = np.concatenate([[0], np.cumsum(np.bincount(doc[some], minlength=len(words)))])
        parts = [pa.array((first - starts[doc])[some], pa.int64()), pa.array(size[some], pa.int64()), pa.array([langs[k] for k in label[first][some].tolist()], pa.string())]
        return pred, share.max(1) / np.maximum(1, total), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(parts, names=["first", "words", "lang"]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH) -> DataFrame:
    """Rows (id, lang_pred, score, spans), one for each row of docs.

    spans are (first word, words, language) over blank-separated words; lang_pred has most letters,
    score is its share of letters. Null texts, texts without a letter, and all texts under a model
    without languages are UNDETERMINED with score 0 and no spans. Ties go to the first language by
    name. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = Labeller(shared.value, penalty)
        for batch in batches:
            pred, score, spans = of.label(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), spans], names=[id_col, "lang_pred", "score", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {typed(docs, id_col)}, lang_pred string, score double, spans array<struct<first: long, words: long, lang: string>>")


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the rows whose language is UNDETERMINED or has less than least_score of the letters.

    All columns stay as they are, whatever their names.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        of = Labeller(shared.value)
        for batch in batches:
            pred, score, _ = of.label(texts(batch.column(at)))
            yield batch.filter(pa.array([p != UNDETERMINED and s >= least_score for p, s in zip(pred, score.tolist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, lang_pred, score; learned where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(F.coalesce(crc_mod(F.col("doc_id"), 3) != 1, F.lit(False))))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
