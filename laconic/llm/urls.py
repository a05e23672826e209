"""Operator 5, URL filter: listed rules first, else the ratio of two character models.

Two variable-order Markov models, of accepted and of rejected URLs, give each character's
probability from up to ORDER characters before it; a shorter context is mixed in by the number of
different characters that followed (Witten-Bell). The verdict is whether the difference of their
log-likelihoods a character reaches a threshold, calibrated on held-out labelled URLs.

Labelled URLs are those that a rule fits. The models are fitted on a bounded sample of them: about
SAMPLE_PER_CLASS of each verdict, drawn by a hash of the URL, copies once; a fifth calibrates. So
their n-grams are bounded too, and are broadcast, as sorted arrays of hashes. Whole URLs are judged,
scheme, query and fragment included, MOST_CHARS of them when fitting.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laconic.llm.common import table, typed

#: (verdict, rule): a host, and a path from its first slash on.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Characters of a context; labelled URLs a verdict that are fitted on, about; first characters of each that are.
ORDER, SAMPLE_PER_CLASS, MOST_CHARS = 5, 10_000, 2_000
#: Characters judged at a time, about.
STEP_CHARS = 2_000_000
BEGIN, END = "\x02", "\x03"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first "://" up to / ? # or the end, A-Z in lower case; empty without "://"."""
    rest = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without "://"."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null; of equal lengths the listed first."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        of, slash, start = rule.partition("/")
        fits = (host == of) | F.endswith(host, F.lit("." + of))
        found = F.when(fits & F.startswith(path, F.lit(slash + start)), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _laid(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of texts laid end to end, each with order begins and an end, and where each stops."""
    forms = [BEGIN * order + x + END for x in texts]
    codes = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    return codes, np.cumsum([len(x) for x in forms]).astype(np.int64)


def _predicted(codes: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """Positions of all characters but the begins."""
    own = np.ones(len(codes), bool)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    own[(starts[:, None] + np.arange(order)).ravel()] = False
    return np.flatnonzero(own)


def _hashed(codes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n characters before each position, and of these with the one there."""
    h = np.zeros(len(at), np.uint64)
    for k in range(n, 0, -1):
        h = h * _FACTOR + codes[at - k]
    return h, h * _FACTOR + codes[at]


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class Markov:
    """Counts of next characters by context, with Witten-Bell mixing of shorter contexts; sorted hash arrays."""

    def __init__(self, texts: list[str], order: int):
        self.order, self.levels = order, []
        codes, ends = _laid(texts, order)
        at = _predicted(codes, ends, order)
        for n in range(order + 1):
            context, gram = _hashed(codes, at, n)
            keys, first, seen = np.unique(gram, return_index=True, return_counts=True)
            contexts, total = np.unique(context, return_counts=True)
            kinds = np.unique(context[first], return_counts=True)[1]
            self.levels.append((keys, seen.astype(float), contexts, total.astype(float), kinds.astype(float)))
        self.letters = len(self.levels[0][0]) + 1

    def log(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of the character at each position after those before it."""
        p = np.full(len(at), 1.0 / self.letters)
        for n, (keys, seen, contexts, total, kinds) in enumerate(self.levels):
            context, gram = _hashed(codes, at, n)
            all_, different = _looked_up(contexts, total, context), _looked_up(contexts, kinds, context)
            p = np.where(all_ > 0, (_looked_up(keys, seen, gram) + different * p) / np.maximum(all_ + different, 1), p)
        return np.log(p)


class Filter:
    """Models of both verdicts and the threshold on their difference a character."""

    def __init__(self, accepted: list[str], rejected: list[str], order: int = ORDER):
        (held_a, fit_a), (held_r, fit_r) = ((x[::5], [y for i, y in enumerate(x) if i % 5]) for x in (sorted(accepted), sorted(rejected)))
        self.accepted, self.rejected = Markov(fit_a, order), Markov(fit_r, order)
        self.threshold = 0.0
        a, r = np.sort(self.ratios(held_a)), np.sort(self.ratios(held_r))
        if len(a) and len(r):
            cuts = np.unique(np.concatenate([a, r]))
            cuts = np.concatenate([[cuts[0]], (cuts[1:] + cuts[:-1]) / 2])
            wrong = np.searchsorted(a, cuts) / len(a) + 1 - np.searchsorted(r, cuts) / len(r)
            best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
            self.threshold = float(cuts[best[len(best) // 2]])

    def ratios(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text as accepted less as rejected, a character."""
        out, first, size = [np.zeros(0)], 0, 0
        for k, x in enumerate(texts):
            size += len(x)
            if size >= STEP_CHARS or k + 1 == len(texts):
                codes, ends = _laid(texts[first : k + 1], self.accepted.order)
                at = _predicted(codes, ends, self.accepted.order)
                total = np.concatenate([[0], np.cumsum(self.accepted.log(codes, at) - self.rejected.log(codes, at))])
                bounds = np.searchsorted(at, np.concatenate([[0], ends]))
                out.append((total[bounds[1:]] - total[bounds[:-1]]) / np.diff(bounds))
                first, size = k + 1, 0
        return np.concatenate(out)


def train(ruled: DataFrame, per_class: int = SAMPLE_PER_CLASS, order: int = ORDER) -> Filter:
    """Fits the filter on rows (text, verdict), of which those with a verdict count."""
    ruled = ruled.filter("verdict IS NOT NULL")
    sizes = ruled.groupBy("verdict").count()
    ruled = ruled.select("verdict", F.substring("text", 1, MOST_CHARS).alias("text"))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = ruled.join(F.broadcast(sizes), "verdict").filter(draw * F.col("count") < per_class).select("verdict", "text").distinct()
    own: dict[str, list[str]] = {"allow": [], "block": []}
    for verdict, text in sample.toLocalIterator():
        own[verdict].append(text)
    return Filter(own["allow"], own["block"], order)


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (id, host, path, rule, verdict, ratio), one for each row of pages.

    A null URL and one without "://" have empty host and path; the model judges the whole URL, null as
    the empty text. Without labelled URLs of both verdicts the models know nothing or one side only; the verdict is
    still the sign of their difference, allow at zero. Other columns are ignored.
    """
    parts = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.coalesce(F.col(url_col), F.lit("")).alias("text"))
    parts = parts.withColumn("_found", rule_of(F.col("host"), F.col("path"), rules))
    fitted = train(parts.select("text", F.col("_found.verdict").alias("verdict")))
    shared = pages.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        for batch in batches:
            of = shared.value
            known = batch.column(4).to_pylist()
            ratio = of.ratios(batch.column(5).to_pylist())
            verdict = [k or ("allow" if r >= of.threshold else "block") for k, r in zip(known, ratio.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdict, pa.string()), pa.array(ratio)], names=[id_col, "host", "path", "rule", "verdict", "ratio"])

    rows = parts.select("_id", "host", "path", F.col("_found.rule").alias("rule"), F.col("_found.verdict").alias("known"), "text")
    return rows.mapInArrow(run, f"`{id_col}` {typed(pages, id_col)}, host string, path string, rule string, verdict string, ratio double")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: page_id, host, path, rule, verdict."""
    return judge(table(spark, sf_dir, "pages")).drop("ratio")
