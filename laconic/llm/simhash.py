"""Operator 2, SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most RADIUS bits share a variant that is at most half the radius,
rounded up, from each. So every distinct fingerprint has its ball of variants, variants are grouped, and
fingerprints that meet in one are verified. What is shuffled are not the variants themselves: all
variants of a fingerprint that go to the same place (equal leading bits) travel as one row, and are
written out there. A place works through its variants in slices of bounded size, and one to which too
many fingerprints would go, since theirs begin alike, is divided by further bits.

A pair meets in several variants. It counts only at its canonical one: the smaller fingerprint with
the lower half of the differing bits flipped. So no list of pairs is shuffled to remove repeats:
each place sends sums of neighbours, and the edges of a spanning forest, at most one a fingerprint.
No variant has more fingerprints than its ball has members (2081 for half a radius of 2), whatever the data.
"""

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laconic.llm.common import table, typed, utf8, written

#: Largest number of differing bits of a link; words of a shingle; fingerprints sent to a place, about.
RADIUS, SHINGLE, PLACE_ROWS = 4, 4, 250_000
#: Fingerprints sent to a place, at most, and bits by which a fuller place is divided.
MOST_ROWS, FURTHER = 1_000_000, 8
#: Variants that a place holds at once, about.
SLICE = 1 << 21

_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 1) - 1
    starts = (ends - n)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    of_byte = h.view(np.uint8).reshape(-1, 8)
    value = 0
    for k in range(8):
        ones = np.bincount(of_byte[:, k], minlength=256) @ _BITS
        for bit in np.flatnonzero(2 * ones > len(h)).tolist():
            value |= 1 << (8 * k + bit)
    return value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): fp holds the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(x) for x in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {typed(docs, id_col)}, fp long")


def half_of(radius: int) -> int:
    """How far variants lie from a fingerprint, at most."""
    return (radius + 1) // 2


@lru_cache(maxsize=256)
def _masks(bits: int, weight: int) -> np.ndarray:
    """All numbers of that many bits with at most weight of them set."""
    return np.array([sum(1 << b for b in c) for w in range(weight + 1) for c in combinations(range(bits), w)], np.uint64)


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


class _Place:
    """Pairs that are canonical at one place, as sums and a spanning forest."""

    def __init__(self, fps: np.ndarray, count: np.ndarray, radius: int):
        self.fps, self.count, self.radius = fps, count, radius
        self.near = np.zeros(len(fps), np.int64)
        self.parent = list(range(len(fps)))
        self.edges: list[tuple[int, int]] = []

    def slice(self, rows: np.ndarray, left: np.ndarray, prefix: int, bits: int) -> None:
        """Variants of rows with leading bits prefix: left flips remain for the other bits."""
        half = half_of(self.radius)
        masks = {w: _masks(64 - bits, w) for w in set(left.tolist())}
        if sum(int((left == w).sum()) * len(m) for w, m in masks.items()) > SLICE and bits < 62 and len(rows) > 1:
            for bit in (0, 1):
                own = (self.fps[rows] >> np.uint64(63 - bits)) & np.uint64(1)
                rest = left - (own != bit)
                keep = rest >= 0
                if keep.any():
                    self.slice(rows[keep], rest[keep], (prefix << 1) | bit, bits + 1)
            return
        low = np.uint64((1 << (64 - bits)) - 1)
        prefix &= (1 << 64) - 1
        variants, owners = [], []
        for w, m in masks.items():
            own = rows[left == w]
            variants.append(((self.fps[own] & low)[:, None] ^ m[None, :]).ravel())
            owners.append(np.repeat(own, len(m)))
        variant, owner = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(variant)
        ordered = variant[order]
        same = np.flatnonzero(ordered[1:] == ordered[:-1])
        if not len(same):
            return
        keep = np.zeros(len(ordered), bool)
        keep[same] = keep[same + 1] = True
        ordered, owner = ordered[keep], owner[order][keep]
        begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        size = np.diff(np.append(begin, len(ordered)))
        top = np.uint64((prefix << (64 - bits)) & ((1 << 64) - 1))
        for k in np.unique(size).tolist():
            at = begin[size == k]
            step = max(1, SLICE // (k * k))
            for s in range(0, len(at), step):
                group = owner[at[s : s + step, None] + np.arange(k)[None, :]]
                self.pairs(group, ordered[at[s : s + step]] | top, half)

    def pairs(self, group: np.ndarray, variant: np.ndarray, half: int) -> None:
        """Verify the pairs that share each variant, in blocks; keep those canonical there."""
        k = group.shape[1]
        a, b = np.triu_indices(k, 1)
        x, y = group[:, a].ravel(), group[:, b].ravel()
        at = np.repeat(variant, len(a))
        first, second = np.minimum(self.fps[x], self.fps[y]), np.maximum(self.fps[x], self.fps[y])
        differ = first ^ second
        flip, rest, n = np.zeros(len(x), np.uint64), differ.copy(), np.bitwise_count(differ).astype(np.int64)
        for step in range(half):
            lowest = rest & (~rest + np.uint64(1))
            flip |= np.where(n > 2 * step, lowest, np.uint64(0))
            rest ^= lowest
        good = (n > 0) & (n <= self.radius) & (at == (first ^ flip))
        x, y = x[good], y[good]
        np.add.at(self.near, x, self.count[y])
        np.add.at(self.near, y, self.count[x])
        for i, j in zip(x.tolist(), y.tolist()):
            i, j = _find(self.parent, i), _find(self.parent, j)
            if i != j:
                self.parent[max(i, j)] = min(i, j)
                self.edges.append((i, j))


def place_bits_for(classes: int, half: int) -> int:
    """Leading bits that place a variant: from 8 on, so many that a place gets about PLACE_ROWS fingerprints."""
    bits = 8
    while bits < 24 and classes * len(_masks(bits, half)) > PLACE_ROWS << bits:
        bits += 1
    return bits


def _placed(classes: DataFrame, half: int, bits: int, most: int) -> DataFrame:
    """Rows (fp, n, place, bits, flips): each fingerprint at every place where it has a variant, and how many
    flips remain. Places have at most most rows, unless they are a single variant."""

    def spread(rows: DataFrame, at: int, more: int) -> DataFrame:
        """rows at their places of at bits, divided by more bits."""
        masks = _masks(more, half)
        options = F.array(*(F.struct(F.lit(int(m)).cast("long").alias("m"), F.lit(int(m).bit_count()).alias("w")) for m in masks))
        own = F.shiftrightunsigned(F.shiftleft("fp", at), 64 - more)
        sent = rows.withColumn("_o", F.explode(F.filter(options, lambda o: o["w"] <= F.col("flips"))))
        place = F.shiftleft("place", more).bitwiseOR(own.bitwiseXOR(F.col("_o.m")))
        return sent.select("fp", "n", place.alias("place"), F.lit(at + more).alias("bits"), (F.col("flips") - F.col("_o.w")).alias("flips"))

    start = classes.select("fp", "n", F.lit(0).cast("long").alias("place"), F.lit(half).alias("flips"))
    rows, done = spread(start, 0, bits), None
    while bits < 64:
        # as many as there are rows by most, whatever the data
        full = [r["place"] for r in rows.groupBy("place").count().filter(F.col("count") > most).select("place").toLocalIterator()]
        if not full:
            break
        full = F.broadcast(classes.sparkSession.createDataFrame([(x,) for x in full], "place long"))
        kept, more = rows.join(full, "place", "left_anti"), min(FURTHER, 64 - bits)
        done = kept if done is None else done.unionByName(kept)
        rows, bits = spread(rows.join(full, "place", "left_semi"), bits, more), bits + more
    return rows if done is None else done.unionByName(rows)


def near_pairs(classes: DataFrame, radius: int = RADIUS, place_bits: int | None = None, most: int = MOST_ROWS) -> DataFrame:
    """Rows (fp, near, other) from distinct (fp, n): partial sums of neighbours (other null), or forest edges (near 0).

    place_bits sets how many places there are at first; each gets a fingerprint at most once.
    """
    half = half_of(radius)
    sent = _placed(classes, half, place_bits or place_bits_for(classes.count(), half), most)

    def run(place, group):
        fps = group.column("fp").to_numpy().view(np.uint64)
        at, bits = place[0].as_py() & (1 << 64) - 1, place[1].as_py()
        of = _Place(fps, group.column("n").to_numpy(), radius)
        of.slice(np.arange(len(fps)), group.column("flips").to_numpy().astype(np.int64), at, bits)
        signed = fps.view(np.int64)
        some = np.flatnonzero(of.near)
        a, b = (np.array([e[k] for e in of.edges], np.int64) for k in (0, 1))
        return pa.table(
            {
                "fp": pa.array(np.concatenate([signed[some], signed[a]])),
                "near": pa.array(np.concatenate([of.near[some], np.zeros(len(a), np.int64)])),
                "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(signed[b])]),
            }
        )

    return sent.groupBy("place", "bits").applyInArrow(run, "fp long, near long, other long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): connected components of undirected edges, root the least node of each.

    Alternating large-star and small-star steps until the edges stay the same; each step ends in
    checkpoint(), so nothing is recomputed through the rounds. Minima are partly aggregated before
    they are shuffled, and the joins that follow are split by AQE where a node has many edges.
    """
    spark = edges.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        from laconic.llm.common import scratch

        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoint"))
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct().checkpoint()
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = small.checkpoint()
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fingerprint, n_near, component_id), one for each row of docs.

    Texts with equal fingerprints are one class; only classes are compared. Null and empty texts and
    texts without words have fingerprint 0 and link like any other. A repeated row counts as one more
    document. A null id never is a component's id unless all its ids are null. Empty in, empty out.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    prints = written(fingerprints(own, "_id", "_text"), "fingerprints")
    classes = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("least"))
    found = written(near_pairs(classes.select("fp", "n"), radius), "near")
    near = found.filter("other IS NULL").groupBy("fp").agg(F.sum("near").alias("near"))
    roots = components(found.filter("other IS NOT NULL"), "fp", "other").withColumnRenamed("node", "fp")
    linked = classes.join(near, "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    component = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = linked.join(component, "root").select("fp", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(of_class, "fp").select(F.col("_id").alias(id_col), hexed.alias("fingerprint"), "n_near", "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the least id, of its rows the least text hash, once.

    Null and empty texts are alike and leave one row. Null ids come last; rows equal in id and text leave
    one, whichever, and the other columns are that row's. Empty in, empty out. All columns stay as they are,
    whatever their names. Only keys go through the comparison; texts are shuffled once.
    """
    column = lambda c: F.col(f"`{c}`")
    key = F.struct(column(id_col).isNull().alias("none"), column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("h"))
    keyed = docs.select(key.alias("key"), column(text_col).alias("text"), F.struct(*map(column, docs.columns)).alias("row"))
    found = near_duplicates(keyed, radius, "key", "text")
    kept = found.filter(F.col("key") == F.col("component_id")).select("key").distinct()
    once = Window.partitionBy("key").orderBy("key")
    one = keyed.select("key", "row").join(kept, "key", "left_semi").withColumn("place", F.row_number().over(once)).filter("place = 1")
    return one.select("row.*")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, fingerprint, n_near, component_id."""
    return near_duplicates(table(spark, sf_dir, "documents"))
