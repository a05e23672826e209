"""Operator 10, benchmark decontamination: suffix arrays over shards of the training words.

The benchmark is the stated query set: it is cut into blocks of at most BLOCK_BYTES of text, of which
at most PASS_BLOCKS are broadcast at once; a larger benchmark takes more passes over the documents. A
shard is some whole documents of an Arrow batch. Its suffix array holds every suffix that can match:
those that begin with as many words known to the block as its shortest window has. Every suffix of an
item that has a window's words is binary-searched in it, all together; a suffix's occurrences are one
range of the array. Occurrences side by side on one diagonal are a longest verbatim match. Documents
never leave their task, so nothing is shuffled.
"""

import hashlib
import json
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laconic.llm.common import table, typed, utf8, written

#: Words of a window; bytes of benchmark text in a broadcast block, at most, but for one longer item; blocks broadcast at once.
WINDOW, BLOCK_BYTES, PASS_BLOCKS = 10, 4 << 20, 16
#: Bytes of training text in a shard, about.
SHARD_BYTES = 10 << 20

#: A-Z to lower case; bytes that no word has to blanks; digits, a-z and all beyond ASCII stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Block:
    """Windows of some items, in a form for binary search.

    Word numbers start at 1, 0 is any other word or a document's end. width numbers of bits bits
    fit one 64-bit key; a window is a row of keys, zero-padded in low and one-padded in high.
    """

    def __init__(self, items: list[tuple], window: int):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple, list[tuple[int, int]]] = {}
        self.items = [x for x, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            n = min(window, len(ids))
            for a in range(len(ids) - n + 1 if n else 0):
                windows.setdefault(tuple(ids[a : a + n]), []).append((k, a))
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.width = 64 // self.bits
        self.columns = -(-window // self.width)
        self.window = window
        order = sorted(windows)
        self.lengths = np.array([len(w) for w in order], np.int64)
        self.shortest = int(self.lengths.min()) if order else 0
        flat, top = np.zeros((len(order), self.columns * self.width), np.uint64), np.uint64((1 << self.bits) - 1)
        for k, w in enumerate(order):
            flat[k, : len(w)] = w
        self.low = self.keys(flat)
        self.high = self.keys(np.where(np.arange(flat.shape[1])[None, :] >= self.lengths[:, None], top, flat))
        found = [windows[w] for w in order]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int64)
        self.item = np.array([k for x in found for k, _ in x], np.int64)
        self.at = np.array([a for x in found for _, a in x], np.int64)

    def keys(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros((len(numbers), self.columns), np.uint64)
        for c in range(self.columns):
            for j in range(self.width):
                out[:, c] = (out[:, c] << np.uint64(self.bits)) | numbers[:, c * self.width + j]
        return out


def _bisect(array: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Where each row of wanted belongs in the sorted rows of array; all rows at once."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(array), np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = np.minimum((low + high) // 2, len(array) - 1)
        row = array[middle]
        less, same = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for c in range(array.shape[1]):
            less |= same & (row[:, c] < wanted[:, c])
            same &= row[:, c] == wanted[:, c]
        less |= same & right
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)


def occurrences(words: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words (0 ends each document) and the number of the block's window there."""
    none = np.zeros(0, np.int64)
    if not len(block.lengths) or not len(words):
        return none, none
    zeros = np.flatnonzero(words == 0)
    ends = zeros[np.searchsorted(zeros, np.arange(len(words)))]
    run = ends - np.arange(len(words))
    suffixes = np.flatnonzero(run >= block.shortest)
    if not len(suffixes):
        return none, none
    reach = run[suffixes]
    padded = np.concatenate([words, np.zeros(block.window, words.dtype)])
    numbers = np.zeros((len(suffixes), block.columns * block.width), np.uint64)
    for j in range(block.window):
        numbers[:, j] = np.where(reach > j, padded[suffixes + j], 0)
    keys = block.keys(numbers)
    order = np.lexsort([keys[:, c] for c in reversed(range(block.columns))])
    array, keys = suffixes[order], keys[order]
    low, high = _bisect(keys, block.low, False), _bisect(keys, block.high, True)
    count = high - low
    window = np.repeat(np.arange(len(count)), count)
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return array[np.repeat(low, count) + within], window


def query_blocks(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, pass_blocks: int = PASS_BLOCKS) -> Iterator[list]:
    """Broadcast blocks of the query set, those of one pass at a time; its rows stream through the driver."""
    context, blocks, rows, size = items.sparkSession.sparkContext, [], [], 0
    for item, text in items.select(item_col, text_col).toLocalIterator():
        text = (text or "").encode()
        if rows and size + len(text) > block_bytes:
            blocks.append(context.broadcast(Block(rows, window)))
            rows, size = [], 0
            if len(blocks) == pass_blocks:
                yield blocks
                blocks = []
        rows.append((item, text))
        size += len(text)
    if rows:
        blocks.append(context.broadcast(Block(rows, window)))
    if blocks:
        yield blocks


def _shard(column: pa.Array) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each document, their counts, and where each document starts among all words and ends."""
    words = [words_of(x) for x in utf8(column)]
    n = np.array([len(x) for x in words], np.int64)
    return words, n, np.concatenate([[0], np.cumsum(n + 1)])


def _numbers(words: list[list[bytes]], starts: np.ndarray, block: Block) -> np.ndarray:
    out = np.zeros(int(starts[-1]), np.int32)
    get = block.vocabulary.get
    for a, own in zip(starts.tolist(), words):
        out[a : a + len(own)] = np.fromiter(map(get, own, repeat(0)), np.int32, len(own))
    return out


def _longest(at: np.ndarray, which: np.ndarray, starts: np.ndarray, block: Block) -> tuple[np.ndarray, ...]:
    """Maximal verbatim matches: document, item row of the block, first word in either, and words."""
    many = block.first[which + 1] - block.first[which]
    pick = np.repeat(block.first[which], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    at, length = np.repeat(at, many), np.repeat(block.lengths[which], many)
    own, of, there = np.searchsorted(starts, at, side="right") - 1, block.item[pick], block.at[pick]
    order = np.lexsort([at, at - there, of, own])
    at, length, own, of, there = (x[order] for x in (at, length, own, of, there))
    fresh = np.ones(len(at), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1]) | (at[1:] - there[1:] != at[:-1] - there[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return own[first], of[first], at[first] - starts[own[first]], there[first], at[last] + length[last] - at[first]


def _parts(column: pa.Array) -> Iterator[pa.Array]:
    """Slices of about SHARD_BYTES of text, or one longer text."""
    if len(column) > 1 and column.nbytes > SHARD_BYTES:
        yield from _parts(column.slice(0, len(column) // 2))
        yield from _parts(column.slice(len(column) // 2))
    else:
        yield column


class _Leak:
    """What a document has of the query set so far: ranges of words hit, items found, the longest match and its place."""

    def __init__(self, state: str | None = None):
        self.hit, self.items, self.longest, self.at = json.loads(state) if state else ([], [], 0, None)

    def state(self) -> str:
        return json.dumps([self.hit, self.items, self.longest, self.at])

    def add(self, a: int, item, n: int) -> None:
        self.hit.append([a, a + n])
        if item is not None and str(item) not in self.items:
            self.items.append(str(item))
        if (n, -a) > (self.longest, -(self.at or 0)):
            self.longest, self.at = n, a

    def words(self) -> int:
        total = reach = 0
        for a, b in sorted(self.hit):
            total += max(0, b - max(a, reach))
            reach = max(reach, b)
        return total


def _leaks(column: pa.Array, blocks: list, states: list | None = None) -> Iterator[tuple[int, _Leak | None]]:
    """Each text's number of words and leaks, None without any."""
    done = 0
    for part in _parts(column):
        words, n, starts = _shard(part)
        found = [_Leak(x) if x else None for x in states[done : done + len(part)]] if states else [None] * len(part)
        done += len(part)
        for shared in blocks:
            block = shared.value
            at, which = occurrences(_numbers(words, starts, block), block)
            for own, item, a, _, size in zip(*(x.tolist() for x in _longest(at, which, starts, block))):
                if found[own] is None:
                    found[own] = _Leak()
                found[own].add(a, block.items[item], size)
        yield from zip(n.tolist(), found)


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at, items), one for each row of docs.

    longest is the number of words of the longest verbatim match and longest_at the first place where
    one of that length begins, counting words from 0; 0 and null without a hit. items lists the ids of
    the items found. Null and empty texts have no words and no hits; an item without words has no
    window; items of the same id count once, and one of null id hits but isn't counted; repeated
    documents each get a row. An empty query set hits nothing. Other columns are ignored.
    """
    key = typed(docs, id_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.lit(None).cast("string").alias("_state"))

    def kept(blocks: list):
        def run(batches):
            for batch in batches:
                states = [x.state() if x else None for _, x in _leaks(batch.column(1), blocks, batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(states, pa.string())], names=["_id", "_text", "_state"])

        return run

    def told(blocks: list):
        def run(batches):
            for batch in batches:
                n, leaks = zip(*_leaks(batch.column(1), blocks, batch.column(2).to_pylist())) if batch.num_rows else ((), ())
                names = [sorted(x.items) if x else [] for x in leaks]
                n_hit = [x.words() if x else 0 for x in leaks]
                digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
                longest, at = [x.longest if x else 0 for x in leaks], [x.at if x else None for x in leaks]
                numbers = [pa.array(x, pa.int64()) for x in (n, n_hit, [len(x) for x in names])]
                columns = [batch.column(0), *numbers, pa.array(digests, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(longest, pa.int64()), pa.array(at, pa.int64()), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_at", "items"])

        return run

    passes = query_blocks(items, item_col, item_text_col, window)
    blocks = next(passes, [])
    for following in passes:
        rows = written(rows.mapInArrow(kept(blocks), f"_id {key}, _text string, _state string"), "leaks")
        for x in blocks:
            x.unpersist()
        blocks = following
    return rows.mapInArrow(told(blocks), f"`{id_col}` {key}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_at long, items array<string>")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows in which a window of an item occurs; all columns stay as they are.

    Null and empty texts stay; an empty query set drops nothing; repeated rows fare alike.
    """
    at = docs.columns.index(text_col)

    def kept(blocks: list):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array([x is None for _, x in _leaks(batch.column(at), blocks)], pa.bool_()))

        return run

    passes = query_blocks(items, item_col, item_text_col, window)
    blocks = next(passes, [])
    for following in passes:
        docs = written(docs.mapInArrow(kept(blocks), docs.schema), "clean")
        for x in blocks:
            x.unpersist()
        blocks = following
    return docs.mapInArrow(kept(blocks), docs.schema)


def longest_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (id, item, doc_start, item_start, n_words): every maximal verbatim match of a window or more.

    Positions count words from 0. Matches are windows found next to each other on one diagonal of
    document and item; an item shorter than a window matches whole or not at all.
    """

    def of(blocks: list) -> DataFrame:
        def run(batches):
            for batch in batches:
                words, _, starts = _shard(batch.column(1))
                found = [[], [], [], [], []]
                for shared in blocks:
                    block = shared.value
                    own, item, *places = _longest(*occurrences(_numbers(words, starts, block), block), starts, block)
                    names = [None if block.items[k] is None else str(block.items[k]) for k in item.tolist()]
                    for to, x in zip(found, (own.tolist(), names, *(x.tolist() for x in places))):
                        to += x
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found[0], pa.int32())), pa.array(found[1], pa.string()), *(pa.array(x, pa.int64()) for x in found[2:])], names=[id_col, item_col, "doc_start", "item_start", "n_words"])

        return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {typed(docs, id_col)}, `{item_col}` string, doc_start long, item_start long, n_words long")

    out = of([])
    for k, blocks in enumerate(query_blocks(items, item_col, item_text_col, window)):
        out = of(blocks) if k == 0 else written(out, "matches").unionAll(of(blocks))
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, with the longest match of each and where it begins."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS k, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, k, j, n, array_to_string(w[j:j + n - 1], ' ') AS win
  FROM (SELECT item_id, k, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
m AS (SELECT r, i, dw.n, item_id, k, j FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
s AS (SELECT r, count(x) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256 FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM m) GROUP BY r),
runs AS (SELECT r, i, n, k, j - i AS diagonal, i - row_number() OVER (PARTITION BY r, k, j - i ORDER BY i) AS island FROM m),
l AS (SELECT r, min(i) - 1 AS place, max(i) - min(i) + any_value(n) AS size FROM runs GROUP BY r, k, diagonal, island),
best AS (SELECT r, max(size) AS longest, arg_max(place, size * 4294967296 - place) AS longest_at FROM l GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest, longest_at::BIGINT AS longest_at
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r) LEFT JOIN best USING (r)
"""
