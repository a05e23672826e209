"""Operator 7, packing: first-fit decreasing over a tournament tree, in random groups of documents.

A document is cut at multiples of the sequence length; full pieces fill a sequence each, past the
tree, and the rest goes to the first open sequence with room. Groups are drawn by a hash of row position,
not of any value, so no hot key can swell one; pieces are drawn one by one, so no long document can.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laconic.llm.common import sliced, table, texts, typed
from laconic.llm.tokens import encoder

#: Pieces of a group, about, at most: padding is below half a sequence a group.
GROUP_PIECES = 16_384


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, longest first, each into the first bin with room.

    The tournament tree's leaves are the bins' free room and inner nodes hold the larger child,
    so the leftmost bin with enough room is found and updated on one path from the root.
    """
    size = 1
    while size < len(lengths):
        size *= 2
    tree = [capacity] * (2 * size)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need, node = lengths[i], 1
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - size, capacity - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left > right else right
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, groups: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, grp) of every document; no shuffle."""

    def run(batches):
        of, end, row, part = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 0, TaskContext.get().partitionId()
        for batch in sliced(batches):
            at, start, length, crc, total, group = [], [], [], [], [], []
            for k, coded in enumerate(of.stream(texts(batch.column(1)))):
                ids = memoryview(coded + end)
                n = len(ids) // 4
                for a in range(0, n, capacity):
                    b = min(a + capacity, n)
                    at.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                    total.append(n)
                    group.append(zlib.crc32(f"{part}:{row}:{a}".encode()) % groups)
                row += 1
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total, group)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *numbers], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "grp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {typed(docs, id_col)}, start long, length long, ids_crc32 long, doc_tokens long, grp long")


def pack(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces of at most capacity tokens, group by group."""
    schema = f"`{id_col}` {typed(pieces, id_col)}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        rest, full = np.flatnonzero(lengths < capacity), np.flatnonzero(lengths == capacity)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        if len(rest):
            sequence[rest], offset[rest] = first_fit_decreasing(lengths[rest].tolist(), capacity)
        sequence[full] = np.arange(len(full)) + (int(sequence.max()) + 1 if len(rest) else 0)
        sequence += group.column("grp")[0].as_py() << 32
        return group.drop_columns(["grp"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return pieces.groupBy("grp").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most capacity tokens.

    Null text is empty: one end id. Repeated rows and null ids are packed like any other row; an
    empty table gives no pieces; other columns are ignored.
    """
    # a document has no more tokens than bytes and its end, so this many pieces at most
    most = F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) / F.lit(float(capacity)) + 1
    groups = max(1, math.ceil((docs.agg(F.sum(most)).first()[0] or 0) / GROUP_PIECES))
    return pack(cut_documents(docs, tokenizer, end_id, capacity, groups, id_col, text_col), capacity, id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096: a row a piece."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
