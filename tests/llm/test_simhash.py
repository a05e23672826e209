import random
import re

import numpy as np
import xxhash

from laconic.llm import simhash
from tests.llm.conftest import SCHEMA, sentence


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_rows(rows):
    """Fingerprint, neighbours and component of each row, by comparing all with all."""
    f = np.array([plain(t) for _, t, *_ in rows], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    label = np.arange(len(rows))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    least = {k: min((rows[i][0] for i in np.flatnonzero(label == k) if rows[i][0] is not None), default=None) for k in set(label.tolist())}
    return [(d, format(int(x), "016x"), int(n.sum()) - 1, least[k]) for (d, *_), x, n, k in zip(rows, f, near, label.tolist())]


def key(r):
    return tuple(-1 if x is None else x for x in r)


def test_like_all_pairs(spark, edge_docs, edge_rows):
    assert sorted(map(tuple, simhash.near_duplicates(edge_docs).collect()), key=key) == sorted(plain_rows(edge_rows), key=key)


def test_chains_and_copies(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        words = sentence(rng, 300).split()
        for _ in range(12):
            words[rng.randrange(len(words))] = rng.choice(["one", "two", "three"])
            rows.append((len(rows), " ".join(words), None, None, None))
    rows += [(1000 + i, rows[0][1].upper(), None, None, None) for i in range(40)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = plain_rows(rows)
    assert sorted(map(tuple, got)) == sorted(want)
    assert len({r[3] for r in want}) < 60


def test_spark_hash_is_the_same(spark):
    for s in ("", "a b c d", "ünï" * 30):
        got = spark.sql(f"SELECT xxhash64('{s}')").first()[0]
        assert got % (1 << 64) == xxhash.xxh64_intdigest(s.encode(), 42)


def test_pairs_of_random_balls(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (30, 20, 3)).astype(np.uint64)) * rng.integers(0, 2, (30, 20, 3)).astype(np.uint64)
    fps = np.unique((base[:, None] ^ np.bitwise_xor.reduce(flips, axis=2)).ravel())
    count = rng.integers(1, 5, len(fps))
    rows = [(int(f), int(n)) for f, n in zip(fps.view(np.int64), count)]
    for bits, most in ((8, 1_000_000), (8, 40)):  # the latter divides places
        got = simhash.near_pairs(spark.createDataFrame(rows, "fp long, n long"), 4, bits, most).collect()
        sums = {}
        for r in got:
            if r.other is None:
                sums[r.fp] = sums.get(r.fp, 0) + r.near
        near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4) & (fps[:, None] != fps[None, :])
        want = {int(f): int(n) for f, n in zip(fps.view(np.int64), near.astype(int) @ count) if n}
        assert sums == want


def test_all_radii(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for n in range(1, 8):
            for _ in range(2):
                fps.add(b ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)))
    fps = np.array(sorted(fps), np.uint64)
    rows = [(int(f), 1) for f in fps.view(np.int64)]
    for radius in range(1, 7):
        got = simhash.near_pairs(spark.createDataFrame(rows, "fp long, n long"), radius, 4).filter("other IS NULL").groupBy("fp").sum("near").collect()
        near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius) & (fps[:, None] != fps[None, :])
        assert dict(map(tuple, got)) == {int(f): int(n) for f, n in zip(fps.view(np.int64), near.sum(1)) if n}, radius


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(50)] + [(7, 7)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate(spark, edge_docs, edge_rows, no_docs):
    kept = simhash.deduplicate(edge_docs)
    assert kept.schema == edge_docs.schema
    want = {r[3] for r in plain_rows(edge_rows)}
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(want) and {i for i in ids if i is not None} == {w for w in want if w is not None}
    assert simhash.deduplicate(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0
