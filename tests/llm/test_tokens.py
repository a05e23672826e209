import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from laconic.llm import packing, token_store
from laconic.llm.common import scratch
from laconic.llm.tokens import Encoder


def plain_ids(path, text, end=2):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chunks_equal_whole_texts(tokenizer):
    own, plain = Encoder(tokenizer), Tokenizer.from_file(tokenizer)
    assert own.by_chunk

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.sampled_from("aBcé ßÿ÷×'sdlmrvet.,!-#12 \n\t\u00a0\u0301\u2028日😀<|>ΣİK") | st.characters(codec="utf-8"), max_size=60))
    def run(text):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids

    run()
    for text in ("a<|endoftext|>b <|startoftext|> c", "a<|ENDOFTEXT|>b <|EndOfText|> <|StartOfText|>", "don't we'll I'M", "x" * 5000):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_store_round_trip(spark, edge_docs, edge_rows, tokenizer):
    path = scratch(spark, "test")
    token_store.write_tokens(edge_docs, path, tokenizer, 2)
    rows = token_store.checksums(spark.read.parquet(path)).collect()
    want = sorted((-1 if d is None else d, len(i := plain_ids(tokenizer, t)), crc(i)) for d, t, *_ in edge_rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    part = token_store.read_tokens(spark, path, 4, 8)
    assert "GreaterThanOrEqual(doc_id,4)" in part._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: list(r.ids) for r in part.collect()}[8] == plain_ids(tokenizer, "x")
    meta = token_store.read_meta(spark, path)
    assert sorted((r.start, r.n_tokens) for r in meta.collect()) == sorted((r.start, r.n_tokens) for r in rows)


def test_store_of_nothing(spark, no_docs, tokenizer):
    path = scratch(spark, "test")
    token_store.write_tokens(no_docs, path, tokenizer, 2)
    assert token_store.checksums(spark.read.schema("doc_id long, part long, first long, n_tokens long, ids array<int>").parquet(path)).count() == 0


def test_first_fit_decreasing_like_plain():
    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(0, 80))]
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        free, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            k = next((k for k, f in enumerate(free) if f >= lengths[i]), None)
            if k is None:
                free.append(100)
                k = len(free) - 1
            want[i] = (k, 100 - free[k])
            free[k] -= lengths[i]
        assert {i: (b, o) for i, (b, o) in enumerate(zip(bins, offsets))} == want


def test_packing_keeps_every_token(edge_docs, edge_rows, no_docs, tokenizer):
    rows = packing.pack_documents(edge_docs, tokenizer).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 4096
    by_id = defaultdict(list)
    for d, text, *_ in edge_rows:
        by_id[d].append(plain_ids(tokenizer, text))
    for d, texts in by_id.items():
        want = sorted((a, len(p := ids[a : a + 4096]), crc(p), len(ids)) for ids in texts for a in range(0, len(ids), 4096))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[d]) == want
    assert packing.pack_documents(no_docs, tokenizer).count() == 0
