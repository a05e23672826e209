"""The pipeline against a plain version of its stages on the small documents table."""

import os
import re

import pytest

import corpus_pipeline
from laconic.llm import langid, pii
from laconic.llm.common import table
from tests.llm.test_simhash import plain_rows
from tests.llm.test_texts import plain_leaks
from tests.llm.test_tokens import crc, plain_ids

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_pipeline_like_plain(spark, tokenizer):
    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.collect()]
    model = langid.train(docs)
    known = {r.doc_id for r in langid.identify(docs, model).collect() if r.lang_pred != "und" and r.score >= 0.5}
    rows = [r for r in rows if r[0] in known]
    kept = {r[3] for r in plain_rows(rows)}
    rows = [r for r in rows if r[0] in kept]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    leaked = {r[0] for r in plain_leaks(rows, items) if r[5]}
    rows = [r for r in rows if r[0] not in leaked]
    clean = {r[0]: pii.redacted(r[1], pii.find_spans(r[1])) for r in rows}
    got = corpus_pipeline.run(spark, SF).collect()
    want = set()
    for d, text in clean.items():
        ids = plain_ids(tokenizer, text)
        want |= {(d, a, len(p := ids[a : a + 4096]), crc(p), len(ids)) for a in range(0, len(ids), 4096)}
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got} == want and len(got) == len(want)
    assert not any(re.search(r"[\w.]+@\w+\.\w+", t) for t in clean.values())


def test_stages_keep_the_columns(spark, edge_docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edge_docs, SF).columns == edge_docs.columns
