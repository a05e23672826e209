"""Each registered query over whole tables of the smallest scale, against plain versions."""

import hashlib
import os
import re
from collections import defaultdict

import duckdb
import pytest

from laconic.llm import licenses, pii, quality
from laconic.llm.common import table
from laconic.llm.queries import ORACLES, QUERIES
from tests.llm.test_quality import plain_counts
from tests.llm.test_simhash import plain_rows
from tests.llm.test_texts import plain_base, plain_leaks, plain_parts, plain_rule
from tests.llm.test_tokens import crc, plain_ids

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def rows(spark):
    return sorted(map(tuple, table(spark, SF, "documents").collect()))


def result(spark, number):
    (name,) = (q for q in QUERIES if q.startswith(f"op{number}_"))
    return QUERIES[name](spark, SF).collect()


def test_one_query_an_operator():
    assert set(ORACLES) <= set(QUERIES)
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


def test_op1(spark, rows, tokenizer):
    want, start = [], 0
    for d, text, *_ in rows:
        ids = plain_ids(tokenizer, text)
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in result(spark, 1)) == want


def test_op2(spark, rows):
    assert sorted(map(tuple, result(spark, 2))) == sorted(plain_rows(rows))


def test_op3(spark, rows):
    got = result(spark, 3)
    want = [(d, *(c := plain_counts(t)), c[0] < 50 or 2 * c[4] > c[0]) for d, t, *_ in rows]
    assert sorted((r.doc_id, *(r[c] for c in quality.COUNTS), r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    passed = [r for r in got if not r.base_failed]
    assert sum(r.kept for r in passed) >= 0.9 * len(passed) > 0


def test_op4(spark, rows):
    known = dict(licenses.known_digests())
    want = []
    for d, text, *_ in rows:
        form = licenses.canonical(text or "")
        digest = hashlib.sha256(form.encode()).hexdigest()
        want.append((d, digest, len(form.split(" ")) if form else 0, known.get(digest)))
    assert sorted(map(tuple, result(spark, 4)), key=str) == sorted(want, key=str)


def test_op5(spark):
    got = {r.page_id: r for r in result(spark, 5)}
    pages = table(spark, SF, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        r, (host, path) = got[p.page_id], plain_parts(p.url)
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and r.verdict == (verdict or r.verdict)


def test_op6(spark, rows):
    got = {r.doc_id: r for r in result(spark, 6)}
    assert set(got) == {r[0] for r in rows} and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[d].lang_pred, lang) for d, _, lang, *_ in rows if got[d].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 0


def test_op7(spark, rows, tokenizer):
    got, want, sequences = result(spark, 7), [], defaultdict(list)
    for d, text, *_ in rows:
        ids = plain_ids(tokenizer, text)
        want += [(d, a, len(p := ids[a : a + 4096]), crc(p), len(ids)) for a in range(0, len(ids), 4096)]
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 4096
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.02 * total / 4096 + 1


def test_op8(spark, rows):
    """All windows of 50 words that two texts have lie in passages, and nothing else but near copies does."""
    cut = {d: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for d, t, *_ in rows}
    owners = defaultdict(set)
    for d, w in cut.items():
        for i in range(len(w) - 49):
            owners[tuple(w[i : i + 50])].add(d)
    spans = defaultdict(list)
    for r in result(spark, 8):
        spans[r.doc_id].append((r.start_word, r.end_word))
        assert r.end_word - r.start_word >= 50 and r.class_id <= r.doc_id
    held = lost = 0
    for d, w in cut.items():
        for i in range(len(w) - 49):
            if len(owners[tuple(w[i : i + 50])]) > 1:
                inside = any(a <= i and i + 50 <= b for a, b in spans[d])
                held, lost = held + inside, lost + (not inside)
    assert held > 0 and lost <= 0.001 * held
    assert {d for w, own in owners.items() if len(own) > 1 for d in own} <= set(spans)


def test_op9(spark, rows):
    got = {r.doc_id: r for r in result(spark, 9)}
    for d, text, *_ in rows:
        base, r = plain_base(text or ""), got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest()
        assert {"%s:%d:%d" % s for s in base} <= set(r.spans.split(",")) | {""}
    assert len(got) == len(rows)


def test_op10(spark, rows):
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert sorted(map(tuple, result(spark, 10))) == sorted(plain_leaks(rows, items))


def test_oracles(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in ORACLES.items():
        want, got = con.sql(sql), QUERIES[name](spark, SF)
        assert sorted(want.columns) == sorted(got.columns)
        order = ", ".join(got.columns)
        assert sorted(map(str, con.sql(f"SELECT {order} FROM ({sql})").fetchall())) == sorted(str(tuple(r)) for r in got.collect())
