"""Language ID, licences, personal data, URLs and benchmark leaks."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laconic.llm import decontaminate, langid, licenses, pii, urls
from tests.llm.conftest import SCHEMA, sentence

WORDS = {"en": "the and of with that have from this house water".split(), "de": "der und nicht eine sich auch haus wasser über für".split(), "ru": "это что как дом вода для они было".split()}


def key(r):
    return tuple("" if x is None else str(x) for x in r)


# ---- language


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, 60, WORDS[lang]), lang, "s", 0) for i in range(90) for lang in WORDS]
    return langid.train(spark.createDataFrame(rows, SCHEMA))


def test_language_on_new_texts(spark, model):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 25, WORDS[lang]), lang, "s", 0) for i in range(40) for lang in WORDS]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()}
    assert got == {(i, lang) for i, _, lang, *_ in rows}


def test_spans_of_mixed_text(spark, model):
    rng = random.Random(3)
    text = sentence(rng, 30, WORDS["en"]) + " " + sentence(rng, 20, WORDS["de"]) + " " + sentence(rng, 10, WORDS["ru"])
    r = langid.identify(spark.createDataFrame([(1, text, None, None, None)], SCHEMA), model).first()
    assert [(s.first, s.words, s.lang) for s in r.spans] == [(0, 30, "en"), (30, 20, "de"), (50, 10, "ru")]
    assert r.lang_pred == "en" and 0.3 < r.score < 0.7


def test_viterbi_like_plain():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(0, 7, 5)
        starts = np.cumsum(lengths) - lengths
        scores = rng.normal(size=(int(lengths.sum()), 3)).astype(np.float32)
        got = langid.viterbi(scores, starts, lengths, 0.7)
        for a, n in zip(starts.tolist(), lengths.tolist()):
            value = lambda path: sum(scores[a + t, s] for t, s in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:]))
            best = max((value(p) for p in np.ndindex(*[3] * n)), default=0)
            assert value(got[a : a + n].tolist()) == pytest.approx(best, abs=1e-4)


def test_language_edges(spark, edge_docs, edge_rows, no_docs, model):
    rows = langid.identify(edge_docs, model).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        if r.doc_id in (1, 2, 3, 9):
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
        else:
            assert r.lang_pred in WORDS and 0 < r.score <= 1
    kept = langid.keep_identified(edge_docs, model, 0.0)
    assert kept.schema == edge_docs.schema and kept.count() == len(edge_rows) - 4
    assert langid.identify(no_docs, langid.train(no_docs)).count() == 0
    assert {r.lang_pred for r in langid.identify(edge_docs, langid.train(no_docs)).collect()} == {"und"}


# ---- licences


def test_license_forms(spark):
    mit = licenses.KNOWN["MIT"][0]
    forms = [mit, "MIT Licence\n\nCopyright (c) 2020 Someone\nAll rights reserved.\n" + mit.upper(), re.sub(" ", "\n   ", mit), mit.replace('"AS IS"', "“as is”"), mit + " And more."]
    rows = [(i, t, None, None, None) for i, t in enumerate([*forms, licenses.KNOWN["Zlib"][0]])]
    got = {r.doc_id: r.license_id for r in licenses.find_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: "Zlib"}


def test_license_column_like_plain(edge_docs, edge_rows, no_docs):
    rows = licenses.find_licenses(edge_docs).collect()
    want = [(d, hashlib.sha256((c := licenses.canonical(t or "")).encode()).hexdigest(), len(c.split(" ")) if c else 0, None) for d, t, *_ in edge_rows]
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert licenses.find_licenses(no_docs).count() == 0


# ---- personal data


def plain_base(text):
    spans = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            spans.append(("card", m.start(), m.end()))
    spans += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(spans, key=lambda s: (s[1], "email ip card phone".split().index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab@@..-+ 0123456789()é\n", max_size=80) | st.sampled_from(["x a.b@c.d@e.f 4111 1111-1111 1111", "+1 (555) 123-4567 1.2.3.4.5 256.1.1.1 00255.1.1.1"]))
def test_base_spans_like_plain(text):
    assert sorted(pii.base_spans(text), key=lambda s: (s[1], pii._ORDER[s[0]])) == plain_base(text)


def test_further_spans_and_redaction():
    text = "IBAN DE89 3704 0044 0532 0130 00, IBAN DE88370400440532013000 by jo@ex.org, token = \"0641917ea4e9feb9cda83477b57ac2654884f485\""
    kinds = [(k, text[a:b]) for k, a, b in pii.find_spans(text)]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in kinds and ("email", "jo@ex.org") in kinds
    assert ("key", "0641917ea4e9feb9cda83477b57ac2654884f485") in kinds and not any(k == "iban" and "DE88" in x for k, x in kinds)
    clean = pii.redacted(text, pii.find_spans(text))
    assert "jo@ex.org" not in clean and "<email>" in clean and not pii.find_spans(clean)


def test_personal_data_edges(spark, edge_docs, edge_rows, no_docs):
    rows = pii.find_personal_data(edge_docs).collect()
    assert len(rows) == len(edge_rows) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    again = pii.redact(edge_docs)
    assert again.schema == edge_docs.schema
    assert sorted((r[:5] for r in again.collect()), key=key) == sorted((tuple(None if x is None else x for x in (d, t, la, s, n if t is None else len(t))) for d, t, la, s, n in edge_rows), key=key)
    assert pii.redact(no_docs).count() == 0
    one = pii.redact(spark.createDataFrame([(1, "mail a@b.cd now", "en", "s", 15)], SCHEMA)).first()
    assert (one.text, one.n_chars) == ("mail <email> now", 16)


# ---- URLs


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def plain_rule(host, path):
    fits = [(len(r), r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, default=(0, None, None))[1:]


def test_urls_like_plain(spark):
    rng = random.Random(1)
    some = [None, "", "x", "://", "http://", "ftp://A.Com/en/", "a://b://c/d", "http://EXAMPLE.com/en/7x?q#f", "http://com/en/", "http://xcom/en/", "http://sub.example.net/de/8", "http://n.net/de/9#z", "http://é.org/es/?x"]
    some += ["".join(rng.choice(["http", "://", "/", "?", "#", "example", ".com", ".net", "/en/", "/de/8", "A", "é"]) for _ in range(rng.randint(1, 9))) for _ in range(200)]
    some += [f"http://good{i}.com/en/{i}" for i in range(60)] + [f"http://fine{i}.net/de/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(some)], "page_id long, url string, html string, host string")
    rows = {r.page_id: r for r in urls.judge(pages).collect()}
    assert len(rows) == len(some)
    for i, u in enumerate(some):
        r, (host, path) = rows[i], plain_parts(u)
        assert (r.host, r.path) == (host, path), u
        rule, verdict = plain_rule(host, path)
        assert r.rule == rule and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert urls.judge(pages.filter("page_id < 0")).count() == 0
    assert urls.judge(pages.filter("page_id < 3")).count() == 3


def test_url_models_by_the_book():
    texts = ["abab", "abc", "bca"]
    m = urls.Markov(texts, 2)

    def p(context, c):
        if context is None:
            return 1 / (len(set("".join(texts)) | {"\x03"}) + 1)
        follow = [t[i] for t in ("\x02\x02" + x + "\x03" for x in texts) for i in range(2, len(t)) if t[i - len(context) : i] == context]
        rest = p(context[1:] if context else None, c)
        return rest if not follow else (follow.count(c) + len(set(follow)) * rest) / (len(follow) + len(set(follow)))

    for gram in ("aba", "abx", "\x02\x02a", "zzz", "ca\x03"):
        codes = np.array([ord(c) + 1 for c in gram], np.uint64)
        assert m.log(codes, np.array([2]))[0] == pytest.approx(float(np.log(p(gram[:-1], gram[-1]))))
    f = urls.Filter([], [])
    f.accepted, f.rejected = m, urls.Markov(["zz"], 2)
    asked = ["ab", "", "zzz"]
    whole = [f.ratios([x])[0] for x in asked]
    assert f.ratios(asked).tolist() == pytest.approx(whole) and whole[0] > 0 > whole[2]


def test_url_verdicts_on_held_out():
    rng = random.Random(1)
    good = [f"news{rng.randint(1, 99)}.com/story/{rng.randint(1, 10**6)}" for _ in range(300)]
    bad = [f"casino{rng.randint(1, 99)}.biz/win/{rng.randint(1, 10**6)}?x" for _ in range(300)]
    f = urls.Filter(good[:200], bad[:200])
    assert (f.ratios(good[200:]) >= f.threshold).all() and (f.ratios(bad[200:]) < f.threshold).all()


# ---- benchmark leaks


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_leaks(docs, items):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).update([] if item is None else [str(item)])
    out = []
    for d, text, *_ in docs:
        words, hit, found = plain_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(words[i : i + n])]
        longest = max(((n, -i) for i in range(len(words)) for n in plain_reach(words, i, items)), default=(0, None)) if hit else (0, None)
        out.append((d, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), longest[0], -longest[1] if hit else None))
    return out


def plain_reach(words, i, items):
    """Lengths of verbatim matches from a word on that are as long as a window of their item."""
    for _, text in items:
        w = plain_words(text)
        for j in range(len(w)):
            n = 0
            while i + n < len(words) and j + n < len(w) and words[i + n] == w[j + n]:
                n += 1
            if n >= min(10, len(w)):
                yield n


def test_leaks_like_plain(spark, edge_docs, edge_rows, no_docs):
    rng = random.Random(6)
    vocabulary = "a b c d é".split()
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([0, 1, 2, 9, 10, 11, 14, 30, 3])] + [(20, None), (3, "a-B!c"), (21, "a b a b a b a b a b a b a b"), (None, "zz a zz b zz a zz b zz a zz b"), (None, "zz zz zz")]
    docs = [(i, " ".join(rng.choice(vocabulary + ["zz"]) for _ in range(rng.choice([0, 5, 60, 150]))), None, None, None) for i in range(30)]
    docs += [(100 + i, "x " + (items[7][1]) + ". " + items[i][1], None, None, None) for i in range(5)] + [(5, None, None, None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1, 40, 1 << 20):
        passes = list(decontaminate.query_blocks(bench, block_bytes=size, pass_blocks=3))
        assert (size > 1000) == (len(passes) == 1) and all(len(x) <= 3 for x in passes)
    plain = sorted(plain_leaks(docs, items), key=key)
    old = decontaminate.query_blocks.__defaults__
    for size, at_once in ((1 << 20, 16), (40, 16), (40, 3)):
        decontaminate.query_blocks.__defaults__ = ("item_id", "text", 10, size, at_once)
        try:
            got = decontaminate.find_contamination(spark.createDataFrame(docs, SCHEMA), bench).drop("items").collect()
            left = decontaminate.drop_contaminated(spark.createDataFrame(docs, SCHEMA), bench).collect()
            longest = decontaminate.longest_matches(spark.createDataFrame(docs, SCHEMA), bench).collect()
        finally:
            decontaminate.query_blocks.__defaults__ = old
        assert sorted(map(tuple, got), key=key) == plain
        assert sorted(r.doc_id for r in left) == sorted(r[0] for r in plain if not r[5])
        most = {}
        for r in longest:
            most[r.doc_id] = max(most.get(r.doc_id, (0, 0)), (r.n_words, -r.doc_start))
        assert most == {r[0]: (r[6], -r[7]) for r in plain if r[5]}
    few = items[4:8]
    got = decontaminate.find_contamination(edge_docs, spark.createDataFrame(few, "item_id long, text string")).drop("items").collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_leaks([r for r in edge_rows], few), key=key)
    assert decontaminate.drop_contaminated(edge_docs, bench.filter("item_id < 0")).count() == len(edge_rows)
    assert decontaminate.find_contamination(no_docs, bench).count() == 0


def test_longest_matches(spark):
    rng = random.Random(7)
    item = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(["x", *item[3:30], "y", *item[10:20], "z"]), None, None, None), (2, sentence(rng, 50), None, None, None)]
    got = decontaminate.longest_matches(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_words) for r in got) == [(1, "7", 1, 3, 27), (1, "7", 29, 10, 10)]


def test_crc_of_ids(spark):
    import zlib

    from laconic.llm.common import crc_mod

    got = spark.range(20).select(crc_mod(F.col("id"), 3).alias("x")).collect()
    assert [r.x for r in got] == [zlib.crc32(str(i).encode()) % 3 for i in range(20)]


def test_long_licences_and_short_notices():
    import hashlib
    from pathlib import Path

    from laconic.llm import licenses

    known = dict(licenses.known_digests())
    name = lambda text: known.get(hashlib.sha256(licenses.canonical(text).encode()).hexdigest())
    assert name("Released under the MIT License.") == "MIT"
    assert name("This project is licensed under the Apache License, Version 2.0") == "Apache-2.0"
    assert name("// SPDX-License-Identifier: GPL-3.0") == "GPL-3.0"
    assert name("Released under the MIT License. Enjoy it.") is None
    assert {"Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"} <= set(known.values())
    folder = Path("/usr/share/common-licenses")
    for file, one in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if (folder / file).exists():
            assert name((folder / file).read_text()) == one
