import math
import random
from collections import Counter

import numpy as np
import pytest

from laconic.llm import quality
from tests.llm.conftest import SCHEMA, sentence


def plain_model(texts, order):
    """Modified Kneser-Ney by the book: a function of a text to its mean log-probability a character."""
    form = lambda t: "".join("0" if c in "0123456789" else c for c in quality.spelt(t.encode().split(), order))
    counts = {n: Counter() for n in range(1, order + 1)}
    for t in texts:
        t = form(t)
        for i in range(order, len(t) + 1):
            counts[order][t[i - order : i]] += 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    vocabulary = len(counts[1]) + 1
    cuts = {}
    for n, c in counts.items():
        k = Counter(min(x, 4) for x in c.values())
        y = k[1] / max(1.0, k[1] + 2 * k[2])
        cuts[n] = [0.0, *(min(j, max(0.1 * j, j - (j + 1) * y * k[j + 1] / max(1.0, k[j]))) for j in (1, 2, 3))]

    def p(g):
        if not g:
            return 1.0 / vocabulary
        n = len(g)
        own = {x: c for x, c in counts[n].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total, freed = sum(own.values()), sum(cuts[n][min(c, 3)] for c in own.values())
        c = own.get(g, 0)
        return (c - cuts[n][min(c, 3)] if c else 0) / total + freed / total * p(g[1:])

    def mean(text):
        t = form(text)
        return float(np.mean([math.log(p(t[i - order : i])) for i in range(order, len(t) + 1)]))

    return mean


def test_model_by_the_book(spark):
    rng = random.Random(1)
    texts = [sentence(rng, 120) for _ in range(6)]
    docs = spark.createDataFrame([(t, f"en{quality.SPLIT}0") for t in texts], "text string, key string")
    for order in (2, 4):
        models = quality.train(docs, "text", "key", order)
        plain = plain_model(texts, order)
        asked = ["alphas betaing, zebra kappa.", "ünï 1999", "x", texts[0]]
        got = quality.log_means([x.encode().split() for x in asked], [f"en{quality.SPLIT}0"] * 4, models, order)
        assert got == pytest.approx([plain(x) for x in asked], rel=1e-4)


def test_n_grams_of_a_bucket_count_together(spark):
    rows = [("k", f"gram{i}", i + 1) for i in range(40)]
    grams = spark.createDataFrame(rows, "key string, gram string, n long")
    got = quality.pooled(grams, 8).collect()
    assert len(got) <= 8 and sum(r.n for r in got) == sum(n for *_, n in rows) and "gram39" in {r.gram for r in got}
    assert {(r.gram, r.n) for r in quality.pooled(grams).collect()} == {(g, n) for _, g, n in rows}


def test_each_n_gram_has_its_own_count(spark):
    """N-grams of which two share one of the 4,194,304 places of pooled() are both in the model."""
    rng = random.Random(13)
    texts = [" ".join("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(6)) for _ in range(2000)) for _ in range(2)]
    docs = spark.createDataFrame([(t, "k") for t in texts], "text string, key string")
    grams = quality.count_grams(docs, "text", "key")
    assert quality.pooled(grams).count() < (n := grams.count())
    model = quality.train(docs, "text", "key")["k"].value
    assert len(model.hashes[quality.ORDER]) == n


def plain_counts(text):
    words = quality.utf8(__import__("pyarrow").array([text]))[0].split()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = (text or "").split("\n")
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), sum(bool(x.encode().split()) and x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_counts(spark, edge_docs, edge_rows, no_docs):
    rows = quality.judge(edge_docs).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted(((r.doc_id, *(r[c] for c in quality.COUNTS), r.base_failed) for r in rows), key=key)
    want = [(d, *(c := plain_counts(t)), c[0] < 50 or 2 * c[4] > c[0]) for d, t, *_ in edge_rows]
    assert got == sorted(want, key=key)
    assert all(not r.kept for r in rows if r.base_failed)
    assert quality.judge(no_docs).count() == 0


def test_repeats_and_lines():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("ab \n#") for _ in range(rng.randint(0, 120)))
        n, _, _, lines, hit = plain_counts(text)
        words = text.encode().split()
        ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
        assert quality.repeated_words(np.array([ids[w] for w in words], np.int64)) == hit
        assert quality.repeated_words(np.array([ids[w] + (1 << 22) for w in words], np.int64)) == hit
        assert quality.duplicate_lines(text.encode()) == lines


def test_bands_keep_plain_texts_and_reject_junk(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 150), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, " ".join("".join(rng.choice("qxzj#%kwv") for _ in range(9)) for _ in range(150)), "en", "s", 0) for i in range(3)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(3))


def test_every_document_is_counted(spark, edge_docs, edge_rows):
    docs = spark.createDataFrame([(1, "### $$$ %%% | | one", "en", "s", 0)], SCHEMA)
    got = {r.gram: r.n for r in quality.count_grams(docs, "text", "lang").collect()}
    text = quality.BEGIN * 4 + "### $$$ %%% | | one" + quality.END
    assert got == Counter(text[i : i + 5] for i in range(len(text) - 4))
    found = quality.count_grams(edge_docs, "text", "lang").selectExpr("sum(n) AS n").first().n
    assert found == sum(len(b" ".join((t or "").encode().split()).decode()) + 1 for _, t, *_ in edge_rows)


def test_order_of_words_counts(spark):
    """Texts in which each word calls for the next: the same words in another order are less likely."""
    rng = random.Random(7)
    word = [f"{a}{b}{c}" for a, b, c in zip("bdfgklmnpr" * 4, "aeiou" * 8, "stnrl" * 8)]
    rows, other = [], []
    for i in range(80):
        at, words = rng.randrange(40), []
        for _ in range(150):
            words.append(word[at])
            at = (at * 7 + rng.randrange(2)) % 40
        rows.append((i, " ".join(words), "en", "s", 0))
        rng.shuffle(words)
        other.append((1000 + i, " ".join(words), "en", "s", 0))
    got = {r.doc_id: r.perplexity for r in quality.judge(spark.createDataFrame(rows + other[:8], SCHEMA)).collect()}
    assert min(got[1000 + i] for i in range(8)) > max(got[i] for i in range(80))


def test_both_bounds(spark):
    """Random letters are above the upper bound; common words and nothing else are below the lower."""
    rng = random.Random(8)
    common = "of the and to in that is was for on with as".split()
    rare = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    text = lambda share: " ".join(rng.choice(common) if rng.random() < share else rare() for _ in range(150))
    rows = [(i, text(rng.uniform(0.45, 0.55)), "en", "s", 0) for i in range(300)]
    rows += [(1000, " ".join("".join(rng.choice("bcdfglmnprstaeiouxz#") for _ in range(8)) for _ in range(150)), "en", "s", 0), (1001, text(1.0), "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for good in (None, spark.createDataFrame([(i,) for i in range(200)], "doc_id long")):
        got = {r.doc_id: r for r in quality.judge(docs, good).collect()}
        assert got[1000].perplexity > got[1000].high and not got[1000].kept
        assert got[1001].perplexity < got[1001].low and not got[1001].kept and not got[1001].base_failed
        assert sum(got[i].kept for i in range(300)) >= 294


def test_few_symbols_do_not_save_junk_and_copies_do_not_vouch(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, 150), "en", "s", 0) for i in range(60)]
    rows += [(60 + i, sentence(rng, 130) + " ### $$ % | * & # $ | <> # * | % $ & # | * < >", "en", "s", 0) for i in range(60)]
    letters = "".join(rows[0][1].split())
    junk = " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(150))
    rows += [(200 + i, junk, "en", "s", 0) for i in range(12)] + [(300, sentence(rng, 100), "xx", "s", 0)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(kept[200 + i] for i in range(12))
    assert sum(kept[i] for i in range(120)) == 120
