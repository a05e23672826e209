import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ing", "er"]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rng = random.Random(1)
    same = sentence(rng, 80)
    return [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", None, None, None), (4, same, "en", "s", 1), (5, same, "en", "s", 1), (5, same, "en", "s", 1),
        (None, same + " more", "en", None, None), (7, sentence(rng, 30_000), "en", "s", 1), (8, "x", "de", "s", 1), (9, "... 123 !!!", "de", "s", 1), (10, "a" * 200_000, "de", "s", 1), (11, "naïve café Ünder\u00a0x\u2028y 日本語 😀", "fr", "s", 2),
    ]


#: Names that operators use for their own columns.
CLASHES = "fp part first n_tokens ids grp rid sig pair id host path rule verdict spans score lang_pred kept n_words __laconic_key __laconic_row row keep key place text_ _id _text _state at reach shift words longest ratio log_mean lengths".split()


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows, SCHEMA)
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES))


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("doc_id > 1000").cache()


@pytest.fixture(scope="session")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
