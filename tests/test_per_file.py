"""Per-file operators: the reference inputs, and random texts against plain restatements."""

import random
import re

import pytest
from pyspark.sql import functions as F

from laconic.config import Settings
from laconic.functions import text as T
from laconic.functions.languages import admitted
from laconic.operators import comments, rle, whitespace
from laconic.sources import admits

OWN = Settings()


def column(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def stripped(spark, name, text):
    return column(spark, [text], lambda x: comments.strip_comments(x, F.lit(name), OWN))[0]


def test_python_comments(spark):
    out = stripped(spark, "a.py", "x = 1  # one\ny = 2\nz = f(x)  # call\n")
    assert out == "x = 1\ny = 2\nz = f(x)\n"
    assert "# TODO later" in stripped(spark, "a.py", "# TODO later\n# plain\nx = 1")
    assert "# plain" not in stripped(spark, "a.py", "# TODO later\n# plain\nx = 1")
    kept = stripped(spark, "a.py", "# Copyright 2024 X\n# License: Y\nx = 1")
    assert kept == "# Copyright 2024 X\n# License: Y\nx = 1"
    assert stripped(spark, "a.py", 'u = "http://a/#b"  # gone') == 'u = "http://a/#b"'


def test_docstrings():
    words = OWN.keep_words()
    source = '"""Module."""\ndef f(a):\n    \'\'\'Doc\n    more\'\'\'\n    return g(\n        """text"""\n    )\nclass A:\n    r"""Doc."""\n    x = """kept"""\n'
    want = 'def f(a):\n    return g(\n        """text"""\n    )\nclass A:\n    x = """kept"""\n'
    assert comments.strip_python_source(source, words) == want
    assert '"""text"""' not in comments.strip_python_source(source, words, anywhere=True)
    assert comments.strip_python_source("def f(:\n  x = '#' # gone\n", words) == "def f(:\n  x = '#'\n"
    assert comments.strip_python_source("if x:\n        a # b\n    c # d", words) == "if x:\n        a\n    c"


def test_other_languages(spark):
    out = stripped(spark, "a.js", "// gone\nconst a = 1; // gone\n/* gone\n gone */\nconst b = '// stays';")
    assert "gone" not in out and "const a = 1;" in out and "const b = '// stays';" in out
    assert stripped(spark, "a.xyz", "text # stays") == "text # stays"
    assert stripped(spark, "a.html", "<a><!-- gone --><!-- TODO --><!-- open") == "<a><!-- TODO --><!-- open"
    assert stripped(spark, "a.yml", "k: '#1' # gone\nv: 2 # fixme") == "k: '#1'\nv: 2 # fixme"
    assert stripped(spark, "X.PY", "x # stays") == "x # stays"


def plain_slashes(s, words):
    out, i, quote = [], 0, None
    while i < len(s):
        if quote and s[i] == "\\":
            out.append(s[i : i + 2])
            i += 2
        elif quote:
            out.append(s[i])
            quote = None if s[i] == quote else quote
            i += 1
        elif s[i] in "'\"`":
            quote = s[i]
            out.append(s[i])
            i += 1
        elif s[i : i + 2] in ("//", "/*"):
            if s[i + 1] == "/":
                end = s.find("\n", i)
                end = len(s) if end < 0 else end
            else:
                end = s.find("*/", i + 2)
                end = len(s) if end < 0 else end + 2
            if any(w in s[i:end].lower() for w in words):
                out.append(s[i:end])
            i = end
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


def plain_hashes(s, words):
    return "\n".join(comments._plain_hash_line(x, words) for x in s.split("\n"))


def plain_markup(s, words):
    return re.sub(r"<!--[\s\S]*?-->", lambda m: m.group() if any(w in m.group().lower() for w in words) else "", s)


def plain_whitespace(s):
    lines = [x.rstrip() for x in s.split("\n")]
    out = [x for i, x in enumerate(lines) if x or (i and lines[i - 1])]
    while out and not out[0]:
        out.pop(0)
    while out and not out[-1]:
        out.pop()
    return re.sub(r"(?<=\S) {2,}(?=\S)", " ", "\n".join(out))


def plain_runs(s):
    def one(line):
        out = re.sub(r"(.)\1{3,}", lambda m: f'"{m.group(1)}"*{len(m.group())}' if not m.group(1).isalnum() and m.group(1) != " " else m.group(), line)
        return out if len(out) < len(line) else line

    return "\n".join(map(one, s.split("\n")))


RANDOM = {
    "slashes": (["/", "*", "//", "/*", "*/", "'", '"', "`", "\\", "\n", "a", " ", "todo", "License"], lambda x: comments.strip_slashes(x, OWN), lambda s: plain_slashes(s, OWN.keep_words())),
    "hashes": (["#", "'", '"', "\\", "\n", "a", " ", "\t", "bug", "\u00a0"], lambda x: comments.strip_hashes(x, OWN), lambda s: plain_hashes(s, OWN.keep_words())),
    "markup": (["<!--", "-->", "<!", "--", ">", "a", "\n", "xxx"], lambda x: comments.strip_markup(x, OWN), lambda s: plain_markup(s, OWN.keep_words())),
    "whitespace": ([" ", "  ", "\t", "\n", "\n\n", "a", "b", "\r", "\u00a0", "\x1c", "\x85", "\u3000"], whitespace.normalize_whitespace, plain_whitespace),
    "runs": (["=", "==", "====", "-", "a", "aaaa", " ", "    ", "_", "\n", "\t", "😀", "é"], rle.encode_runs, plain_runs),
    "strip": ([" ", "\t", "\n", "a", "\u00a0", "\x1c", "\x85", "\u3000"], T.strip, str.strip),
}


@pytest.mark.parametrize("name", RANDOM)
def test_random_texts_like_plain(spark, name):
    pieces, make, plain = RANDOM[name]
    rng = random.Random(name)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert column(spark, texts, make) == [plain(t) for t in texts]


def test_whitespace_and_run_examples(spark):
    norm = lambda t: column(spark, [t], whitespace.normalize_whitespace)[0]
    assert norm("line1\n\n\n\n\nline2") == "line1\n\nline2"
    assert norm("line1   \nline2\t") == "line1\nline2"
    assert norm("a\n    b\n        c") == "a\n    b\n        c"
    assert norm("x  =   1") == "x = 1"
    once = norm("a  b \n\n\n c")
    assert norm(once) == once
    code = lambda t: column(spark, [t], rle.encode_runs)[0]
    assert '"="*40' in code("print('" + "=" * 40 + "')")
    assert code("'==='") == "'==='" and code("a" * 10) == "a" * 10
    assert column(spark, ["\t" * 9 + "x"], lambda x: rle.encode_runs(x, spare_indentation=True)) == ["\t" * 9 + "x"]


def test_admission_agrees(spark):
    names = ["a.py", "src/b.TXT", ".env", "id_rsa", "venv/a.py", "x/.git/a.py", ".hid.py", "a", "a/b.c/d", "secrets.yaml", "k.yaml", "__init__.py", "a.tar.md"]
    got = column(spark, names, lambda x: admitted(x, F.lit(10)))
    assert got == [admits(n, 10) for n in names]


def test_token_counts(spark):
    assert column(spark, ["some words, 12345", ""], T.approx_tokens) == [6, 0]
    assert column(spark, ["some"], T.count_tokens(None)) == [None]
    P = pytest.importorskip("public_tokenizers")
    assert column(spark, ["hello world", None], T.count_tokens(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)) == [2, None]
    assert column(spark, ["/home/me/x", "/tmp/x"], lambda x: T.shorten_home(x, "/home/me")) == ["~/x", "/tmp/x"]
    assert column(spark, ["a\r\nb\rc"], T.universal_newlines) == ["a\nb\nc"]
