"""The library's own queries over the driver's tables, each with DuckDB SQL where SQL can say it.

documents become corpora: source is the corpus, doc_id the order, text the content.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laconic.config import Settings
from laconic.functions import text as T
from laconic.functions.languages import admitted, detect_language, parsed_language, suffix
from laconic.operators import blocks, codebook, comments, patterns, rle, similarity, syntax, whitespace
from laconic.plans import compression, session
from laconic.plans.lineage import checkpointed
from laconic.sources import joined_parts, with_extensions

OWN = Settings()
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpora(spark: SparkSession, d: str, suffix: str = ".txt") -> DataFrame:
    docs = _table(spark, d, "documents")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(suffix))
    return docs.select(F.coalesce("source", F.lit("")).alias("corpus_id"), F.col("doc_id").alias("file_idx"), name.alias("filename"), F.coalesce("text", F.lit("")).alias("content"))


_FILES = "files AS (SELECT coalesce(source, '') AS corpus_id, doc_id AS file_idx, 'doc' || doc_id || '.txt' AS filename, coalesce(text, '') AS content FROM documents)"
_LINES = "lines AS (SELECT corpus_id, file_idx, string_split(content, chr(10)) AS l FROM files)"

# ---- sources, languages and comments

_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@_query(rf"""
WITH p AS (SELECT page_id, {_PATH} AS filename, strlen(html) AS size FROM pages),
q AS (SELECT *, string_split(filename, '/') AS parts, lower(regexp_extract(filename, '[^/.][^/]*(\.[^/.]+)$', 1)) AS suffix FROM p)
SELECT page_id, filename, suffix FROM q WHERE suffix IN ('.html', '.htm', '.xml', '.txt', '.md', '.json', '.py', '.js', '.css', '.php', '.sh')
AND size <= 1000000 AND len(list_filter(parts, lambda x: starts_with(x, '.') OR x IN ('build', 'dist', 'node_modules', 'venv', '__pycache__'))) = 0""")
def load_filter(spark, d):
    """Which pages the tree source would read, by path and size."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    pages = _table(spark, d, "pages").select("page_id", path.alias("filename"), F.octet_length("html").alias("size"))
    return pages.filter(admitted(F.col("filename"), F.col("size"))).select("page_id", "filename", suffix(F.col("filename")).alias("suffix"))


_SUFFIXES = (".py", ".tsx", ".kts", ".scss", ".htm", ".mjs", ".sql", ".yml", ".PY", "")


@_query("""
WITH n AS (SELECT doc_id, length(text) % 10 AS k, lower(regexp_extract(text, '[A-Za-z]+')) || (CASE length(text) % 10 WHEN 0 THEN '.py' WHEN 1 THEN '.tsx' WHEN 2 THEN '.kts' WHEN 3 THEN '.scss' WHEN 4 THEN '.htm' WHEN 5 THEN '.mjs' WHEN 6 THEN '.sql' WHEN 7 THEN '.yml' WHEN 8 THEN '.PY' ELSE '' END) AS filename FROM documents)
SELECT doc_id, filename, CASE k WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'kotlin' WHEN 3 THEN 'css' WHEN 4 THEN 'html' WHEN 7 THEN 'yaml' END AS comment_language,
  CASE k WHEN 0 THEN 'python' WHEN 1 THEN 'tsx' WHEN 5 THEN 'javascript' END AS tree_language FROM n""")
def detect_languages(spark, d):
    """Languages of files named by each text's first word, with a suffix by its length."""
    name = F.concat(F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)), F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.length("text") % 10 + 1).cast("int")))
    return _table(spark, d, "documents").select("doc_id", name.alias("filename"), detect_language(name).alias("comment_language"), parsed_language(name).alias("tree_language"))


_KEEP = "regexp_matches(lower({0}), 'bug|fixme|hack|todo|xxx|copyright|license|spdx')"


@_query(f"SELECT doc_id, {_KEEP.format('text')} AS kept FROM documents")
def keep_comment(spark, d):
    return _table(spark, d, "documents").select("doc_id", comments.keeps_comment(F.col("text"), OWN).alias("kept"))


@_query(rf"""
SELECT page_id, list_reduce(list_filter(regexp_extract_all(html, '<!--[\s\S]*?-->'), lambda c: NOT {_KEEP.format('c')}), lambda acc, c: replace(acc, c, ''), html) AS stripped FROM pages""")
def strip_markup(spark, d):
    return _table(spark, d, "pages").select("page_id", comments.strip_markup(F.col("html"), OWN).alias("stripped"))


_HASH = r"""'^((?:[^''"#]|''(?:[^''\\]|\\[\s\S])*''|"(?:[^"\\]|\\[\s\S])*")*)#'"""


@_query(rf"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN NOT regexp_matches(x, {_HASH}) THEN x
  WHEN {_KEEP.format(f"substr(x, length(regexp_extract(x, {_HASH}, 1)) + 1)")} THEN x ELSE rtrim(regexp_extract(x, {_HASH}, 1)) END) AS l FROM documents)
SELECT doc_id, array_to_string(l, chr(10)) AS stripped FROM l""")
def strip_hash(spark, d):
    return _table(spark, d, "documents").select("doc_id", comments.strip_hashes(F.col("text"), OWN).alias("stripped"))


_TOKENS = r"""'"(?:[^"\\]|\\[\s\S])*(?:"|\\?\z)|''(?:[^''\\]|\\[\s\S])*(?:''|\\?\z)|`(?:[^`\\]|\\[\s\S])*(?:`|\\?\z)|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|[^"''`/]+|/'"""


@_query(rf"""
SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, {_TOKENS}),
  lambda t: CASE WHEN (starts_with(t, '//') OR starts_with(t, '/*')) AND NOT {_KEEP.format('t')} THEN '' ELSE t END), '') AS stripped FROM pages""")
def strip_c_style(spark, d):
    """Whole pages, with their strings, URLs and scripts, as sources in the style of C."""
    return _table(spark, d, "pages").select("page_id", comments.strip_slashes(F.col("html"), OWN).alias("stripped"))


@_query(rf"""
SELECT page_id, CASE page_id % 3
  WHEN 0 THEN list_reduce(list_filter(regexp_extract_all(html, '<!--[\s\S]*?-->'), lambda c: NOT {_KEEP.format('c')}), lambda acc, c: replace(acc, c, ''), html)
  WHEN 1 THEN array_to_string(list_transform(regexp_extract_all(html, {_TOKENS}), lambda t: CASE WHEN (starts_with(t, '//') OR starts_with(t, '/*')) AND NOT {_KEEP.format('t')} THEN '' ELSE t END), '')
  ELSE html END AS stripped FROM pages""")
def comment_dispatch(spark, d):
    """Whole pages under names of three kinds: each has its own rules, or none."""
    name = F.concat(F.lit("page"), F.element_at(F.array(F.lit(".html"), F.lit(".js"), F.lit(".txt")), (F.col("page_id") % 3 + 1).cast("int")))
    return _table(spark, d, "pages").select("page_id", comments.strip_comments(F.col("html"), name, OWN, F.col("html")).alias("stripped"))


_FLAT = r"""rtrim(regexp_replace(text, '[^\pL\pN ,.#]', ' ', 'g'), ' ')"""


@_query(rf'''
WITH t AS (SELECT doc_id, {_FLAT} AS t FROM documents)
SELECT doc_id, CASE WHEN {_KEEP.format('t')} THEN '# ' || t || chr(10) ELSE '' END || 'x = "' || t || '"' || CASE WHEN {_KEEP.format('t')} THEN '  # ' || t ELSE '' END
  || chr(10) || 'def f():' || chr(10) || CASE WHEN {_KEEP.format('t')} THEN '    """' || t || '"""' || chr(10) ELSE '' END || '    return 1' AS stripped FROM t
''')
def strip_python(spark, d):
    """Python sources in which each whole text is a comment, a string, a comment behind code and a docstring."""
    t = F.rtrim(F.regexp_replace("text", r"[^\p{L}\p{N} ,.#]", " "))
    source = F.concat(F.lit("# "), t, F.lit('\nx = "'), t, F.lit('"  # '), t, F.lit('\ndef f():\n    """'), t, F.lit('"""\n    return 1'))
    return _table(spark, d, "documents").select("doc_id", comments.strip_python(source, OWN).alias("stripped"))


# ---- whitespace and runs

_PADDED = "chr(10) || chr(10) || replace(replace(text, '. ', '.   '), chr(10), '  ' || chr(10) || chr(10) || ' ' || chr(10)) || '  ' || chr(10)"


def _padded():
    return F.concat(F.lit("\n\n"), F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".   ")), F.lit("\n"), F.lit("  \n\n \n")), F.lit("  \n"))


_NORMAL = r"regexp_replace(trim(regexp_replace(rtrim(regexp_replace({0}, ' +\n', chr(10), 'g'), ' '), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), '([^ \n]) {{2,}}', '\1 ', 'g')"


@_query(f"SELECT doc_id, {_NORMAL.format(_PADDED)} AS normalized FROM documents")
def ws_normalize(spark, d):
    return _table(spark, d, "documents").select("doc_id", whitespace.normalize_whitespace(_padded()).alias("normalized"))


@_query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text || chr(10) || repeat('=', doc_id % 9) || 'x' || repeat('-', doc_id % 7), chr(10))) AS line, generate_subscripts(string_split(text || chr(10) || 'x', chr(10)), 1) AS k FROM documents),
c AS (SELECT doc_id, k, line, unnest(regexp_extract_all(line, '[\s\S]')) AS ch, generate_subscripts(regexp_extract_all(line, '[\s\S]'), 1) AS i FROM l),
g AS (SELECT doc_id, k, ch, i, i - row_number() OVER (PARTITION BY doc_id, k, ch ORDER BY i) AS run FROM c),
r AS (SELECT doc_id, k, min(i) AS i, CASE WHEN count(*) >= 4 AND NOT regexp_matches(ch, '[\pL\pN ]') THEN '"' || ch || '"*' || count(*) ELSE repeat(ch, count(*)) END AS t FROM g GROUP BY doc_id, k, ch, run),
e AS (SELECT doc_id, k, string_agg(t, '' ORDER BY i) AS t FROM r GROUP BY doc_id, k),
b AS (SELECT l.doc_id, l.k, CASE WHEN e.t IS NOT NULL AND length(e.t) < length(line) THEN e.t ELSE line END AS t FROM l LEFT JOIN e ON l.doc_id = e.doc_id AND l.k = e.k)
SELECT doc_id, string_agg(t, chr(10) ORDER BY k) AS encoded FROM b GROUP BY doc_id""")
def rle_lines(spark, d):
    more = F.expr("concat(text, '\\n', repeat('=', cast(doc_id % 9 as int)), 'x', repeat('-', cast(doc_id % 7 as int)))")
    return _table(spark, d, "documents").select("doc_id", rle.encode_runs(more).alias("encoded"))


@_query("""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l FROM documents)
SELECT doc_id, i::BIGINT AS start, md5(array_to_string(l[i + 1:i + 3], chr(10))) AS h FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS i FROM l WHERE len(l) >= 3)""")
def block_hash(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", T.lines(F.col("text")).alias("l")).filter("size(l) >= 3")
    placed = docs.withColumn("i", F.explode(F.expr("sequence(0, size(l) - 3)")))
    return placed.select("doc_id", F.col("i").cast("long").alias("start"), T.block_hash(F.expr("slice(l, i + 1, 3)")).alias("h"))


@_query("""
WITH l AS (SELECT doc_id, list_transform(string_split(trim(text, ' ' || chr(10)), chr(10)), lambda x: trim(x)) AS l FROM documents)
SELECT doc_id, array_to_string(l, chr(10)) AS normalized FROM l""")
def pattern_normalize(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.normalized(F.col("text")).alias("normalized"))


@_query(r"SELECT doc_id, len(regexp_extract_all(text, '[\pL\pN]{1,4}|[^\pL\pN\s]'))::BIGINT AS tokens FROM documents")
def approx_tokens(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


# ---- codebooks


def _windows_sql(first: int, last: int) -> str:
    return f"""{_FILES}, {_LINES},
w AS (SELECT corpus_id, array_to_string(l[i:i + n - 1], chr(10)) AS pattern FROM (SELECT corpus_id, n, list_transform(l, lambda x: trim(x)) AS l, unnest(range(1, len(l) - n + 2)) AS i FROM lines, (SELECT unnest(range({first}, {last + 1})) AS n) WHERE len(l) >= n)),
scored AS (SELECT corpus_id, pattern, count(*) AS count, ((length(pattern) - 5) * count(*))::BIGINT AS score FROM w WHERE length(pattern) >= 30 GROUP BY corpus_id, pattern HAVING count(*) >= 3)"""


@_query(f"WITH {_windows_sql(1, 1)} SELECT * FROM scored")
def line_patterns(spark, d):
    return patterns.line_patterns(corpora(spark, d), 30, 3, 1).withColumn("score", F.col("score").cast("long"))


@_query(f"WITH {_windows_sql(2, 5)} SELECT * FROM scored")
def ngram_patterns(spark, d):
    return patterns.line_patterns(corpora(spark, d), 30, 3, 5, 2).withColumn("score", F.col("score").cast("long"))


def _top_sql(last: int = 5) -> str:
    return f"""{_windows_sql(1, last)},
top AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY score DESC, pattern DESC, count DESC) AS rank FROM scored QUALIFY rank <= 100)"""


@_query(f"WITH {_top_sql()} SELECT corpus_id, rank::BIGINT AS rank, pattern, count, score FROM top")
def codebook_topk(spark, d):
    top = codebook.candidates(corpora(spark, d), 30, 3, 50)
    return top.select("corpus_id", F.col("rank").cast("long").alias("rank"), "pattern", "count", F.col("score").cast("long").alias("score"))


def _book_sql(last: int = 5) -> str:
    return f"""{_top_sql(last)},
r(corpus_id, k, chosen) AS (SELECT DISTINCT corpus_id, 0::BIGINT, []::STRUCT(code_idx BIGINT, pattern VARCHAR, count BIGINT, score BIGINT)[] FROM top
  UNION ALL SELECT r.corpus_id, r.k + 1, CASE WHEN len(chosen) < 50
    AND len(list_filter(chosen, lambda e: contains(e.pattern, t.pattern) OR contains(t.pattern, e.pattern))) = 0
    AND (length(t.pattern) - length('[D' || (len(chosen) + 1) || ']')) * (t.count - 1) >= 10
    THEN list_append(chosen, {{'code_idx': len(chosen) + 1, 'pattern': t.pattern, 'count': t.count, 'score': t.score}}) ELSE chosen END
  FROM r JOIN top t ON t.corpus_id = r.corpus_id AND t.rank = r.k + 1),
book AS (SELECT corpus_id, max_by(chosen, k) AS entries FROM r GROUP BY corpus_id HAVING len(max_by(chosen, k)) > 0)"""


@_query(f"WITH RECURSIVE {_book_sql()}, e AS (SELECT corpus_id, unnest(entries) AS e FROM book) SELECT corpus_id, e.code_idx AS code_idx, 'D' || e.code_idx AS code, e.pattern AS pattern, e.count AS count, e.score AS score FROM e")
def codebook_select(spark, d):
    books = codebook.build_codebooks(corpora(spark, d), 30, 3, 50)
    return codebook.entry_rows(books).drop("display").withColumn("code_idx", F.col("code_idx").cast("long"))


_SHOWN = "CASE WHEN length(replace(e.pattern, chr(10), ' | ')) > 120 THEN substr(replace(e.pattern, chr(10), ' | '), 1, 117) || '...' ELSE replace(e.pattern, chr(10), ' | ') END"


@_query(f"""WITH RECURSIVE {_book_sql()} SELECT corpus_id, '[CODEBOOK]' || chr(10) || array_to_string(list_transform(entries, lambda e: '# D' || e.code_idx || ' = ' || {_SHOWN}), chr(10)) || chr(10) || '[/CODEBOOK]' || chr(10) AS header FROM book""")
def codebook_header(spark, d):
    return codebook.build_codebooks(corpora(spark, d), 30, 3, 50).select("corpus_id", codebook.header(F.col("entries")).alias("header"))


@_query(f"""WITH RECURSIVE {_book_sql(1)},
ready AS (SELECT corpus_id, list_sort(list_transform(entries, lambda e: {{'k': -length(e.pattern), 'i': e.code_idx, 'p': e.pattern}})) AS ready FROM book)
SELECT f.corpus_id, file_idx, CASE WHEN ready IS NULL THEN content ELSE list_reduce(list_transform(ready, lambda e: [e.p, '[D' || e.i || ']']), lambda a, e: [replace(a[1], e[1], e[2])], [content])[1] END AS coded
FROM files f LEFT JOIN ready ON f.corpus_id = ready.corpus_id""")
def codebook_apply(spark, d):
    """A codebook of single lines, applied."""
    files = corpora(spark, d)
    books = codebook.choose_entries(codebook.candidates(files, 30, 3, 50, most_lines=1), 50)
    return codebook.apply_codebooks(files, books).select("corpus_id", "file_idx", "coded")


@_query("SELECT coalesce(source, '') AS corpus_id, doc_id AS file_idx, coalesce(text, '') AS expanded FROM documents")
def codebook_round_trip(spark, d):
    """Applied and expanded again: the text comes back."""
    files = corpora(spark, d)
    books = codebook.build_codebooks(files, 30, 3, 50)
    coded = codebook.apply_codebooks(files, books).join(books, "corpus_id", "left")
    empty = F.array().cast(books.schema["entries"].dataType)
    return coded.select("corpus_id", "file_idx", codebook.expand_entries(F.col("coded"), F.coalesce("entries", empty)).alias("expanded"))


_IMPORTS = "CASE doc_id % 3 WHEN 0 THEN 'import a' || chr(10) || 'from b import c' || chr(10) || 'x = 1' || chr(10) || chr(10) || chr(10) || 'import d' || chr(10) || 'import e' WHEN 1 THEN 'import a' || chr(10) || chr(10) || '  import b' ELSE 'import a' || chr(10) || 'y' || chr(10) || 'z' || chr(10) || 'import b' END || chr(10) || text"


@_query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split({_IMPORTS}, chr(10))) AS line, generate_subscripts(string_split({_IMPORTS}, chr(10)), 1) - 1 AS k FROM documents),
m AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 2 THEN 0 ELSE 1 END AS fresh FROM l WHERE regexp_matches(trim(line), '^(import|from)\s')),
g AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM m)
SELECT doc_id, min(k)::BIGINT AS first, max(k)::BIGINT AS last FROM g GROUP BY doc_id, g HAVING count(*) > 1""")
def import_blocks(spark, d):
    text = F.expr(_IMPORTS.replace("chr(10)", "'\\n'"))
    found = _table(spark, d, "documents").select("doc_id", F.explode(syntax.import_islands(text)).alias("b"))
    return found.select("doc_id", F.col("b.first").cast("long").alias("first"), F.col("b.last").cast("long").alias("last"))


@_query("""
WITH t AS (SELECT source AS corpus_id, coalesce(lang, 'none') AS lang, regexp_extract(text, '[A-Za-z]+') AS w FROM documents)
SELECT corpus_id, pattern, count(*) AS count, sum(length(pattern) - 5)::BIGINT - (length(pattern) - 5) AS score FROM
(SELECT corpus_id, unnest(['import os' || chr(10) || 'import sys' || chr(10) || 'import lang_' || lang, 'def function_' || lower(w) || '(value):' || chr(10) || '    return value + "' || w || '"']) AS pattern FROM t)
WHERE length(pattern) >= 30 GROUP BY corpus_id, pattern HAVING count(*) >= 3""")
def syntax_patterns(spark, d):
    """Python sources about each text's language and first word: import blocks and bodies, grouped over each source."""
    lang = _table(spark, d, "documents").select(F.col("doc_id").alias("file_idx"), F.coalesce("lang", F.lit("none")).alias("lang"))
    word = F.regexp_extract("content", "[A-Za-z]+", 0)
    source = F.concat(F.lit("import os\nimport sys\nimport lang_"), F.col("lang"), F.lit("\n\ndef function_"), F.lower(word), F.lit('(value):\n    return value + "'), word, F.lit('"'))
    found = syntax.extract_patterns(corpora(spark, d, ".py").join(lang, "file_idx").withColumn("content", source), "content")
    return patterns.group_patterns(found, 30, 3).withColumn("score", F.col("score").cast("long"))


# ---- blocks and similarity

_BLOCKS = f"""{_FILES}, {_LINES},
w AS (SELECT corpus_id, file_idx, n, i, md5(array_to_string(list_transform(l[i + 1:i + n], lambda x: trim(x)), chr(10))) AS h, length(array_to_string(l[i + 1:i + n], chr(10))) AS chars,
  len(list_filter(l[i + 1:i + n], lambda x: trim(x) <> '')) AS filled
  FROM (SELECT corpus_id, file_idx, l, n, unnest(range(0, len(l) - n + 1)) AS i FROM lines, (SELECT unnest(range(3, 21)) AS n) WHERE len(l) >= n)),
s AS (SELECT corpus_id, h, min(n) AS n, min(file_idx) AS ref_file_idx, min_by(i, (file_idx, i)) AS ref_start, min_by(chars, (file_idx, i)) AS chars FROM w WHERE filled >= 3 GROUP BY corpus_id, h HAVING min(file_idx) < max(file_idx))"""


@_query(f"WITH {_BLOCKS} SELECT corpus_id, h, n::BIGINT AS n, ref_file_idx, ref_start::BIGINT AS ref_start, chars::BIGINT AS chars FROM s WHERE chars >= 30")
def shared_blocks(spark, d):
    found = blocks.shared_blocks(blocks.block_windows(corpora(spark, d), 3, 20), 30)
    return found.select("corpus_id", "h", F.col("n").cast("long").alias("n"), "ref_file_idx", F.col("ref_start").cast("long").alias("ref_start"), F.col("chars").cast("long").alias("chars"))


@_query(f"""
WITH RECURSIVE {_BLOCKS},
c AS (SELECT w.corpus_id, w.file_idx, w.i, w.n, s.ref_file_idx, s.ref_start, row_number() OVER (PARTITION BY w.corpus_id, w.file_idx ORDER BY s.chars DESC, s.ref_file_idx, w.n DESC, s.ref_start, w.i) AS k
  FROM w JOIN s ON w.corpus_id = s.corpus_id AND w.h = s.h WHERE s.chars >= 30 AND w.filled >= 3 AND w.file_idx <> s.ref_file_idx),
r(corpus_id, file_idx, k, taken) AS (SELECT DISTINCT corpus_id, file_idx, 0::BIGINT, []::STRUCT(i BIGINT, n BIGINT, f BIGINT, s BIGINT)[] FROM c
  UNION ALL SELECT r.corpus_id, r.file_idx, r.k + 1, CASE WHEN len(list_filter(taken, lambda e: e.i < c.i + c.n AND c.i < e.i + e.n)) = 0
    THEN list_append(taken, {{'i': c.i, 'n': c.n, 'f': c.ref_file_idx, 's': c.ref_start}}) ELSE taken END
  FROM r JOIN c ON c.corpus_id = r.corpus_id AND c.file_idx = r.file_idx AND c.k = r.k + 1),
packed AS (SELECT corpus_id, file_idx, unnest(max_by(taken, k)) AS e FROM r GROUP BY corpus_id, file_idx),
cover AS (SELECT corpus_id, file_idx, e, unnest(range(e.i, e.i + e.n)) AS k FROM packed),
one AS (SELECT corpus_id, file_idx, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS k FROM lines)
SELECT one.corpus_id, one.file_idx, string_agg(CASE WHEN e IS NULL THEN line WHEN one.k = e.i THEN '[same as doc' || e.f || '.txt:' || (e.s + 1) || '-' || (e.s + e.n) || ']' END, chr(10) ORDER BY one.k) AS deduped
FROM one LEFT JOIN cover ON one.corpus_id = cover.corpus_id AND one.file_idx = cover.file_idx AND one.k = cover.k GROUP BY one.corpus_id, one.file_idx""")
def dedup_pack(spark, d):
    """Texts with shared blocks as notes."""
    return blocks.dedup_blocks(corpora(spark, d), 3, 20, 30, checkpointed).select("corpus_id", "file_idx", "deduped")


@_query(f"WITH {_FILES} SELECT a.corpus_id, a.file_idx AS i, b.file_idx AS j FROM files a JOIN files b ON a.corpus_id = b.corpus_id AND a.file_idx < b.file_idx WHERE length(a.content) + length(b.content) = 0 OR 2.0 * least(length(a.content), length(b.content)) >= 0.8 * (length(a.content) + length(b.content))")
def length_band_pairs(spark, d):
    return similarity.length_pairs(corpora(spark, d), 0.8)


@_query()
def similar_pairs(spark, d):
    return similarity.similar_pairs(corpora(spark, d), 0.8)


@_query(f"WITH {_FILES}, k AS (SELECT corpus_id, file_idx AS j, min(file_idx) OVER (PARTITION BY corpus_id, trim(content)) AS i FROM files) SELECT corpus_id, j, i FROM k WHERE i < j")
def leader_clusters(spark, d):
    """Leaders and followers where similar means the same stripped text."""
    files = corpora(spark, d).select("corpus_id", "file_idx", T.strip(F.col("content")).alias("t"))
    least = F.min("file_idx").over(Window.partitionBy("corpus_id", "t"))
    edges = files.select("corpus_id", least.alias("i"), F.col("file_idx").alias("j")).filter("i < j")
    return similarity.leaders(edges, checkpointed)


@_query()
def delta_encode(spark, d):
    return similarity.encode_deltas(corpora(spark, d), 0.8, checkpointed).select("corpus_id", "file_idx", "encoded")


@_query(f"""WITH {_FILES}, k AS (SELECT *, min(file_idx) OVER (PARTITION BY corpus_id, content) AS i FROM files)
SELECT corpus_id, file_idx, CASE WHEN i < file_idx THEN '[identical to doc' || i || '.txt]' ELSE content END AS encoded FROM k""")
def delta_identical(spark, d):
    """Deltas at a threshold of one: copies name the first of them."""
    return similarity.encode_deltas(corpora(spark, d), 1.0, checkpointed).select("corpus_id", "file_idx", "encoded")


# ---- guard, savings and sessions


@_query(f"""WITH p AS (SELECT doc_id, {_PADDED} AS s0, {_NORMAL.format(_PADDED)} AS s2, left(text, (length(text) * (doc_id % 10) // 10)::BIGINT) AS s5 FROM documents)
SELECT doc_id, CASE WHEN length(s0) > 0 AND length(s5)::DOUBLE / length(s0) < 0.5 THEN s2 ELSE s5 END AS kept, length(s0) > 0 AND length(s5)::DOUBLE / length(s0) < 0.5 AS backed_off FROM p""")
def backoff_guard(spark, d):
    s0, s5 = _padded(), F.expr("left(text, cast(length(text) * (doc_id % 10) div 10 as int))")
    kept, over = compression.guarded(s0, whitespace.normalize_whitespace(s0), s5, 0.5)
    return _table(spark, d, "documents").select("doc_id", kept.alias("kept"), over.alias("backed_off"))


@_query(f"""WITH p AS (SELECT source AS corpus_id, {_PADDED} AS s0, {_NORMAL.format(_PADDED)} AS s1 FROM documents)
SELECT corpus_id, (sum(length(s0)) + count(*) - 1)::BIGINT AS original_chars, (sum(length(s1)) + count(*) - 1)::BIGINT AS compressed_chars, (sum(length(s0)) - sum(length(s1)))::BIGINT AS saved,
  round((1 - (sum(length(s1)) + count(*) - 1)::DOUBLE / (sum(length(s0)) + count(*) - 1)) * 100, 6) AS char_savings_pct FROM p GROUP BY corpus_id""")
def corpus_stats(spark, d):
    """Characters and savings by source where the whitespace stage is the only one."""
    rows = _table(spark, d, "documents").select(F.col("source").alias("corpus_id"), _padded().alias("s0")).withColumn("s1", whitespace.normalize_whitespace(F.col("s0")))
    for k in range(2, 6):
        rows = rows.withColumn(f"s{k}", F.col("s1"))
    stats = compression.corpus_stats(rows.withColumn("final", F.col("s5")))
    return stats.select("corpus_id", "original_chars", "compressed_chars", F.col("stage_savings")["comment_stripper"].alias("saved"), F.round("char_savings_pct", 6).alias("char_savings_pct"))


@_query(f"""WITH p AS (SELECT source AS corpus_id, {_PADDED} AS s0, {_NORMAL.format(_PADDED)} AS s1 FROM documents)
SELECT corpus_id, 'whitespace_normalizer' AS stage, (sum(length(s0)) - sum(length(s1)))::BIGINT AS saved FROM p GROUP BY corpus_id HAVING sum(length(s0)) > sum(length(s1))""")
def nonzero_stages(spark, d):
    """Stages that saved something, where whitespace is the only one that can."""
    rows = _table(spark, d, "documents").select(F.col("source").alias("corpus_id"), _padded().alias("s0")).withColumn("s1", F.col("s0"))
    rows = rows.withColumn("s2", whitespace.normalize_whitespace(F.col("s0")))
    for k in range(3, 6):
        rows = rows.withColumn(f"s{k}", F.col("s2"))
    stats = compression.positive_savings(compression.corpus_stats(rows.withColumn("final", F.col("s5"))))
    return stats.select("corpus_id", F.explode("stage_savings").alias("stage", "saved"))


def _events(spark, d):
    turns = _table(spark, d, "conversations")
    size = F.length("text").cast("long")
    names = F.transform(F.sequence(F.lit(0), F.col("turn").cast("int")), lambda k: F.concat(F.lit("f"), k.cast("string")))
    return turns.select("conv_id", "turn", names.alias("files"), F.floor(size / 4).alias("original_tokens"), F.floor(size / 6).alias("compressed_tokens"), size.alias("original_chars"), F.floor(size / 2).alias("compressed_chars"))


_EVENTS = "e AS (SELECT conv_id, turn, length(text) // 4 AS ot, length(text) // 6 AS ct, length(text) AS oc, length(text) // 2 AS cc FROM conversations)"


@_query(f"""WITH {_EVENTS} SELECT conv_id, count(*) AS events, sum(ot)::BIGINT AS original_tokens, sum(ct)::BIGINT AS compressed_tokens, sum(oc)::BIGINT AS original_chars, sum(cc)::BIGINT AS compressed_chars,
  (sum(ot) - sum(ct))::BIGINT AS saved_tokens, round(CASE WHEN sum(ot) = 0 THEN 0 ELSE (1 - sum(ct)::DOUBLE / sum(ot)) * 100 END, 6) AS saved_pct FROM e GROUP BY conv_id""")
def session_totals(spark, d):
    return session.totals(_events(spark, d), "conv_id").withColumn("saved_pct", F.round("saved_pct", 6))


@_query(f"""WITH {_EVENTS} SELECT conv_id, row_number() OVER w AS event_no, sum(ot) OVER w::BIGINT AS running_original_tokens, sum(ct) OVER w::BIGINT AS running_compressed_tokens,
  '  #' || row_number() OVER w || ': ' || array_to_string(list_transform(range(0, least(turn + 1, 3)), lambda k: 'f' || k), ', ') || CASE WHEN turn + 1 > 3 THEN ' +' || (turn - 2) || ' more' ELSE '' END
  || ' | ' || ot || ' -> ' || ct || ' tokens (' || round(CASE WHEN ot = 0 THEN 0 ELSE (1 - ct::DOUBLE / ot) * 100 END)::INT || '% saved)' AS line
FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, ot, ct ROWS UNBOUNDED PRECEDING)""")
def session_running(spark, d):
    numbered = session.running(_events(spark, d), ("conv_id",), ("turn", "original_tokens", "compressed_tokens"))
    return session.event_lines(numbered).select("conv_id", "event_no", "running_original_tokens", "running_compressed_tokens", "line")


@_query(f"WITH {_FILES} SELECT corpus_id, filename, md5(CASE WHEN n > 1 THEN '--- ' || filename || ' ---' || chr(10) || content ELSE content END) AS part_md5 FROM (SELECT *, count(*) OVER (PARTITION BY corpus_id) AS n FROM files)")
def concat_sink(spark, d):
    """What the concatenating sink writes of each file, as a digest."""
    return joined_parts(corpora(spark, d), "content").select("corpus_id", "filename", F.md5("part").alias("part_md5"))


@_query(f"WITH {_FILES} SELECT corpus_id, file_idx FROM files WHERE ends_with(filename, '7.txt') OR ends_with(filename, '9.txt')")
def extension_filter(spark, d):
    return with_extensions(corpora(spark, d), ["7.txt", "9.txt"]).select("corpus_id", "file_idx")


@_query(f"WITH {_FILES} SELECT corpus_id, file_idx, file_idx IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_target FROM files")
def target_split(spark, d):
    """Targets (here the toxic documents) and the rest."""
    marked = _table(spark, d, "labels").filter("toxic = 1").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"))
    return compression.mark_targets(corpora(spark, d), marked).select("corpus_id", "file_idx", "is_target")


@_query(f"WITH {_FILES} SELECT corpus_id, sum(n)::BIGINT AS tokens FROM (SELECT corpus_id, len(regexp_extract_all(string_agg(content, chr(10) ORDER BY file_idx), '[\\pL\\pN]{{1,4}}|[^\\pL\\pN\\s]'))::BIGINT AS n FROM files GROUP BY corpus_id) GROUP BY corpus_id")
def corpus_tokens(spark, d):
    """Rough tokens of each source's joined text."""
    return compression.token_sums(corpora(spark, d), T.approx_tokens, "content").withColumnRenamed("content", "tokens")


@_query(f"""WITH RECURSIVE {_book_sql(1)},
ready AS (SELECT corpus_id, list_sort(list_transform(entries, lambda e: {{'k': -length(e.pattern), 'i': e.code_idx, 'p': e.pattern}})) AS ready,
  '[CODEBOOK]' || chr(10) || array_to_string(list_transform(entries, lambda e: '# D' || e.code_idx || ' = ' || {_SHOWN}), chr(10)) || chr(10) || '[/CODEBOOK]' || chr(10) AS head FROM book),
coded AS (SELECT f.corpus_id, f.content, head, list_reduce(list_transform(ready, lambda e: [e.p, '[D' || e.i || ']']), lambda a, e: [replace(a[1], e[1], e[2])], [content])[1] AS coded
  FROM files f JOIN ready ON f.corpus_id = ready.corpus_id)
SELECT corpus_id, length(any_value(head))::BIGINT AS header_chars, (sum(length(content)) - sum(length(coded)))::BIGINT AS saved, sum(length(content)) - sum(length(coded)) > length(any_value(head)) AS has_header
FROM coded GROUP BY corpus_id""")
def header_gate(spark, d):
    """Whether a corpus' codebook of single lines saves more than its header takes."""
    files = corpora(spark, d)
    books = codebook.choose_entries(codebook.candidates(files, 30, 3, 50, most_lines=1), 50)
    saved = codebook.apply_codebooks(files, books).groupBy("corpus_id").agg((F.sum(F.length("content")) - F.sum(F.length("coded"))).cast("long").alias("saved"))
    heads = books.select("corpus_id", F.length(codebook.header(F.col("entries"))).cast("long").alias("header_chars")).join(saved, "corpus_id")
    return heads.select("corpus_id", "header_chars", "saved", compression.pays(F.col("saved"), F.col("header_chars")).alias("has_header"))


_UNION = f"""{_windows_sql(1, 5)}, given AS (SELECT corpus_id, content AS pattern, count(*) AS count, ((length(content) - 5) * count(*))::BIGINT AS score FROM files WHERE length(content) >= 30 GROUP BY corpus_id, content HAVING count(*) >= 2),
u AS (SELECT * FROM scored UNION ALL SELECT * FROM given)"""


@_query(f"WITH {_UNION} SELECT corpus_id, rank::BIGINT AS rank, pattern, count, score FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY score DESC, pattern DESC, count DESC) AS rank FROM u) WHERE rank <= 100")
def candidate_union(spark, d):
    """Line patterns together with patterns from elsewhere: here whole texts that occur twice or more."""
    files = corpora(spark, d)
    whole = files.filter("length(content) >= 30").groupBy("corpus_id", F.col("content").alias("pattern")).agg(F.count(F.lit(1)).alias("count")).filter("count >= 2")
    whole = whole.withColumn("score", (F.length("pattern") - 5) * F.col("count"))
    top = codebook.candidates(files, 30, 3, 50, whole)
    return top.select("corpus_id", F.col("rank").cast("long").alias("rank"), "pattern", "count", F.col("score").cast("long").alias("score"))


# ---- the whole plan


@_query()
def compress_pipeline(spark, d):
    """All stages over documents, a corpus a source: names, lengths and the compressed text."""
    done = compression.compress(corpora(spark, d), OWN, python=False)
    return done.files.select("corpus_id", "file_idx", "compressed", "backed_off")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each corpus' codebook, best first."""
    return codebook_topk(spark, d)
