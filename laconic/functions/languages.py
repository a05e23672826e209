"""Languages by file suffix; suffixes are case-sensitive."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_BY_LANGUAGE = {
    "c": ".c .h", "cpp": ".cc .cpp .hpp", "csharp": ".cs", "css": ".css .scss", "go": ".go", "html": ".htm .html",
    "java": ".java", "javascript": ".js .jsx", "kotlin": ".kt .kts", "php": ".php", "python": ".py", "ruby": ".rb",
    "rust": ".rs", "shell": ".bash .sh .zsh", "swift": ".swift", "toml": ".toml", "typescript": ".ts .tsx",
    "xml": ".xml", "yaml": ".yaml .yml",
}
_PARSED = {"go": ".go", "java": ".java", "javascript": ".cjs .js .jsx .mjs", "python": ".py", "tsx": ".tsx", "typescript": ".ts"}

#: Families of comment syntax.
SLASHES = frozenset("c cpp csharp css go java javascript kotlin php rust swift typescript".split())
HASHES = frozenset("ruby shell toml yaml".split())
MARKUP = frozenset("html xml".split())

#: What the tree source admits: suffixes (in lower case), and names and folders that it never reads.
SUFFIXES = frozenset(" ".join([*_BY_LANGUAGE.values(), ".dockerfile .graphql .hcl .json .md .proto .sql .tf .txt"]).split())
SECRET_NAMES = frozenset("id_rsa id_ed25519 secrets.yaml credentials.json .env.production .env.local .env".split())
SKIPPED_FOLDERS = frozenset("venv .venv node_modules dist build __pycache__ .git".split())


def _language(filename: Column, table: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for language, suffixes in table.items():
        ends = [F.endswith(filename, F.lit(s)) for s in suffixes.split()]
        some = ends[0]
        for e in ends[1:]:
            some = some | e
        found = F.when(some, F.lit(language)).otherwise(found)
    return found


def detect_language(filename: Column) -> Column:
    """Language of a file's comments, or null."""
    return _language(filename, _BY_LANGUAGE)


def parsed_language(filename: Column) -> Column:
    """Language of a file's syntax tree, or null."""
    return _language(filename, _PARSED)


def suffix(filename: Column) -> Column:
    """The last suffix of the base name in lower case; empty for dot files without another dot."""
    return F.lower(F.regexp_extract(filename, r"[^/.][^/]*(\.[^/.]+)$", 1))


def admitted(filename: Column, size: Column | None = None, most: int = 1_000_000) -> Column:
    """Whether the tree source would read a relative path: suffix, secret names, folders and size."""
    parts = F.split(filename, "/")
    name = F.element_at(parts, -1)
    good = suffix(filename).isin(*SUFFIXES) & ~name.isin(*SECRET_NAMES)
    good = good & ~F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(*SKIPPED_FOLDERS))
    return good if size is None else good & (size <= most)
