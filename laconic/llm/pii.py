"""Operator 9, personal data: patterns propose, checksums confirm, nearby words adjust the score.

Base kinds (email, ip, card, phone) are kept whatever their score. Further kinds come from the
method and need a score of THRESHOLD: iban (mod 97), ssn, imei (Luhn), mac and key (long secrets).
Spans are code points, end exclusive. Everything happens in the row's own task; no shuffle.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from laconic.llm.common import sliced, table, texts, typed

#: Score that a further span needs; code points before and after a span in which context counts.
THRESHOLD, NEAR = 0.6, 40

BASE = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Kind, pattern, score of a proposal, and the words that raise or lower it.
FURTHER = (
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), 0.4, r"\b(iban|bank|konto|compte|cuenta|account|bic|swift)\b", r"\b(part|serial|model|isbn)\b"),
    ("ssn", re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"), 0.5, r"\b(ssn|social security|taxpayer)\b", r"\b(order|invoice|part|isbn)\b"),
    ("imei", re.compile(r"(?<![0-9])[0-9]{15}(?![0-9])"), 0.4, r"\b(imei|handset|device)\b", r"\b(card|order|invoice)\b"),
    ("mac", re.compile(r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])"), 0.6, r"\b(mac|ethernet|wifi|adapter)\b", r"\b(example)\b"),
    ("key", re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{40})(?![A-Za-z0-9])"), 0.5, r"\b(token|key|secret|password|api|auth)\b", r"\b(commit|sha1?|checksum|digest)\b"),
)
_FURTHER = tuple((kind, p, score, re.compile(up, re.I), re.compile(down, re.I)) for kind, p, score, up, down in FURTHER)


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number's check digits are right (remainder 1)."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each is a run of local letters up to an @ that a domain follows."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            last = domain.end()
            found.append((start, last))
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds' spans, kind by kind."""
    spans = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:] or 0) <= 255 for p in m.group().split(".")):
                spans.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    spans.append(("phone", m.start(), m.end()))
    return spans


def _confirmed(kind: str, match: str) -> float:
    """What the validator of a kind adds to the score; a failed checksum rules the span out."""
    if kind == "iban":
        code = match.replace(" ", "")
        return 0.5 if 15 <= len(code) <= 34 and mod97(code) else -0.15
    if kind == "imei":
        return 0.1 if luhn(match) else -1.0
    if kind == "key":
        return 0.2 if len(set(match)) >= 8 else -1.0
    return 0.0


def further_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Proposals of the further kinds that reach the threshold, with their score."""
    found = []
    for kind, pattern, score, up, down in _FURTHER:
        for m in pattern.finditer(text):
            total = score + _confirmed(kind, m.group())
            before, after = text[max(0, m.start() - NEAR) : m.start()], text[m.end() : m.end() + NEAR]
            total += 0.3 * bool(up.search(before) or up.search(after)) - 0.3 * bool(down.search(before) or down.search(after))
            if total >= THRESHOLD:
                found.append((kind, m.start(), m.end(), total))
    return found


_ORDER = {kind: k for k, kind in enumerate([*BASE, *(x[0] for x in FURTHER)])}


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind."""
    spans = base_spans(text) + [x[:3] for x in further_spans(text)]
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by its first span's kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one for each row of docs.

    spans joins kind:start:end; base_sha256 digests the base kinds' spans joined likewise. Null and
    empty texts have no spans. Other columns are ignored, repeated rows each get a row.
    """

    def run(batches):
        for batch in sliced(batches):
            counts, digests, joined = [[] for _ in BASE], [], []
            for text in texts(batch.column(1)):
                spans = find_spans(text)
                base = [s for s in spans if s[0] in BASE]
                for k, kind in enumerate(BASE):
                    counts[k].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest())
                joined.append(",".join("%s:%d:%d" % s for s in spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in counts), *(pa.array(x, pa.string()) for x in (digests, joined))], names=[id_col, *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {typed(docs, id_col)}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with personal data in the text replaced, and chars_col, if there, counted anew; null stays null.

    Every column of docs stays, whatever its name.
    """
    at, count = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        for batch in sliced(batches):
            columns = list(batch.columns)
            clean = [None if x is None else redacted(x, find_spans(x)) for x in columns[at].to_pylist()]
            if count is not None:
                old = columns[count].to_pylist()
                columns[count] = pa.array([o if c is None else len(c) for o, c in zip(old, clean)], columns[count].type)
            columns[at] = pa.array(clean, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: counts and digest of the base kinds, and all spans."""
    return find_personal_data(table(spark, sf_dir, "documents"))
