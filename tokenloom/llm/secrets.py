"""Secret scans: fixed patterns, and an assignment-aware lexer that adds what the patterns miss.

The lexer (module lexer) reads source and configuration syntax into name-literal pairs and propagates constants
through names and scopes, so a literal is judged under every name that comes to hold it, wherever it stands.
A value's score adds the weight of the most sensitive part of its target's name, its length and its mixture of
character classes; from MIN_SCORE on its literals, all of them where it is put together, are findings of kind `literal`.

Spans are code points, end exclusive. Null and empty texts have no findings; very long ones are read whole. Repeated
findings of one span and kind count once; repeated rows each get their row. Documents are read row by row in Arrow
batches and never shuffled. Empty tables give empty results. Other columns, whatever their names, pass through; one
called like the result column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import read
from tokenloom.llm.lexer import named_literals

KINDS = ("assign", "access", "hex", "literal")
FOUND = "kinds array<string>, starts array<int>, ends array<int>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_HINT = re.compile(r"password|passwd|secret|token|api_?key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of a run of hex digits become 1: a long run is then found by plain search.
_HEX_CLASS = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_HEX_RUN = b"1" * 24

#: Weights of the parts of a target's name.
SENSITIVE = {
    "password": 4, "passwd": 4, "passphrase": 4, "pwd": 3, "secret": 4, "token": 3, "apikey": 4, "credential": 3, "credentials": 3,
    "private": 2, "signing": 2, "encryption": 2, "access": 1, "auth": 2, "key": 2, "salt": 1, "bearer": 3, "dsn": 2,
}
#: Values that stand for a secret without being one.
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|todo|changeme|example|your.*|<.*>|\$\{.*\}|%\(.*\)s|process\.env.*|os\.environ.*)$")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
MIN_SCORE = 6


#: Bytes that part the pieces of a name: without them, neighbouring pieces join as `sensitivity` joins them.
_PARTING = bytes(b for b in range(256) if not (48 <= b <= 57 or 97 <= b <= 122))


def may_name(lower: str) -> bool:
    """Whether a lower-cased text can hold a name of any weight: false only if none does."""
    joined = lower.encode("utf-8", "ignore").translate(None, _PARTING)
    return any(part.encode() in joined for part in SENSITIVE)


def sensitivity(name: str) -> int:
    """The weight of a name: that of its weightiest part, plus one if a second part has a weight too."""
    parts = [p.lower() for p in _PART.findall(name)]
    weights = sorted((SENSITIVE.get(p, 0) for p in [*parts, *(a + b for a, b in zip(parts, parts[1:], strict=False))]), reverse=True)
    return weights[0] + (len(weights) > 1 and weights[1] > 0) if weights else 0


def literal_score(name: str, value: str) -> int:
    weight = sensitivity(name)
    if weight < 2 or len(value) < 8 or " " in value or _PLACEHOLDER.match(value):
        return 0
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return weight + (len(value) >= 12) + (len(value) >= 20) + (classes >= 2) + (classes >= 3) - 2 * (classes == 1 and not value.isdigit())


def lexed(text: str) -> list[tuple[str, int, int]]:
    """Spans of the literals that a sensitive name holds, itself or through other names."""
    out = set()
    for name, spans in named_literals(text):
        if sensitivity(name) >= 2 and literal_score(name, "".join(text[s:e] for s, e in spans)) >= MIN_SCORE:
            out.update(("literal", s, e) for s, e in spans if e > s)
    return list(out)


def scan(text: str | None, lexer: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every finding, by start, then kind as listed, then end."""
    if not text:
        return []
    found = set()
    lower = text.lower()
    hinted = _ASSIGN_HINT.search(lower) if ":" in text or "=" in text else None
    if hinted:
        found.update(("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6)
    if "AKIA" in text:
        found.update(("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20)
    if _HEX_RUN in text.encode().translate(_HEX_CLASS):
        found.update(("hex", *m.span()) for m in _HEX.finditer(text))
    if lexer and any(x in text for x in (":", "=", "</", "--")) and may_name(lower):
        found.update(lexed(text))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan_all(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [scan(t) for t in batch]
        yield pd.DataFrame({k: [[x[i] for x in r] for r in rows] for i, k in enumerate(("kinds", "starts", "ends"))})


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with a column _secrets: kinds, starts and ends of all findings, by start."""
    return docs.withColumn("_secrets", F.pandas_udf(_scan_all, FOUND)(F.col(f"`{text}`")))


def redact_text(text: str | None, mask: str = "[{}]") -> str | None:
    """The text with every finding replaced by its kind; overlapping findings become one."""
    out, at = [], 0
    for kind, start, end in scan(text):
        if start >= at:
            out += [text[at:start], mask.format(kind.upper())]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def _redact_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(redact_text, na_action="ignore")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with secrets masked in their text."""
    return docs.withColumn(text, F.pandas_udf(_redact_all, "string")(F.col(f"`{text}`")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    one = F.transform(F.arrays_zip("_secrets.kinds", "_secrets.starts", "_secrets.ends"), lambda x: F.struct(x["kinds"].alias("k"), F.concat_ws(":", x["kinds"], x["starts"], x["ends"]).alias("s")))
    found = found.select("doc_id", one.alias("_one"))
    count = lambda kind: F.size(F.filter("_one", lambda x: x["k"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("_one", lambda x: x["k"] != "literal"), lambda x: x["s"]), ",")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("_one", lambda x: x["s"]), ",").alias("spans"),
    )
