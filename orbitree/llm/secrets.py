"""Secret scans (operator 3).

Fixed patterns find assignments, access keys and hex strings. The method adds strings of high
entropy: candidate strings are scanned with a sliding window whose Shannon entropy is kept by
incremental counts, with a threshold for each character class; an allow-list suppresses
numbers, words and identifiers that are not secret.

A text of any length is scanned whole, in time in proportion to its length, and needs memory for
its text and spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Window length, and the least entropy (bits a character) of a secret for each class.
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
_CLASSES = (("hex", re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")), ("alnum", re.compile(r"[A-Za-z0-9]+")), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+")))

#: Candidates that are no secrets: numbers with separators, words (joined by separators, with
#: a short number), UUIDs, paths of words. No pattern can match a string in two ways, so each
#: takes time in proportion to its length. Words must look like words besides (``_wordlike``).
ALLOWED = (
    re.compile(r"[0-9+/_=-]+"),
    re.compile(r"[A-Za-z]+(?:[+/_=-]+[A-Za-z]+)*[+/_=-]*[0-9]{0,4}"),
    re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"),
    re.compile(r"(?:[A-Za-z]{2,}[0-9]{0,4}[+/_=-]+)*[A-Za-z]{2,}[0-9]{0,4}[+/_=-]*"),
)

#: Words by case in a run of letters, and what words of natural language keep to (fixed values).
_CASED = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_LONGEST_WORD = 30
_LEAST_MEAN = 3.0
_LEAST_VOWELS = 0.28
_MOST_RARE = 0.2
_CONSONANTS = re.compile(r"[b-df-hj-np-tv-xz]{7}", re.IGNORECASE)

_SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
_LOG = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]


def _wordlike(candidate: str) -> bool:
    """Whether the letters of a candidate look like words: by case pattern, length, vowels,
    rare letters and runs of consonants. A candidate without letters does."""
    letters = "".join(c for c in candidate.lower() if "a" <= c <= "z")
    if not letters:
        return True
    words = _CASED.findall(candidate)
    if max(map(len, words)) > _LONGEST_WORD or len(letters) < _LEAST_MEAN * len(words) or _CONSONANTS.search(candidate):
        return False
    return sum(c in "aeiouy" for c in letters) >= _LEAST_VOWELS * len(letters) and sum(c in "jkqvwxz" for c in letters) <= _MOST_RARE * len(letters)


def _allowed(candidate: str) -> bool:
    numbers, words, uuid, paths = ALLOWED
    if numbers.fullmatch(candidate) or uuid.fullmatch(candidate):
        return True
    return bool(words.fullmatch(candidate) or paths.fullmatch(candidate)) and _wordlike(candidate)


def entropy_spans(candidate: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int]]:
    """Ranges of a candidate covered by windows of high entropy."""
    kind = next((name for name, shape in _CLASSES if shape.fullmatch(candidate)), None)
    if kind is None or len(candidate) < window or _allowed(candidate):
        return []
    need = (log2(window) - thresholds[kind]) * window
    counts: dict[str, int] = {}
    total = 0.0
    found: list[tuple[int, int]] = []
    for i, c in enumerate(candidate):
        if i >= window:
            gone = candidate[i - window]
            n = counts[gone]
            total += _LOG[n - 1] - _LOG[n]
            counts[gone] = n - 1
        n = counts.get(c, 0)
        total += _LOG[n + 1] - _LOG[n]
        counts[c] = n + 1
        if i >= window - 1 and total <= need + 1e-9:
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the ranges that sorted spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret, sorted; kind is an index of KINDS."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    starts, ends = _merged(sorted((s, e) for s, _, e in found))
    for m in _CANDIDATE.finditer(text):
        for lo, hi in entropy_spans(m.group()):
            start, end = m.start() + lo, m.start() + hi
            last = bisect_left(starts, end) - 1  # the last range that starts before the span's end
            if last < 0 or ends[last] <= start:
                found.append((start, 3, end))
    return sorted(found)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(text.as_py() or "")] for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of each text: (doc_id, spans array<struct<kind,start,end>>), one row per input row.

    Offsets are code points, the end exclusive; spans are sorted by start, then kind. Null and
    empty texts have none. Null or repeated ids are kept as they are; an empty table gives no rows;
    other columns are ignored."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan_batches, _SPANS)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) from ``find_secrets``."""
    found = find_secrets(docs, id_col, text_col)
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *counts[:3], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), counts[3])
