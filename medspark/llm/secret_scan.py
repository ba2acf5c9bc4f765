"""Secret scan: fixed patterns plus sliding-window entropy per character class.

A candidate is a maximal run of token characters.  Within it every stretch of
one character class (hex digits, or the base-64 alphabet) is scanned by a window
of fixed width; the window's Shannon entropy is kept by adding and removing one
character's term ``c log2 c`` at a time.  Windows at or above the class's limit
merge into spans.  Candidates that an allow-list pattern matches as a whole are
suppressed, and so are those of a candidate's parts, between the signs that join
words, that hold an allowed word; the other parts are scanned.  Spans of the fixed
patterns are never suppressed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from medspark.llm.texts import map_rows, map_texts

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{16,}")
CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
KEYWORD = re.compile(rb"(?i:passw|secret|token|api_?key)")
MIN_VALUE = 12


@dataclass(frozen=True)
class CharClass:
    kind: str
    stretch: re.Pattern
    width: int
    limit: float  # bits a character


CLASSES = (CharClass("entropy_hex", re.compile(rb"[0-9a-fA-F]{20,}"), 20, 2.8),
           CharClass("entropy_base64", re.compile(rb"[A-Za-z0-9+/_-]{24,}={0,2}"), 24, 3.9))
#: Candidates that look random but are not secrets.
ALLOWED = (rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
           rb"[A-Za-z]+([-_/=+][A-Za-z]+)*[-_/=+]*",  # joined words
           rb"[0-9_/=+-]+")  # numbers, dates, rulers
#: Words, in either case, of parts that are not secrets.
ALLOWED_WORDS = (b"0123456789", b"abcdefghij", b"example", b"placeholder", b"xxxxxxxx")
_JOINT = re.compile(rb"[-_/=+]")
_TERM = [0.0, *(c * math.log2(c) for c in range(1, 4097))]


def entropy_windows(text: bytes, width: int, limit: float) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``width`` characters whose entropy is at
    least ``limit`` bits a character."""
    counts, total, spans = [0] * 256, 0.0, []
    log_width = math.log2(width)
    for i, c in enumerate(text):
        total += _TERM[counts[c] + 1] - _TERM[counts[c]]
        counts[c] += 1
        if i >= width:
            old = text[i - width]
            total += _TERM[counts[old] - 1] - _TERM[counts[old]]
            counts[old] -= 1
        if i >= width - 1 and log_width - total / width >= limit - 1e-9:
            if spans and spans[-1][1] >= i + 1 - width:
                spans[-1][1] = i + 1
            else:
                spans.append([i + 1 - width, i + 1])
    return [tuple(s) for s in spans]


@dataclass(frozen=True)
class AllowList:
    """Patterns of whole candidates, and words of parts of them."""

    whole: re.Pattern
    words: re.Pattern

    @classmethod
    def of(cls, patterns: tuple[bytes, ...] = ALLOWED, words: tuple[bytes, ...] = ALLOWED_WORDS) -> AllowList:
        return cls(re.compile(b"|".join(b"(?:%s)" % p for p in patterns) or rb"(?!)"),
                   re.compile(b"|".join(map(re.escape, words)) or rb"(?!)", re.IGNORECASE))

    def rest(self, value: bytes) -> Iterator[tuple[int, int]]:
        """Ranges of ``value`` without the parts that hold an allowed word."""
        at = 0
        for m in self.words.finditer(value):
            if m.start() >= at:
                first = max(at, 1 + max(value.rfind(joint, at, m.start()) for joint in (b"-", b"_", b"/", b"=", b"+")))
                yield at, first
                after = _JOINT.search(value, m.end())
                at = after.start() if after else len(value)
        yield at, len(value)


def find_secrets(text: bytes, allowed: AllowList) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value) of all spans, byte offsets."""
    found = []
    if KEYWORD.search(text):
        found += [(m.start(), m.end(), "assign", m.start(1)) for m in ASSIGN.finditer(text)
                  if m.end(1) - m.start(1) >= MIN_VALUE]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    for candidate in CANDIDATE.finditer(text):
        value = candidate.group()
        if allowed.whole.fullmatch(value):
            continue
        for first, last in allowed.rest(value):
            part = value[first:last]
            for cls in CLASSES:
                for m in cls.stretch.finditer(part):
                    at = candidate.start() + first + m.start()
                    found += [(at + a, at + b, cls.kind, at + a)
                              for a, b in entropy_windows(m.group(), cls.width, cls.limit)
                              if mixed(m.group()[a:b])]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def mixed(value: bytes) -> bool:
    """Letters and digits: words and numbers alone are not secrets."""
    return bool(re.search(rb"[0-9]", value) and re.search(rb"[A-Za-z]", value))


def in_code_points(text: bytes, spans: list[tuple]) -> list[tuple[int, int, str]]:
    """Spans by code points, counted in one pass over the text."""
    if text.isascii():
        return [s[:3] for s in spans]
    place, at, before = {}, 0, 0
    for edge in sorted({x for s in spans for x in s[:2]}):
        before += len(text[at:edge].decode())
        place[edge], at = before, edge
    return [(place[a], place[b], kind) for a, b, kind, *_ in spans]


def _shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 allow: tuple[bytes, ...] = ALLOWED, words: tuple[bytes, ...] = ALLOWED_WORDS) -> DataFrame:
    """One row per input row: counts of each fixed kind, the digest of their
    spans and all spans as ``kind:start:end`` (code points, end exclusive).

    NULL and empty texts have no spans (counts 0, digest of the empty string,
    ``spans`` ''); repeated rows each get their row; ids may be NULL.
    """
    pattern = AllowList.of(allow, words)

    def make():
        def columns(texts):
            counts, digests, shown = {k: [] for k in KINDS[:3]}, [], []
            for text in texts:
                spans = in_code_points(text, find_secrets(text, pattern))
                base = [s for s in spans if s[2] in counts]
                for kind in counts:
                    counts[kind].append(sum(s[2] == kind for s in base))
                digests.append(hashlib.sha256(_shown(base).encode()).hexdigest())
                shown.append(_shown(spans))
            return [*(pa.array(c, pa.int64()) for c in counts.values()), pa.array(digests, pa.string()),
                    pa.array(shown, pa.string())]
        return columns

    return map_texts(df, make, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
                     id_col, text_col)


def redacted(text: bytes, allowed: AllowList, mark: bytes) -> bytes:
    """``text`` with the value of every secret replaced by ``mark``."""
    spans = find_secrets(text, allowed)
    if not spans:
        return text
    out, at = [], 0
    for start, end in sorted((value, end) for _, end, _, value in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return b"".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]",
                   allow: tuple[bytes, ...] = ALLOWED, words: tuple[bytes, ...] = ALLOWED_WORDS) -> DataFrame:
    """All rows and columns of ``df``, secrets in ``text_col`` replaced by
    ``mark``.  Of an assignment only the value goes.  NULL stays NULL."""
    pattern = AllowList.of(allow, words)

    def changed(batch: pa.RecordBatch, place: int) -> pa.RecordBatch:
        texts = [None if x is None else redacted(x.encode(), pattern, mark.encode()).decode()
                 for x in batch.column(place).to_pylist()]
        return batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.column(place).type))

    return map_rows(df, changed, text_col)
