"""Secret scan with multipart credential linking.

Strong spans (base patterns) always count. Weak parts - access identifiers, secret-looking values, endpoints - are common in
harmless text, so one is reported only when a complementary part co-occurs: identifiers and endpoints need a secret, weak
secrets need an identifier or an endpoint. Parts are joined as intervals: widened by ``REACH`` code points they overlap, and no
scope border (a blank line) lies between them. Per text this is a sorted sweep: for each part the nearest complementary part on
either side decides, so a text with very many parts costs n log n and no pairs are made. A weak part that overlaps a base span
is not reported again.

Positions are code points, ends exclusive. Defined results: a null text counts as empty and has no spans; texts are scanned
whole; repeated rows are scanned alike; equal starts are ordered by kind as listed in ``KINDS``; an added column replaces an
input column of its name; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from aerovigil.llm.frames import add_columns

REACH = 200
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}
_NEEDS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}

# ASCII: in either case only the letters A-Z match each other.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as a search finds each run at its start
IDENTIFIER = re.compile(
    r"""\b(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?|key_?id|tenant)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9_.@+-]{3,})"""
    r"""|\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+""", re.ASCII | re.IGNORECASE)
WEAK_ASSIGN = re.compile(r"""\b(?:pwd|pass(?:phrase|code)?|credentials?|private_?key|auth(?:orization)?)["']?[ ]*[:=][ ]*["']?([^\s"',;]{4,})""",
                         re.ASCII | re.IGNORECASE)
WEAK_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"""\b[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s"'<>|]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.]*[0-9])(?::[0-9]{1,5})?"""
                      r"""|\b(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}:[0-9]{2,5}\b""", re.ASCII)
SCOPE = re.compile(r"\n[ \t\r]*\n")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind as listed."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        low = text.lower()  # only to skip texts without any of the words; positions come from the text itself
        if any(w in low for w in ASSIGN_WORDS):
            out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


def _mixed(token: str) -> bool:
    """A digit and letters of both cases, or digits and letters of one case in alternation: no word, no number."""
    digits = sum(c.isdigit() for c in token)
    return digits >= 2 and len(token) - digits >= 2 and len(set(token)) >= 8


def weak_spans(text: str) -> list[Span]:
    out = [(m.start(), m.end(), "secret") for m in WEAK_TOKEN.finditer(text) if _mixed(m.group())]
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "secret") for m in WEAK_ASSIGN.finditer(text)]
        out += [(m.start(), m.end(), "identifier") for m in IDENTIFIER.finditer(text)]
    elif "@" in text:
        out += [(m.start(), m.end(), "identifier") for m in IDENTIFIER.finditer(text)]
    return out + [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak spans with a complementary part, base or weak, within reach and scope."""
    weak = weak_spans(text)
    parts = sorted({*base, *weak}, key=lambda s: (s[0], s[1], _ORDER[s[2]]))
    if not weak or "secret" not in {_ROLE[k] for _, _, k in parts}:
        return []
    border = np.array([m.start() for m in SCOPE.finditer(text)], np.int64)
    sides = {}
    for role in _NEEDS:
        mine = [(s, e) for s, e, k in parts if _ROLE[k] == role]
        starts = np.array([s for s, _ in mine], np.int64)
        ends = np.array([e for _, e in mine], np.int64)
        sides[role] = (starts, np.maximum.accumulate(ends) if len(ends) else ends)
    taken_start = np.array([s for s, _, _ in base], np.int64)
    taken_end = np.maximum.accumulate(np.array([e for _, e, _ in base], np.int64)) if base else np.empty(0, np.int64)
    out = []
    for start, end, kind in weak:
        at = int(np.searchsorted(taken_start, end))
        if at and taken_end[at - 1] > start:
            continue
        low, high = max(0, start - reach), end + reach
        at = int(np.searchsorted(border, start))
        if at:
            low = max(low, int(border[at - 1]) + 1)
        if at < len(border):
            high = min(high, int(border[at]) - 1)
        for role in _NEEDS[_ROLE[kind]]:
            starts, reach_end = sides[role]
            k = int(np.searchsorted(starts, high, "right"))  # parts that start at or before the end of the range
            if k and reach_end[k - 1] >= low:
                out.append((start, end, kind))
                break
    return out


def scan(text: str | None, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of one text, each by start, then kind."""
    base = base_spans(text or "")
    both = {*base, *linked_spans(text or "", base, reach)}
    return base, sorted(both, key=lambda s: (s[0], _ORDER[s[2]], s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, text: str = "text", reach: int = REACH, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``secret_base`` and ``secret_spans``: arrays of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        found = [scan(t, reach) for t in part.column(text).to_pylist()]
        return [pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in f[i]] for f in found], kind) for i in (0, 1)]

    one = "array<struct<kind:string,start:bigint,end:bigint>>"
    return add_columns(docs, compute, f"secret_base {one}, secret_spans {one}", text, keep)


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base spans, the hash of their list, and all spans as a string."""
    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for t in part.column(text).to_pylist():
            base, spans = scan(t)
            kinds = [k for _, _, k in base]
            rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        columns = zip(*rows) if rows else ([],) * 5
        return [pa.array(list(c), t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2)]

    return add_columns(docs, compute, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", text, [doc_id])


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of touching spans replaced by the kind of its first one."""
    out, at, run = [], 0, None
    for start, end, kind in [*spans, (len(text) + 1, 0, "")]:
        if run and start <= run[1]:
            run = (run[0], max(run[1], end), run[2])
            continue
        if run:
            out += [text[at:run[0]], f"[{run[2]}]"]
            at = run[1]
        run = (start, end, kind)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` with the found spans replaced in the text; all rows and other columns stay."""
    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([None if t is None else redacted(t, scan(t, reach)[1]) for t in part.column(text).to_pylist()], pa.string())]

    return add_columns(docs, compute, f"`{text}` string", text).select(*docs.columns)
