"""Secret scan: fixed patterns, and weak candidates that only linked parts confirm."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices, utf8

# Fixed patterns of the base scan; the last number is the least length (of group 2 for assign).
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
BASE_KINDS = ("assign", "access", "hex")

#: Parts that say little alone. An identifier or an endpoint is named or typed; a secret is only dense. Runs of any length are
#: taken whole.
IDENTIFIER = re.compile(r"""\b(?:client|access|account|user|app|tenant|key)[_-]?(?:id|name|key)["']?\x20{0,4}[:=]\x20{0,4}["']?([A-Za-z0-9_.@-]{3,}+)""", re.I | re.A)
ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{3,}+|\b(?:host|endpoint|server|bucket)(?:name)?["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9.:/_-]{3,}+""", re.I | re.A)
DENSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+(?![A-Za-z0-9+/_=-])")
#: Bits a character that a dense run carries at least, and how far the scope of a part reaches.
LEAST_ENTROPY = 3.5
SCOPE = 240
KINDS = (*BASE_KINDS, "identifier", "secret", "endpoint")
Span = tuple[int, int, int]  # start, end, index in KINDS

_HEX_BYTE = np.array([chr(b) in "0123456789abcdef" for b in range(256)])


def base_spans(text: str, hexes: bool = True) -> list[Span]:
    """The base matches, leftmost and non-overlapping per kind; failing matches are dropped, not retried."""
    found: list[Span] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if hexes:
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[0], s[2]))


def entropy(run: str) -> float:
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values())


def weak_parts(text: str) -> list[Span]:
    """Identifiers, endpoints, and dense runs of letters and digits that are no piece of either, whatever the base scan found."""
    parts = [(m.start(), m.end(), 3) for m in IDENTIFIER.finditer(text)]
    parts += [(m.start(), m.end(), 5) for m in ENDPOINT.finditer(text)]
    begins, reach = _reach([(s, e) for s, e, _ in parts])
    for m in DENSE.finditer(text):
        run = m[0]
        before = bisect_left(begins, m.end())
        if before and reach[before - 1] > m.start():
            continue
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and entropy(run) >= LEAST_ENTROPY:
            parts.append((m.start(), m.end(), 4))
    return parts


def linked(text: str, base: list[Span]) -> list[Span]:
    """The weak parts that a complementary part confirms.

    The scope of a part is its span, SCOPE further on both sides, within its block between blank lines.
    A secret and an identifier or endpoint are linked if each lies in the other's scope and none of their characters
    is in both, so that nothing confirms itself; base spans take part, an access key as an identifier and the
    others as secrets. The join sweeps the parts by start, so
    it takes n log n steps. A part inside a base span or inside a part of an earlier kind isn't reported.
    """
    if "://" not in text and "=" not in text and ":" not in text and "AKIA" not in text:
        return []
    weak = weak_parts(text)
    if not weak:
        return []
    breaks = np.array([m.end() for m in re.finditer(r"\n[ \t\r]*\n", text)], np.int64)
    parts = np.array(sorted(weak + [(s, e, 3 if k == 1 else 4) for s, e, k in base]), np.int64)
    start, end, kind = parts.T
    # blocks are set so far apart that no scope reaches from one into the next
    apart = np.searchsorted(breaks, start, side="right") * (len(text) + 2 * SCOPE + 1)
    met = np.zeros(len(parts), bool)
    for one, other in ((kind == 4, kind != 4), (kind != 4, kind == 4)):
        begins, ends = np.sort((start + apart)[other]), np.sort((end + apart)[other])
        first, last = (start + apart)[one], (end + apart)[one]
        after = np.searchsorted(begins, last + SCOPE, side="right") > np.searchsorted(begins, last, side="left")
        before = np.searchsorted(ends, first, side="right") > np.searchsorted(ends, first - SCOPE, side="left")
        met[one] = after | before  # some begin in the scope after it, or end in the scope before it
    taken = [(s, e) for s, e, _ in base]
    out: list[Span] = []
    for k in (3, 4, 5):
        begins, reach = _reach(taken)
        mine = sorted({(s, e) for s, e, kk in zip(start[met].tolist(), end[met].tolist(), kind[met].tolist(), strict=True) if kk == k})
        for s, e in mine:
            before = bisect_left(begins, e)  # of those that begin before it ends, does one end after it begins
            if not before or reach[before - 1] <= s:
                out.append((s, e, k))
                taken.append((s, e))
    return out


def _reach(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """The starts of the spans in order, and how far they reach up to each."""
    spans = sorted(spans)
    return [s for s, _ in spans], list(accumulate((e for _, e in spans), max))


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        data, at = utf8(batch.column(1))
        run = np.concatenate([[0], np.cumsum(_HEX_BYTE[data], dtype=np.int64)])
        n = LEAST["hex"]
        full = np.flatnonzero(run[n:] - run[:-n] == n) if len(data) >= n else np.zeros(0, np.int64)
        with_hex = set(np.searchsorted(at, full, side="right").tolist())  # one more than the row's index
        rows = []
        for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            text = text or ""
            base = base_spans(text, k + 1 in with_hex)
            more = linked(text, base)
            counts = Counter(s[2] for s in base)
            digest = hashlib.sha256(spell(base).encode()).hexdigest()
            rows.append((doc_id, counts[0], counts[1], counts[2], digest, spell(base + more), len(more)))
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(NAMES))


NAMES = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")


def scan(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Spans are kind:start:end in code points. The parts of a credential lie in one document, so they are
    joined where the document is read and nothing is shuffled; a text of any length takes n log n steps. Parts that tie
    or repeat are reported each at its place. A null text is empty and has no span; repeated and null doc ids keep a row each;
    columns of other names play no part; an empty table gives no row.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    return documents.select("doc_id", "text").mapInArrow(_scan, schema)
