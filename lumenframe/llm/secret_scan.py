"""Secret scan: base patterns, and weak candidates that only count together.

Weak candidates are access identifiers, secrets and endpoints that alone would
be noise.  Within a scope (a paragraph: lines between blank lines) an interval
join pairs each weak secret with the identifiers and endpoints that lie at most
`reach` code points away; what has no complement is not reported.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenframe.llm import _text
from lumenframe.llm._spark import map_arrow

# The base patterns, the least length of the part that counts, in the order of ties.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
WEAK_ACCESS = re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{16,32}(?![A-Za-z0-9])")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"https?://[^\s\"'<>]+|(?<![A-Za-z0-9.-])(?:[a-z0-9-]+\.){2,}(?:com|net|org|io|dev|cloud)(?![A-Za-z0-9-])", re.A)
SCOPE = re.compile(r"\n[\x20\t\r]*\n")
#: Code points between a weak secret and what complements it.
REACH = 200

_TOKEN = np.zeros(256, bool)
_TOKEN[[c for c in range(256) if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_=-")]] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' matches that are long enough."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def _mixed(s: str) -> bool:
    """Of at least three of: lower case, upper case, digits, signs; with a digit."""
    kinds = (bool(re.search("[a-z]", s)), bool(re.search("[A-Z]", s)), bool(re.search("[0-9]", s)), bool(re.search("[+/_=-]", s)))
    return kinds[2] and sum(kinds) >= 3


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """Weak candidates that complement each other in one scope; those that overlap a base span are that span."""
    begins = sorted(b for b, _, _ in base)
    #: The furthest end of all base spans that begin no later.
    furthest = list(itertools.accumulate((e for _, e in sorted((b, e) for b, e, _ in base)), max))

    def free(m: re.Match) -> bool:
        k = bisect.bisect_left(begins, m.end())
        return not k or furthest[k - 1] <= m.start()

    secrets = [(m.start(), m.end(), "weak_secret") for m in WEAK_SECRET.finditer(text) if _mixed(m[0]) and "://" not in m[0] and free(m)]
    access = [
        (m.start(), m.end(), "weak_access")
        for m in WEAK_ACCESS.finditer(text)
        if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and free(m)
    ]
    points = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    strong = [x for x in base if x[2] == "access"]
    held = [x for x in base if x[2] != "access"]
    if not (secrets or held) or not (access or points or strong):
        return []
    borders = [m.end() for m in SCOPE.finditer(text)]
    scope = lambda x: bisect.bisect_right(borders, x[0])
    others = sorted(access + points + strong)
    longest = max((e - b for b, e, _ in others), default=0)
    found = set()
    for s in sorted(secrets + held):
        near = bisect.bisect_left(others, (s[0] - reach - longest,))
        for o in others[near:]:
            if o[0] > s[1] + reach:
                break
            if o[1] >= s[0] - reach and scope(o) == scope(s) and (o[1] <= s[0] or o[0] >= s[1]):
                # An assignment beside an endpoint is an everyday line: it lifts identifiers only.
                if s in held and o[2] == "endpoint":
                    continue
                found |= {x for x in (s, o) if x[2] in ("weak_access", "weak_secret", "endpoint")}
    return sorted(found)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return ",".join(f"{k}:{b}:{e}" for b, e, k in order)


def _long_runs(data: np.ndarray, offsets: np.ndarray, least: int = 16) -> np.ndarray:
    """For each row, whether it has `least` bytes in a row that a credential can be made of; runs end with their row."""
    starts, ends, _ = _text.words(data, offsets, ~_TOKEN)
    starts = starts[ends - starts >= least]
    rows = np.zeros(len(offsets) - 1, bool)
    rows[np.searchsorted(offsets, starts, "right") - 1] = True
    return rows


def secret_scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """For each row of docs: doc_id, n_assign, n_access, n_hex, base_spans, spans.

    base_spans and spans are kind:start:end joined by commas, in code points with
    the end exclusive, by start, kind and end; base_spans has the base patterns
    alone.  A null text is empty and has no spans; a null doc_id stays null.
    Repeated rows are scanned each for itself.  Added spans never overlap base spans.
    Texts are scanned whole, one at a time; a task holds about ten times its longest.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.utf8(batch.column(1))
            cols: list[list] = [[], [], [], [], []]
            for i, j in _text.steps(offsets):
                at = offsets[i : j + 1] - offsets[i]
                part = data[offsets[i] : offsets[j]]
                long = _long_runs(part, at) if len(part) else np.zeros(j - i, bool)
                raw = part.tobytes()
                for k in range(j - i):
                    text = raw[at[k] : at[k + 1]].decode("utf-8", "replace")
                    # An assignment needs one of its signs; all other kinds need a long run.
                    base = base_spans(text) if long[k] or ":" in text or "=" in text else []
                    more = linked_spans(text, base, reach) if long[k] else []
                    kinds = [x[2] for x in base]
                    for col, v in zip(cols, (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), _joined(base), _joined(base + more)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"],
            )

    return map_arrow(
        docs.selectExpr("cast(doc_id as long) doc_id", "text"),
        scan,
        "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"
    )
