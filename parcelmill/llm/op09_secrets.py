"""Secret scan with multipart credential linking.

Every text is scanned whole.  Three strong detectors report on their own:

* ``assign``  a keyword, an assignment sign and a value of six characters or more,
* ``access``  an access-key identifier,
* ``hex``     a long run of hexadecimal digits.

A credential is often spread over several places: an identifier, its secret and the endpoint
they open.  Each of those parts alone is weak evidence (a user name, 20 or more letters of base64,
url-safe or not, a URL), so weak parts are *candidates* only, and an interval join decides: every part is an
interval of code points, widened by ``reach`` on both sides to its scope; scopes also end at
blank lines.  A weak secret is reported if the scope of an identifier or an endpoint overlaps it that is
not part of it (a long user name or a path in a URL is not its own secret); beside an endpoint alone it must hold both letters and
digits, as long words stand beside links everywhere.  A weak identifier or endpoint is reported if a
secret's scope overlaps it.  Parts are sorted by start, so the join is a sweep with binary search, not a loop over pairs.

Edge cases: null and empty texts have no spans (empty strings, zero counts); repeated rows are
scanned one by one; an empty table gives an empty result; other columns are ignored by
``scan`` and kept unchanged by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import table

BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("secret", "ident", "endpoint")
KINDS = BASE_KINDS + WEAK_KINDS
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[+/_-]*+[A-Za-z0-9])[A-Za-z0-9+/_-]{20,}+={0,2}")
WEAK_IDENT = re.compile(r"""(?ai:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.ASCII)
WEAK_ENDPOINT = re.compile(r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{4,}")
MIXED = re.compile(r"(?=[^0-9]*[0-9])[^A-Za-z]*[A-Za-z]")
REACH = 240
SCOPE_END = re.compile(r"\n[ \t\r]*\n")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Strong matches as (start, end, kind), each kind leftmost and non-overlapping."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def weak_candidates(text: str, identified: bool) -> list[Span]:
    """Weak parts, reported only when linked; a bare secret needs some identifier or endpoint in the text."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "ident") for m in WEAK_IDENT.finditer(text)]
    if "://" in text:
        found += [(m.start(), m.end(), "endpoint") for m in WEAK_ENDPOINT.finditer(text)]
    if identified or found:
        found += [(m.start(), m.end(), "secret") for m in WEAK_SECRET.finditer(text)]
    return found


def _merged(parts: list[Span], walls: list[int], reach: int) -> tuple[list[int], list[int]]:
    """Union of the parts' scopes as sorted, disjoint intervals."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e, _ in sorted(parts):
        k = bisect_left(walls, s + 1)
        low = max(s - reach, walls[k - 1] if k else 0)
        k = bisect_left(walls, e)
        high = min(e + reach, walls[k] if k < len(walls) else e + reach)
        if starts and low <= ends[-1]:
            ends[-1] = max(ends[-1], high)
        else:
            starts.append(low)
            ends.append(high)
    return starts, ends


def _within(span: Span, scope: tuple[list[int], list[int]]) -> bool:
    k = bisect_left(scope[0], span[1]) - 1
    return k >= 0 and scope[1][k] > span[0]


def _beside(secrets: list[Span], parts: list[Span], walls: list[int], reach: int) -> list[Span]:
    """Secrets within the scope of a part that does not overlap them; the nearest on each side decides."""
    starts, ends = sorted(s for s, _, _ in parts), sorted(e for _, e, _ in parts)
    found = []
    for span in secrets:
        before, after = bisect_right(ends, span[0]), bisect_left(starts, span[1])
        near = [(e - 1, e, "ident") for e in ends[max(before - 1, 0) : before]] + [(s, s + 1, "ident") for s in starts[after : after + 1]]
        if _within(span, _merged(near, walls, reach)):
            found.append(span)
    return found


def linked(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak candidates whose complementary part lies in the same scope."""
    weak = weak_candidates(text, any(k == "access" for _, _, k in base))
    if not weak:
        return []
    walls = [m.start() for m in SCOPE_END.finditer(text)]
    # An assignment already names its value; other detectors' spans inside it add nothing.
    taken = _merged([x for x in base if x[2] != "access"], [], 0)
    weak = [x for x in weak if not (x[2] == "secret" and _within(x, taken))]
    idents = [x for x in base if x[2] == "access"] + [x for x in weak if x[2] == "ident"]
    endpoints = [x for x in weak if x[2] == "endpoint"]
    bare = [x for x in weak if x[2] == "secret"]
    inside = _merged(endpoints, [], 0)
    mixed = [x for x in bare if MIXED.match(text, x[0], x[1]) and not _within(x, inside)] if endpoints else []
    secrets = sorted({*_beside(bare, idents, walls, reach), *_beside(mixed, endpoints, walls, reach)})
    scope = _merged([x for x in base if x[2] != "access"] + secrets, walls, reach)
    return secrets + [x for x in weak if x[2] != "secret" and _within(x, scope)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            more = linked(text, base)
            n = [sum(k == kind for _, _, k in base) for kind in BASE_KINDS]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts, base digest and all reported spans."""
    return docs.select("doc_id", "text").mapInArrow(kernel.task(_scan), SCHEMA)


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with each reported span replaced by ``mark``; overlapping spans are replaced once.
    A null text stays null.  ``n_chars``, where present, is counted anew for changed texts."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, lengths = [], []
            for text in batch.column(at):
                text = text.as_py()
                if text:
                    base = base_spans(text)
                    starts, ends = _merged(base + linked(text, base), [], 0)
                    text = mark.join(text[e:s] for e, s in zip([0, *ends], [*starts, len(text)]))
                    lengths.append(len(text) if starts else None)
                else:
                    lengths.append(None)
                texts.append(text)
            batch = batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))
            if (k := batch.schema.get_field_index("n_chars")) >= 0:
                old = batch.column(k)
                batch = batch.set_column(k, "n_chars", pa.array([b if b is not None else a.as_py() for a, b in zip(old, lengths)], old.type))
            yield batch

    return docs.mapInArrow(kernel.task(clean), docs.schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
