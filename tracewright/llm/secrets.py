"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns near hits, checksum validation.

One automaton pass over the ASCII-lowered text finds keyword positions; a pattern is only ever tried
anchored at a hit. Kinds with an embedded checksum (fixed values of the public token formats) are
reported only if the checksum holds. Long hexadecimal runs have no keyword; they are found by one
linear scan. Spans are code points, end exclusive.

Defined results: null and empty texts have no spans; repeated rows are scanned one by one; nothing is
shuffled, so hot sources and very long texts stay in their own task, in time linear in their length. Of spans that
start at one place the kinds come in the order of KINDS.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need

#: Kinds in reporting order; the first three are the base kinds.
BASE_KINDS = ("assign", "access", "hex")
MORE_KINDS = ("github", "npm", "slack", "google", "stripe", "jwt", "pem")
KINDS = BASE_KINDS + MORE_KINDS

_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run is a match of [0-9a-f]+, of which shorter ones fail
_NEAR = {
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    "stripe": re.compile(r"[sr]k_live_[A-Za-z0-9]{16,250}"),
}
_RUN = re.compile(r"[A-Za-z0-9_-]*")
_BEGIN, _END = (re.compile(rf"-----{x} (?:[A-Z]+ )?PRIVATE KEY-----") for x in ("BEGIN", "END"))
_KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"), "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"), "npm_": "npm",
    **dict.fromkeys(("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), "slack"), "aiza": "google",
    **dict.fromkeys(("sk_live_", "rk_live_"), "stripe"), "eyj": "jwt", "-----begin ": "pem",
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """CRC-32 of the body as six base-62 digits, as public token formats append it."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = _BASE62[k] + out
    return out


def _valid(kind: str, found: str) -> bool:
    if kind in ("github", "npm"):
        body = found.partition("_")[2]
        return checksum62(body[:30]) == body[30:]
    return True


class _Places:
    """Ends of the spans of one text that have no bounded length, each part of the text being read once."""

    def __init__(self, text: str):
        self.text = text
        self.run = (0, 0)  # the run of token letters last looked at
        self.ends: list[tuple[int, int]] | None = None

    def end(self, kind: str, start: int) -> int:
        """Where the secret of this kind that starts here ends; 0 if there is none."""
        if kind == "pem":
            return self._pem(start)
        if kind == "jwt":
            return self._jwt(start)
        m = _NEAR[kind].match(self.text, start)
        return m.end() if m and _valid(kind, m[0]) else 0

    def _run_end(self, at: int) -> int:
        if not self.run[0] <= at < self.run[1]:
            self.run = (at, _RUN.match(self.text, at).end())
        return self.run[1]

    def _jwt(self, start: int) -> int:
        """Three runs of 8 letters or more joined by dots, the first two beginning with eyJ besides."""
        first = self._run_end(start)
        if first - start < 11 or not self.text.startswith(".eyJ", first):
            return 0
        second = _RUN.match(self.text, first + 1).end()
        if second - first < 12 or not self.text.startswith(".", second):
            self.run = (self.run[0], first)
            return 0
        third = _RUN.match(self.text, second + 1).end()
        return third if third - second > 8 else 0

    def _pem(self, start: int) -> int:
        """Up to the first end mark after the begin mark."""
        m = _BEGIN.match(self.text, start)
        if not m:
            return 0
        if self.ends is None:
            self.ends = [x.span() for x in _END.finditer(self.text)]
        k = bisect_left(self.ends, (m.end(), 0))
        return self.ends[k][1] if k < len(self.ends) else 0


class Scanner:
    def __init__(self):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for word, kind in _KEYWORDS.items():
            self.words.add_word(word, (kind, len(word)))
        self.words.make_automaton()

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind; per kind leftmost and non-overlapping."""
        if not text:
            return []
        found: list[tuple[str, int, int]] = []
        past = dict.fromkeys(KINDS, 0)
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # ASCII letters only
        places = _Places(text)
        hits = sorted((end - size + 1, kind) for end, (kind, size) in self.words.iter(low))
        for start, kind in hits:
            if start < past[kind]:
                continue
            if kind == "assign":
                if m := _ASSIGN.match(text, start):
                    past[kind] = m.end()
                    if m.end(1) - m.start(1) >= 8:
                        found.append((kind, start, m.end()))
            elif kind == "access":
                if m := _ACCESS.match(text, start):
                    past[kind] = m.end()
                    if m.end() - start >= 16:
                        found.append((kind, start, m.end()))
            elif end := places.end(kind, start):
                past[kind] = end
                found.append((kind, start, end))
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
        found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        return found


def redact_text(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each run of overlapping spans replaced by a mark naming its first kind."""
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"[{kind} removed]"]
        at, k = end, k + 1
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and spans array<struct<kind,start,end>>."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scanner.spans(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span)], names=["id", "spans"])

    source = need(docs, id_col, text_col)
    kind = source.schema[id_col].dataType.simpleString()
    found = source.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return found.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every secret in the text replaced by a mark; all other columns as they were."""

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = [redact_text(x, scanner.spans(x)) for x in (v.as_py() for v in batch.column(k))]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest_columns(scanned: DataFrame) -> DataFrame:
    """Counts and digests of the contract from the spans of scan_secrets()."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )


def brute_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by plain scans, for tests."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
