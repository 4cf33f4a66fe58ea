"""Secret scans: an Aho-Corasick automaton finds keywords, anchored expressions run only at its hits, and tokens that
embed a checksum are validated.

Kinds: assign (keyword = value), access (AKIA ids), hex (long hexadecimal runs, found by a byte map instead of a
keyword), github and npm tokens (CRC-32 in base 62 at their end), xprv keys (base58 with a double SHA-256 checksum).

Defined cases: a null text is empty and has no spans; the same kind never overlaps itself, different kinds may; spans
are code points, end exclusive. Other columns pass through redact() untouched.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memgate.llm._shared import small_batches, text_slices

KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
BASE_KINDS = KINDS[:3]
#: Anchored expression of each keyword's kind and the least length of its value (of the whole match where there is no group).
AT = {
    "assign": (re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 20),
    "github": (re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), 36),
    "npm": (re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), 36),
    "xprv": (re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"), 111),
}
WORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "npm_": "npm", "xprv": "xprv", **{f"gh{c}_": "github" for c in "pousr"}}
HEX = re.compile(r"[0-9a-f]{24,}")
HEX_MAP = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc62(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = B62[r] + out
    return out


def valid(kind: str, m: re.Match) -> bool:
    """Whether a match is long enough and, where its kind embeds a checksum, bears it out."""
    value = m[1] if m.re.groups else m[0]
    if len(value) < AT[kind][1]:
        return False
    if kind in ("github", "npm"):
        return crc62(value[:30]) == value[30:]
    if kind == "xprv":
        n = 0
        for c in value:
            n = n * 58 + B58.index(c)
        try:
            raw = n.to_bytes(82, "big")
        except OverflowError:
            return False
        return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]
    return True


def automaton():
    a = ahocorasick.Automaton()
    for w, kind in WORDS.items():
        a.add_word(w, (len(w), kind))
    a.make_automaton()
    return a


def spans_of(raw: bytes, find) -> list[tuple[int, int, int]]:
    """(start, kind's rank, end) of all secrets of a UTF-8 text, in order."""
    out = []
    hits = list(find(raw.lower().decode()))  # of bytes, lower() changes A-Z only
    has_hex = b"x" * 24 in raw.translate(HEX_MAP)
    if not hits and not has_hex:
        return out
    text = raw.decode()
    last = dict.fromkeys(KINDS, 0)
    for start, kind in sorted((end + 1 - n, kind) for end, (n, kind) in hits):
        if start >= last[kind] and (m := AT[kind][0].match(text, start)):
            if valid(kind, m):
                out.append((start, KINDS.index(kind), m.end()))
            if kind in BASE_KINDS or out and out[-1][0] == start:
                last[kind] = m.end()
    if has_hex:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans, an array of (kind, start, end), for every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        find = automaton().iter
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for ids, texts in text_slices(batches):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t, find)] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, spans array<struct<kind string, start int, end int>>")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret of the text replaced by mark; overlapping spans become one mark. Null stays null."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        find = automaton().iter
        for batch in batches:
            out = []
            for raw in batch.column(at).cast(pa.binary()).to_pylist():
                spans = spans_of(raw, find) if raw else []
                if spans:
                    text, parts, pos = raw.decode(), [], 0
                    for s, _, e in spans:
                        if s >= pos:
                            parts += [text[pos:s], mark]
                        pos = max(pos, e)
                    raw = "".join([*parts, text[pos:]]).encode()
                out.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string()) if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digest(scanned: DataFrame) -> DataFrame:
    """The counts, base_sha256 and joined spans of scan()'s rows."""
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return scanned.select("doc_id", *(n(k) for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
