"""Secret scan: keyword automaton, anchored patterns near hits, checksums.

1. One Aho-Corasick pass over the ASCII-lower-cased text finds every keyword
   (assignment names, token prefixes).  Text without a hit costs only this pass.
2. At each hit the kind's pattern is *anchored* there, never searched.
3. Kinds with an embedded check are kept only when it holds: the last six
   base-62 digits of GitHub/npm style tokens are the CRC-32 of the body, a JSON
   web token's header must decode to JSON with an ``alg``.

Hex runs carry no keyword; they are the maximal ``[0-9a-f]`` runs, found for a
whole slice of the column at once by run lengths.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.textcols import SLICE_BYTES, raw, text_array

# fixed values: kinds in the order in which they are listed
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "slack", "stripe", "google", "private_key")

_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
                     r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_PREFIXED = {
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "jwt": re.compile(r"(eyJ[0-9A-Za-z_-]{4,})\.([0-9A-Za-z_-]{4,})\.([0-9A-Za-z_-]{8,})"),
    "slack": re.compile(r"xox[abprs]-[0-9]{8,}(?:-[0-9A-Za-z]+)+"),
    "stripe": re.compile(r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    "google": re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    # to its END line; without one, the base64 lines that follow
    "private_key": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=:,.\s]|-(?!----))*+-----END (?:[A-Z]+ )*PRIVATE KEY-----"
                              r"|(?:\s+[A-Za-z0-9+/=]{16,})*)"),
}
# fixed values: lower-case keyword -> kind
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
    "api_key": "assign", "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
    "eyj": "jwt", "xox": "slack", "sk_live_": "stripe", "rk_live_": "stripe", "sk_test_": "stripe",
    "rk_test_": "stripe", "aiza": "google", "-----begin ": "private_key",
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24


def base62_crc32(body: str) -> str:
    """CRC-32 of the body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def _jwt_ok(header: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
    except (ValueError, TypeError):
        return False


def _accept(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return m.end(1) - m.start(1) >= MIN_ASSIGN
    if kind == "access":
        return m.end() - m.start() >= MIN_ACCESS
    if kind in ("github", "npm"):
        return base62_crc32(m.group(1)) == m.group(2)
    if kind == "jwt":
        return _jwt_ok(m.group(1))
    return True


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def keyword_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every accepted keyword kind; per kind leftmost and
    non-overlapping, where a failing match also uses up its characters."""
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits: dict[str, list[int]] = {}
    for end, (size, kind) in automaton.iter(low):
        hits.setdefault(kind, []).append(end - size + 1)
    out = []
    for kind, starts in hits.items():
        pattern = _ASSIGN if kind == "assign" else _ACCESS if kind == "access" else _PREFIXED[kind]
        free = 0
        for s in sorted(starts):
            if s >= free and (m := pattern.match(text, s)):
                free = m.end()
                if _accept(kind, m):
                    out.append((s, m.end(), kind))
    return out


def hex_runs(data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, byte start, byte end) of every maximal hex run of MIN_HEX or more."""
    out, n = [], len(off) - 1
    lo = 0
    while lo < n:
        hi = min(max(int(np.searchsorted(off, off[lo] + SLICE_BYTES, side="right")) - 1, lo + 1), n)
        a, b = int(off[lo]), int(off[hi])
        if b > a:
            flag = _HEX[data[a:b]]
            change = np.flatnonzero(flag[1:] != flag[:-1]) + 1
            change = np.unique(np.concatenate(([0], change, off[lo:hi] - a, [b - a])))
            change = change[change <= b - a]
            st, en = change[:-1], change[1:]
            good = (en - st >= MIN_HEX) & flag[st]
            for s, e in zip((st[good] + a).tolist(), (en[good] + a).tolist(), strict=True):
                out.append((int(np.searchsorted(off, s, side="right")) - 1, s, e))
        lo = hi
    return out


def _order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``<id_col>, spans array<struct<kind,start,end>>``.

    Offsets are code points, end exclusive.  Null text counts as empty and has
    no spans; a null id stays null; repeated rows are scanned each; other
    columns are ignored.  Work is per row, so no key can be hot.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            col = text_array(batch.column("text"))
            data, off = raw(col)
            runs: dict[int, list[tuple[int, int]]] = {}
            for d, s, e in hex_runs(data, off):
                runs.setdefault(d, []).append((s, e))
            spans = []
            for d in range(len(col)):
                text = col[d].as_py()
                found = keyword_spans(text, automaton) if text else []
                for s, e in runs.get(d, ()):
                    at = int(s - off[d])
                    if not text.isascii():
                        at = len(data[off[d]:s].tobytes().decode("utf-8"))
                    found.append((at, at + e - s, "hex"))
                spans.append([{"kind": k, "start": s, "end": e} for s, e, k in _order(found)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(spans, type=pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                names=["id", "spans"])

    out = src.mapInArrow(run, f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.select(F.col("id").alias(id_col), "spans")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, text`` with every span replaced by ``<SECRET:kind>`` (overlaps merged)."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                spans = keyword_spans(text, automaton)
                spans += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]{24,}", text)]
                parts, at = [], 0
                for s, e, k in _order(spans):
                    if e <= at:
                        continue
                    if s >= at:
                        parts += [text[at:s], f"<SECRET:{k}>"]
                    at = e
                texts.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, type=pa.string())], names=["id", "text"])

    return src.mapInArrow(run, f"id {id_type}, text string").select(F.col("id").alias(id_col), F.col("text").alias(text_col))
