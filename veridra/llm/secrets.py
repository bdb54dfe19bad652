"""Operator 1, secret scans: an Aho-Corasick keyword prefilter, anchored patterns near hits, embedded checksums.

One pass over the texts in Python workers. The automaton finds every place where a keyed pattern can begin; the
pattern is then matched at just that place. Long hex runs have no keyword: any run of 24 covers three neighbours
of every eighth character, so only texts (and places) with such three are looked at. Tokens with a CRC-32 in their
last six characters (base 62) count only if it is right.

Results: null text counts as empty; no text, no spans; every input row gives one output row, repeated rows too.
"""

from __future__ import annotations

import binascii
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from veridra.llm.common import text_slices, texts

# The kinds in listing order and their patterns.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"
STRIDE = MIN_HEX // 3
THREE_HEX = re.compile(r"[0-9a-f]{3}")
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            a.add_word(word, (len(word), kind))
        a.make_automaton()
        _automaton = a
    return _automaton


def checksum(body: str) -> str:
    """The last six characters of a token whose first characters are body: its CRC-32 in base 62."""
    n, out = binascii.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0")


def _hex_spans(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in THREE_HEX.finditer(text[STRIDE - 1 :: STRIDE]):
        for k in range(m.start(), m.end()):
            p = k * STRIDE + STRIDE - 1
            if p < end:
                continue
            a = p
            while a > end and text[a - 1] in "0123456789abcdef":
                a -= 1
            end = HEX.match(text, p).end()
            if end - a >= MIN_HEX:
                yield a, end


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of everything found, in order; ends are exclusive code points."""
    low = text.lower()
    if len(low) != len(text):  # a character whose lower case is longer
        low = "".join(c if c > "\x7f" else c.lower() for c in text)
    hits: dict[str, list[int]] = {}
    for last, (size, kind) in automaton().iter(low):
        hits.setdefault(kind, []).append(last - size + 1)
    out, end = [], 0
    for at in sorted(hits.get("assign", ())):
        if at >= end and (m := ASSIGN.match(text, at)):
            end = m.end()
            if len(m[2]) >= MIN_ASSIGN:
                out.append((at, 0, end))
    end = 0
    for at in hits.get("access", ()):
        if at >= end and (m := ACCESS.match(text, at)):
            end = m.end()
            if end - at >= MIN_ACCESS:
                out.append((at, 1, end))
    out += [(a, 2, b) for a, b in _hex_spans(text)]
    for k, pattern in ((3, GITHUB), (4, NPM)):
        for at in hits.get(KINDS[k], ()):
            if (m := pattern.match(text, at)) and checksum(m[0][4:-6]) == m[0][-6:]:
                out.append((at, k, m.end()))
    return sorted(out)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        cols: list[list] = [[] for _ in range(6)]
        for text in texts(batch):
            found = spans(text)
            written = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
            kinds = [k for _, k, _ in found]
            base = ",".join(w for w, k in zip(written, kinds, strict=True) if k < 3)
            for col, value in zip(cols, (*(kinds.count(k) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), ",".join(written), sum(k > 2 for k in kinds)), strict=True):
                col.append(value)
        ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([ids, *map(pa.array, cols, kinds)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"])


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (columns doc_id and text; others are ignored): see SCHEMA."""
    return docs.select("doc_id", "text").mapInArrow(_rows, SCHEMA)
