"""Operator 4, BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring symbols that stands side by side in no vocabulary entry can't be inside a merged token, so
a cut between them is certain. Words are cut at all such pairs; the fragments are encoded on their own (a fragment
is met far more often than its word, so most come from a table of those met before) and put together again. A slice of
texts is normalized, cut at white space by Arrow, and dictionary-encoded: the codec sees each different chunk of a slice
once, and ids and decoded texts are gathered for all texts by index.

The vocabulary file is read by each Python worker from `path`, a parameter; it must be readable on every node.
Results: null text counts as empty; an empty text has no tokens, ids and text hash as the empty string; every
input row gives one output row, repeated rows too; no rows give no rows. A very long text makes a slice of its own.
Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from veridra.llm.common import text_slices, texts

END = "</w>"
#: Entries that a worker keeps of chunks, and of fragments, met; a table starts anew beyond.
CACHE = 400_000
#: Up to this many symbols a plain scan for the best merge is quicker than a heap.
PLAIN = 48
NEVER = 1 << 30
#: White space as the Unicode property; letters and numbers that the library's Unicode tables (version
#: 16) don't know yet; capitals that Python's tables (15.1) don't know, with their small letters.
WHITE = r"\t-\r \x85\xa0  -     　"
LATER = "".join(
    f"\\U{int(a, 16):08x}-\\U{int((b or a), 16):08x}"
    for a, _, b in (
        x.partition("-")
        for x in """558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf
        10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686
        16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2
        1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5
        1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f""".split()
    )
)
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITALS |= {0x10D50 + k: 0x10D70 + k for k in range(22)} | {0x16EA0 + k: 0x16EBB + k for k in range(25)}
RARE = re.compile(f"[{LATER}{''.join(map(chr, CAPITALS))}]")


def split_pattern(template: str, later: bool) -> regex.Pattern:
    """The template with L, N and W set in; `later` leaves out what the library's tables don't know."""
    letter, number = (rf"[\p{{L}}--[{LATER}]]", rf"[\p{{N}}--[{LATER}]]") if later else (r"\p{L}", r"\p{N}")
    other = rf"(?:(?![{WHITE}]|{letter}|{number}).)" if later else rf"[^{WHITE}\p{{L}}\p{{N}}]"
    return regex.compile(template.replace("LL", letter).replace("NN", number).replace("OO", other), regex.V1 | regex.DOTALL)


#: Fixed value: the split of the vocabulary.
WORDS = [split_pattern("'s|'t|'re|'ve|'m|'ll|'d|LL+|NN|OO+", later) for later in (False, True)]
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
#: White space beyond ASCII's, and what Python but not the vocabulary takes for it: such texts are cut in Python.
ODD_WHITE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bytes of text that are dictionary-encoded at once.
SLICE = 8_000_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [], 0x100
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


BYTE_CHARS = byte_chars()


class Merges:
    """The merges of a vocabulary file in the JSON form of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {p: k for k, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}

    def merge(self, parts: list[str]) -> list[str]:
        """The tokens of a run of symbols: the best-ranked pair first, the leftmost of equals."""
        if len(parts) > PLAIN:
            return self._merge_long(parts)
        get, parts = self.ranks.get, list(parts)
        rank = [get(p, NEVER) for p in zip(parts, parts[1:])]
        while rank:
            best = min(rank)
            if best == NEVER:
                break
            at = rank.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del rank[at]
            if at:
                rank[at - 1] = get((parts[at - 1], parts[at]), NEVER)
            if at < len(rank):
                rank[at] = get((parts[at], parts[at + 1]), NEVER)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        n, sym = len(parts), list(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = right[k]
            if sym[k] != a or j < 0 or sym[j] != b:
                continue
            sym[k], sym[j], right[k] = a + b, "", right[j]
            if right[j] >= 0:
                left[right[j]] = k
            for i in (left[k], k):
                if i >= 0 and right[i] >= 0 and (r := self.ranks.get((sym[i], sym[right[i]]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[right[i]]))
        return [s for s in sym if s]


class ForcedBoundaryCodec:
    """Encodes and decodes texts as the library does with a vocabulary of words that end in `</w>`."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.inside = set()
        for token in self.merges.vocab:
            symbols = self._symbols_of(token)
            self.inside.update(zip(symbols, symbols[1:]))
        self.fragments: dict[tuple[str, ...], list[str]] = {}
        self.chunks: dict[str, bytes] = {}
        special = sorted(self.merges.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, special))) if special else None

    @staticmethod
    def _symbols_of(token: str) -> list[str]:
        if token.endswith(END) and token != END:
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def split(self, word: str) -> list[list[str]]:
        """The symbols of a word, cut at every forced boundary."""
        symbols = [BYTE_CHARS[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += END
        out, start = [], 0
        for k, pair in enumerate(zip(symbols, symbols[1:]), 1):
            if pair not in self.inside:
                out.append(symbols[start:k])
                start = k
        out.append(symbols[start:])
        return out

    def encode_word(self, word: str) -> list[str]:
        """Tokens of one pre-token."""
        out = []
        for part in self.split(word):
            key = "".join(part)
            if (tokens := self.fragments.get(key)) is None:
                if len(self.fragments) >= CACHE:
                    self.fragments.clear()
                tokens = self.merges.merge(part)
                if len(part) <= 64:
                    self.fragments[key] = tokens
            out += tokens
        return out

    def chunk(self, chunk: str) -> bytes:
        """Ids (as 32-bit integers) of normalized text without white space."""
        if (found := self.chunks.get(chunk)) is not None:
            return found
        body, last = chunk[:-1], chunk[-1:]
        if not chunk:
            words = []
        elif last in ".,;:!?" and body.isalpha() and not RARE.search(body):
            words = [body, last]
        else:
            rare = bool(RARE.search(chunk))
            words = [chunk] if not rare and chunk.isalpha() else WORDS[rare].findall(chunk)
        vocab = self.merges.vocab
        found = np.array([vocab[t] for word in words for t in self.encode_word(word)], np.int32).tobytes()
        if len(chunk) <= 64:
            if len(self.chunks) >= CACHE:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if RARE.search(text):
                text = text.translate(CAPITALS)
        return text.lower()

    def _plain(self, text: str) -> bytes:
        """Ids of text without special tokens."""
        text = self.normal(text)
        chunks = text.split() if not SEPARATORS.search(text) else regex.split(f"[{WHITE}]+", text)
        return b"".join(map(self.chunk, chunks))

    def encode(self, text: str) -> list[int]:
        """Ids of one text, special tokens in it included."""
        at, out = 0, []
        for m in self.specials.finditer(text) if self.specials else ():
            out += [self._plain(text[at : m.start()]), np.int32(self.merges.special[m[0]]).tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:] if at else text)]), np.int32).tolist()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text begin (and the last ones end), and the ids of all."""
        one_by_one = {k: self.encode(t) for k, t in enumerate(texts) if any(x in t for x in self.merges.special) or ODD_WHITE.search(t)}
        lists = pc.ascii_split_whitespace(pa.array(["" if k in one_by_one else self.normal(t) for k, t in enumerate(texts)], pa.string()))
        flat = lists.flatten().dictionary_encode()
        known = list(map(self.chunk, flat.dictionary.to_pylist()))
        size, code = np.fromiter(map(len, known), np.int64, len(known)) // 4, np.asarray(flat.indices, dtype=np.int64)
        start, n = np.cumsum(size) - size, size[code]
        ends = np.r_[0, np.cumsum(n)]
        ids = np.frombuffer(b"".join(known), np.int32)[np.repeat(start[code] - ends[:-1], n) + np.arange(ends[-1])]
        offsets = ends[np.asarray(lists.offsets, dtype=np.int64)]
        if one_by_one:  # they have no ids yet
            more = np.zeros(len(texts), np.int64)
            more[list(one_by_one)] = list(map(len, one_by_one.values()))
            ids = np.insert(ids, np.repeat(offsets[:-1], more), np.concatenate([np.array(x, np.int32) for x in one_by_one.values()]))
            offsets = offsets + np.r_[0, np.cumsum(more)]
        return offsets, ids

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: what the library gives where the file names no decoder."""
        return self.decode_all(np.array([0, len(ids)]), np.array(ids, np.int32))[0]

    def decode_all(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """The texts that the ids of each stretch decode to; ids that the vocabulary lacks say nothing."""
        names, _ = self.by_id
        known = np.asarray(names.is_valid())[ids] if names.null_count else None
        if known is not None and not known.all():
            offsets, ids = np.r_[0, np.cumsum(known)][offsets], ids[known]
        return joined(offsets, names.take(pa.array(ids)))

    @cached_property
    def by_id(self) -> tuple[pa.StringArray, pa.StringArray]:
        """The token and the decimal digits of each id."""
        names = {i: t for t, i in (self.merges.vocab | self.merges.special).items()}
        every = range(max(names) + 1)
        return pa.array([names.get(i) for i in every], pa.string()), pa.array(list(map(str, every)), pa.string())

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text the number of its tokens, and hashes of the joined ids and of what they decode to."""
        offsets, ids = self.encode_all(texts)
        written = joined(offsets, self.by_id[1].take(pa.array(ids)))
        sha = hashlib.sha256
        return [(n, sha(x.encode()).hexdigest(), sha(y.encode()).hexdigest()) for n, x, y in zip(np.diff(offsets).tolist(), written, self.decode_all(offsets, ids), strict=True)]


def joined(offsets: np.ndarray, parts: pa.StringArray) -> list[str]:
    """The parts of each stretch, joined by spaces."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts), " ").to_pylist()


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryCodec:
    return ForcedBoundaryCodec(path)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row for each row of docs (columns doc_id and text): see SCHEMA."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in text_slices(batches, SLICE):
            found = own.digests(texts(batch))
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            cols = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(rows, SCHEMA)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded for each row of docs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in text_slices(batches, 500_000):
            offsets, ids = own.encode_all(texts(batch))
            doc = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([doc, lists, pa.array(own.decode_all(offsets, ids), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, ids array<int>, decoded string")
