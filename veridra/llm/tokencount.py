"""Operator 10, token counts with the whole-token shortcut.

Before the pass, `whole_tokens` proves which vocabulary strings come out of the merges as one token when they stand
alone. A pre-token among them counts one without any merge; only the rest are merged. Texts in which no two white
space characters meet are taken chunk by chunk (a chunk is what stands between single spaces, with the space before
it), as pre-tokens never reach over a chunk's ends there. A slice of texts is cut and dictionary-encoded by Arrow, so
each of its different chunks is looked up once; counts of chunks met are kept.

Results: null text counts as empty (0 bytes, 0 tokens); every input row gives one output row, repeated rows too; no rows
give no rows. A very long text makes a slice of its own. Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from veridra.llm.bpe import BYTE_CHARS, RARE, SLICE, WHITE, Merges, split_pattern
from veridra.llm.common import text_slices, texts

LIMIT = 512
CACHE = 600_000
#: Fixed value: the split of the vocabulary.
PATTERN = [split_pattern(rf"'s|'t|'re|'ve|'m|'ll|'d| ?LL+| ?NN+| ?OO+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+", later) for later in (False, True)]
TWO_WHITE = re.compile(rf"[{WHITE}][{WHITE}]")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def spelled(text: str) -> str:
    return "".join([BYTE_CHARS[b] for b in text.encode("utf-8", "surrogatepass")])


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings (spelled in byte characters) that the merges turn into themselves."""
    m = merges(path)
    return frozenset(t for t in m.vocab if m.merge(list(t)) == [t])


class Counts(dict):
    """Tokens of each chunk met; a chunk not met before is split and merged."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__()
        self.merges, self.whole = merges(path), whole
        special = sorted(self.merges.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __missing__(self, chunk: str) -> int:
        body = chunk[1:-1]
        if chunk[-1:] in (".", ",") and body.isalpha() and (chunk[0] == " " or chunk[0].isalpha()) and not RARE.search(chunk):
            n = self[chunk[:-1]] + 1  # the mark stands alone: it is followed by white space or the end
        elif body.isalpha() and chunk[-1].isalpha() and (chunk[0] == " " or chunk[0].isalpha()) and not RARE.search(chunk):
            n = self.one(chunk)
        else:
            n = sum(map(self.one, PATTERN[bool(RARE.search(chunk))].findall(chunk)))
        if len(chunk) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = n
        return n

    def one(self, token: str) -> int:
        """Tokens of one pre-token."""
        name = spelled(token)
        return 1 if name in self.whole else len(self.merges.merge(list(name)))

    def plain(self, text: str) -> int:
        if TWO_WHITE.search(text):
            return sum(map(self.__getitem__, PATTERN[bool(RARE.search(text))].findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        n = self[first]
        for chunk in rest:
            n += self[chunk[1:]] + 1 if chunk[:1] == "\n" else self[" " + chunk]
        return n

    def count(self, text: str) -> int:
        if self.specials and self.specials.search(text):
            return len(self.specials.findall(text)) + sum(map(self.plain, self.specials.split(text)))
        return self.plain(text)

    def count_all(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        apart = {k: self.count(t) for k, t in enumerate(texts) if TWO_WHITE.search(t) or any(x in t for x in self.merges.special)}
        ready = ["" if k in apart else t.replace("\n", " \n") for k, t in enumerate(texts)]
        lists = pc.split_pattern(pa.array(ready, pa.string()), " ")
        flat = lists.flatten().dictionary_encode()
        spaced = {c: self[c[1:]] + 1 if c[:1] == "\n" else self[" " + c] for c in flat.dictionary.to_pylist()}
        each = np.fromiter(spaced.values(), np.int64, len(spaced))[np.asarray(flat.indices, dtype=np.int64)]
        out = np.diff(np.r_[0, np.cumsum(each)][np.asarray(lists.offsets, dtype=np.int64)])
        firsts = [t.split(" ", 1)[0] for t in ready]  # no space before these, whatever was counted above
        out += np.array([self[c] - spaced[c] for c in firsts], np.int64)
        out[list(apart)] = list(apart.values())
        return out


@lru_cache(maxsize=2)
def counts(path: str, whole: frozenset[str]) -> Counts:
    return Counts(path, whole)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs (columns doc_id and text): see SCHEMA."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # no larger than the vocabulary

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counts(path, whole.value)
        for batch in text_slices(batches, SLICE):
            found = texts(batch)
            n = own.count_all(found)
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            size = [len(t.encode("utf-8", "surrogatepass")) for t in found]
            cols = [pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(rows, SCHEMA)
