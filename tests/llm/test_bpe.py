import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veridra.llm import bpe, tokencount

ODD = ["", "  ", "a  b\n\nc 's don't I'LL x<|endoftext|>y <|startoftext|> Σας ΟΔΟΣ İstanbul ½ Ⅷ ǅ\x1c\x1fq é ", "漢字かな 🎉🎉 ٣٤", "tab\tx y\u2003z\u200b", " lead", "trail ", "\n", "a\n", "x" * 3000, "ab" * 5000, "ﬁ ẞ ŉ 'S 'T", "\u1c89\ua7cb x"]


def texts():
    rnd = random.Random(4)
    pick = lambda: rnd.choice([chr(rnd.randrange(0x20, 0x17F)), chr(rnd.randrange(1, 0xD7FF)), chr(rnd.randrange(0xE000, 0x3FFFF)), " ", "a", "\n", "'s", "  ", "1"])
    return ODD + ["".join(pick() for _ in range(30)) for _ in range(800)]


@pytest.fixture(scope="module")
def word():
    path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path), bpe.codec(path), path


def test_codec_equals_the_library(word):
    library, own, _ = word
    for text, want in zip(texts(), library.encode_batch(texts(), add_special_tokens=False), strict=True):
        assert own.encode(text) == want.ids, text
        assert own.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)
        ((n, ids, decoded),) = own.digests([text])
        assert (n, ids) == (len(want.ids), hashlib.sha256(" ".join(map(str, want.ids)).encode()).hexdigest())
        assert decoded == hashlib.sha256(library.decode(want.ids, skip_special_tokens=False).encode()).hexdigest()


def test_slices_equal_single_texts(word):
    _, own, _ = word
    many = texts()
    assert own.digests(many) == [own.digests([t])[0] for t in many] and own.digests([]) == []
    offsets, ids = own.encode_all(many)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [own.encode(t) for t in many]


def test_forced_boundaries_never_split_a_token(word):
    _, own, _ = word
    for w in ["unbelievable", "thwhion", "qxzj", "ßtraße", "a", "x" * 200]:
        parts = own.split(w)
        assert [s for p in parts for s in p] == own.split(w)[0] + [s for p in own.split(w)[1:] for s in p]
        whole = own.merges.merge([s for p in parts for s in p])
        assert [t for p in parts for t in own.merges.merge(p)] == whole


def test_long_merges_equal_short_ones(word):
    _, own, _ = word
    rnd = random.Random(5)
    for _ in range(50):
        symbols = [rnd.choice("abcdeinorst") for _ in range(120)]
        long = own.merges.merge(symbols)
        limit, bpe.PLAIN = bpe.PLAIN, 10**6
        try:
            assert own.merges.merge(symbols) == long
        finally:
            bpe.PLAIN = limit


def test_counts_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), tokencount.Counts(path, tokencount.whole_tokens(path))
    for text, want in zip(texts(), library.encode_batch(texts(), add_special_tokens=False), strict=True):
        assert own.count(text) == len(want.ids), text
        assert own.count_all([text, " a b", text, ""]).tolist() == [len(want.ids), own.count(" a b"), len(want.ids), 0], text
    assert own.count_all(texts()).tolist() == list(map(own.count, texts())) and not len(own.count_all([]))


def test_rows(spark, word):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "", 0), (None, "hé " * 600, 0)], "doc_id long, text string, n_tokens int")
    got = bpe.round_trip(df, word[2]).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256 == empty) for r in got] == [(0, True), (0, True), (0, True), (got[3].n_tokens, False)]
    counts = tokencount.token_counts(df, path).collect()
    assert [(r.n_bytes, r.over_limit) for r in counts] == [(0, False), (0, False), (0, False), (2400, True)]
    both = bpe.encode(df, word[2]).collect()
    assert both[3].ids == word[1].encode("hé " * 600) and both[0].ids == []
    assert bpe.round_trip(df.limit(0), word[2]).count() == 0
