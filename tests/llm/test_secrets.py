import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from veridra.llm import secrets


def brute(text):
    out = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in secrets.ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in secrets.HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


PIECES = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "fff", "x", "İ", "ſ", "K", "\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30))
def test_base_equals_brute_force(parts):
    text = "".join(parts)
    assert [s for s in secrets.spans(text) if s[1] < 3] == brute(text)


def test_checksums():
    body = "a1B2c3D4e5" * 3
    good = "ghp_" + body + secrets.checksum(body)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert [k for _, k, _ in secrets.spans(f"x {good} y")] == [3]
    assert secrets.spans(f"x {bad} y") == []
    assert [k for _, k, _ in secrets.spans("npm_" + body + secrets.checksum(body))] == [4]
    assert secrets.spans(good + "A") == []


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "token: abcdef"), (3, "token: abcdef"), (None, "f" * 24), (4, "x" * 300_000 + " secret=abcdefg")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string")
    got = secrets.scan(df).collect()
    assert len(got) == len(rows)
    assert [(r.n_assign, r.n_access, r.n_hex) for r in got] == [(0, 0, 0), (0, 0, 0), (1, 0, 0), (1, 0, 0), (0, 0, 1), (1, 0, 0)]
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == "assign:0:13"
    assert secrets.scan(df.limit(0)).count() == 0


def test_random_hex_runs():
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choice(["0123456789abcdef"[rnd.randrange(16)] * rnd.randrange(1, 40), "g", "Z"]) for _ in range(12))
        assert [s for s in secrets.spans(text) if s[1] == 2] == [s for s in brute(text) if s[1] == 2]
