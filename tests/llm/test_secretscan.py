import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tonelake.llm.secretscan import KINDS, find_secrets, scan

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PIECES = ["password", "PassWD", "Token", "secret", "api_key", "apikey", "AKIA", "akia", "=", ":", " ", '"', "'", "abc123", "0f" * 13, "A1" * 9, "İ", "ſecret", "\n", "x"]


def brute(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_kinds_against_plain_search(text):
    assert [x for x in scan(text) if x[1] < 3] == brute(text)


def checked(prefix, body):
    digits, left = "", zlib.crc32(body.encode())
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    while len(digits) < 6:
        left, d = divmod(left, 62)
        digits = alphabet[d] + digits
    return prefix + body + digits


def test_checksums():
    good = checked("ghp_", "aB3" * 10)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    npm = checked("npm_", "Zz9" * 10)
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJhIjoxfQ.c2ln"
    text = f"keys {good} and {bad} {npm} {jwt} eyJub3Q.e30.x"
    kinds = [(KINDS[k], text[a:b]) for a, k, b in scan(text)]
    assert kinds == [("github", good), ("npm", npm), ("jwt", jwt)]


def test_table(spark, odd):
    rows = [(1, "token = 'abcdef0123'"), (1, None), (None, ""), (2, "é" * 70_000 + " AKIA" + "Z" * 16)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["spans"]: r for r in find_secrets(df).collect()}
    assert set(got) == {"assign:0:19", "", "access:70001:70021"}
    assert got["access:70001:70021"]["n_access"] == 1
    assert find_secrets(odd.withColumnRenamed("lang", "spans")).count() == 8
    assert find_secrets(df.limit(0)).count() == 0


def test_deep_headers_and_long_runs():
    import base64
    import time

    deep = base64.urlsafe_b64encode(('{"a":' + "[" * 100_000).encode()).decode().rstrip("=")
    assert scan(f"{deep}.x.y") == []
    began = time.time()
    assert [x for x in scan("eyJ" * 350_000) if x[1] > 2] == []
    assert time.time() - began < 2
    # a run that fails hides no token after it
    head = base64.urlsafe_b64encode(b'{"alg":"none"}').decode().rstrip("=")
    token = f"{head}.e30.c2ln"
    text = f"eyJeyJ eyJa.eyJb {token} EYJ{token}"
    assert [text[a:b] for a, k, b in scan(text) if KINDS[k] == "jwt"][0] == token
    assert scan(f"{token}")[0][2] == len(token)


def test_no_rows(spark, odd):
    assert find_secrets(odd.limit(0)).count() == 0
