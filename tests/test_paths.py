import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.errors import ConfigError
from tidemark.functions import paths as P
from tidemark.functions.rules import Rule, denied, is_denied, matches, parse_rules
from tidemark.functions.sizes import format_size, parse_size
from tidemark.operators.scan import collisions, path_stage, sanitized

PORTABLE = {"src/a.py": True, "con.txt": False, "a/NUL": False, "lpt9.x.y": False, "a:b": False, "a.": False, "a ": False, "a\x07": False, "a‮b": False, "a\\b": False, "": False, "../a": False, "/a": False, "a//b": False, "x" * 256: False, "conx.txt": True, ".env": True}


@pytest.mark.parametrize("path", PORTABLE)
def test_portable(path):
    assert (P.portable_path(path) is not None) == PORTABLE[path]


def test_composition():
    assert P.portable_path("é.txt") == "é.txt" and P.portable_path("é.txt", normalize=False) is None


def test_columns_agree(spark):
    df = spark.createDataFrame([(p,) for p in [*PORTABLE, "é/ß.txt", None]], "p string")
    for r in df.select("p", P.portable(df.p).alias("slow"), P.safe_path(df.p).alias("fast"), P.fold_key(df.p).alias("key")).collect():
        assert r.slow == r.fast == (None if r.p is None else P.portable_path(r.p))
        assert r.key == (None if r.p is None else r.p.casefold())


EXCLUDED = {".env": 1, ".env.local": 1, ".env.example": 0, ".env.example.bak": 1, ".env.example/x": 1, "a/node_modules/b": 1, "x.egg-info/y": 1, "x.egg-info": 0, "id_rsa": 1, "id_rsa_work": 1, "id_rsa.pub": 0, "k.pem": 1, ".pem": 1, "k.PEM~": 1, "s.tfstate": 1, "s.tfstate.1": 1, "a.ppk.old": 1, "auth.json.save": 1, "src/a.py": 0, "builds/a": 0, "build": 1, "x.db": 1, "db": 0, "a/.ssh/config": 1, "keys/a.txt": 0}


def test_always_excluded(spark):
    df = spark.createDataFrame(list(EXCLUDED.items()), "p string, e int")
    wrong = [r.p for r in df.select("p", "e", P.is_always_excluded(df.p).alias("got")).collect() if r.got != bool(r.e)]
    assert wrong == []


RULE_CASES = [("build/", "a/build/x", 1), ("build/", "build", 1), ("*.log", "a/b.log", 1), ("*.log", "b.log/c", 1), ("/a.txt", "sub/a.txt", 1), ("/tmp/", "tmp/x", 1), ("/tmp/", "a/tmp/x", 0), ("/t*/", "tmp/x", 0), ("a*c", "a/b/c", 0), ("x/*.py", "x/y/z.py", 1), ("/*", "a/b", 1), ("do?s/", "docs/x", 1), ("a/b/", "q/a/b/c", 1), ("[ab].c", "b.c", 1), ("[!ab].c", "b.c", 0), ("[.c", "[.c", 1), ("/", "a", 0)]


def test_rules(spark):
    for pattern, path, expected in RULE_CASES:
        assert matches(pattern, path) == bool(expected), (pattern, path)
        df = spark.createDataFrame([(path,)], "p string")
        assert df.select(denied(df.p, [Rule(pattern)]).alias("d")).first().d == bool(expected), (pattern, path)


def test_rule_order():
    rules = [Rule("*.py", deny=False), Rule("keep.py", negated=True, deny=False), Rule("deny.py")]
    assert [is_denied(p, rules) for p in ("a.py", "keep.py", "deny.py", "b")] == [True, False, True, False]


def test_rule_files():
    assert parse_rules("﻿# c\n\n a/ \nb\\c") == [Rule("a/"), Rule("b/c")]
    for text in ("!a", "x" * 1025, "\n".join(f"r{i}" for i in range(513))):
        with pytest.raises(ConfigError):
            parse_rules(text)


def test_sizes():
    assert [parse_size(x) for x in ("5", "1k", "2MiB", " 3 gb ", "1T")] == [5, 1024, 2 << 20, 3 << 30, 1 << 40]
    assert [format_size(x) for x in (1023, 1536, 5 << 40)] == ["1023 B", "1.5 KiB", "5120.0 GiB"]
    for text in ("0", "", "-1", "1q", "x"):
        with pytest.raises(ConfigError):
            parse_size(text)


def test_suffixes(spark):
    cases = {"a.tar.gz": ".gz", ".gitignore": "", "a.": "", "A.PY": ".py", "d.x/b": ""}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.s for r in df.select("p", P.last_suffix(df.p).alias("s")).collect()} == cases


def test_path_stage(spark):
    secret = "gh" + "p_" + "a1" * 12
    df = spark.createDataFrame([("./src/a.py",), ("a\\b",), (f"x/{secret}",), (".env",), ("no/x.sql",), ("out.zip",)], "path string")
    rows = {r.path: (r.shown_path, r.path_reason) for r in path_stage(df, [Rule("*.sql")], "out.zip").collect()}
    assert rows["./src/a.py"] == ("src/a.py", None) and rows["a\\b"][1] == "unsafe_path" and rows["a\\b"][0].startswith("<unsafe-path:")
    assert rows[f"x/{secret}"] == ("<redacted-path>", "secret_in_path") and rows[".env"][1] == "always_excluded" and rows["no/x.sql"][1] == "project_ignore" and rows["out.zip"][1] == "output_archive"


def test_collisions(spark):
    df = spark.createDataFrame([("A.txt",), ("a.txt",), ("b",), ("STRASSE",), ("straße",)], "safe_path string")
    assert sorted(r.fold for r in collisions(df).collect()) == ["a.txt", "strasse"]


def test_sanitized():
    assert sanitized("a‮b", 99) == ("a�b", {"UNSAFE_METADATA": 1})
    assert sanitized("x" * 50, 20) == ("x" * 9 + "[TRUNCATED]", {"TRUNCATED_METADATA": 1})
    assert sanitized(None, 5) == (None, {})


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_portable_is_stable(path):
    out = P.portable_path(path)
    assert out is None or P.portable_path(out, normalize=False) == out
