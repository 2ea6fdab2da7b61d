"""What Python gets of tables and gives back: bounded batches, whatever the size of the input."""

import hashlib
import io
import random
import zipfile

import pytest

import __spark_entry__ as entry
from tidemark import queries as Q
from tidemark.functions import redaction as R
from tidemark.functions.rules import Rule
from tidemark.operators.scan import path_stage
from tidemark.plans import pack, verify

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
WORD = "q7" + "Zt" * 6


def test_engine_queries_let_batches_be_small(spark, sf_dir):
    before = spark.conf.get(SETTING, None)
    spark.conf.unset(SETTING)
    try:
        entry.queries()["policy_tokens"](spark, sf_dir)
        assert spark.conf.get(SETTING) == f"{2 << 20}b"
    finally:
        spark.conf.set(SETTING, before) if before else spark.conf.unset(SETTING)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_archives_are_streamed(spark):
    """No group and no single row is a frame of its own, and each archive is that of its files alone."""
    files = [(k % 7 if k % 7 < 6 else None, f"docs/{k}.md", f"text {k}\ntoken = \"{WORD}\"\n" * (k % 3)) for k in range(60)]
    made = pack.pack_groups(spark.createDataFrame(files, "archive long, path string, text string").repartition(5), "p")
    assert "MapInArrow" in plan(made) and "InPandas" not in plan(made)
    rows = made.collect()
    assert {r.archive: bytes(r.data) for r in rows} == {a: pack.archive_of([(p, t) for k, p, t in files if k == a], f"p-{a}") for a in (*range(6), None)} and len(rows) == 7
    listed = verify.listed_entries(made)
    assert "MapInArrow" in plan(listed) and "InPandas" not in plan(listed)
    got = sorted(((r.archive, r.n, r.path, r.size, bytes(r.content)) for r in listed.where("archive is not null").collect()))
    want = []
    for r in rows:
        with zipfile.ZipFile(io.BytesIO(bytes(r.data))) as z:
            want += [(r.archive, n, i.filename, i.file_size, z.read(i)) for n, i in enumerate(z.infolist()) if r.archive is not None]
    assert got == sorted(want)
    assert verify.checked_archives(made).collect() == [] and verify.archive_summaries(made).count() == 7


def test_only_wanted_entries_are_read(spark):
    """An entry that isn't wanted can be spoilt: its content isn't looked at, and doesn't leave Python."""
    data = pack.archive_of([("a.md", "some text\n"), ("b.md", f'token = "{WORD}"\n')], "p")
    made = spark.createDataFrame([(7, bytearray(data.replace(b"some text", b"same text")))], "archive long, data binary")
    rows = verify.listed_entries(made, lambda path: path == "CONTEXT.md").collect()
    assert [(r.archive, r.path, b"- `files/b.md`" in bytes(r.content)) for r in rows] == [(7, "CONTEXT.md", True)]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert rows[0].n == z.namelist().index("CONTEXT.md") and rows[0].size == len(bytes(rows[0].content))
    with pytest.raises(Exception, match="CRC"):
        verify.listed_entries(made).collect()


def test_assignments_are_tried_from_their_keys_on():
    """What a search from the text's beginning finds, in every line and with all that may stand before a key."""
    prose = "it was said again " * 1000
    assert R._key_start(prose + "'db-token'  = x", 0, len(prose) + 12) == len(prose) and R._key_start("a: token = x", 9, 9) == 9
    parts = ("token", "TOKEN", "pa\u017f\u017fword", "to\u212aen", "x" * 255, "_" * 257, "-", "=", ":", " = ", "\t", '"', "'", "\\", "\n", "\r\n", "\u2028", " ", "é", "abcd1234", "${A}", "if")
    rng, found = random.Random(5), 0
    for form, edits in ((R.DOUBLE_QUOTED, R._value(R.GENERIC, R._no_secret)), (R.SINGLE_QUOTED, R._value(R.GENERIC, R._no_secret)), (R.BARE, R._value(R.GENERIC, lambda m: R._no_secret(m) or R.is_code(m)))):
        near, whole = R._assignments(form, edits), R._matches(form, edits)
        for _ in range(3000):
            text = "".join(rng.choices(parts, k=rng.randint(2, 24)))
            want = list(whole(text))
            assert list(near(text)) == want, text
            found += len(want)
    assert found > 500


def test_detectors_are_asked_only_where_they_can_match(monkeypatch):
    """Plain prose reaches no form, and characters that (?i) takes for letters of a key still do."""
    assert all(not list(detect("it was said: a = b, at http://x/y@z; 'auth' | more > less " * 9)) for _, detect in R.CASCADE)
    searched = []
    monkeypatch.setattr(R, "Lines", lambda text: searched.append(text))
    R.redact("a | b > c: prose = none")
    assert not searched
    for key in ("toKen", "paſſword", "pass-word", "PASS_WORD"):
        masked, counts = R.redact(f"{key}: {WORD}")
        # the key's own characters decide whether it is sensitive; none may be passed over because of its case
        assert (counts == {R.GENERIC: 1}) == R.is_sensitive(key) and (WORD not in masked) == R.is_sensitive(key), key


def test_portable_paths_of_all_ascii():
    from tidemark.functions.paths import portable_path

    for c in map(chr, range(128)):
        assert (portable_path(f"a{c}b") is None) == (ord(c) < 32 or ord(c) == 127 or c in "\\:"), hashlib.sha256(c.encode()).hexdigest()


@pytest.mark.parametrize("name", ["rule_files", "manifest_fields", "config_files", "skip_reason_histogram"])
def test_small_files_are_dealt_over_tasks(spark, sf_dir, name):
    """However few bytes a table has: each of its rows takes Python or long expressions."""
    dealt = [line for line in plan(Q.QUERIES[name](spark, sf_dir)).splitlines() if "REPARTITION_BY_NUM" in line]
    assert dealt and all(f", {spark.conf.get('spark.sql.shuffle.partitions')})" in line for line in dealt)


def test_paths_are_decided_once(spark):
    """A predicate on the reason gets no copies of what the reason is made of."""
    files = spark.createDataFrame([("a\\b",), ("docs/x.py",), (".env",), ("é/π.md",), ("x/AKIA" + "Z9" * 8,), ("end.",)], "path string")
    found = path_stage(files, (Rule("/docs/"),))
    skipped = found.where("path_reason is not null")
    assert skipped._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= 12
    assert {r.path: (r.path_reason, r.shown_path == r.path, r.path_counts) for r in found.collect()} == {
        "a\\b": ("unsafe_path", False, {}), "docs/x.py": ("project_ignore", True, {}), ".env": ("always_excluded", True, {}), "é/π.md": (None, True, {}),
        "x/AKIA" + "Z9" * 8: ("secret_in_path", False, {"AWS_ACCESS_KEY": 1}), "end.": ("unsafe_path", False, {}),
    }
    assert skipped.count() == 5
