"""Queries over tables of archives, manifests, policies and names, and the same in SQL for DuckDB.

Eight documents make an archive, and every fifth document has a secret at its end.
"""

from __future__ import annotations

import copy
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import vocabulary as V
from tidemark.config import Config, policy_token
from tidemark.errors import ConfigError
from tidemark.functions import redaction as R
from tidemark.functions.rules import parse_rules
from tidemark.operators.scan import path_stage, sanitized_with_counts, skipped_order
from tidemark.operators.select import greedy_select
from tidemark.plans import manifest, pack, verify
from tidemark.queries import _NAME, _PORTABLE_SQL, _RULE_SQL, _SELECT, DOCS, EXCLUDED, PATHS, RULES, SELECT_FILES, SELECT_TOTAL, _many_paths, _narrow_files, natural_hits, natural_masked, query
from tidemark.sources.tables import document_files, spread, table

ARCHIVED = f"""{DOCS}, a AS (SELECT doc_id // 8 AS archive, path, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'token = "' || left(sha256(text), 20) || '"' ELSE text END AS text FROM docs),
    p AS (SELECT *, 'files/' || path AS name, {natural_masked('text')} AS packed, {natural_hits('text')} AS hits FROM a)"""
_TURN = "row_number() OVER (PARTITION BY archive ORDER BY lower(name), name)"


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_files(spark, sf_dir)
    secret = F.concat(F.lit('\ntoken = "'), F.substring(F.sha2("text", 256), 1, 20), F.lit('"'))
    text = F.concat("text", F.when(F.pmod("doc_id", F.lit(5)) == 0, secret).otherwise(F.lit("")))
    return pack.pack_groups(docs.select(F.floor(F.col("doc_id") / 8).alias("archive"), "path", text.alias("text")), "docs")


@query(f"WITH {ARCHIVED} SELECT archive, {_TURN} + 4 AS n, name AS path, octet_length(encode(packed))::BIGINT AS size, sha256(packed) AS sha256 FROM p")
def archive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored files of each archive as they are read back, with their places; five generated entries come before them."""
    entries = verify.listed_entries(archives(spark, sf_dir), lambda path: path.startswith("files/"))
    return entries.select("archive", "n", "path", "size", F.sha2("content", 256).alias("sha256"))


@query(f"WITH {ARCHIVED} SELECT archive, name AS path, octet_length(encode(packed))::BIGINT AS size, sha256(packed) AS sha256, path AS source_path, octet_length(encode(text))::BIGINT AS source_size, hits AS redactions FROM p")
def archive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each archive's manifest."""
    return verify.manifest_records(archives(spark, sf_dir))


@query(f"WITH {ARCHIVED} SELECT archive, 'VERIFIED' AS integrity, 'docs-' || archive AS project, count(*) AS source_files, sum(octet_length(encode(packed)))::BIGINT AS packed_bytes, sum(hits)::BIGINT AS redactions FROM p GROUP BY archive")
def archive_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All archives are verified, their totals among others."""
    return verify.archive_summaries(archives(spark, sf_dir))


#: What is done to an archive, by its number modulo the length, and the check that must tell.
TAMPERING = ("", "entry.sha256", "entry.size", "entry.missing", "entry.extra", "entry.order", "entry.stored", "entry.mode", "entry.time", "archive", "archive")


def tampered(data: bytes, kind: int) -> bytes:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        entries = [(i, z.read(i)) for i in z.infolist()]
    at = max((k for k, (i, _) in enumerate(entries) if i.filename.startswith("files/")), key=lambda k: len(entries[k][1]))
    info, content = entries[at]
    if kind == 1:
        entries[at] = info, bytes([content[0] ^ 1]) + content[1:]
    elif kind == 2:
        entries[at] = info, content + b"x"
    elif kind == 3:
        del entries[at]
    elif kind == 4:
        extra = copy.copy(info)
        extra.filename = "files/zz"
        entries.insert(next(k for k, (i, _) in enumerate(entries) if i.filename == "MANIFEST.json"), (extra, b""))
    elif kind == 5:
        entries.reverse()
    elif kind == 6:
        info.compress_type = zipfile.ZIP_DEFLATED
    elif kind == 7:
        info.external_attr = 0o100755 << 16
    elif kind == 8:
        info.date_time = (1981, 1, 1, 0, 0, 0)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, c in entries:
            z.writestr(i, c, compress_type=i.compress_type)
        if kind == 10:
            z.comment = b"more"
    return out.getvalue()[: -1 if kind == 9 else None]


def _tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            yield batch.assign(data=[tampered(bytes(d), k % len(TAMPERING)) if k % len(TAMPERING) else d for k, d in zip(batch["archive"], batch["data"], strict=True)])

    made = archives(spark, sf_dir)
    return made.mapInPandas(run, made.schema)


_KIND = "CASE archive % 11 " + " ".join(f"WHEN {k} THEN '{check}'" for k, check in enumerate(TAMPERING) if check) + " END"


@query(f"WITH a AS (SELECT DISTINCT doc_id // 8 AS archive FROM documents) SELECT archive, {_KIND} AS \"check\" FROM a WHERE archive % 11 > 0")
def archive_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.checked_archives(_tampered(spark, sf_dir)).select("archive", "check").distinct()


@query(f"WITH {ARCHIVED} SELECT archive, 'NOT_VERIFIED' AS integrity, count(*) AS source_files FROM p WHERE archive % 11 < 2 GROUP BY archive")
def archive_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inspection doesn't read contents, so it lets pass what only their hashes would tell."""
    return verify.archive_summaries(_tampered(spark, sf_dir), hashes=False).select("archive", "integrity", "source_files")


def _lines(spark: SparkSession, sf_dir: str, entry: str, wanted: str) -> DataFrame:
    """(archive, n, line) of the lines of an entry that begin so."""
    text = verify.listed_entries(archives(spark, sf_dir), lambda path: path == entry).select("archive", F.decode("content", "UTF-8").alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.startswith(wanted))
    return text.select("archive", F.posexplode(lines).alias("n", "line")).select("archive", (F.col("n") + 1).cast("bigint").alias("n"), "line")


@query(f"WITH {ARCHIVED} SELECT archive, {_TURN} AS n, '- `' || name || '`: {R.GENERIC}=' || hits AS line FROM p WHERE hits > 0")
def archive_redaction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "REDACTIONS.md", "- `files/")


@query(f"WITH {ARCHIVED} SELECT archive, {_TURN} AS n, '- `' || name || '`' AS line FROM p")
def archive_context_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "CONTEXT.md", "- `files/")


@query("WITH a AS (SELECT DISTINCT doc_id // 8 AS archive FROM documents), e(path, head) AS (VALUES ('adapters/AGENTS.md', '# Snapshot of docs-'), ('adapters/CLAUDE.md', '# Snapshot of docs-'), ('adapters/IMPORT_PROMPT.md', '# Import docs-')) SELECT archive, path, head || archive AS line FROM a, e")
def archive_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = verify.listed_entries(archives(spark, sf_dir), lambda path: path.startswith("adapters/") and path.endswith(".md"))
    return entries.select("archive", "path", F.substring_index(F.decode("content", "UTF-8"), "\n", 1).alias("line"))


# manifests


@query("""SELECT s_suppkey, '{' || chr(10) || '  "a": {' || chr(10) || '    "é": "' || s_name || '"' || chr(10) || '  },' || chr(10) || '  "b": ' || s_suppkey || ',' || chr(10) || '  "c": [' || chr(10) || '    true,' || chr(10) || '    null' || chr(10) || '  ]' || chr(10) || '}' || chr(10) AS text FROM supplier""")
def manifest_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def text(n: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([manifest.canonical({"b": int(k), "c": [True, None], "a": {"é": x}}).decode() for k, x in zip(n, name, strict=True)])

    return table(spark, sf_dir, "supplier").select("s_suppkey", text("s_suppkey", "s_name").alias("text"))


@query("SELECT s_suppkey, s_suppkey % 8 = 0 AS canonical FROM supplier")
def manifest_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only one form of a content is a manifest: not a compact one, a fraction, a double key, a long integer, a constant, a missing line end, a byte order mark."""
    name = F.col("s_name")
    forms = ('{\n  "a": "%s"\n}\n', '{"a": "%s"}\n', '{\n  "%s": 1.5\n}\n', '{\n  "%s": 1,\n  "a": 1,\n  "a": 1\n}\n', '{\n  "%s": ' + "9" * 5000 + "\n}\n", '{\n  "%s": NaN\n}\n', '{\n  "a": "%s"\n}', '﻿{\n  "a": "%s"\n}\n')
    text = F.element_at(F.array(*(F.replace(F.lit(form), F.lit("%s"), name) for form in forms)), (F.pmod("s_suppkey", F.lit(len(forms))) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", manifest.is_canonical(text).alias("canonical"))


#: Fields of a manifest (a path into it), a wrong value, and the check that must tell.
WRONG_FIELDS = (
    (("format",), "other", "format"), (("schema_version",), True, "schema_version"), (("tool", "name"), "", "tool"), (("project", "name"), "a‮b", "project.name"), (("project", "git", "branch"), 5, "git.branch"),
    (("project", "git", "commit"), "abc", "git.commit"), (("project", "languages"), {"x": -1}, "project.languages"), (("policy", "max_files"), 0, "policy.max_files"), (("policy", "secret_policy"), "keep", "policy"),
    (("totals", "redactions"), 1, "totals.redactions"), (("totals", "packed_bytes"), 1, "totals.packed_bytes"), (("totals", "source_bytes"), 1, "totals.source_bytes"), (("totals", "candidate_files"), 9, "totals.candidate_files"),
    (("totals", "redactions_by_kind"), {"X": 1}, "totals.redactions_by_kind"), (("warnings",), [""], "warnings"), (("entries", 5, "sha256"), "A" * 64, "record.sha256"), (("entries", 5, "source_path"), "b.py", "record.source_path"),
    (("entries", 5, "size"), -1, "record.size"), (("entries", 5, "source_size"), 1 << 40, "record.source_size"), (("entries", 0, "kind"), "other", "record.kind"), (("entries", 0, "path"), "adapters/x:y", "record.path"),
)


@query("SELECT p_partkey, CASE p_partkey % " + str(len(WRONG_FIELDS) + 1) + " " + " ".join(f"WHEN {k} THEN '{check}'" for k, (_, _, check) in enumerate(WRONG_FIELDS, 1)) + " END AS \"check\" FROM part")
def manifest_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks of types, ranges and totals say of a manifest with one wrong field; null if nothing."""
    m = manifest.parse(zipfile.ZipFile(io.BytesIO(pack.archive_of([("a.py", "x = 1\n")], "p"))).read("MANIFEST.json"))

    @F.pandas_udf("string")
    def found(n: pd.Series) -> pd.Series:
        out = []
        for k in n:
            changed, place = copy.deepcopy(m), int(k) % (len(WRONG_FIELDS) + 1)
            if place:
                (*way, last), value, _ = WRONG_FIELDS[place - 1]
                at = changed
                for step in way:
                    at = at[step]
                at[last] = value
            wrong = manifest.structure_violations(changed) or verify.total_violations(changed)
            out.append(",".join(sorted({check for _, check, _ in wrong})) or None)
        return pd.Series(out, dtype=object)

    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", found("p_partkey").alias("check"))


# policies and names


#: Rule files, and the patterns in them; None: they aren't accepted.
RULE_FILES = (("*.log\n\n# c\n docs/ \n", "*.log|docs/"), ("!keep\n", None), ("a\\b\r\n", "a/b"), ("x" * 1025, None), ("﻿/top\n", "/top"), ("# only\n", ""), ("a\n" * 513, None), ("a\n" * 512, "|".join("a" * 512)), ("é\n", "é"))


@query("SELECT p_partkey, CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN {'NULL' if x is None else repr(x)}" for k, (_, x) in enumerate(RULE_FILES)) + " END AS patterns FROM part")
def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def patterns(texts: pd.Series) -> pd.Series:
        found = {}  # equal files of a batch are read once
        for text in texts:
            if text not in found:
                try:
                    found[text] = "|".join(r.pattern for r in parse_rules(text))
                except ConfigError:
                    found[text] = None
        return pd.Series([found[text] for text in texts], dtype=object)

    text = F.element_at(F.array(*(F.lit(t) for t, _ in RULE_FILES)), (F.pmod("p_partkey", F.lit(len(RULE_FILES))) + 1).cast("int"))
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", patterns(text).alias("patterns"))


_CONFIGS = ("[limits]\nmax_files = %s\n", "", "[limits]\nmax_files = 0\n", "[limits]\nmax_files = true\n", "[limits]\nmax_files = 10001\n", "[other]\n", "﻿[limits]\nmax_files = 7\n[scan]\ninclude_untracked = false\n", "[limits\n", "[limits]\nmax_file = 1\n", "[scan]\ninclude_untracked = 1\n")


@query(f"SELECT p_partkey, CASE p_partkey % {len(_CONFIGS)} WHEN 0 THEN p_size::BIGINT WHEN 1 THEN {V.DEFAULT_FILES} WHEN 6 THEN 7 END AS max_files FROM part")
def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit of files that a configuration sets; null if it isn't accepted."""

    @F.pandas_udf("long")
    def limit(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            try:
                out.append(Config.parse(text.encode()).max_files)
            except ConfigError:
                out.append(None)
        return pd.Series(out, dtype="Int64")

    text = F.element_at(F.array(*(F.replace(F.lit(t), F.lit("%s"), F.col("p_size").cast("string")) for t in _CONFIGS)), (F.pmod("p_partkey", F.lit(len(_CONFIGS))) + 1).cast("int"))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", limit(text).alias("max_files"))


@query("SELECT s_suppkey, sha256(CASE WHEN s_suppkey % 2 = 0 THEN 'missing' ELSE 'present:' || s_name END) AS token FROM supplier")
def policy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.udf(lambda data: policy_token(None if data is None else bytes(data)), "string")
    return table(spark, sf_dir, "supplier").select("s_suppkey", token(F.when(F.pmod("s_suppkey", F.lit(2)) == 1, F.encode("s_name", "UTF-8"))).alias("token"))


@query(f"""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN left(repeat(s_name, 9), 49) || '[TRUNCATED]' WHEN 1 THEN chr(65533) || s_name || chr(65533) WHEN 2 THEN 'pwd={R.mask(R.GENERIC)}' ELSE s_name END AS text,
    CASE s_suppkey % 4 WHEN 0 THEN 'TRUNCATED_METADATA=1' WHEN 1 THEN 'UNSAFE_METADATA=2' WHEN 2 THEN '{R.GENERIC}=1' ELSE '' END AS counts FROM supplier""")
def metadata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod("s_suppkey", F.lit(4))
    name = F.when(kind == 0, F.repeat("s_name", F.lit(9))).when(kind == 1, F.concat(F.lit("‮"), "s_name", F.lit("\x07"))).when(kind == 2, F.concat(F.lit("pwd="), "s_name")).otherwise(F.col("s_name"))
    found = table(spark, sf_dir, "supplier").select("s_suppkey", sanitized_with_counts(name, 60).alias("r"))
    counts = F.array_sort(F.transform(F.map_entries("r.counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return found.select("s_suppkey", "r.text", F.concat_ws(",", counts).alias("counts"))


# paths and selection


OUTPUT = "lib/x/y/q.xlsx"
_SECRET_PATHS = f"{PATHS}, q AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN path || '/AKIA' || upper(left(sha256(path), 16)) ELSE path END AS path, p_partkey % 4 = 0 AS secret FROM paths)"
_DECIDED = f"""WITH {_SECRET_PATHS}, d AS (SELECT p_partkey, path, CASE WHEN NOT ({_PORTABLE_SQL}) THEN 'unsafe_path' WHEN secret THEN 'secret_in_path' WHEN {EXCLUDED} THEN 'always_excluded' WHEN {_RULE_SQL} THEN 'project_ignore'
    WHEN path = '{OUTPUT}' THEN 'output_archive' END AS reason FROM q), s AS (SELECT p_partkey, reason, CASE reason WHEN 'unsafe_path' THEN '<unsafe-path:' || left(sha256(path), 12) || '>' WHEN 'secret_in_path' THEN '<redacted-path>' ELSE path END AS shown FROM d)"""


def _decided_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.concat(F.lit("/AKIA"), F.upper(F.substring(F.sha2("path", 256), 1, 16)))
    paths = spread(_many_paths(spark, sf_dir), "p_partkey").withColumn("path", F.concat("path", F.when(F.pmod("p_partkey", F.lit(4)) == 0, token).otherwise(F.lit(""))))
    return path_stage(paths, RULES, OUTPUT)


@query(f"{_DECIDED} SELECT p_partkey, shown, reason FROM s")
def path_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons that a path alone gives, in their order, secrets in paths and the output among them."""
    return _decided_paths(spark, sf_dir).select("p_partkey", F.col("shown_path").alias("shown"), F.col("path_reason").alias("reason"))


@query(f"{_DECIDED} SELECT row_number() OVER (ORDER BY reason, lower(shown), shown, p_partkey) AS n, p_partkey, reason FROM s WHERE reason IS NOT NULL QUALIFY n <= 500")
def skipped_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 skipped files in the order in which they are told."""
    skipped = _decided_paths(spark, sf_dir).where("path_reason is not null").select("p_partkey", F.col("shown_path").alias("path"), F.col("path_reason").alias("reason"))
    order = [*skipped_order(), F.col("p_partkey")]
    return skipped.orderBy(*order).limit(500).select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("n"), "p_partkey", "reason")


@query(f"WITH {_SELECT} SELECT path, reason FROM fold WHERE k > 0")
def selection_within_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection with the inspection budget on: it would fail if more than twice the total limit were read."""
    return greedy_select(_narrow_files(spark, sf_dir)[1], SELECT_FILES, SELECT_TOTAL, 2)
