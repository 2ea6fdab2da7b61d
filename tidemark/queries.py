"""The queries over the driver's tables, and the same in SQL for DuckDB.

Files are views of the tables (sources.tables). Natural secrets are rare there, so most detectors run on values made from hashes of the
texts: a third of the documents has a real-looking one, a third a placeholder, the rest none. Each is registered twice: on the value in a short
note, which SQL can follow, and as redact_..._whole on the value at the end of the document's whole text, which it can't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import vocabulary as V
from tidemark.functions import content as C
from tidemark.functions import paths as P
from tidemark.functions import redaction as R
from tidemark.functions.rules import Rule, compiled, denied
from tidemark.functions.sizes import formatted_size, parsed_size
from tidemark.operators import aggregates
from tidemark.operators.scan import Scan, chosen_files, collisions, content_stage, path_stage, sanitized_column, scan
from tidemark.operators.select import greedy_select
from tidemark.plans import manifest, verify
from tidemark.sources.tables import FOLDERS, SUFFIXES, all_files, document_columns, document_files, spread, table
from tidemark.storage import work_folder
from tidemark.streaming import drained, redacted_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


# the file views in SQL
_SUFFIX_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUFFIXES.items())
DOCS = f"docs AS (SELECT doc_id, [{', '.join(repr(f) for f in FOLDERS)}][doc_id % 6 + 1] || '/' || coalesce(source, 'none') || '/' || doc_id || CASE lang {_SUFFIX_SQL} ELSE '.txt' END AS path, coalesce(text, '') AS text FROM documents)"
FILES = f"""{DOCS}, files AS (SELECT path, text FROM docs UNION ALL SELECT 'site/' || page_id || '.html', coalesce(html, '') FROM pages
    UNION ALL SELECT 'docs/chat/' || conv_id || '_' || turn || '.txt', coalesce(text, '') FROM conversations
    UNION ALL SELECT 'data/ev/' || event_id || '.json', coalesce(props, '') FROM events UNION ALL SELECT 'tests/' || item_id || '.txt', coalesce(text, '') FROM benchmark)"""
_NAME, _SUFFIX = "regexp_extract(path, '[^/]*$')", "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))"
PRIORITY = f"""CASE WHEN lower({_NAME}) IN {_list(V.HIGH_SIGNAL_NAMES)} OR lower({_NAME}) LIKE 'readme%' THEN 0 WHEN lower(split_part(path, '/', 1)) IN ('docs', '.github') THEN 1
    WHEN len(string_split(path, '/')) <= 2 THEN 2 WHEN lower(split_part(path, '/', 1)) IN ('src', 'app', 'lib', 'packages') THEN 3 WHEN lower(split_part(path, '/', 1)) IN ('test', 'tests', 'spec', 'specs') THEN 4 ELSE 5 END"""
LANGUAGE = f"CASE {_SUFFIX} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.LANGUAGES.items()) + " END"


def _sensitive_sql(name: str, template: bool) -> str:
    bare = "CASE " + " ".join(f"WHEN ends_with({name}, '{s}') THEN left({name}, len({name}) - {len(s)})" for s in V.BACKUP_SUFFIXES) + f" ELSE {name} END"
    env = f"starts_with({bare}, '.env')" + (f" AND (({bare}) <> {name} OR ({bare}) NOT IN {_list(V.ENV_TEMPLATES)})" if template else "")
    tests = [f"({bare}) IN {_list(V.EXCLUDED_NAMES)}", env, *(f"starts_with({bare}, '{p}')" for p in V.KEY_PREFIXES), f"contains({bare}, '.tfstate.')", f"contains({bare}, '.ppk.')", *(f"ends_with({bare}, '{s}')" for s in (".tfstate", ".ppk", *V.EXCLUDED_SUFFIXES))]
    return "(" + " OR ".join(f"({t})" for t in tests) + ")"


EXCLUDED = f"""(len(list_filter(string_split(lower(path), '/')[:-2], lambda x: x IN {_list(V.EXCLUDED_DIRECTORIES)} OR ends_with(x, '.egg-info') OR {_sensitive_sql('x', False)})) > 0
    OR lower({_NAME}) IN {_list((*V.EXCLUDED_DIRECTORIES, *V.EXCLUDED_NAMES))} OR {_sensitive_sql(f'lower({_NAME})', True)})"""


# contents


@query(f"WITH {FILES} SELECT path, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size FROM files")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_files(spark, sf_dir).select("path", C.content_hash(F.col("text")).alias("sha256"), C.byte_size(F.col("text")).alias("size"))


@query(f"WITH {FILES} SELECT sha256(text) AS sha256, count(*) AS n, min(path) AS first_path FROM files GROUP BY 1 HAVING count(*) > 1")
def dedup_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = all_files(spark, sf_dir).select("path", C.content_hash(F.col("text")).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")


@query(f"""WITH {DOCS}, t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, ' ', chr(13) || chr(10)) WHEN 1 THEN replace(text, ' ', chr(13)) ELSE text END AS text FROM docs)
    SELECT doc_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS sha256 FROM t""")
def newline_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod("doc_id", F.lit(3))
    text = F.when(kind == 0, F.replace("text", F.lit(" "), F.lit("\r\n"))).when(kind == 1, F.replace("text", F.lit(" "), F.lit("\r"))).otherwise(F.col("text"))
    return document_files(spark, sf_dir).select("doc_id", C.content_hash(C.unix_newlines(text)).alias("sha256"))


@query(f"""WITH {DOCS}, t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || repeat(chr(1), (doc_id % 50)::INT) WHEN 1 THEN repeat(chr(2) || 'abcdefghi', (doc_id % 7)::INT) WHEN 2 THEN '' ELSE text END AS text FROM docs),
    n AS (SELECT doc_id, len(regexp_replace(text, '[^\\x01-\\x08\\x0E-\\x1F]', '', 'g')) AS c, octet_length(encode(text)) AS size FROM t)
    SELECT doc_id, size > 0 AND c > 0.05 * size AS is_binary FROM n""")
def binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod("doc_id", F.lit(4))
    text = F.when(kind == 0, F.concat("text", F.repeat(F.lit("\x01"), F.pmod("doc_id", F.lit(50)).cast("int")))).when(kind == 1, F.repeat(F.lit("\x02abcdefghi"), F.pmod("doc_id", F.lit(7)).cast("int"))).when(kind == 2, F.lit("")).otherwise(F.col("text"))
    return document_files(spark, sf_dir).select("doc_id", C.is_binary(F.encode(text, "UTF-8")).alias("is_binary"))


@query(f"WITH {DOCS} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE sha256(text) END AS sha256 FROM docs")
def utf8_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document ends in a byte that UTF-8 doesn't know, every other begins with a byte order mark."""
    data = F.encode("text", "UTF-8")
    content = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.concat(data, F.lit(b"\xff"))).when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit(b"\xef\xbb\xbf"), data)).otherwise(data)
    return document_files(spark, sf_dir).select("doc_id", F.sha2(C.text_of(content), 256).alias("sha256"))


@query(f"WITH {FILES} SELECT path, octet_length(encode(text))::BIGINT AS size FROM files WHERE octet_length(encode(text)) <= 4096")
def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_files(spark, sf_dir).select("path", C.byte_size(F.col("text")).alias("size")).where("size <= 4096")


# paths


def _many_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with all kinds of names, from parts of the tables."""
    names = F.array(*map(F.lit, NAMES))
    folder = F.element_at(F.array(*map(F.lit, PLACES)), (F.pmod(F.floor(F.col("p_partkey") / len(NAMES)), F.lit(len(PLACES))) + 1).cast("int"))
    name = F.element_at(names, (F.pmod("p_partkey", F.lit(len(NAMES))) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(folder, name).alias("path"))


NAMES = ("a.py", "README.txt", "LICENSE", "x.tar.gz", ".gitignore", ".env", ".env.example", ".env.example.bak", "id_rsa", "id_rsa_old.orig", "main.tfstate.1", "cert.PEM", "photo.JPG", "q.xlsx", "App.tsx", "s.sql", "con.txt", "bad:name", "end.", "end ", "data.sqlite3~", "dir.egg-info", "k.ppk.x", "Makefile", "notes", "a.", ".hidden.md", "auth.json", "b.kdbx.save")
PLACES = ("", "docs/", "src/app/", "lib/x/y/", "tests/unit/", "spec/", "a/b/c/", ".github/w/", "node_modules/m/", "p.egg-info/", ".env.d/", "SRC/Deep/", "build/", ".Ssh/", "x/.env.example/")
PATHS = f"paths AS (SELECT p_partkey, [{', '.join(repr(p) for p in PLACES)}][(p_partkey // {len(NAMES)}) % {len(PLACES)} + 1] || [{', '.join(repr(n) for n in NAMES)}][p_partkey % {len(NAMES)} + 1] AS path FROM part)"


@query(f"WITH {PATHS} SELECT p_partkey, path, {_SUFFIX} IN {_list(V.BINARY_SUFFIXES)} AS is_binary FROM paths")
def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _many_paths(spark, sf_dir).select("p_partkey", "path", P.is_binary_suffix(F.col("path")).alias("is_binary"))


@query(f"WITH {PATHS} SELECT p_partkey, path, {PRIORITY} AS priority FROM paths")
def priority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _many_paths(spark, sf_dir).select("p_partkey", "path", P.priority(F.col("path")).alias("priority"))


@query(f"WITH {FILES}, l AS (SELECT {LANGUAGE} AS language FROM files) SELECT language, count(*) AS n FROM l WHERE language IS NOT NULL GROUP BY 1")
def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.languages(all_files(spark, sf_dir))


@query(f"WITH {PATHS} SELECT p_partkey, path, {EXCLUDED} AS excluded FROM paths")
def always_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _many_paths(spark, sf_dir).select("p_partkey", "path", P.is_always_excluded(F.col("path")).alias("excluded"))


@query(f"WITH {PATHS}, n AS (SELECT p_partkey, lower({_NAME}) AS name FROM paths) SELECT p_partkey, name, {_sensitive_sql('name', True)} AS sensitive_file, {_sensitive_sql('name', False)} AS sensitive_folder FROM n")
def sensitive_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(P.base_name(F.col("path")))
    return _many_paths(spark, sf_dir).select("p_partkey", name.alias("name")).select("p_partkey", "name", P.is_sensitive_component(F.col("name"), True).alias("sensitive_file"), P.is_sensitive_component(F.col("name"), False).alias("sensitive_folder"))


@query(f"""WITH {PATHS}, d AS (SELECT p_partkey, './/' AS x, path FROM paths)
    SELECT p_partkey, trim(regexp_replace(replace('././' || replace(path, '/', chr(92)) || '/', chr(92), '/'), '^(\\./)+', ''), '/') AS path FROM d""")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("././"), F.replace("path", F.lit("/"), F.lit("\\")), F.lit("/"))
    return _many_paths(spark, sf_dir).select("p_partkey", P.normalized(raw).alias("path"))


_PORTABLE_SQL = f"""path <> '' AND NOT contains(path, chr(92)) AND NOT regexp_matches(path, '[\\x00-\\x1F\\x7F]') AND len(path) <= 4096 AND len(list_filter(string_split(path, '/'),
    lambda p: p IN ('', '.', '..') OR len(p) > 255 OR contains(p, ':') OR regexp_matches(p, '[ .]$') OR lower(split_part(p, '.', 1)) IN {_list(V.RESERVED_STEMS)})) = 0"""


@query(f"WITH {PATHS} SELECT p_partkey, path, {_PORTABLE_SQL} AS portable, CASE WHEN NOT ({_PORTABLE_SQL}) THEN '<unsafe-path:' || left(sha256(path), 12) || '>' ELSE path END AS shown FROM paths")
def path_portability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native where paths are ASCII, which these are; the Unicode form is tested against it."""
    fine = P.is_portable_ascii(F.col("path"))
    return _many_paths(spark, sf_dir).select("p_partkey", "path", fine.alias("portable"), F.when(~fine, P.unsafe_label(F.col("path"))).otherwise(F.col("path")).alias("shown"))


@query(f"WITH {PATHS}, p AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(path) ELSE path END AS path FROM paths WHERE {_PORTABLE_SQL}) SELECT lower(path) AS fold, count(DISTINCT path) AS n FROM p GROUP BY 1 HAVING count(DISTINCT path) > 1")
def path_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _many_paths(spark, sf_dir).where(P.is_portable_ascii(F.col("path"))).select(F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.upper("path")).otherwise(F.col("path")).alias("safe_path"))
    return collisions(paths)


RULES = (Rule("tests/"), Rule("/docs/"), Rule("*.sql"), Rule("src/*.tsx"), Rule("/a.py"))
IGNORES = (Rule("*.py", deny=False), Rule("*.md", deny=False), Rule("*.hidden.md", negated=True, deny=False))
_RULE_SQL = "regexp_matches(path, '^(tests|.*/tests)(/.*)?$') OR regexp_matches(path, '^docs(/.*)?$') OR regexp_matches(path, '(^|/)[^/]*\\.sql(/|$)') OR regexp_matches(path, '^src/.*\\.tsx$|(^|/)src/[^/]*\\.tsx$') OR regexp_matches(path, '(^|/)a\\.py$')"


@query(f"WITH {PATHS} SELECT p_partkey, path, {_RULE_SQL} AS denied, regexp_matches(path, '(^|/)[^/]*\\.(py|md)(/|$)') AND NOT regexp_matches(path, '(^|/)[^/]*\\.hidden\\.md(/|$)') AS ignored FROM paths")
def deny_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _many_paths(spark, sf_dir).select("p_partkey", "path", denied(path, RULES).alias("denied"), denied(path, IGNORES).alias("ignored"))


@query(f"WITH {DOCS} SELECT path FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def ignored_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files less those of a list of ignored ones; labels stand for what git ignores."""
    return document_files(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("path")


# redaction


def _fake(length: int, upper: bool = False) -> Column:
    """So many hex digits made from the text's hash."""
    value = F.substring(F.concat(F.sha2("text", 256), F.sha2("text", 512)), 1, length)
    return F.upper(value) if upper else value


def _with_value(spark: SparkSession, sf_dir: str, real: Column, placeholder: Column, whole: bool = False) -> DataFrame:
    """A short note with a value for each document, after the whole of its text if wanted."""
    kind = F.pmod("doc_id", F.lit(3))
    before = F.concat("text", F.lit(" note ")) if whole else F.lit("note ")
    return document_files(spark, sf_dir).select("doc_id", F.concat(before, F.when(kind == 0, real).when(kind == 1, placeholder).otherwise(F.lit("none")), F.lit(" end")).alias("text"))


_HEX = "sha256(text)"
WHOLE = {
    "aws": ("AWS_ACCESS_KEY", "AKIA", 16, True, ""), "github": ("GITHUB_TOKEN", "ghp_", 36, False, ""), "google": ("GOOGLE_API_KEY", "AIza", 35, False, ""),
    "slack": ("SLACK_TOKEN", "xoxb-", 20, False, ""), "stripe": ("STRIPE_SECRET_KEY", "sk_live_", 24, False, ""), "openai": ("OPENAI_API_KEY", "sk-proj-", 32, False, ""),
    "jwt": ("JWT", "eyJ", 10, False, ".aaaaaaaaaa.bbbbbbbbbb"),
}


def _register_whole(name: str, kind: str, prefix: str, length: int, upper: bool, tail: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _with_value(spark, sf_dir, F.concat(F.lit(prefix), _fake(length, upper), F.lit(tail)), F.lit(prefix + "x"))
        return docs.select("doc_id", R.native_mask(F.col("text"), kind).alias("text"), R.native_count(F.col("text"), kind).alias("n"))

    def run_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _with_value(spark, sf_dir, F.concat(F.lit(prefix), _fake(length, upper), F.lit(tail)), F.lit(prefix + "x"), True)
        return docs.select("doc_id", F.sha2(R.native_mask(F.col("text"), kind), 256).alias("sha256"), R.native_count(F.col("text"), kind).alias("n"))

    run.__name__, run_whole.__name__ = f"redact_{name}", f"redact_{name}_whole"
    query()(run_whole)
    value = f"left({_HEX}, {length})"
    masked = f"'note {R.mask(kind)} end'"
    query(f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {masked} WHEN 1 THEN 'note {prefix}x end' ELSE 'note none end' END AS text, CASE WHEN doc_id % 3 = 0 AND len('{prefix}' || {value}) > 4 THEN 1 ELSE 0 END AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)".replace("1 ELSE 0 END AS n", "1::BIGINT ELSE 0::BIGINT END AS n"))(run)


for _name, _args in WHOLE.items():
    _register_whole(_name, *_args)


def _register_cascade(name: str, real: Callable[[], Column], real_sql: str, expected_sql: str, placeholder: str, kind: str) -> None:
    """A detector of the cascade, on a value in each third document and a placeholder in the next."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _with_value(spark, sf_dir, real(), F.lit(placeholder))
        found = docs.select("doc_id", R.redacted(F.col("text")).alias("r"))
        return found.select("doc_id", "r.text", F.coalesce(F.try_element_at("r.counts", F.lit(kind)), F.lit(0).cast("bigint")).alias("n"))

    def run_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _with_value(spark, sf_dir, real(), F.lit(placeholder), True)
        found = docs.select("doc_id", R.redacted(F.col("text")).alias("r"))
        return found.select("doc_id", F.sha2("r.text", 256).alias("sha256"), F.coalesce(F.try_element_at("r.counts", F.lit(kind)), F.lit(0).cast("bigint")).alias("n"))

    run.__name__, run_whole.__name__ = f"redact_{name}", f"redact_{name}_whole"
    query()(run_whole)
    quoted = placeholder.replace("'", "''")
    query(f"SELECT doc_id, 'note ' || CASE doc_id % 3 WHEN 0 THEN {expected_sql} WHEN 1 THEN '{quoted}' ELSE 'none' END || ' end' AS text, CASE WHEN doc_id % 3 = 0 THEN 1::BIGINT ELSE 0::BIGINT END AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")(run)


_G = R.mask(R.GENERIC)


def natural_masked(text: str) -> str:
    """SQL of a document with its own secrets masked; they are all of one form, in capitals where the document is."""
    return f"regexp_replace({text}, '(?i)(token) = \"[0-9a-f]+\"', '\\1 = \"{_G}\"', 'g')"


def natural_hits(text: str) -> str:
    return f"len(regexp_extract_all({text}, '(?i)token = \"[0-9a-f]+\"'))::BIGINT"


_register_cascade("authorization", lambda: F.concat(F.lit("Authorization: Bearer "), _fake(20)), "", f"'Authorization: Bearer {R.mask('AUTHORIZATION')}'", "Authorization: Bearer YOUR_TOKEN_HERE", "AUTHORIZATION")
_register_cascade("url", lambda: F.concat(F.lit("db://user:"), _fake(12), F.lit("@host")), "", f"'db://{R.mask('URL_USERNAME')}:{R.mask('URL_PASSWORD')}@host'", "db://${U}:${P}@host", "URL_CREDENTIALS")
_register_cascade("docker", lambda: F.concat(F.lit('"auth": "'), _fake(16), F.lit('"')), "", f"'\"auth\": \"{R.mask('DOCKER_AUTH')}\"'", '"auth": "xxxxxxxx"', "DOCKER_AUTH")
_register_cascade("xml", lambda: F.concat(F.lit("<password>"), _fake(16), F.lit("</password>")), "", f"'<password>{R.mask('XML_SECRET')}</password>'", "<password>changeme</password>", "XML_SECRET")
_register_cascade("generic_quoted", lambda: F.concat(F.lit("db_password = \""), _fake(16), F.lit("\" x '")), "", f"'db_password = \"{_G}\" x '''", "db_password = '${DB}'", R.GENERIC)
_register_cascade("generic_bare", lambda: F.concat(F.lit("\napi_key="), _fake(16), F.lit("\n")), "", f"chr(10) || 'api_key={_G}' || chr(10)", "\napi_key=your_api_key_here\n", R.GENERIC)
_register_cascade("triple_quoted", lambda: F.concat(F.lit('\nsecret = """'), _fake(8), F.lit("\n"), _fake(9), F.lit('"""')), "", f"chr(10) || 'secret = \"{_G}\"'", '\nsecret = """changeme"""', R.GENERIC)
_register_cascade("yaml_block", lambda: F.concat(F.lit("\npassword: |\n  "), _fake(8), F.lit("\n  "), _fake(9), F.lit("\nnext")), "", f"chr(10) || 'password: \"{_G}\"' || chr(10) || 'next'", "\nusername: |\n  changeme\nnext", R.GENERIC)
_register_cascade("pem", lambda: F.concat(F.lit("\n-----BEGIN RSA PRIVATE KEY-----\n"), _fake(64), F.lit("\n-----END RSA PRIVATE KEY-----\n")), "", f"chr(10) || '{R.mask('PRIVATE_KEY')}' || chr(10)", "\n-----BEGIN PUBLIC KEY-----\n", "PRIVATE_KEY")
_register_cascade("pgp", lambda: F.concat(F.lit("\n-----BEGIN PGP PRIVATE KEY BLOCK-----\n"), _fake(64), F.lit("\n\n-----END PGP PRIVATE KEY BLOCK-----\n")), "", f"chr(10) || '{R.mask('PGP_PRIVATE_KEY')}' || chr(10)", "\n-----BEGIN PGP MESSAGE-----\n", "PGP_PRIVATE_KEY")
_register_cascade("putty", lambda: F.concat(F.lit("\nPuTTY-User-Key-File-3: ssh-rsa\nPrivate-Lines: 2\n"), _fake(64), F.lit("\n"), _fake(32), F.lit("\nPrivate-MAC: x")), "", f"chr(10) || 'PuTTY-User-Key-File-3: ssh-rsa' || chr(10) || 'Private-Lines: 2' || chr(10) || '{R.mask('PUTTY_PRIVATE_KEY')}' || chr(10) || 'Private-MAC: x'", "\nPrivate-Lines: 2\n", "PUTTY_PRIVATE_KEY")


@query(f"WITH {DOCS} SELECT path, sha256(regexp_replace(text, 'token = \"[0-9a-f]+\"', 'token = \"{_G}\"', 'g')) AS sha256, len(regexp_extract_all(text, 'token = \"[0-9a-f]+\"'))::BIGINT AS n FROM docs")
def redact_full_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade on the documents as they are."""
    found = document_files(spark, sf_dir).select("path", R.redacted(F.col("text")).alias("r"))
    return found.select("path", F.sha2("r.text", 256).alias("sha256"), F.aggregate(F.map_values("r.counts"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))


@query(f"WITH {DOCS} SELECT '{R.GENERIC}' AS kind, sum(len(regexp_extract_all(text, 'token = \"[0-9a-f]+\"')))::BIGINT AS n FROM docs HAVING n > 0")
def redactions_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_files(spark, sf_dir).select(R.redacted(F.col("text"))["counts"].alias("redactions"))
    return aggregates.redactions_by_kind(found)


@query()
def redact_all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over all tables; what JSON and HTML hold has no short form in SQL."""
    found = all_files(spark, sf_dir).select("path", R.redacted(F.col("text")).alias("r"))
    return found.select("path", F.sha2("r.text", 256).alias("sha256"), F.size("r.counts").cast("bigint").alias("kinds"))


@query(f"WITH {DOCS} SELECT path, sha256(regexp_replace(text, 'token = \"[0-9a-f]+\"', 'token = \"{_G}\"', 'g')) AS sha256 FROM docs")
def redact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator that streams use, on a table."""
    files = document_files(spark, sf_dir).select("path", F.encode("text", "UTF-8").alias("content"))
    return redacted_stream(files).select("path", F.sha2("text", 256).alias("sha256"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN left(n, 30 - 11) || '[TRUNCATED]' ELSE n END AS name FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN repeat(s_name, 5) WHEN 1 THEN chr(65533) || s_name || chr(65533) ELSE s_name END AS n FROM supplier)")
def metadata_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod("s_suppkey", F.lit(3))
    name = F.when(kind == 0, F.repeat("s_name", F.lit(5))).when(kind == 1, F.concat(F.lit("‮"), "s_name", F.lit("\x07"))).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", sanitized_column(name, 30).alias("name"))


@query("""SELECT p_partkey, p_size::BIGINT * CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 ELSE NULL END AS bytes FROM part""")
def size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("", "K", " MiB", "gb", "q"))), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", parsed_size(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query("""WITH s AS (SELECT p_partkey, (p_size::BIGINT ** (1 + p_partkey % 6))::BIGINT AS n FROM part)
    SELECT p_partkey, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576) ELSE printf('%.1f GiB', n / 1073741824) END AS shown FROM s""")
def size_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.pow(F.col("p_size").cast("double"), F.pmod("p_partkey", F.lit(6)) + 1).cast("bigint")
    return table(spark, sf_dir, "part").select("p_partkey", formatted_size(n).alias("shown"))


# whole scans


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of all files and what is decided by them; no content is needed for that."""
    return path_stage(spread(all_files(spark, sf_dir).select("path"), "path"), RULES)


_REASON = f"CASE WHEN {EXCLUDED} THEN 'always_excluded' WHEN {_RULE_SQL} THEN 'project_ignore' END"


@query(f"WITH {FILES}, r AS (SELECT {_REASON} AS reason FROM files) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1")
def skip_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.reasons(_staged(spark, sf_dir).where("path_reason is not null").select(F.col("path_reason").alias("reason")))


def _narrow_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents as files, and the narrow columns that decide about them."""
    docs = document_files(spark, sf_dir).select(F.col("path").alias("safe_path"), F.encode("text", "UTF-8").alias("content")).withColumn("size", F.octet_length("content").cast("bigint"))
    kept = content_stage(docs, SELECT_FILE).withColumn("path", F.col("safe_path"))
    kept = kept.withColumn("priority", P.priority(F.col("path"))).withColumn("fold", P.fold_key(F.col("path")))
    return docs, kept.select("priority", "fold", "path", F.col("size").alias("planned_size"), "read_reason", "source_size", "packed_size")


def _selected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, decisions) of a scan of the documents with small budgets."""
    docs, narrow = _narrow_files(spark, sf_dir)
    return docs, greedy_select(narrow, SELECT_FILES, SELECT_TOTAL, None)


SELECT_FILE, SELECT_TOTAL, SELECT_FILES = 6_000, 400_000, 300
_SELECT = f"""RECURSIVE {DOCS}, sized AS (SELECT path, octet_length(encode(text))::BIGINT AS size, octet_length(encode(regexp_replace(text, 'token = "[0-9a-f]+"', 'token = "{_G}"', 'g')))::BIGINT AS packed, text FROM docs),
    ranked AS (SELECT *, row_number() OVER (ORDER BY {PRIORITY}, lower(path), path) AS k FROM sized),
    fold AS (SELECT 0::BIGINT AS k, 0::BIGINT AS n, 0::BIGINT AS p, 0::BIGINT AS s, NULL::VARCHAR AS path, NULL::VARCHAR AS reason UNION ALL
        SELECT r.k, f.n + (c.reason IS NULL)::BIGINT, f.p + CASE WHEN c.reason IS NULL THEN r.packed ELSE 0 END, f.s + CASE WHEN c.reason IS NULL THEN r.size ELSE 0 END, r.path, c.reason
        FROM fold f JOIN ranked r ON r.k = f.k + 1, LATERAL (SELECT CASE WHEN f.n >= {SELECT_FILES} THEN 'file_limit' WHEN f.s + r.size > {SELECT_TOTAL} THEN 'source_total_size_limit'
            WHEN r.size > {SELECT_FILE} THEN 'file_size_limit' WHEN f.p + r.packed > {SELECT_TOTAL} THEN 'total_size_limit' END AS reason) c)"""


@query(f"WITH {_SELECT} SELECT path, reason FROM fold WHERE k > 0")
def greedy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir)[1]


_RECORDS = f"""{_SELECT}, records AS (SELECT 'source' AS kind, 'files/' || f.path AS path, sha256(regexp_replace(z.text, 'token = "[0-9a-f]+"', 'token = "{_G}"', 'g')) AS sha256, z.packed AS size, f.path AS source_path, z.size AS source_size,
    len(regexp_extract_all(z.text, 'token = "[0-9a-f]+"'))::BIGINT AS redactions FROM fold f JOIN sized z USING (path) WHERE f.k > 0 AND f.reason IS NULL)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, decided = _selected(spark, sf_dir)
    chosen = content_stage(chosen_files(docs, decided, SELECT_FILES), SELECT_FILE).withColumnRenamed("safe_path", "path")
    return manifest.records(chosen.select("path", "source_size", "packed", "sha256", "redactions"))


_SCANNED = f"""RECURSIVE {DOCS}, f AS (SELECT doc_id % 7 AS k, text, CASE WHEN doc_id % 7 = 3 THEN path || '.png' ELSE path END AS path, octet_length(encode(text))::BIGINT + (doc_id % 7 IN (1, 2))::BIGINT AS size,
        octet_length(encode({natural_masked('text')}))::BIGINT AS packed FROM docs),
    d AS (SELECT *, {_REASON} AS path_reason, CASE WHEN size > {V.DEFAULT_FILE_BYTES} THEN 'file_size_limit' WHEN k = 3 THEN 'binary_extension' WHEN k = 2 THEN 'binary_content' WHEN k = 1 THEN 'non_utf8_text' END AS told FROM f),
    ranked AS (SELECT *, row_number() OVER (ORDER BY {PRIORITY}, lower(path), path) AS at FROM d WHERE path_reason IS NULL),
    fold AS (SELECT 0::BIGINT AS at, 0::BIGINT AS n, 0::BIGINT AS p, 0::BIGINT AS s, NULL::VARCHAR AS path, NULL::VARCHAR AS reason UNION ALL
        SELECT r.at, f.n + (c.reason IS NULL)::BIGINT, f.p + CASE WHEN c.reason IS NULL THEN r.packed ELSE 0 END, f.s + CASE WHEN c.reason IS NULL THEN r.size ELSE 0 END, r.path, c.reason
        FROM fold f JOIN ranked r ON r.at = f.at + 1, LATERAL (SELECT CASE WHEN f.n >= {V.DEFAULT_FILES} THEN 'file_limit' WHEN f.s + r.size > {V.DEFAULT_TOTAL_BYTES} THEN 'source_total_size_limit'
            WHEN r.told IS NOT NULL THEN r.told WHEN f.p + r.packed > {V.DEFAULT_TOTAL_BYTES} THEN 'total_size_limit' END AS reason) c),
    skipped AS (SELECT path, path_reason AS reason FROM d WHERE path_reason IS NOT NULL UNION ALL SELECT path, reason FROM fold WHERE reason IS NOT NULL)"""


def _scanned(spark: SparkSession, sf_dir: str) -> Scan:
    """A whole scan of the documents with the default limits; some are binary by name or content, or not in UTF-8."""
    docs, kind, data = document_files(spark, sf_dir), F.pmod("doc_id", F.lit(7)), F.encode("text", "UTF-8")
    content = F.when(kind == 1, F.concat(data, F.lit(b"\xff"))).when(kind == 2, F.concat(data, F.lit(b"\0"))).otherwise(data)
    path = F.when(kind == 3, F.concat("path", F.lit(".png"))).otherwise(F.col("path"))
    files = docs.select(path.alias("path"), content.alias("content")).withColumn("size", F.octet_length("content").cast("bigint"))
    return scan(files, rules=RULES, ceilings=False)


@query(f"WITH {_SCANNED} SELECT path, reason FROM skipped")
def scan_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).skipped


@query(f"WITH {_SCANNED} SELECT reason, count(*) AS n FROM skipped GROUP BY reason")
def scan_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason of a whole scan holds, those of contents and limits too."""
    return aggregates.reasons(_scanned(spark, sf_dir).skipped)


@query(f"WITH {_SCANNED} SELECT o.path, d.size AS source_size, d.packed AS packed_size, sha256({natural_masked('d.text')}) AS sha256 FROM fold o JOIN d USING (path) WHERE o.at > 0 AND o.reason IS NULL")
def scan_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).files.select("path", "source_size", "packed_size", "sha256")


_hits = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("bigint"), lambda a, x: a + x)


@query(f"WITH {_RECORDS} SELECT * FROM records")
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).withColumn("redactions", _hits("redactions"))


@query(f"WITH {_RECORDS} SELECT count(*) AS source_files, sum(size)::BIGINT AS packed_bytes, sum(source_size)::BIGINT AS source_bytes, sum(redactions)::BIGINT AS redactions FROM records")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.totals(_records(spark, sf_dir).withColumnRenamed("size", "packed_size"))


def _tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as entries of an archive, of which some are gone, some longer and some changed."""
    docs = document_files(spark, sf_dir).where(F.pmod("doc_id", F.lit(11)) != 0)
    kind = F.pmod("doc_id", F.lit(13))
    content = F.encode(F.when(kind == 0, F.concat("text", F.lit("x"))).when(kind == 1, F.concat(F.lit("#"), F.expr("substring(text, 2)"))).otherwise(F.col("text")), "UTF-8")
    path = F.when(kind == 2, F.concat("path", F.lit(".new"))).otherwise(F.col("path"))
    return docs.select("doc_id", path.alias("path"), content.alias("content")).withColumn("size", F.octet_length("content").cast("bigint"))


_TAMPERED = f"""{DOCS}, told AS (SELECT path, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha256 FROM docs),
    entries AS (SELECT CASE WHEN doc_id % 13 = 2 THEN path || '.new' ELSE path END AS path, CASE doc_id % 13 WHEN 0 THEN text || 'x' WHEN 1 THEN '#' || substr(text, 2) ELSE text END AS content FROM docs WHERE doc_id % 11 <> 0)"""


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select("path", C.byte_size(F.col("text")).alias("size"), C.content_hash(F.col("text")).alias("sha256"))


@query(f"""WITH {_TAMPERED} SELECT coalesce(t.path, e.path) AS path, CASE WHEN e.path IS NULL THEN 'entry.missing' WHEN t.path IS NULL THEN 'entry.extra' ELSE 'entry.size' END AS "check"
    FROM told t FULL JOIN entries e ON t.path = e.path WHERE e.path IS NULL OR t.path IS NULL OR t.size <> octet_length(encode(e.content))""")
def verify_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.missing_and_extra(_told(spark, sf_dir), _tampered(spark, sf_dir)).select("path", "check")


@query(f"WITH {_TAMPERED} SELECT t.path, 'entry.sha256' AS \"check\" FROM told t JOIN entries e ON t.path = e.path WHERE t.sha256 <> sha256(e.content)")
def verify_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.wrong_hashes(_told(spark, sf_dir), _tampered(spark, sf_dir)).select("path", "check")


@query("WITH e AS (SELECT s_suppkey AS n, 'files/' || (s_suppkey * 7 % 13) || '/' || s_name AS path FROM supplier), l AS (SELECT path, lag(struct_pack(a := lower(path), b := path)) OVER (ORDER BY n) AS before FROM e) SELECT path FROM l WHERE struct_pack(a := lower(path), b := path) <= before")
def canonical_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"), F.concat(F.lit("files/"), F.pmod(F.col("s_suppkey") * 7, F.lit(13)), F.lit("/"), "s_name").alias("path"))
    return verify.out_of_order(entries).select("path")


@query(f"WITH {_TAMPERED}, again AS (SELECT path, sha256(content) AS h FROM entries) SELECT t.path FROM told t JOIN again a ON t.path = a.path WHERE t.sha256 <> a.h")
def stability_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose content differs between a first and a second reading."""
    second = _tampered(spark, sf_dir).select("path", F.sha2("content", 256).alias("again"))
    return _told(spark, sf_dir).select("path", "sha256").join(second, "path").where("sha256 <> again").select("path")


@query("SELECT n, path FROM (SELECT row_number() OVER (ORDER BY lower(path), path) AS n, path FROM (SELECT 'p/' || p_name || p_partkey AS path FROM part)) WHERE n <= 500")
def top_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 paths in the archive's order, which is what a listing shows."""
    top = table(spark, sf_dir, "part").select(F.concat(F.lit("p/"), "p_name", "p_partkey").alias("path")).orderBy(*manifest.archive_order(F.col("path"))).limit(500)
    return top.select(F.row_number().over(Window.orderBy(*manifest.archive_order(F.col("path")))).cast("bigint").alias("n"), "path")


@query(f"WITH {FILES} SELECT sum(greatest(1, len(list_filter(string_split(path, '/'), lambda x: x <> '')))) ::BIGINT * {len(RULES)} AS match_work, sum(octet_length(encode(path)) + 1)::BIGINT AS path_bytes, count(*) AS candidates FROM files")
def work_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.greatest(F.size(P.components(P.normalized(F.col("path")))), F.lit(1))
    return all_files(spark, sf_dir).agg((F.sum(parts) * len(RULES)).cast("bigint").alias("match_work"), F.sum(F.octet_length("path") + 1).cast("bigint").alias("path_bytes"), F.count("*").alias("candidates"))


@query(f"WITH {DOCS} SELECT source, '{R.GENERIC}' AS kind, sum(len(regexp_extract_all(d.text, 'token = \"[0-9a-f]+\"')))::BIGINT + sum((doc_id % 7 = 0)::BIGINT)::BIGINT AS n FROM docs d JOIN documents USING (doc_id) GROUP BY source HAVING n > 0")
def secrets_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many secrets of which kind each source has; every seventh document gets one more."""
    docs, text = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    more = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat(F.lit("\ntoken = \""), F.substring(F.sha2(text, 256), 1, 20), F.lit("\""))).otherwise(F.lit(""))
    found = docs.select("source", R.redacted(F.concat(text, more))["counts"].alias("counts"))
    return found.select("source", F.explode_outer("counts").alias("kind", "n")).where("kind is not null").groupBy("source", "kind").agg(F.sum("n").cast("bigint").alias("n"))


@query(f"WITH {DOCS} SELECT path, sha256({natural_masked('text')}) AS sha256, {natural_hits('text')} AS n FROM docs")
def redact_streamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade on a stream of the documents' files, run until it has all, and what it wrote."""
    docs = spark.readStream.schema(table(spark, sf_dir, "documents").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parque[t]")
    files = document_columns(docs).select("path", F.encode("text", "UTF-8").alias("content"))
    return drained(redacted_stream(files), work_folder(spark)).select("path", F.sha2("text", 256).alias("sha256"), _hits("redactions").alias("n"))


assert all(compiled(r.pattern) for r in RULES)

# further queries register themselves with these
from tidemark import archive_queries, detector_queries  # noqa: E402, F401
