"""Detectors on whole documents with values of many forms, and SQL for DuckDB that computes what they find."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import redaction as R
from tidemark.queries import DOCS, _fake, _G, natural_hits, natural_masked, query
from tidemark.sources.tables import document_files

#: By detector: what a value begins with, and of how many digits of a hash it consists; some are too short to count. Then its pattern in SQL.
TOKENS: dict[str, tuple[Sequence[tuple[str, int]], str]] = {
    "AWS_ACCESS_KEY": ((("AKIA", 16), ("ASIA", 16), ("AKIA", 15), ("ABIA", 16)), r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    "GITHUB_TOKEN": ((("ghp_", 36), ("gho_", 20), ("ghs_", 40), ("github_pat_", 50), ("ghp_", 19), ("ghx_", 36)), r"\b(?:gh[opsur]_[A-Za-z0-9]{20,255}|github_pat_[A-Za-z0-9_]{20,255})\b"),
    "GOOGLE_API_KEY": ((("AIza", 35), ("AIza", 30), ("AIza", 29), ("aIza", 35)), r"\bAIza[0-9A-Za-z_-]{30,}\b"),
    "SLACK_TOKEN": ((("xoxb-", 20), ("xoxp-", 10), ("xoxs-1-", 9), ("xoxz-", 20), ("xoxa-", 9)), r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    "STRIPE_SECRET_KEY": ((("sk_live_", 24), ("rk_test_", 16), ("sk_test_", 15), ("pk_live_", 24)), r"\b(?:sk|rk)_(?:live|test)_[0-9A-Za-z]{16,}\b"),
    "OPENAI_API_KEY": ((("sk-proj-", 32), ("sk-svcacct-", 20), ("sk-", 20), ("sk-", 19), ("sk_", 30)), r"\bsk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{20,}\b"),
}
#: The same for tokens in three parts, whose neighbours RE2 can only look at by taking them along.
_JWT = r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"


def _chosen(values: Sequence[Column]) -> Column:
    return F.element_at(F.array(*values), (F.pmod("doc_id", F.lit(len(values))) + 1).cast("int"))


def _register_token(kind: str, forms: Sequence[tuple[str, int]], pattern: str) -> None:
    upper = kind == "AWS_ACCESS_KEY"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = _chosen([F.concat(F.lit(prefix), _fake(length, upper)) for prefix, length in forms])
        docs = document_files(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" note "), value, F.lit(" end")).alias("text"))
        return docs.select("doc_id", F.sha2(R.native_mask(F.col("text"), kind), 256).alias("sha256"), R.native_count(F.col("text"), kind).alias("n"))

    run.__name__ = f"detect_{kind.lower()}"
    digits = f"sha256(text) || '{'0' * 64}'"  # no form has more than a hash
    values = " ".join(f"WHEN {k} THEN '{prefix}' || {'upper' if upper else ''}(left({digits}, {length}))" for k, (prefix, length) in enumerate(forms))
    query(f"WITH {DOCS}, t AS (SELECT doc_id, text || ' note ' || CASE doc_id % {len(forms)} {values} END || ' end' AS text FROM docs) SELECT doc_id, sha256(regexp_replace(text, '{pattern}', '{R.mask(kind)}', 'g')) AS sha256, len(regexp_extract_all(text, '{pattern}'))::BIGINT AS n FROM t")(run)


for _kind, (_forms, _pattern) in TOKENS.items():
    _register_token(_kind, _forms, _pattern)


_THREE = ("eyJ{v}.{v}.{v}", "eyJ{v}.{v}.short", "-eyJ{v}.{v}.{v}", "(eyJ{v}.{v}.{v})", "eyJabc.{v}.{v}", "xeyJ{v}.{v}.{v}")


@query(f"""WITH {DOCS}, t AS (SELECT doc_id, text || ' note ' || replace([{', '.join(map(repr, _THREE))}][doc_id % {len(_THREE)} + 1], '{{v}}', left(sha256(text), 16)) || ' end' AS text FROM docs)
    SELECT doc_id, sha256(regexp_replace(text, '{_JWT}', '\\1{R.mask("JWT")}', 'g')) AS sha256, len(regexp_extract_all(text, '{_JWT}'))::BIGINT AS n FROM t""")
def detect_jwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = _chosen([F.replace(F.lit(form), F.lit("{v}"), _fake(16)) for form in _THREE])
    docs = document_files(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" note "), value, F.lit(" end")).alias("text"))
    return docs.select("doc_id", F.sha2(R.native_mask(F.col("text"), "JWT"), 256).alias("sha256"), R.native_count(F.col("text"), "JWT").alias("n"))


#: What stands on lines of its own below a document ({v}: 16 digits of its hash), and what the cascade leaves of it; equal ones are left alone.
_D, _X, _A, _U, _P = R.mask("DOCKER_AUTH"), R.mask("XML_SECRET"), R.mask("AUTHORIZATION"), R.mask("URL_USERNAME"), R.mask("URL_PASSWORD")
ALONE = (
    # placeholders
    'api_key = "your_api_key_here"', "api_key = '${DB_KEY}'", "password=$env:PASS", 'secret: "{{ vault.x }}"', "token=%TOKEN%", "password = os.environ['P']", "pwd=********", 'client_secret = "changeme"', "passwd: replace-this", "token=process.env.TOKEN",
    # code
    "password = settings.db.password", "token = get_token(user)", "_secret=a.b", "safe_password = given", "password: str | None = None", "secret = a.b if c else d",
    # keys that aren't sensitive, and other neighbours
    "username = {v}", 'password_hint_text = "{v}"', "Authorization: Basic YOUR_TOKEN_HERE", "db://${U}:${P}@host", '"auth": "xxxx"', "<password>changeme</password>",
)
CHANGED = (
    # quotes of both kinds, with escapes, and keys of all cases
    ("db_password = '{v}' x", f"db_password = '{_G}' x"), ("pwd = 'a''{v}'", f"pwd = '{_G}'"), ('pwd = "a\\"{v}"', f'pwd = "{_G}"'), ('"serviceApiKey": "{v}",', f'"serviceApiKey": "{_G}",'),
    ('paſsword = "{v}"', f'paſsword = "{_G}"'), ('toKen = "{v}"', f'toKen = "{_G}"'), ("PASSWORD='{v}'", f"PASSWORD='{_G}'"),
    # bare values and blocks
    ("MY-SECRET-KEY: {v} and more", f"MY-SECRET-KEY: {_G}"), ("token={v}", f"token={_G}"), ("password={v}(a.b)", f"password={_G}"), ("password: |\n  {v}\n\n  {v}\nnext", f'password: "{_G}"\nnext'), ('secret = """{v}\n{v}"""', f'secret = "{_G}"'),
    # forms of their own
    ("authorization: 'Basic {v}='", f"authorization: 'Basic {_A}'"), ("Authorization:Bearer  {v}", f"Authorization:Bearer {_A}"), ("db://user:{v}@host", f"db://{_U}:{_P}@host"), ("redis://:{v}@h", f"redis://:{_P}@h"), ("https://{v}:@h", f"https://{_U}:@h"),
    ("db://${U}:{v}@host", f"db://${{U}}:{_P}@host"), ("'auth': '{v}=='", f"'auth': '{_D}'"), ("<passwd>{v}</passwd>", f"<passwd>{_X}</passwd>"),
    ("-----BEGIN PRIVATE KEY-----\n{v}\n{v}\n-----END PRIVATE KEY-----", R.mask("PRIVATE_KEY")), ("-----BEGIN EC PRIVATE KEY-----\nProc-Type: 4\n\n{v}\n-----END EC PRIVATE KEY-----", R.mask("PRIVATE_KEY")),
    ("-----BEGIN PGP PRIVATE KEY BLOCK-----\n{v}{v}{v}{v}\n-----END PGP PRIVATE KEY BLOCK-----", R.mask("PGP_PRIVATE_KEY")),
    ("PuTTY-User-Key-File-2: x\nPrivate-Lines: 2\n{v}\n{v}\nPrivate-MAC: 0", f"PuTTY-User-Key-File-2: x\nPrivate-Lines: 2\n{R.mask('PUTTY_PRIVATE_KEY')}\nPrivate-MAC: 0"),
)
FORMS = tuple((x, x) for x in ALONE) + CHANGED


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"""WITH {DOCS}, f AS (SELECT [{', '.join(_literal(a) for a, _ in FORMS)}] AS given, [{', '.join(_literal(b) for _, b in FORMS)}] AS kept),
    t AS (SELECT doc_id, {natural_masked('text')} || chr(10) || replace(kept[doc_id % {len(FORMS)} + 1], '{{v}}', left(sha256(text), 16)) || chr(10) || 'end' AS text,
        {natural_hits('text')} + (given[doc_id % {len(FORMS)} + 1] <> kept[doc_id % {len(FORMS)} + 1])::INT AS n FROM docs, f)
    SELECT doc_id, sha256(text) AS sha256, n::BIGINT AS n FROM t""")
def detect_all_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade on whole documents that end in one of many forms of secrets, placeholders and code."""
    form = _chosen([F.replace(F.lit(given), F.lit("{v}"), _fake(16)) for given, _ in FORMS])
    found = document_files(spark, sf_dir).select("doc_id", R.redacted(F.concat("text", F.lit("\n"), form, F.lit("\nend"))).alias("r"))
    return found.select("doc_id", F.sha2("r.text", 256).alias("sha256"), F.aggregate(F.map_values("r.counts"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
