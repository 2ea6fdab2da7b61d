"""The pipeline's stages against what each should do with a small table."""

import corpus_pipeline as P
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil magic potions near the river bank"


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def docs(spark):
    en, fr = "the water and the house of them with this", "le maison et la rue des enfants avec une"
    rows = [(i, f"{en if i % 2 else fr} number w{i} x{i} y{i} z{i} v{i}", "en" if i % 2 else "fr", "s", 1) for i in range(40)]
    rows += [(100, ITEM + " tail", "en", "s", 1), (101, "mail me at bob@example.com or +1 (017) 555-7713 the house of water", "en", "s", 1), (102, "12 34 ...", "en", "s", 1), (103, None, None, "s", None)]
    rows += [(200, "copy of the water and house of them all", "en", "s", 1), (201, "Copy of the water and house of them all", "en", "s", 1), (202, "copy of the water and house of them all", "en", "t", 1), (202, "copy of the water and house of them all", "en", "t", 1)]
    return spark.createDataFrame(rows, COLUMNS)


def test_stages(spark, folder):
    assert len(P.STAGES) == 5
    kept, ids = docs(spark), {}
    for name, stage in P.STAGES:
        kept = stage(spark, kept, folder)
        rows = kept.collect()
        kept = spark.createDataFrame(rows, kept.schema)
        if name != "tokens":
            assert kept.columns == list(P.COLUMNS)
        ids[name] = sorted(r.doc_id for r in rows)
    clean = list(range(40))
    assert ids["language"] == clean + [100, 101, 200, 201, 202, 202]
    assert ids["near_duplicates"] == clean + [100, 101, 200]
    assert ids["decontamination"] == ids["personal_data"] == ids["tokens"] == clean + [101, 200]


def test_repeated_rows_with_one_id(spark, folder):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (None, "a b c d e f", "en", "s", 1)]
    out = P.drop_near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), folder).collect()
    assert sorted([r.doc_id for r in out], key=str) == [1, None]


def test_null_and_repeated_ids_are_judged_by_their_text(spark, folder):
    fine = "the water and the house of them with this"
    base = docs(spark)
    rows = [(None, "12 34 ...", "en", "s", 1), (None, ITEM, "en", "s", 1), (None, fine + " null", "en", "s", 1), (900, fine + " first text", "en", "s", 1), (900, "12 34 ...", "en", "s", 1), (900, f"{fine} {ITEM} and more", "en", "s", 1)]
    rows += [(901, "les enfants de la rue avec une maison bleue", "fr", "s", 1), (901, "a house of water stands with them on the hill", "en", "s", 1)]
    kept = base.unionByName(spark.createDataFrame(rows, COLUMNS))
    for stage, gone in ((P.keep_known_languages, {"12 34 ..."}), (P.drop_near_duplicates, set()), (P.drop_benchmark_leaks, {ITEM, f"{fine} {ITEM} and more"})):
        out = stage(spark, kept, folder)
        assert out.columns == list(P.COLUMNS)
        found = out.collect()
        assert {(r.doc_id, r.text) for r in found if r.doc_id is None or r.doc_id >= 900} == {r[:2] for r in rows if r[1] not in gone}, stage
        kept = spark.createDataFrame(found, COLUMNS)
        rows = [r for r in rows if r[1] not in gone]
    assert len(rows) == 4


def test_masks(spark, folder):
    out = {r.doc_id: r for r in P.mask_personal_data(spark, docs(spark), folder).collect()}
    assert out[101].text == "mail me at [EMAIL] or [PHONE] the house of water" and out[101].n_chars == len(out[101].text) and out[103].text is None


def test_run(spark, sf_dir):
    rows = P.run(spark, sf_dir).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)


def test_empty(spark, folder):
    none = spark.createDataFrame([], COLUMNS)
    assert all(stage(spark, none, folder).collect() == [] for _, stage in P.STAGES)


def test_other_columns_with_clashing_names(spark, folder):
    plain = docs(spark)
    names = [*plain.columns, "DOC_ID", "Text", "_row", "h", "key", "score", "lang_pred", "block", "data", "bucket", "digest"]
    clashing = plain.select("*", *[plain["doc_id"].alias(f"c{k}") for k in range(len(names) - len(plain.columns))]).toDF(*names)
    for name, stage in P.STAGES:
        rows = [stage(spark, d, folder).collect() for d in (plain, clashing)]
        assert sorted(map(repr, rows[0])) == sorted(map(repr, rows[1])), name
