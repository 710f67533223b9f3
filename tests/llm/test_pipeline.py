"""The pipeline's stages on odd rows, clashing columns and empty tables, and the whole pipeline."""

import random

import corpus_pipeline as pipeline
import pytest

WORDS = {"aa": ["ba", "bel", "mobo", "lam", "abel", "bomel"], "cc": ["di", "gih", "fuci", "hid", "chidu", "fi"]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "score double, rejected boolean, entropy double, lang_pred string, kept string, n_removed long, contaminated boolean, row long, words string, node long, held_out boolean, hits string"


def prose(rng, lang, n=60):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = [(k, prose(rng, "aa" if k % 2 else "cc"), "aa" if k % 2 else "cc", "s", 1) for k in range(200)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def wide(spark, rows):
    """Rows of documents with further columns that have the names of operators' results."""
    extra = (0.5, True, 0.1, "x", "k", 7, True, 3, "w", 9, False, "h")
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{SCHEMA}, {CLASHES}")


BENCH = "one two three four five six seven eight nine ten"
ROWS = [(1, "bel mobo " * 20, "aa", "s", 1), (None, "x " + BENCH + " y", "aa", "s", 1), (None, "bel lam", None, None, None), (2, None, "aa", "s", 1), (3, "", "aa", "s", 1), (4, "1234 ###", "aa", "s", 1), (5, BENCH.upper(), "aa", "s", 1), (5, "abel bomel", "aa", "s", 1), (6, "q" * 5000, "aa", "s", 1)]


def test_stages_keep_columns_and_their_values(spark, docs, sf):
    table = wide(spark, [*ROWS, *(tuple(r) for r in docs.limit(60).collect())])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.columns == table.columns, name
        assert {(r.score, r.rejected, r.kept, r.n_removed, r.row) for r in out.collect()} <= {(0.5, True, "k", 7, 3)}, name


def test_empty_tables(spark, docs, sf):
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_language_rejects_noise_and_keeps_prose(spark, docs, sf):
    rng = random.Random(9)
    noise = [(1000 + k, "".join(rng.choice("wxyzqvk") for _ in range(300)), None, "s", 1) for k in range(20)]
    out = pipeline.keep_known_languages(spark, docs.union(spark.createDataFrame([*noise, (2000, "1 2 3", None, "s", 1), (None, prose(rng, "aa"), None, "s", 1)], SCHEMA)), sf)
    left = [r.doc_id for r in out.collect()]
    assert not [x for x in left if x is not None and x >= 1000] and None in left
    assert len([x for x in left if x is not None and x < 200]) >= 196


def test_near_duplicates(spark, sf):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(10_000)}" for _ in range(200))
    rows = [(5, text, "aa", "s", 1), (7, text, "aa", "s", 1), (9, text + " more", "aa", "s", 1), (None, text, "aa", "s", 1), (11, "", "aa", "s", 1), (12, None, "aa", "s", 1)]
    out = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), sf)
    assert sorted((r.doc_id is not None, r.doc_id) for r in out.collect() if r.doc_id is not None) == [(True, 5), (True, 11), (True, 12)] and out.filter("doc_id IS NULL").count() == 1


def test_repeats_are_cut(spark, sf):
    shared = "".join(chr(0x61 + k % 26) + str(k) for k in range(90))
    rows = [(1, shared + " tail one", "aa", "s", 0), (2, "head " + shared, "aa", "s", 0), (3, None, "aa", "s", 0)]
    out = {r.doc_id: r for r in pipeline.cut_repeats(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()}
    assert out[1].text == rows[0][1] and out[2].text == "head " and out[2].n_chars == 5 and out[3].text is None


def test_contaminated_rows_go_with_or_without_id(spark, sf):
    out = pipeline.drop_contaminated(spark, spark.createDataFrame(ROWS, SCHEMA), sf)
    assert sorted(r.text or "" for r in out.collect()) == sorted(t or "" for _, t, *_ in ROWS if BENCH not in (t or "").lower())


def test_tokenise(spark, sf):
    out = pipeline.tokenise(spark, spark.createDataFrame(ROWS, SCHEMA), sf)
    assert out.count() == len(ROWS) and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_run_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema) if stage is not pipeline.tokenise else stage(spark, docs, sf_dir)
    ours = sorted(map(tuple, pipeline.run(spark, sf_dir).collect()))
    assert ours == sorted(map(tuple, docs.collect())) and len(ours) > 50
