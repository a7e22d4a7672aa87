"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tagloom.llm import classifier, credentials, decontaminate, divergence, licenses, packing, pii, sharding, simhash, suffixes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, score string, shard string, position int, item int, bin int, size int, kind string, bad_id__ int, gone__ int, key__ int, label int, value int, word string, rank int, total int, n int, ref_lang string, classes string, words string"
EXTRA = ("k", "s", "h", 1, 2, 3, 4, "x", 5, 6, 7, 8, 9, "w", 10, 11, 12, "l", "c", "v")
LABELS = "doc_id bigint, quality int, toxic int, text string, id__ int"
BENCH = "item_id bigint, text string, doc_id int"


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


LONG = prose(60_000, 1)
ROWS = [
    (1, prose(80, 2), "en"), (1, prose(80, 2), "en"), (1, prose(80, 2), "en"), (2, prose(80, 2), None), (3, "", "en"), (4, None, None), (None, None, None),
    (None, prose(90, 3), "de"), (5, LONG, "en"), (6, "!!! ???", "en"), (7, "one", "en"), (8, "mail joe.doe@mail.example.com or 10.2.3.4 " + prose(50, 4), "en"),
    (9, "Released under the MIT License.\n" + prose(40, 5), "en"), (10, "password=hunter22 user=joe host=db.example.com", "en"), (11, prose(80, 6), "en"), (12, prose(80, 7), "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "s", len(t) if t else None, *EXTRA) for i, t, lang in ROWS], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x", 1), (1, None, None, "x", 1), (8, 0, 0, "y", 2), (11, 0, 1, None, None), (12, 1, 0, None, None), (None, 0, 0, None, None), (99, 1, 0, "", 0)], LABELS)


@pytest.fixture(scope="module")
def bench(spark):
    words = LONG.split()
    return spark.createDataFrame([(1, " ".join(words[30_000:30_030]), 1), (1, " ".join(words[30_000:30_030]), 1), (2, None, 2), (3, "", 3), (None, " ".join(prose(80, 6).split()[10:40]), 4), (4, "one", 5)], BENCH)


def operators(docs, labels, bench):
    return {
        "op1": decontaminate.contained_items(docs, bench), "op2": suffixes.repeats(docs, 10, 4), "op3": divergence.kept(docs), "op4": pii.find_pii(docs), "op5": simhash.near_duplicates(docs),
        "op6": sharding.shuffled(docs), "op7": credentials.credentials(docs), "op8": licenses.find_licenses(docs), "op9": classifier.accepted(docs, labels), "op10": packing.pack(docs, 100),
    }


def test_empty_tables_give_empty_results(none, labels, bench):
    for name, df in operators(none, labels.where("false"), bench.where("false")).items():
        assert df.count() == 0, name


def test_empty_side_tables(docs, labels, bench):
    assert decontaminate.contained_items(docs, bench.where("false")).count() == 0
    scores = {r.doc_id: r.score for r in classifier.quality_scores(docs, labels.where("false")).where("doc_id is not null").collect()}
    assert scores[3] == 0 and scores[4] == 0 and scores[6] == 0 and scores[1] == 1 and scores[7] == 1


@pytest.fixture(scope="module")
def results(docs, labels, bench):
    return {k: [tuple(r) for r in df.collect()] for k, df in operators(docs, labels, bench).items()}


def test_op1_finds_items_in_long_texts_once(results):
    assert set(results["op1"]) == {(5, 1, 1.0), (11, None, 1.0)}


def test_op2_reports_repeated_rows_but_one(results):
    got = [r for r in results["op2"] if r[0] in (1, 2) or r[0] is None]
    assert len(got) == 4 and {r[2] for r in got} == {80} and all(r[1] == 0 and r[3] == 1 and r[4] == 0 for r in got) and sum(r[5] for r in got) == 1


def test_op3_keeps_what_is_too_short(results):
    got = {r[0]: r for r in results["op3"]}
    assert got[3][2:] == (None, None) and got[4][1:] == (None, None, None) and got[7][2:] == (None, None)
    assert None in got and got[5][2] is not None


def test_op4_and_op7_and_op8(results):
    assert sorted((r[0], r[1], r[4]) for r in results["op4"]) == [(8, "email", "joe.doe@mail.example.com"), (8, "ip", "10.2.3.4"), (10, "secret", "hunter22")]
    assert [(r[0], r[1], r[2], r[4], r[6]) for r in results["op7"]] == [(10, "linked", "joe", "hunt****", "db.example.com")]
    assert [(r[0], r[1], r[2], r[3]) for r in results["op8"]] == [(9, "MIT", 0, 30)]


def test_op5_groups_repeated_rows_and_equal_texts(results):
    assert sorted(results["op5"]) == [(1, 1), (1, 1), (2, 1)]


def test_op6_keeps_all_rows_and_columns(results, docs):
    n = len(docs.columns)
    assert sorted(map(repr, (r[:n] for r in results["op6"]))) == sorted(map(repr, (tuple(r) for r in docs.collect())))
    assert sorted(r[-1] for r in results["op6"]) == list(range(len(ROWS)))


def test_op9_rejects_texts_without_words(results):
    ids = {r[0] for r in results["op9"]}
    assert not ids & {3, 4, 6}


def test_op10_places_every_word_once(results):
    spans = sorted((r[3], r[4]) for r in results["op10"] if r[1] == 5)
    assert spans == [(i, 100) for i in range(0, 60_000, 100)]
    assert sum(r[4] for r in results["op10"]) == sum(len((t or "").split()) for _, t, _ in ROWS)
    assert sum(r[1] == 1 for r in results["op10"]) == 3 and not any(r[1] in (3, 4) for r in results["op10"])


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory, docs, labels, bench):
    d = tmp_path_factory.mktemp("sf")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(str(d / f"{name}.parquet"))
    return str(d)


def test_stages_keep_columns_and_repeated_rows_count(spark, docs, none, sf_dir):
    n = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        if name != "packing":
            assert got.columns == docs.columns
        n[name] = got.count()
        assert stage(spark, none, sf_dir).count() == 0
    assert n["near_duplicates"] == len(ROWS) - 3 and n["decontamination"] == len(ROWS) - 2 and n["pii"] == len(ROWS)


def test_redaction_takes_effect_and_counts(spark, docs):
    r = pii.redact_pii(docs).where("doc_id = 8").first()
    assert r.text.startswith("mail <EMAIL> or <IP> ") and r.n_chars == len(r.text)
    same = pii.redact_pii(docs).where("doc_id is null or doc_id not in (8, 10)")
    assert sorted(map(repr, same.collect())) == sorted(map(repr, docs.where("doc_id is null or doc_id not in (8, 10)").collect()))


def test_run_applies_all_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["bin_id", "doc_id", "piece", "first_word", "n_words", "offset"]
    assert got.where(F.col("doc_id").isin(3, 4, 5, 6)).count() == 0
