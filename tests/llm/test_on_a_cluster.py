"""Queries that stage tables, where the session is a cluster's and its checkpoint folder a ``file:`` mount that all machines share."""

import random

import pytest

import corpus_pipeline
from roomledger import session
from roomledger.llm.queries import QUERIES, read
from roomledger.plans.cases import load_all

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(300)]
TEXTS = {k: " ".join([rng.choice(WORDS) for _ in range(60)] + ["quux", "zebra"]) for k in range(1, 31)}
TEXTS[12], TEXTS[13] = TEXTS[11], None
N_WORDS = {k: len((t or "").split()) for k, t in TEXTS.items()}
#: smallest document with the same text
FIRST = {k: 11 if k == 12 else k for k in TEXTS}


@pytest.fixture
def cluster(spark, monkeypatch):
    assert spark.sparkContext.getCheckpointDir().startswith("file:")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://main:7077")
    return spark


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(1, 21)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_a_shared_folder_is_tried_once(cluster, monkeypatch):
    monkeypatch.setattr(session, "_SHARED", set())
    folder = cluster.sparkContext.getCheckpointDir()
    assert session.scratch_dir(cluster, "x").startswith(f"{folder}/x-") and session._SHARED == {folder}
    monkeypatch.setattr(session, "rows_come_back", None)
    assert session.scratch_dir(cluster, "x").startswith(f"{folder}/x-")


def test_a_folder_of_each_machine_is_refused(cluster, monkeypatch):
    monkeypatch.setattr(session, "_SHARED", set())
    monkeypatch.setattr(session, "rows_come_back", lambda spark, folder: False)
    with pytest.raises(RuntimeError):
        session.scratch_dir(cluster, "x")


def test_pipeline_first_stage(cluster, tables):
    kept = corpus_pipeline.STAGES[0][1](cluster, read(cluster, tables, "documents"), tables).collect()
    assert sorted(r["doc_id"] for r in kept) == [k for k in TEXTS if k != 13]


def test_op2(cluster, tables):
    score = {r["doc_id"]: r["score"] for r in QUERIES["op2_quality_classifier"](cluster, tables).collect()}
    assert score.keys() == TEXTS.keys() and score[11] == score[12] and all(0 <= x <= 1 for x in score.values())


def test_op3(cluster, tables):
    assert {r["doc_id"]: r["class_id"] for r in QUERIES["op3_probminhash"](cluster, tables).collect()} == FIRST


def test_op4(cluster, tables):
    rows = QUERIES["op4_simhash"](cluster, tables).collect()
    assert {r["doc_id"]: r["class_size"] for r in rows if r["doc_id"] != 13} == {k: 1 + (k in (11, 12)) for k in TEXTS if k != 13}
    assert len(rows) == len(TEXTS)


def test_op5(cluster, tables):
    rows = QUERIES["op5_quality_rules"](cluster, tables).collect()
    assert {r["doc_id"]: (r["n_words"], r["base_failed"]) for r in rows} == {k: (n, n < 50) for k, n in N_WORDS.items()}


def test_op6(cluster, tables):
    rows = QUERIES["op6_entropy_mixing"](cluster, tables).collect()
    assert {r["doc_id"]: r["size"] for r in rows} == N_WORDS
    for source in range(3):
        own = [r for r in rows if r["doc_id"] % 3 == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 62


def test_op7(cluster, tables):
    rows = QUERIES["op7_suffix_dedup"](cluster, tables).collect()
    assert {r["doc_id"]: r["n_removed"] for r in rows} == {k: len(t) if k == 12 else 0 for k, t in TEXTS.items()}


def test_op9(cluster, tables):
    rows = QUERIES["op9_packing"](cluster, tables).collect()
    assert {r["doc_id"] for r in rows} == TEXTS.keys()
    for k in TEXTS:
        own = [r for r in rows if r["doc_id"] == k]
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"] and (own[0]["doc_tokens"] == 1) == (k == 13)


def test_op11(cluster, tables):
    rows = QUERIES["op11_phrase_collocations"](cluster, tables).collect()
    assert [(r["lang"], r["phrase"], r["a"], r["l"], r["r"], r["n"]) for r in rows] == [("en", "quux zebra", 29, 29, 29, 29 * 62)]


def test_op13(cluster, tables):
    rows = QUERIES["op13_jaccard_join"](cluster, tables).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == FIRST


def test_run_stamped_sink(cluster, tables):
    rows = load_all()["run_stamped_sink"][0](cluster, tables).collect()
    assert sorted((r["doc_id"], r["run_ts"]) for r in rows) == [(k, "20260101_120000") for k in TEXTS]
