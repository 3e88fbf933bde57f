"""What is learned, held against labels it has not seen."""

import zlib

from pyspark.sql import functions as F

from roomledger.llm.queries import QUERIES, read

SF = "/root/testdata/sf0.01"


def labels_of(spark):
    return {r["doc_id"]: r["quality"] for r in read(spark, SF, "labels").collect()}


def test_quality_scores_of_held_out_rows(spark):
    labels = labels_of(spark)
    rows = QUERIES["op2_quality_classifier"](spark, SF).collect()
    assert len(rows) == read(spark, SF, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    good = [r["score"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == 1]
    bad = [r["score"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == 0]
    assert min(len(good), len(bad)) >= 10
    above = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert above >= 0.95


def test_verdicts_of_the_decision_list(spark):
    labels = labels_of(spark)
    docs = {r["doc_id"]: r["text"] or "" for r in read(spark, SF, "documents").collect()}
    rows = QUERIES["op5_quality_rules"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(docs)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)
    told = [(labels[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    good, bad = [k for q, k in told if q == 1], [k for q, k in told if q == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.1 * len(bad)
    # unlabelled documents are judged by the same list
    assert 0.5 < sum(r["kept"] for r in rows if not r["base_failed"]) / sum(not r["base_failed"] for r in rows) <= 1


def test_every_query_takes_an_empty_table(spark, tmp_path):
    """The thin queries over whole, empty tables."""
    root = str(tmp_path)
    for table in ("documents", "labels", "pages", "conversations"):
        read(spark, SF, table).where(F.lit(False)).write.parquet(f"{root}/{table}.parquet")
    for name in ("op1_warc_derivatives", "op4_simhash", "op6_entropy_mixing", "op7_suffix_dedup", "op8_token_counts", "op11_phrase_collocations",
                 "op12_periodic_runs", "op13_jaccard_join"):
        assert QUERIES[name](spark, root).collect() == [], name
    assert [r["conv_id"] for r in QUERIES["op10_chat_format"](spark, root).collect()] == [-7]
