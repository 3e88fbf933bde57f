"""The driver contract: entry, queries and oracle SQL."""

import re

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def training_data(key: str) -> bool:
    """Queries of the training-data subpackage: no SQL form, tested beside it."""
    return key == "pipeline" or re.match(r"op\d+_", key) is not None


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["source", "n_listings", "site_rank"] and len(rows) > 0


def test_every_query_has_oracle_or_is_declared_rows_only():
    q, s = entry.queries(), entry.oracle_sql()
    assert {k for k in set(q) - set(s) if not training_data(k)} == set()
    assert set(s) <= set(q)
    assert len([k for k in q if not training_data(k)]) >= 79


def test_queries_match_oracle_on_sf0001(spark):
    import sys
    sys.path.insert(0, "tools")
    from check_oracle import rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sqls = entry.oracle_sql()
    bad = []
    for key, fn in entry.queries().items():
        if training_data(key):
            continue
        df = fn(spark, SF)
        srows = [tuple(r) for r in df.collect()]
        if key not in sqls:
            continue
        res = con.execute(sqls[key])
        dcols = [d[0] for d in res.description]
        if sorted(df.columns) != sorted(dcols) or rows_of(df.columns, srows) != rows_of(dcols, res.fetchall()):
            bad.append(key)
    assert bad == []
