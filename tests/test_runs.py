"""Bad rows, documents landed twice, and outputs of runs that are killed."""

import datetime as dt
import json

import pytest

from landed_fixture import CLASSIFIEDS, SEARCH, UNIT, _api_rows, _ld, _page_rows, write_rows
from roomledger.operators import joins, windows
from roomledger.plans import batch_run
from roomledger.schema import LISTING_SCHEMA
from roomledger.session import scratch_dir
from roomledger.sources import payloads, sinks
from roomledger.sources.adapters import classifieds, js_pages, rental_pages, search_json, unit_api

TS = dt.datetime(2026, 1, 1, 12, 0)
OUTPUTS = ["listings", "audit", "funnel", "dedup", "summary"]


def by_url(df):
    return {r["url"]: r for r in df.collect()}


def test_one_bad_row_costs_one_row(spark):
    bad = {"guid": "bad", "location": "Leuven", "surfaceAreaFrom": 9.0}
    api = [r if not (r[0] == "detail" and r[3] == 102) else (*r[:4], json.dumps({"data": bad})) for r in _api_rows()]
    pages = []
    for r in _page_rows():
        if r[0] == CLASSIFIEDS and r[4].endswith("m3"):
            r = (*r[:5], _ld({"offers": ["x"], "name": "n"}), *r[6:])
        if r[0] == SEARCH and r[4] == "s2p1":
            ads = json.loads(r[5][r[5].index("{"): r[5].rindex("}") + 1])
            ads["results"][1:1] = [{"id": 77, "property": "house"}, 5]
            r = (*r[:5], f"<pre>{json.dumps(ads)}</pre>", *r[6:])
        pages.append(r)
    root = write_rows(spark, scratch_dir(spark, "bad"), api, pages)
    out = scratch_dir(spark, "out")
    res = batch_run.run(spark, root, out, TS)
    assert res["failures"] == {} and len(res["sources"]) == 5
    assert spark.read.parquet(res["outputs"]["listings"]).count() == 5
    errors = {(r["source"], r["parse_error"]) for r in
              spark.read.parquet(res["outputs"]["audit"]).where("reject_reason = 'parse_error'").collect()}
    assert errors == {(UNIT, "$.location"), (CLASSIFIEDS, "$.offers"), (SEARCH, "$.property"), (SEARCH, "$")}


def test_checked_details(spark):
    good = {"guid": "g", "location": None, "pricing": {}, "unitType": "1", "surfaceAreaFrom": 5}
    bodies = {1: {"data": good}, 2: {"data": "text"}, 3: {"data": {"facilities": {"options": {"a": 1}}}}, 4: {"data": {}}, 5: {"data": {"guid": "g", "pricing": {"totalMonthlyRent": {"from": "x"}}}}}
    df = spark.createDataFrame([(k, json.dumps(b)) for k, b in bodies.items()] + [(6, "{broken"), (7, None)], "id int, body string")
    got = {r["id"]: r["parse_error"] for r in payloads.read_checked_details(df).collect()}
    # a unit type of another kind is unknown, as it was before
    assert got == {1: None, 2: "$", 3: "$.facilities.options", 5: "$.pricing.totalMonthlyRent.from"}
    assert [r["id"] for r in payloads.read_detail_docs(df).collect()] == [1]


def test_the_first_landing_wins(spark):
    api, pages = _api_rows(), _page_rows()
    old = json.loads(next(r[4] for r in api if r[3] == 101))
    old["data"]["guid"] = "a-0"  # the least content, landed last
    api.append(("detail", None, None, 101, json.dumps(old)))
    again = [(r[0], r[1], r[2], r[3], r[4], "<main><h1>AAA</h1><p>Leuven, € 1 per maand, 9 m2</p></main>" if r[1] == "detail" else "<i></i>", r[6])
             for r in pages if r[6] == 200]
    root = write_rows(spark, scratch_dir(spark, "twice"), api, pages + again)
    once = write_rows(spark, scratch_dir(spark, "once"), _api_rows(), pages)
    for adapter in (unit_api, classifieds, rental_pages, search_json, js_pages):
        assert by_url(adapter.build(spark, root, TS)) == by_url(adapter.build(spark, once, TS)), adapter.SOURCE


def test_landing_order_of_joins(spark):
    docs = spark.createDataFrame([("u", "b", 1), ("u", "a", 2), ("u", "0", None), ("v", "z", None)], "url string, body string, seq long")
    links = spark.createDataFrame([("u",), ("v",), ("w",)], "detail_url string")
    got = {r["detail_url"]: r["body"] for r in joins.link_page_join(links, docs, order=("seq",), how="left").collect()}
    assert got == {"u": "b", "v": "z", "w": None}


def test_first_with_flag_aggregates_numbers_alone(spark):
    df = spark.createDataFrame([("u", 1, 5, True), ("u", 1, 4, False), ("v", 2, 0, False), ("v", 1, 9, True), ("w", 3, 3, False), ("w", 3, 3, True),
                                ("x", 7, 1, None)], "url string, page int, pos int, taken boolean")
    first = windows.first_with_flag(df, ["url"], ["page", "pos"], "taken")
    assert {tuple(r) for r in first.collect()} == {("u", 1, 4, False), ("v", 1, 9, True), ("w", 3, 3, True), ("x", 7, 1, False)}
    cards = df.selectExpr("url AS detail_url", "page", "pos", "if(taken, 'verhuurd', 'vrij') AS card_text")
    plan = joins.card_reject_anti(cards)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def outputs(spark, out, paths):
    return {name: spark.read.parquet(sinks.current_path(spark, out, paths[name])).count() for name in OUTPUTS}


def audit_table(spark, rows):
    given = spark.createDataFrame(rows, "source string, site_rank int, url string, reject_reason string")
    types = {f.name: f.dataType.simpleString() for f in LISTING_SCHEMA.fields} | {"page": "int", "raw": "string", "parse_error": "string"}
    return given.selectExpr("*", *[f"cast(null as {t}) as {c}" for c, t in types.items() if c not in given.columns])


@pytest.mark.parametrize("moves", [0, 1, 2, 3, 5, 8])
def test_a_killed_writer_leaves_one_whole_set(spark, monkeypatch, moves):
    table = audit_table(spark, [("a", 1, "1", None), ("a", 1, "2", None), ("a", 1, "3", "x")])
    out = scratch_dir(spark, "out")
    paths = sinks.write_outputs(table.where("url <> '2'"), out, TS)
    before = outputs(spark, out, paths)
    left, move = [moves], sinks._move

    def dying(fs, source, target):
        left[0] -= 1
        if left[0] < 0:
            raise OSError("killed")
        move(fs, source, target)

    monkeypatch.setattr(sinks, "_move", dying)
    with pytest.raises(OSError):
        sinks.write_outputs(table, out, TS)
    monkeypatch.setattr(sinks, "_move", move)
    whole = {"listings": 2, "audit": 1, "funnel": 2, "dedup": 1, "summary": 3}
    assert outputs(spark, out, paths) == (before if moves == 0 else whole)
    # the next writer finishes the moves
    sinks.recover(spark, out)
    assert {n: spark.read.parquet(paths[n]).count() for n in OUTPUTS} == (before if moves == 0 else whole)
    assert spark.read.parquet(f"{out}/listings").count() == (1 if moves == 0 else 2)


def test_a_retry_without_listings_leaves_the_set(spark):
    table = audit_table(spark, [("a", 1, "1", None), ("a", 1, "2", "x")])
    out = scratch_dir(spark, "out")
    paths = sinks.write_outputs(table, out, TS)
    assert set(sinks.write_outputs(table.where("reject_reason = 'x'"), out, TS).values()) == {None}
    assert {n: spark.read.parquet(paths[n]).count() for n in ("listings", "audit")} == {"listings": 1, "audit": 1}
