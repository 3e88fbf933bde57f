"""What a query reads, parses and computes more than once, told from its plan."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from roomledger.functions import payload as P
from roomledger.operators import windows

SF = "/root/testdata/sf0.001"
LD, LD_ATTRS = '<script type="application/ld+json">', '<script type="application/ld+json" data-x="1">'


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_page_is_cut_and_its_blocks_are_parsed_once(spark):
    plan = optimized(entry.queries()["jsonld_first_match"](spark, SF))
    assert plan.count("parseJson") == 1
    assert plan.count("split(") == 1
    # the pieces are cut by position, without counting their characters
    assert "length(lambda" not in plan.replace("length(substring_index(", "")


def test_predicates_on_parsed_blocks_find_what_they_find_in_pages(spark):
    def page(*texts):
        return "".join(f"{opening}{text}</script>" for opening, text in texts)

    pages = [
        None, "", "no block", page((LD, "")), page((LD, "{bad")), page((LD, "null")), page((LD, "3")),
        page((LD, '{"offers": null, "k": 1}')), page((LD, '{"offers": {}, "k": 2}'), (LD, '{"offers": {"p": 1}, "k": 3}')),
        page((LD, '[{"offers": [], "k": 4}, {"offers": [0], "k": 5}]')),
        page((LD, '[[{"offers": 1, "@type": "Room", "k": 6}], null, 7, {"address": "a", "k": 8}]')),
        page((LD, '{"\\u006fffers": 1, "k": 9}')), page((LD, '{"\\u0040type": "Room", "k": 10}')),
        page((LD, '{"a": {"offers": 1, "@type": "Room", "address": "x"}, "k": 11}')),
        page((LD_ATTRS, '{"offers": 1, "@type": "Room", "k": 12}'), (LD, '{"@type": "Offer", "k": 13}')),
        page((LD, '{"@type": ["Room"], "k": 14}'), (LD, '{"@type": null, "k": 15}'), (LD, '{"@type": "House", "k": 16}')),
        page((LD, '{"offers": 0, "address": "", "k": 17}'), (LD, '{"offers": false, "address": 0.0, "k": 18}')),
        page((LD, '{"offers": "x", "offers": 1, "k": 19}'), (LD, '{"address": true, "k": 20}')),
        page((LD, f'{{"offers": "{LD}", "k": 21}}'), (LD, '{"offers": "é>", "k": 22}')),
        LD + '{"offers": 1, "k": 23}', page((LD, '{"offers": 1, "k": 24}')) + LD + '{"offers": 1}',
        '<script type="application/ld+json"</script>' + page((LD, '{"address": {}, "k": 25}'), (LD, '{"address": {"a": null}, "k": 26}')),
    ]
    # by page: the first block with offers, of a type, with something for offers or an address
    want = [(None, None, None)] * 7 + [
        (1, None, None), (2, None, 3), (None, None, 5), (None, None, 8), (9, None, 9), (None, 10, None), (None, None, None),
        (None, 13, 12), (None, 16, None), (17, None, None), (None, None, 20), (22, None, 22), (None, None, None), (24, None, 24),
        (None, None, 26)]
    k = lambda c: F.try_variant_get(c, "$.k", "int")
    finders = (P.ld_offer_block, P.ld_typed_block, P.ld_offer_or_address_block)
    # rows that come twice come out twice
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)] * 2, "id int, html string").select(
        "id", "html", P.script_blocks("html").alias("blocks"), P.parsed_blocks(P.script_blocks("html")).alias("parsed"))
    for args in ({"html": "html"}, {"html": None, "blocks": F.col("blocks")}, {"html": None, "parsed": F.col("parsed")}):
        got = df.orderBy("id").select(*[k(f(**args)) for f in finders]).collect()
        assert [tuple(r) for r in got] == [w for w in want for _ in range(2)], list(args)


def scans(spark, make) -> int:
    """How often the plan reads files; what is reused is not printed again."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return make()._jdf.queryExecution().executedPlan().toString().count("FileScan")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_duplicates_are_marked_with_three_reads(spark):
    assert scans(spark, lambda: entry.queries()["cross_source_dedup"](spark, SF)) == 3
    # the digest of an address is computed in the three of them, and in no filter besides
    plan = optimized(entry.queries()["cross_source_dedup"](spark, SF))
    assert "isnotnull(unhex" not in plan and "isnotnull(coalesce(unhex" not in plan


def test_marks_of_hot_rare_and_uncompared_rows(spark):
    addresses = [None, "", "no digit", "Hot 1", "hot  1", "Same 2", "Once 3", "٣ x"]
    rows = [(i, addresses[i % 8], None if i % 11 == 0 else i % 3, None if i % 7 == 0 else i % 5) for i in range(1500)]
    # nearly all keys are rare, some of them on several sources, some without any rank
    rows += [(1500 + i, f"street {i % 1700}", 5, None if i % 1700 < 20 or i % 13 == 0 else i % 4) for i in range(3900)]
    rows += rows[:40] + rows[2000:2400]
    schema = "id int, address string, price_eur_month int, site_rank int"

    first = {}
    key = lambda a, p: ("".join(a.lower().split()), p)
    eligible = lambda a, p: a is not None and any(c.isdigit() for c in a) and p is not None
    for _, a, p, r in rows:
        if eligible(a, p) and r is not None:
            first[key(a, p)] = min(r, first.get(key(a, p), r))
    want = [(i, a, p, r, False if not eligible(a, p) else None if r is None else r > first[key(a, p)]) for i, a, p, r in rows]
    order = lambda found: sorted(found, key=repr)
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            got = windows.mark_cross_source_duplicates(spark.createDataFrame(rows, schema)).select(
                "id", "address", "price_eur_month", "site_rank", "is_duplicate").collect()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert order(tuple(r) for r in got) == order(want)
    assert windows.mark_cross_source_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_rejected_rows_are_no_read_of_their_own(spark):
    for key in ("reject_audit", "funnel_counts"):
        assert scans(spark, lambda k=key: entry.queries()[k](spark, SF)) == 3, key


def test_rows_not_among_the_compared_make_no_duplicates(spark):
    rows = [(1, "A 1", 5, 1, False), (2, "A 1", 5, 2, True), (3, "A 1", 5, 3, True), (4, "A 1", 5, 4, None), (5, "A 1", 5, None, False),
            (6, "B 1", None, 1, True), (7, None, 5, 2, True), (8, "C 1", 5, None, True), (8, "C 1", 5, None, True)]
    # as many rare keys: the ones above are hot without them
    for more in (0, 3000):
        df = spark.createDataFrame(rows + [(9, f"street {i}", 5, 1, i % 2 == 0) for i in range(more)],
                                   "id int, address string, price_eur_month int, site_rank int, accepted boolean")
        got = windows.mark_cross_source_duplicates(df, among=F.col("accepted")).where("id < 9").orderBy("id").collect()
        assert [r["is_duplicate"] for r in got] == [False, False, True, False, False, False, False, None, None]


def test_audit_of_odd_documents(spark, tmp_path):
    rows = [(None, "und 1 a", "src1", 5), (1, "und 1 a", "src2", 5), (2, "und 1 a", "src3", None), (3, "und 1 a", "src1", 5),
            (4, "of the\nund 1 a", "src0", 5), (5, "und", "src3", 5), (6, None, "src3", 5), (7, "", "src3", 5), (8, "und 1 a", None, 5),
            (9, "und 1 a", "odd", 5), (10, "none 1", "src1", 5), (11, "UND  1A", "src4", 5), (11, "UND  1A", "src4", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumn("lang", F.lit("de")) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    reasons = {4: "unavailable", 6: "out_of_area", 7: "out_of_area", 10: "out_of_area", 1: "duplicate", 11: "duplicate"}
    audit = entry.queries()["reject_audit"](spark, str(tmp_path)).collect()
    page = lambda i: None if i is None else i // 50 + 1
    assert sorted(map(repr, map(tuple, audit))) == sorted(repr((i, s, page(i), reasons.get(i))) for i, _, s, _ in rows)
    counts = {}
    for i, _, s, _ in rows:
        group = (s, page(i), reasons.get(i, "kept"))
        counts[group] = counts.get(group, 0) + 1
    funnel = entry.queries()["funnel_counts"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, funnel))) == sorted(repr((*k, n)) for k, n in counts.items())
