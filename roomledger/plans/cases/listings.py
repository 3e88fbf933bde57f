"""Listing-level cases on ``documents``: each document is a listing of the
source named in ``source`` (rank = its number), its text the address and
description, its length the price.  Dedup really fires here: the table has
exact copies across sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import compose, flags, numbers, text
from ...operators import aggregates, filters, joins, ordering, windows
from ...sources import sinks
from . import case, read
from .sqlbits import contains_any_sql, keyed_sql, phrase_re2, ppm_sql, q

# Parameters for prose in en/fr/de/es (the driver's text), in place of the Dutch defaults.
PHRASES = [r"\bof the\b", r"\bde la\b", r"\blicense\b"]
AREA_NAME, AREA_CODE = "und", "42"
KEYWORDS = {
    "furnished": ["of the", "und "],
    "private_bathroom": ["la "],
    "shared_kitchen": ["license"],
    "elevator": ["lift ", "que"],
    "pets_allowed": ["ß"],
}
RULES = {
    "type_classifieds": [("Studio", ["license"]), ("Appartement", ["de la", "of the"]), ("Kamer", ["und", "el "])],
    "type_rentals": [("Studio", ["license"]), ("Appartement", ["de la"]), ("Kamer", ["und", "of the"])],
    "type_js_pages": [("Studio", ["license"]), ("Kamer", ["und", "el "]), ("Appartement", ["de la"])],
}
RUN_TS = dt.datetime(2026, 1, 1, 12, 0)
PH = q(phrase_re2(PHRASES))

DOC_SQL = """
doc_listings AS (
  SELECT doc_id, source, TRY_CAST(substr(source, 4) AS INTEGER) AS site_rank, doc_id AS src_pos,
         text AS address, CAST(n_chars AS DECIMAL(18,4)) AS price_eur_month, text,
         split_part(text, chr(10), 1) AS title, doc_id // 50 + 1 AS page, lang
  FROM documents)"""


def doc_listings(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return docs.select(
        "doc_id",
        "source",
        F.col("source").substr(4, 10).try_cast("int").alias("site_rank"),
        F.col("doc_id").alias("src_pos"),
        F.col("text").alias("address"),
        F.col("n_chars").cast(numbers.PRICE_TYPE).alias("price_eur_month"),
        "text",
        F.substring_index("text", "\n", 1).alias("title"),
        (F.floor(F.col("doc_id") / 50) + 1).cast("bigint").alias("page"),
        "lang",
    )


def _sql_phrase(expr: str) -> str:
    return f"COALESCE(regexp_matches({expr}, {PH}), false)"


def _sql_area(expr: str) -> str:
    return f"COALESCE(contains(lower({expr}), {q(AREA_NAME)}) OR contains({expr}, {q(AREA_CODE)}), false)"


def _sql_rules(expr: str, rules) -> str:
    whens = " ".join(f"WHEN {contains_any_sql(expr, kws)} THEN {q(label)}" for label, kws in rules)
    return f"CASE {whens} END"


@case("cross_source_dedup", f"""WITH {DOC_SQL}, {keyed_sql('doc_listings')}
SELECT doc_id, source, site_rank FROM marked WHERE NOT is_duplicate""")
def cross_source_dedup(spark, d):
    return windows.cross_source_dedup(doc_listings(spark, d)).select("doc_id", "source", "site_rank")


@case("dedup_removed_count", f"""WITH {DOC_SQL}, {keyed_sql('doc_listings')}
SELECT count(*) AS rows_in, CAST(count_if(NOT is_duplicate) AS BIGINT) AS rows_kept,
       CAST(count_if(is_duplicate) AS BIGINT) AS rows_removed
FROM marked""")
def dedup_removed_count(spark, d):
    return aggregates.dedup_removed_count(windows.mark_cross_source_duplicates(doc_listings(spark, d)))


@case("count_per_source", f"""WITH {DOC_SQL}, {keyed_sql('doc_listings')}
SELECT source, count(*) AS n_listings, min(site_rank) AS site_rank FROM marked WHERE NOT is_duplicate
GROUP BY source""")
def count_per_source(spark, d):
    return aggregates.count_per_source(windows.cross_source_dedup(doc_listings(spark, d)))


@case("count_total", f"""WITH {DOC_SQL}, {keyed_sql('doc_listings')}
SELECT source, GROUPING(source) = 1 AS is_total, count(*) AS n_listings FROM marked WHERE NOT is_duplicate GROUP BY ROLLUP (source)""")
def count_total(spark, d):
    return aggregates.counts_with_total(windows.cross_source_dedup(doc_listings(spark, d)))


@case("top_n_per_source", f"""WITH {DOC_SQL}
SELECT doc_id, source, src_pos FROM doc_listings
QUALIFY row_number() OVER (PARTITION BY source ORDER BY src_pos) <= 3""")
def top_n_per_source(spark, d):
    return windows.top_n_per_group(doc_listings(spark, d), "source", "src_pos", 3).select("doc_id", "source", "src_pos")


@case("output_order", f"""WITH {DOC_SQL}, {keyed_sql('doc_listings')}
SELECT site_rank, src_pos, doc_id, source FROM marked WHERE NOT is_duplicate ORDER BY site_rank, src_pos""")
def output_order(spark, d):
    kept = windows.cross_source_dedup(doc_listings(spark, d))
    return ordering.output_order(kept).select("site_rank", "src_pos", "doc_id", "source")


@case("phrase_unavailable", f"""SELECT doc_id, {_sql_phrase('text')} AS unavailable FROM documents""")
def phrase_unavailable(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", text.matches_any_phrase("text", PHRASES).alias("unavailable"))


@case("availability_by_scope", f"""WITH {DOC_SQL}
SELECT doc_id,
       NOT {_sql_phrase('title')} AS kept_title_only,
       NOT ({_sql_phrase('title')} OR {_sql_phrase('left(text, 1000)')}) AS kept_scope_1000,
       NOT ({_sql_phrase('title')} OR {_sql_phrase('left(text, 800)')}) AS kept_scope_800
FROM doc_listings""")
def availability_by_scope(spark, d):
    l = doc_listings(spark, d)
    return l.select(
        "doc_id",
        (~filters.unavailable_in_scope("title", None, patterns=PHRASES)).alias("kept_title_only"),
        (~filters.unavailable_in_scope("title", "text", 1000, PHRASES)).alias("kept_scope_1000"),
        (~filters.unavailable_in_scope("title", "text", 800, PHRASES)).alias("kept_scope_800"),
    )


@case("yes_if_mentioned", f"""SELECT doc_id, CASE WHEN {contains_any_sql('lower(text)', KEYWORDS['furnished'])}
THEN true END AS flag FROM documents""")
def yes_if_mentioned(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", text.yes_if_mentioned(F.lower("text"), KEYWORDS["furnished"]).alias("flag"))


@case("keyword_dim_join", "SELECT doc_id, " + ", ".join(
    f"CASE WHEN {contains_any_sql('lower(text)', kws)} THEN true END AS {f}" for f, kws in KEYWORDS.items()
) + " FROM documents")
def keyword_dim_join(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    return joins.keyword_dim_join(docs, "low", KEYWORDS).select("doc_id", *KEYWORDS)


@case("classify_type", "SELECT doc_id, " + ", ".join(
    f"{_sql_rules('lower(text)', rules)} AS {name}" for name, rules in RULES.items()
) + " FROM documents")
def classify_type(spark, d):
    docs = read(spark, d, "documents")
    low = F.lower("text")
    return docs.select("doc_id", *[text.classify_by_keywords(low, r).alias(n) for n, r in RULES.items()])


@case("area_text_filter", f"SELECT doc_id, {_sql_area('text')} AS in_area FROM documents")
def area_text_filter(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", text.area_text_match("text", AREA_NAME, AREA_CODE).alias("in_area"))


@case("address_key", f"""WITH {DOC_SQL}, {keyed_sql('doc_listings')}
SELECT doc_id, _k AS addr_key, dedup_key IS NOT NULL AS eligible FROM keyed""")
def address_key(spark, d):
    l = doc_listings(spark, d)
    return l.select(
        "doc_id",
        text.address_key("address").alias("addr_key"),
        windows.dedup_key("address", "price_eur_month").isNotNull().alias("eligible"),
    )


def audited_listings(spark, d) -> DataFrame:
    """K4: every candidate with its reject reason (NULL = kept)."""
    l = doc_listings(spark, d)
    reason = filters.first_reason(
        (text.matches_any_phrase("title", PHRASES), "unavailable"),
        (~text.area_text_match("text", AREA_NAME, AREA_CODE), "out_of_area"),
    )
    audited = l.withColumn("reject_reason", reason)
    marked = windows.mark_cross_source_duplicates(audited, among=F.col("reject_reason").isNull())
    return marked.withColumn("reject_reason", F.when(F.col("is_duplicate"), F.lit("duplicate")).otherwise(
        F.col("reject_reason"))).drop("is_duplicate")


AUDIT_SQL = f"""{DOC_SQL},
audited AS (SELECT *, CASE WHEN {_sql_phrase('title')} THEN 'unavailable'
                           WHEN NOT {_sql_area('text')} THEN 'out_of_area' END AS reason FROM doc_listings),
accepted AS (SELECT * FROM audited WHERE reason IS NULL), {keyed_sql('accepted')},
audit AS (
  SELECT doc_id, source, site_rank, src_pos, page, reason AS reject_reason FROM audited WHERE reason IS NOT NULL
  UNION ALL
  SELECT doc_id, source, site_rank, src_pos, page, CASE WHEN is_duplicate THEN 'duplicate' END FROM marked)"""


@case("reject_audit", f"WITH {AUDIT_SQL} SELECT doc_id, source, page, reject_reason FROM audit")
def reject_audit(spark, d):
    return audited_listings(spark, d).select("doc_id", "source", "page", "reject_reason")


@case("funnel_counts", f"""WITH {AUDIT_SQL}
SELECT source, page, COALESCE(reject_reason, 'kept') AS outcome, count(*) AS n_rows FROM audit GROUP BY ALL""")
def funnel_counts(spark, d):
    return aggregates.funnel_counts(audited_listings(spark, d), ("source", "page"), "reject_reason")


def canonical_doc_listings(spark, d) -> DataFrame:
    """Documents as canonical listings (the schema every source adapter emits)."""
    l = doc_listings(spark, d)
    low = F.lower("text")
    size = F.size(F.split("text", "\n")).cast(numbers.SIZE_TYPE)
    return l.select(
        "source",
        "site_rank",
        "src_pos",
        F.concat(F.lit("doc:"), F.col("source"), F.lit(":"), F.col("doc_id")).alias("url"),
        "title",
        "address",
        F.col("lang").alias("neighborhood"),
        "price_eur_month",
        size.alias("size_m2"),
        numbers.price_per_m2("price_eur_month", size).alias("price_per_m2"),
        text.classify_by_keywords(low, RULES["type_classifieds"]).alias("listing_type"),
        *[
            (text.yes_if_mentioned(low, KEYWORDS[f]) if f in KEYWORDS else F.lit(None).cast("boolean")).alias(f)
            for f in sinks.FLAG_COLUMNS
        ],
        F.lit(None).cast("string").alias("available_from"),
        compose.run_timestamp(RUN_TS).alias("scraped_on"),
    )


def _present_sql() -> str:
    from ... import constants as K

    def flag(f):
        if f not in KEYWORDS:
            return "CAST(NULL AS VARCHAR)"
        return f"CASE WHEN {contains_any_sql('lower(text)', KEYWORDS[f])} THEN 'Yes' END"

    size = "CAST(len(string_split(text, chr(10))) AS DECIMAL(18,4))"
    exprs = {
        "url": "'doc:' || source || ':' || doc_id",
        "source": "source",
        "title": "title",
        "address": "address",
        "neighborhood": "lang",
        "price_eur_month": "CAST(price_eur_month AS DOUBLE)",
        "size_m2": f"CAST({size} AS DOUBLE)",
        "price_per_m2": ppm_sql("price_eur_month", size),
        "listing_type": _sql_rules("lower(text)", RULES["type_classifieds"]),
        "available_from": "CAST(NULL AS VARCHAR)",
        "scraped_on": q(RUN_TS.strftime("%Y-%m-%d %H:%M")),
    }
    cols = []
    for label, name in K.PRESENT_COLUMNS:
        e = exprs.get(name) or flag(name)
        cols.append(f'{e} AS "{label}"')
    return f"WITH {DOC_SQL} SELECT {', '.join(cols)} FROM doc_listings"


@case("present_listings", _present_sql())
def present_listings(spark, d):
    return sinks.present_listings(canonical_doc_listings(spark, d))


@case("write_summary", f"""WITH {DOC_SQL}, {keyed_sql('doc_listings')},
kept AS (SELECT * FROM marked WHERE NOT is_duplicate)
SELECT -2 AS place, 'run' AS section, 'Scraped on' AS label, {q(RUN_TS.strftime('%Y-%m-%d %H:%M'))} AS value
UNION ALL SELECT -1, 'total', 'Listings found', CAST(count(*) AS VARCHAR) FROM kept
UNION ALL SELECT min(site_rank), 'per_source', source, CAST(count(*) AS VARCHAR) FROM kept GROUP BY source""")
def write_summary(spark, d):
    kept = windows.cross_source_dedup(canonical_doc_listings(spark, d))
    return sinks.summary_rows(kept, RUN_TS)


@case("run_stamped_sink", f"""WITH {DOC_SQL}, {keyed_sql('doc_listings')}
SELECT doc_id, source, {q(RUN_TS.strftime('%Y%m%d_%H%M%S'))} AS run_ts FROM marked WHERE NOT is_duplicate""")
def run_stamped_sink(spark, d):
    from ...session import scratch_dir

    kept = windows.cross_source_dedup(doc_listings(spark, d)).select("doc_id", "source")
    root = scratch_dir(spark, "run_stamped_sink")
    written = sinks.write_run_stamped(kept, root, RUN_TS)
    # the types as written, whatever those of the table's keys are
    schema = T.StructType([*kept.schema, T.StructField("run_ts", T.StringType())])
    if written is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root).select("doc_id", "source", "run_ts")


@case("run_timestamp", f"""SELECT doc_id, {q(RUN_TS.strftime('%Y-%m-%d %H:%M'))} AS scraped_on FROM documents""")
def run_timestamp(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.date_format(compose.run_timestamp(RUN_TS), "yyyy-MM-dd HH:mm").alias("scraped_on"))


@case("yes_no", f"""SELECT doc_id, CASE WHEN {contains_any_sql('lower(text)', KEYWORDS['furnished'])} THEN 'Yes'
WHEN {contains_any_sql('lower(text)', KEYWORDS['elevator'])} THEN NULL ELSE 'No' END AS furnished FROM documents""")
def yes_no(spark, d):
    docs = read(spark, d, "documents")
    low = F.lower("text")
    # A definite flag: yes when mentioned, unknown when only the second list hits, else no.
    cond = F.when(text.contains_any(low, KEYWORDS["furnished"]), True).when(
        text.contains_any(low, KEYWORDS["elevator"]), F.lit(None).cast("boolean")).otherwise(False)
    return docs.select("doc_id", flags.yes_no_text(cond).alias("furnished"))
