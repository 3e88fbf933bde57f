"""Record-level cases on the TPC-H-like tables: parts as search ads,
orders/lineitems as API payloads, customers and suppliers as two sources,
nations/regions as areas, conversations as description blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ... import constants as K
from ...functions import compose, numbers, text
from ...operators import aggregates, filters, joins, ordering
from ...sources import payloads, registry
from . import case, read
from .sqlbits import nonempty_sql, ppm_sql, q, strip_sql


def m(c: str, n: int) -> Column:
    return F.col(c) % n


def amount_sql(e: str) -> str:
    raw = f"regexp_extract({e}, {q(K.AMOUNT_PATTERN)}, 0)"
    plain = f"replace(replace({raw}, '.', ''), ',', '.')"
    return f"CAST(round_even(TRY_CAST(nullif({plain}, '') AS DECIMAL(38,6)), 2) AS DECIMAL(18,2))"


# --- C1: Belgian amounts written from order totals ----------------------------

@case("parse_euro_amount", f"""WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
t AS (SELECT o_orderkey, cents // 100 AS euros, lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS frac FROM o),
x AS (SELECT o_orderkey, CASE o_orderkey % 5
  WHEN 0 THEN '€ ' || replace(format('{{:,}}', euros), ',', '.') || ',' || frac
  WHEN 1 THEN CAST(euros AS VARCHAR) || ',' || frac
  WHEN 2 THEN CAST(euros AS VARCHAR) || '.' || frac
  WHEN 3 THEN replace(format('{{:,}}', euros), ',', chr(160)) || ',' || frac
  ELSE 'n/a' END AS text FROM t)
SELECT o_orderkey, text, CAST({amount_sql('text')} AS DOUBLE) AS amount FROM x""")
def parse_euro_amount(spark, d):
    o = read(spark, d, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    euros = F.floor(cents / 100).cast("bigint")
    frac = F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = F.format_number(euros, 0)
    k = m("o_orderkey", 5)
    txt = (F.when(k == 0, F.concat(F.lit("€ "), F.replace(grouped, F.lit(","), F.lit(".")), F.lit(","), frac))
           .when(k == 1, F.concat(euros.cast("string"), F.lit(","), frac))
           .when(k == 2, F.concat(euros.cast("string"), F.lit("."), frac))
           .when(k == 3, F.concat(F.replace(grouped, F.lit(","), F.lit(" ")), F.lit(","), frac))
           .otherwise(F.lit("n/a")))
    x = o.select("o_orderkey", txt.alias("text"))
    return x.select("o_orderkey", "text", numbers.parse_euro_amount("text").cast("double").alias("amount"))


# --- parts as search ads ---------------------------------------------------------

AD_SQL = """ad AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE CAST(p_size AS DOUBLE) END AS net,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size * 1.5 END AS living,
  CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size * 2.0 END AS total,
  CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE p_retailprice END AS rent,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_retailprice + 100 END AS txn_price,
  p_retailprice - 50 AS ad_price,
  CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE replace(p_name, ' ', '_') END AS subtype FROM part)"""


def ads(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    return p.select(
        "*",
        F.when(k % 4 == 1, F.lit(0.0)).when(k % 4 > 1, size.cast("double")).alias("net"),
        F.when(k % 3 != 0, size * 1.5).alias("living"),
        F.when(k % 7 == 0, F.lit(0.0)).otherwise(size * 2.0).alias("total"),
        F.when(k % 5 == 0, F.lit(0.0)).when(k % 5 != 1, price).alias("rent"),
        F.when(k % 6 != 0, price + 100).alias("txn_price"),
        (price - 50).alias("ad_price"),
        F.when(k % 2 != 0, F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("subtype"),
    )


@case("price_per_m2", f"""SELECT p_partkey, {ppm_sql('CAST(p_retailprice AS DECIMAL(18,4))',
                                                     'CAST(CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_size END AS DECIMAL(18,4))')}
AS price_per_m2 FROM part""")
def price_per_m2(spark, d):
    p = read(spark, d, "part")
    size = F.when(m("p_partkey", 9) == 0, F.lit(0)).otherwise(F.col("p_size"))
    return p.select("p_partkey", numbers.price_per_m2("p_retailprice", size).cast("double").alias("price_per_m2"))


MAX_SIZE, MAX_PRICE = 30, 1500


@case("not_both_exceed", f"""WITH {AD_SQL}
SELECT p_partkey FROM ad WHERE NOT (COALESCE(COALESCE(nullif(net, 0), nullif(living, 0), total) > {MAX_SIZE}, false)
  AND COALESCE(COALESCE(nullif(rent, 0), txn_price) > {MAX_PRICE}, false))""")
def not_both_exceed(spark, d):
    a = ads(spark, d)
    size = numbers.first_truthy("net", "living", "total")
    price = numbers.first_truthy("rent", "txn_price")
    return a.where(filters.not_both_exceed(size, price, MAX_SIZE, MAX_PRICE)).select("p_partkey")


@case("first_truthy", f"""WITH {AD_SQL}
SELECT p_partkey, COALESCE(nullif(net, 0), nullif(living, 0), total) AS size_any,
       COALESCE(nullif(rent, 0), txn_price) AS price_any FROM ad""")
def first_truthy(spark, d):
    a = ads(spark, d)
    return a.select("p_partkey", numbers.first_truthy("net", "living", "total").alias("size_any"),
                    numbers.first_truthy("rent", "txn_price").alias("price_any"))


@case("trunc_int", f"""WITH {AD_SQL}
SELECT p_partkey, CAST(trunc(COALESCE(nullif(rent, 0), nullif(txn_price, 0), nullif(ad_price, 0))) AS BIGINT) AS price_int,
       CAST(trunc(COALESCE(nullif(net, 0), nullif(living, 0), nullif(total, 0))) AS BIGINT) AS size_int FROM ad""")
def trunc_int(spark, d):
    a = ads(spark, d)
    return a.select("p_partkey", compose.search_ad_price("rent", "txn_price", "ad_price").alias("price_int"),
                    compose.search_ad_size("net", "living", "total").alias("size_int"))


@case("type_label", f"""WITH {AD_SQL}, s AS (SELECT p_partkey, replace(COALESCE(nullif(subtype, ''), nullif(p_type, '')), '_', ' ') AS t FROM ad)
SELECT p_partkey, upper(substr(t, 1, 1)) || lower(substr(t, 2)) AS listing_type FROM s""")
def type_label(spark, d):
    a = ads(spark, d)
    return a.select("p_partkey", compose.type_label("subtype", "p_type").alias("listing_type"))


def _size_inputs(p: DataFrame) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return p.select(
        "p_partkey",
        F.when(k % 4 == 0, F.lit(0.0)).when(k % 4 > 1, size + 0.5).alias("surface"),
        F.when(k % 3 == 0, F.concat(size.cast("string"), F.lit(" m²")))
        .when(k % 3 == 1, F.concat(F.lit("groot "), size.cast("string"))).alias("attr"),
        F.when(k % 5 == 0, F.concat((size * 2).cast("string"), F.lit("m"))).alias("floor_size"),
        F.concat(F.lit("Mooie kamer van "), (size + 1).cast("string"), F.lit(" M² in "), F.col("p_name")).alias("description"),
    )


@case("size_fallback", f"""WITH s AS (SELECT p_partkey,
  CASE WHEN p_partkey % 4 = 0 THEN 0.0 WHEN p_partkey % 4 > 1 THEN p_size + 0.5 END AS surface,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) || ' m²' WHEN p_partkey % 3 = 1 THEN 'groot ' || CAST(p_size AS VARCHAR) END AS attr,
  CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size * 2 AS VARCHAR) || 'm' END AS floor_size,
  'Mooie kamer van ' || CAST(p_size + 1 AS VARCHAR) || ' M² in ' || p_name AS description FROM part),
f AS (SELECT *, COALESCE(nullif(attr, ''), nullif(floor_size, ''), '') AS floor_text FROM s)
SELECT p_partkey, CAST(nullif(surface, 0) AS DOUBLE) AS size_unit,
  CAST(COALESCE(TRY_CAST(nullif(regexp_extract(floor_text, {q(K.SIZE_ATTR_PATTERN)}, 1), '') AS DECIMAL(18,4)),
                TRY_CAST(nullif(regexp_extract(description, {q('(?i)' + K.SIZE_TEXT_PATTERN)}, 1), '') AS DECIMAL(18,4))) AS DOUBLE) AS size_classifieds,
  CAST(TRY_CAST(nullif(regexp_extract(description, {q('(?i)' + K.SIZE_TEXT_PATTERN)}, 1), '') AS DECIMAL(18,4)) AS DOUBLE) AS size_text
FROM f""")
def size_fallback(spark, d):
    s = _size_inputs(read(spark, d, "part"))
    floor_text = F.coalesce(text.nonempty("attr"), text.nonempty("floor_size"), F.lit(""))
    classifieds = F.coalesce(compose.size_from_attribute(floor_text), compose.size_from_text("description"))
    return s.select(
        "p_partkey",
        F.nullif(F.col("surface"), F.lit(0.0)).cast("double").alias("size_unit"),
        classifieds.cast("double").alias("size_classifieds"),
        compose.size_from_text("description").cast("double").alias("size_text"),
    )


def _unit_type_sql(e: str) -> str:
    return "CASE " + e + " " + " ".join(f"WHEN {c} THEN {q(v)}" for c, v in K.UNIT_TYPES.items()) + " END"


TITLE_SQL = f"""t AS (SELECT p_partkey, {_unit_type_sql('p_partkey % 6')} AS utype,
  nullif(concat_ws(', ', {nonempty_sql(strip_sql("COALESCE(p_brand, '') || ' ' || COALESCE(CAST(p_size AS VARCHAR), '')"))},
                   nullif(p_type, '')), '') AS address,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_partkey % 10 AS VARCHAR) END AS unit_no,
  CASE WHEN p_partkey % 3 = 0 THEN p_name END AS prop_title, CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS ad_title FROM part)"""


def _title_inputs(p: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return p.select(
        "p_partkey",
        joins.enum_lookup(k % 6).alias("utype"),
        compose.compose_address("p_brand", "p_size", "p_type").alias("address"),
        F.when(k % 4 != 0, (k % 10).cast("string")).alias("unit_no"),
        F.when(k % 3 == 0, F.col("p_name")).alias("prop_title"),
        F.when(k % 5 == 0, F.col("p_brand")).alias("ad_title"),
    )


@case("compose_title", f"""WITH {TITLE_SQL},
b AS (SELECT *, COALESCE(nullif(concat_ws(' ', nullif(utype, ''), nullif(address, '')), ''), '') AS base FROM t)
SELECT p_partkey, nullif(CASE WHEN nullif(unit_no, '') IS NOT NULL THEN base || ' (unit ' || unit_no || ')' ELSE base END, '') AS title_unit,
  COALESCE(nullif(prop_title, ''), nullif(ad_title, ''), nullif(concat_ws(' — ', nullif(utype, ''), nullif(address, '')), '')) AS title_search
FROM b""")
def compose_title(spark, d):
    t = _title_inputs(read(spark, d, "part"))
    return t.select(
        "p_partkey",
        compose.unit_title("utype", "address", "unit_no").alias("title_unit"),
        compose.ad_title("prop_title", "ad_title", "utype", "address").alias("title_search"),
    )


@case("listing_url_build", f"""WITH u AS (SELECT p_partkey,
  CASE WHEN p_partkey % 7 = 0 THEN 'https://ads.example/' || p_partkey END AS url,
  CASE WHEN p_partkey % 5 = 0 THEN 'https://ads.example/p/' || p_partkey END AS permalink,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE upper(p_type) || '_HOUSE' END AS ptype,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS locality,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 3000 + p_size END AS postcode,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'g-' || p_partkey END AS guid FROM part)
SELECT p_partkey,
  COALESCE(nullif(url, ''), nullif(permalink, ''),
    {q(K.SEARCH_URL_TEMPLATE.split('{type}')[0])} || replace(lower(COALESCE(nullif(ptype, ''), {q(K.SEARCH_URL_DEFAULTS['type'])})), '_', '-')
    || '/for-rent/' || replace(lower(COALESCE(nullif(locality, ''), {q(K.SEARCH_URL_DEFAULTS['locality'])})), ' ', '-')
    || '/' || COALESCE(nullif(CAST(postcode AS VARCHAR), ''), {q(K.SEARCH_URL_DEFAULTS['postcode'])}) || '/' || CAST(p_partkey AS VARCHAR)) AS url_search,
  CASE WHEN nullif(guid, '') IS NOT NULL THEN {q(K.UNIT_SITE + K.UNIT_LISTING_PATH)} || guid ELSE {q(K.UNIT_SITE)} END AS url_unit
FROM u""")
def listing_url_build(spark, d):
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    u = p.select(
        "p_partkey",
        F.when(k % 7 == 0, F.concat(F.lit("https://ads.example/"), k.cast("string"))).alias("url"),
        F.when(k % 5 == 0, F.concat(F.lit("https://ads.example/p/"), k.cast("string"))).alias("permalink"),
        F.when(k % 3 != 0, F.concat(F.upper("p_type"), F.lit("_HOUSE"))).alias("ptype"),
        F.when(k % 4 != 0, F.col("p_name")).alias("locality"),
        F.when(k % 6 != 0, F.col("p_size") + 3000).alias("postcode"),
        F.when(k % 4 != 0, F.concat(F.lit("g-"), k.cast("string"))).alias("guid"),
    )
    return u.select(
        "p_partkey",
        compose.search_listing_url("url", "permalink", "ptype", "locality", "postcode", "p_partkey").alias("url_search"),
        compose.unit_listing_url("guid").alias("url_unit"),
    )


# --- P17: available-from on order dates ------------------------------------------

@case("available_from", f"""WITH a AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS avail_from,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') END AS item_from,
  CASE o_orderkey % 3 WHEN 0 THEN 'Beschikbaar vanaf: ' || strftime(o_orderdate, '%d/%m/%Y')
    WHEN 1 THEN 'Nu beschikbaar per ' || strftime(o_orderdate, '%B %Y') || ' voor studenten' ELSE 'Kamer vrij' END AS description
  FROM orders)
SELECT o_orderkey, nullif(substr(COALESCE(nullif(avail_from, ''), nullif(item_from, '')), 1, 10), '') AS avail_unit,
  nullif({strip_sql(f"regexp_extract(description, {q('(?i)' + K.AVAILABLE_CLASSIFIEDS_PATTERN)}, 1)")}, '') AS avail_classifieds,
  nullif({strip_sql(f"regexp_extract(description, {q('(?i)' + K.AVAILABLE_RENTALS_PATTERN)}, 1)")}, '') AS avail_rentals,
  nullif({strip_sql(f"regexp_extract(description, {q('(?i)' + K.AVAILABLE_JSPAGES_PATTERN)}, 1)")}, '') AS avail_js_pages
FROM a""")
def available_from(spark, d):
    o = read(spark, d, "orders")
    k, od = F.col("o_orderkey"), F.col("o_orderdate")
    a = o.select(
        "o_orderkey",
        F.when(k % 3 != 0, F.date_format(od, "yyyy-MM-dd HH:mm:ss")).alias("avail_from"),
        F.when(k % 2 == 0, F.date_format(F.date_add(od, 1), "yyyy-MM-dd")).alias("item_from"),
        F.when(k % 3 == 0, F.concat(F.lit("Beschikbaar vanaf: "), F.date_format(od, "dd/MM/yyyy")))
        .when(k % 3 == 1, F.concat(F.lit("Nu beschikbaar per "), F.date_format(od, "MMMM yyyy"), F.lit(" voor studenten")))
        .otherwise(F.lit("Kamer vrij")).alias("description"),
    )
    return a.select(
        "o_orderkey",
        compose.date_prefix("avail_from", "item_from").alias("avail_unit"),
        compose.available_from_text("description", K.AVAILABLE_CLASSIFIEDS_PATTERN).alias("avail_classifieds"),
        compose.available_from_text("description", K.AVAILABLE_RENTALS_PATTERN).alias("avail_rentals"),
        compose.available_from_text("description", K.AVAILABLE_JSPAGES_PATTERN).alias("avail_js_pages"),
    )


# --- C18: conversation turns as description blocks ----------------------------------

@case("concat_descriptions", """SELECT conv_id, turn, lower(regexp_replace(COALESCE(array_to_string(list_transform(
  string_split(text, chr(10)), lambda l: COALESCE(l, '') || ' ' || COALESCE(role, '')), ''), ''), '<[^>]+>', ' ', 'g'))
  AS description FROM conversations""")
def concat_descriptions(spark, d):
    c = read(spark, d, "conversations")
    # Each turn is one detail document; its description blocks are the turn's lines.
    blocks = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("property"), F.col("role").alias("unit")))
    return c.select("conv_id", "turn", compose.description_text(blocks).alias("description"))


# --- two sources into one schema (U1, P12, P13, X1) ------------------------------------

def customer_source(spark: SparkSession, d: str) -> DataFrame:
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    k = F.col("c_custkey")
    street = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    number = F.when(k % 3 != 0, k.cast("string"))
    return j.select(
        F.lit(K.SOURCES[0]).alias("source"), F.lit(1).alias("site_rank"), k.alias("src_pos"),
        compose.compose_address(street, number, "n_name").alias("address"),
        text.nonempty("n_name").alias("neighborhood"),
    )


def supplier_source(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = read(spark, d, "supplier"), read(spark, d, "nation"), read(spark, d, "region")
    j = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    k = F.col("s_suppkey")
    number = F.when(k % 4 != 0, k.cast("string"))
    postcode = F.when(F.col("s_nationkey") != 0, F.col("s_nationkey").cast("string")).otherwise(F.lit(""))
    district = F.when(k % 2 == 0, F.col("r_name"))
    return j.select(
        F.lit(K.SOURCES[3]).alias("source"), F.lit(4).alias("site_rank"), k.alias("src_pos"),
        compose.compose_address("s_name", number, "n_name", postcode).alias("address"),
        compose.neighborhood_first(district, "n_name").alias("neighborhood"),
    )


UNION_SQL = f"""cs AS (SELECT {q(K.SOURCES[0])} AS source, 1 AS site_rank, c_custkey AS src_pos,
  nullif(concat_ws(', ', {nonempty_sql(strip_sql("COALESCE(nullif(c_mktsegment, 'BUILDING'), '') || ' ' || COALESCE(CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey AS VARCHAR) END, '')"))},
                   nullif(COALESCE(n_name, ''), '')), '') AS address,
  nullif(n_name, '') AS neighborhood
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
ss AS (SELECT {q(K.SOURCES[3])} AS source, 4 AS site_rank, s_suppkey AS src_pos,
  nullif(concat_ws(', ', {nonempty_sql(strip_sql("COALESCE(s_name, '') || ' ' || COALESCE(CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey AS VARCHAR) END, '')"))},
                   {nonempty_sql(strip_sql("CASE WHEN s_nationkey <> 0 THEN CAST(s_nationkey AS VARCHAR) ELSE '' END || ' ' || COALESCE(n_name, '')"))}), '') AS address,
  COALESCE(nullif(CASE WHEN s_suppkey % 2 = 0 THEN r_name END, ''), nullif(n_name, '')) AS neighborhood
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
u AS (SELECT * FROM cs UNION ALL SELECT * FROM ss)"""


@case("union_sources", f"WITH {UNION_SQL} SELECT source, site_rank, src_pos, address, neighborhood FROM u")
def union_sources(spark, d):
    return ordering.union_sources([customer_source(spark, d), supplier_source(spark, d)],
                                  ["source", "site_rank", "src_pos", "address", "neighborhood"])


@case("compose_address", f"WITH {UNION_SQL} SELECT source, src_pos, address FROM u")
def compose_address(spark, d):
    return union_sources(spark, d).select("source", "src_pos", "address")


@case("neighborhood_fallback", f"""WITH {UNION_SQL}, p AS (SELECT *, string_split(replace(address, chr(10), ','), ',') AS parts FROM u)
SELECT source, src_pos, neighborhood,
  CASE WHEN len(parts) >= 2 THEN nullif({strip_sql('parts[len(parts)]')}, '') END AS neighborhood_from_address FROM p""")
def neighborhood_fallback(spark, d):
    u = union_sources(spark, d)
    return u.select("source", "src_pos", "neighborhood", compose.last_address_part("address").alias("neighborhood_from_address"))


@case("source_registry", f"WITH {UNION_SQL} SELECT source, site_rank, src_pos, address, neighborhood FROM u")
def source_registry(spark, d):
    reg = registry.SourceRegistry()
    reg.register(K.SOURCES[0], lambda sp, root: customer_source(sp, root))
    reg.register(K.SOURCES[3], lambda sp, root: supplier_source(sp, root))
    # A source whose landed folder is missing fails at plan time and is skipped.
    reg.register(K.SOURCES[4], lambda sp, root: read(sp, root, "no_such_landed_table"))
    frames = reg.build_all(spark, d)
    return ordering.union_sources(frames.values(), ["source", "site_rank", "src_pos", "address", "neighborhood"])


# --- F6: areas ---------------------------------------------------------------------

AREA_CODES, AREA_NAMES = ["3", "7", "11", "19", "24"], ["europe", "asia"]


@case("area_code_filter", f"""SELECT n_nationkey, n_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
WHERE COALESCE(CAST(n_nationkey AS VARCHAR), '') IN ({', '.join(q(c) for c in AREA_CODES)})
   OR lower(COALESCE(r_name, '')) IN ({', '.join(q(c) for c in AREA_NAMES)})""")
def area_code_filter(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey, "left")
    return j.where(filters.area_code_match("n_nationkey", "r_name", AREA_CODES, AREA_NAMES)).select("n_nationkey", "n_name")


# --- A3 / F10: year options ----------------------------------------------------------

@case("latest_year_option", """WITH o AS (SELECT o_orderkey AS id, o_orderkey AS pos,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'n/a' ELSE CAST(year(o_orderdate) AS VARCHAR) || ' - ' || CAST(year(o_orderdate) + 1 AS VARCHAR) END AS label
  FROM orders), y AS (SELECT *, TRY_CAST(nullif(regexp_extract(label, '\\d{4}', 0), '') AS INTEGER) AS year FROM o)
SELECT id, label, year FROM y WHERE year IS NOT NULL QUALIFY row_number() OVER (ORDER BY year DESC, pos ASC) = 1""")
def latest_year_option(spark, d):
    o = read(spark, d, "orders")
    yr = F.year("o_orderdate")
    label = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("n/a")).otherwise(
        F.concat(yr.cast("string"), F.lit(" - "), (yr + 1).cast("string")))
    options = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"), label.alias("label"))
    return aggregates.latest_year_option(options)


def _year_options(spark, d) -> DataFrame:
    o = read(spark, d, "orders")
    yr = F.year("o_orderdate")
    first = o.groupBy(yr.alias("y")).agg(F.min("o_orderkey").alias("pos"))
    return first.select((F.col("y") - 1990).alias("id"), "pos",
                        F.concat(F.col("y").cast("string"), F.lit(" - "), (F.col("y") + 1).cast("string")).alias("label"))


@case("academic_year_filter", """WITH opts AS (SELECT year(o_orderdate) - 1990 AS id, min(o_orderkey) AS pos,
  year(o_orderdate) AS year FROM orders GROUP BY year(o_orderdate)),
pick AS (SELECT id FROM opts QUALIFY row_number() OVER (ORDER BY year DESC, pos ASC) = 1)
SELECT l_orderkey, l_linenumber FROM lineitem WHERE year(l_shipdate) - 1990 = (SELECT id FROM pick)""")
def academic_year_filter(spark, d):
    items = read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.year("l_shipdate") - 1990).alias("availability_id"))
    picked = aggregates.latest_year_option(_year_options(spark, d))
    return filters.academic_year_filter(items, picked).select("l_orderkey", "l_linenumber")


# --- S1, S2, J1, F11: orders/lineitems as landed API payloads ------------------------

def search_bodies(spark: SparkSession, d: str) -> DataFrame:
    """One landed search body per lineitem row, built from that row alone.

    The shape depends on the row: no ``data`` (return flag R), null items
    (A), else 1-3 items by line number -- an item with a null id, a null
    item, and an item whose id has no detail document occur.
    """
    li = read(spark, d, "lineitem")
    n = F.col("l_linenumber")
    ident = F.col("l_orderkey") * 10 + n

    def item(id_col):
        return F.struct(
            id_col.cast("bigint").alias("id"),
            (F.col("l_linestatus") == "O").alias("hasPrivateBathroom"),
            (F.col("l_discount") > 0.05).alias("hasPrivateKitchen"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("availableFrom"),
        )

    null_item = F.lit(None).cast(payloads.SEARCH_ITEM)
    items = (F.when(n % 4 == 0, F.array(item(ident), null_item, item(F.lit(None))))
             .when(n % 4 == 1, F.array(item(ident)))
             .when(n % 4 == 2, F.array(item(ident), item(ident + 100000000)))
             .otherwise(F.array().cast(T.ArrayType(payloads.SEARCH_ITEM))))
    data = F.struct(items.alias("items"), F.size(items).cast("bigint").alias("totalCount"))
    body = (F.when(F.col("l_returnflag") == "R", F.lit('{"error": "unavailable"}'))
            .when(F.col("l_returnflag") == "A", F.lit('{"data": {"items": null, "totalCount": 0}}'))
            .otherwise(F.to_json(F.struct(data.alias("data")))))
    return li.select(F.col("l_orderkey").alias("page"), n.alias("slot"), body.alias("body"))


SEARCH_ITEMS_SQL = """b AS (SELECT l_orderkey AS page, l_linenumber AS slot, l_returnflag,
  l_orderkey * 10 + l_linenumber AS ident, l_linestatus = 'O' AS bath, l_discount > 0.05 AS kitchen,
  strftime(l_shipdate, '%Y-%m-%d') AS avail FROM lineitem),
lists AS (SELECT page, slot, l_returnflag, CASE l_linenumber_mod
  WHEN 0 THEN [{'id': ident, 'b': bath, 'k': kitchen, 'a': avail}, NULL, {'id': NULL::BIGINT, 'b': bath, 'k': kitchen, 'a': avail}]
  WHEN 1 THEN [{'id': ident, 'b': bath, 'k': kitchen, 'a': avail}]
  WHEN 2 THEN [{'id': ident, 'b': bath, 'k': kitchen, 'a': avail}, {'id': ident + 100000000, 'b': bath, 'k': kitchen, 'a': avail}]
  ELSE [] END AS items FROM (SELECT *, slot % 4 AS l_linenumber_mod FROM b)),
items AS (SELECT page, slot, CAST(i AS INTEGER) AS pos, CAST(len(items) AS BIGINT) AS total_count,
  items[i + 1].id AS id, items[i + 1].b AS hasPrivateBathroom, items[i + 1].k AS hasPrivateKitchen,
  items[i + 1].a AS availableFrom
  FROM (SELECT *, unnest(range(len(items))) AS i FROM lists WHERE l_returnflag NOT IN ('R', 'A'))
  WHERE items[i + 1] IS NOT NULL)"""


@case("read_search_items", f"""WITH {SEARCH_ITEMS_SQL} SELECT * FROM items""")
def read_search_items(spark, d):
    return payloads.read_search_items(search_bodies(spark, d), "body", ("page", "slot"))


@case("drop_missing_id", f"""WITH {SEARCH_ITEMS_SQL} SELECT page, slot, pos, id FROM items WHERE id IS NOT NULL""")
def drop_missing_id(spark, d):
    items = payloads.read_search_items(search_bodies(spark, d), "body", ("page", "slot"))
    return filters.drop_missing_id(items).select("page", "slot", "pos", "id")


def detail_bodies(spark: SparkSession, d: str) -> DataFrame:
    """One landed detail body per lineitem; a fifth have no data, a fifth
    an empty object, a fifth null data."""
    li = read(spark, d, "lineitem")
    n = F.col("l_linenumber")
    ident = F.col("l_orderkey") * 10 + n
    data = F.struct(
        F.concat(F.lit("g-"), ident.cast("string")).alias("guid"),
        n.alias("unitType"),
        F.col("l_quantity").alias("surfaceAreaFrom"),
        F.struct(F.struct((F.col("l_extendedprice") / 100).alias("from")).alias("totalMonthlyRent")).alias("pricing"),
    )
    body = (F.when(n % 5 == 0, F.lit("{}")).when(n % 5 == 1, F.lit('{"data": {}}'))
            .when(n % 5 == 2, F.lit('{"data": null}')).otherwise(F.to_json(F.struct(data.alias("data")))))
    return li.select(ident.alias("id"), body.alias("body"))


DETAILS_SQL = """details AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'g-' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS guid,
  l_linenumber AS unit_type, l_quantity AS surface, l_extendedprice / 100 AS price_from
  FROM lineitem WHERE l_linenumber % 5 NOT IN (0, 1, 2))"""


@case("read_detail_docs", f"WITH {DETAILS_SQL} SELECT * FROM details")
def read_detail_docs(spark, d):
    docs = payloads.read_detail_docs(detail_bodies(spark, d), "body", ("id",))
    return docs.select("id", F.col("detail.guid").alias("guid"), F.col("detail.unitType").alias("unit_type"),
                       F.col("detail.surfaceAreaFrom").alias("surface"),
                       F.col("detail.pricing.totalMonthlyRent.from").alias("price_from"))


@case("item_detail_join", f"""WITH {SEARCH_ITEMS_SQL}, {DETAILS_SQL}
SELECT i.page, i.slot, i.pos, i.id, d.guid, d.price_from FROM items i JOIN (
  SELECT id, guid, price_from FROM details QUALIFY row_number() OVER (PARTITION BY id ORDER BY price_from, surface) = 1) d ON i.id = d.id""")
def item_detail_join(spark, d):
    items = filters.drop_missing_id(payloads.read_search_items(search_bodies(spark, d), "body", ("page", "slot")))
    details = payloads.read_detail_docs(detail_bodies(spark, d), "body", ("id",))
    # Ids were landed more than once: the cheapest, then smallest, counts as the first.
    details = details.unionByName(details.where(F.col("id") % 7 == 0)).withColumns(
        {"landed": F.col("detail.pricing.totalMonthlyRent.from"), "landed_size": F.col("detail.surfaceAreaFrom")})
    j = joins.item_detail_join(items, details, "id", order=("landed", "landed_size"))
    return j.select("page", "slot", "pos", "id", F.col("detail.guid").alias("guid"),
                    F.col("detail.pricing.totalMonthlyRent.from").alias("price_from"))
