"""Payload cases on ``events``: each event becomes a landed document whose
shape depends on its type, built from its ``props`` JSON (``{"k": n}``),
value, user and time.  Codes are derived from ``k`` so every fallback
branch occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ... import constants as K
from ...functions import compose, flags, numbers, payload
from ...operators import filters, joins, windows
from . import case, read
from .sqlbits import q

EV_SQL = """
ev AS (SELECT event_id, ts, user_id, event_type, value, props,
              CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""


def ev(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select("*", F.get_json_object("props", "$.k").cast("int").alias("k"))


def s(x) -> Column:
    """Text of a column for concatenation."""
    return F.col(x).cast("string") if isinstance(x, str) else x.cast("string")


# --- search-result pages (S4, S5) --------------------------------------------

def search_html(e: DataFrame) -> DataFrame:
    props, k, t = F.col("props"), s("k"), F.col("event_type")
    html = (
        F.when(t == "click", F.concat(F.lit('<html><body><pre>{"results": ['), props, F.lit('], "totalItems": '), k,
                                      F.lit("}</pre></body></html>")))
        .when(t == "view", F.concat(F.lit('<pre>not json</pre><script id="__NEXT_DATA__" type="application/json">'
                                          '{"props":{"pageProps":{"classifiedList":['), props, F.lit("]}}}</script>")))
        .when(t == "purchase", F.concat(F.lit('<script id="__NEXT_DATA__">{"props":{"pageProps":{"classifiedList":'
                                              '{"x":1},"results":['), props, F.lit(","), props, F.lit("]}}}</script>")))
        .when(t == "signup", F.concat(F.lit('<pre>{"results": [], "classifiedList": ['), props, F.lit("]}</pre>")))
        .otherwise(F.concat(F.lit("<p>"), props, F.lit("</p>")))
    )
    return e.select("event_id", html.alias("html"))


SEARCH_HTML_SQL = EV_SQL + """,
sp AS (SELECT event_id, CASE event_type
  WHEN 'click' THEN '<html><body><pre>{"results": [' || props || '], "totalItems": ' || k || '}</pre></body></html>'
  WHEN 'view' THEN '<pre>not json</pre><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"classifiedList":[' || props || ']}}}</script>'
  WHEN 'purchase' THEN '<script id="__NEXT_DATA__">{"props":{"pageProps":{"classifiedList":{"x":1},"results":[' || props || ',' || props || ']}}}</script>'
  WHEN 'signup' THEN '<pre>{"results": [], "classifiedList": [' || props || ']}</pre>'
  ELSE '<p>' || props || '</p>' END AS html FROM ev),
pre AS (SELECT event_id, html, CASE WHEN json_valid(b) THEN b::JSON END AS pre
        FROM (SELECT event_id, html, regexp_extract(html, '(?is)<pre[^>]*>(.*?)</pre>', 1) AS b FROM sp))"""


@case("json_in_pre", f"""WITH {SEARCH_HTML_SQL}
SELECT event_id, pre IS NOT NULL AS pre_found, CAST(json_extract(pre, '$.totalItems') AS BIGINT) AS total_items FROM pre""")
def json_in_pre(spark, d):
    h = search_html(ev(spark, d))
    pre = payload.json_in_pre("html")
    return h.select("event_id", pre.isNotNull().alias("pre_found"),
                    F.try_variant_get(pre, "$.totalItems", "bigint").alias("total_items"))


def _list_at(v: str, path: str) -> str:
    return f"CASE WHEN try(json_type({v}, '{path}')) = 'ARRAY' THEN json_extract({v}, '{path}') END"


@case("json_next_data_fallback", f"""WITH {SEARCH_HTML_SQL},
nd AS (SELECT event_id, pre, CASE WHEN json_valid(b) THEN b::JSON END AS nxt
       FROM (SELECT event_id, pre, regexp_extract(html, '(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1) AS b FROM pre)),
lists AS (SELECT event_id, pre,
  COALESCE({_list_at('nxt', '$.props.pageProps.classifiedList')}, {_list_at('nxt', '$.props.pageProps.results')}) AS fb,
  {_list_at('pre', '$.results')} AS res, {_list_at('pre', '$.classifiedList')} AS cl FROM nd),
ads AS (SELECT event_id, pre IS NOT NULL OR fb IS NOT NULL AS found,
  CASE WHEN json_extract(pre, '$.totalItems') IS NULL THEN 0 WHEN json_type(pre, '$.totalItems') = 'NULL' THEN NULL
       ELSE TRY_CAST(json_extract(pre, '$.totalItems') AS BIGINT) END AS total_items,
  CASE WHEN pre IS NOT NULL THEN COALESCE(CASE WHEN json_array_length(res) > 0 THEN res END,
                                          CASE WHEN json_array_length(cl) > 0 THEN cl END, '[]'::JSON)
       ELSE COALESCE(CASE WHEN json_array_length(fb) > 0 THEN fb END, '[]'::JSON) END AS ads FROM lists)
SELECT event_id, found, total_items, CAST(json_array_length(ads) AS INTEGER) AS n_ads,
       CAST(json_extract(ads, '$[0].k') AS INTEGER) AS first_k FROM ads""")
def json_next_data_fallback(spark, d):
    h = search_html(ev(spark, d))
    sp = payload.search_payload("html")
    return h.select(
        "event_id",
        sp["found"].alias("found"),
        sp["total_items"].alias("total_items"),
        F.size(sp["ads"]).alias("n_ads"),
        F.try_variant_get(F.try_element_at(sp["ads"], F.lit(1)), "$.k", "int").alias("first_k"),
    )


# --- JSON-LD blocks (S6) and inline values (S7) -------------------------------

def ld_html(e: DataFrame) -> DataFrame:
    k, t = F.col("k"), F.col("event_type")
    open_s, open_a, close = (F.lit('<script type="application/ld+json">'),
                             F.lit('<script type="application/ld+json" data-x="1">'), F.lit("</script>"))
    b1 = F.when(k % 3 == 0, F.lit("{bad")).otherwise(F.concat(F.lit('{"@type":"Thing","k":'), s(k), F.lit("}")))
    b2 = F.concat(F.lit('[{"@type":"Room","k":'), s(k + 1), F.lit('},{"offers":{"price":'), s(k),
                  F.lit('},"k":'), s(k + 2), F.lit("}]"))
    offers = F.when(t == "view", F.lit("")).otherwise(
        F.concat(F.lit('"offers":'), F.when(k % 2 == 0, F.lit("null")).otherwise(F.lit("{}")), F.lit(",")))
    b3 = F.concat(F.lit("{"), offers, F.lit('"address":"'), t, F.lit('","k":'), s(k + 3), F.lit("}"))
    b4 = F.concat(F.lit('{"offers":{"p":1},"k":'), s(k + 4), F.lit("}"))
    html = F.concat(open_s, b1, close,
                    F.when(t == "error", F.lit("")).otherwise(F.concat(open_s, b2, close)),
                    open_s, b3, close, open_a, b4, close)
    return e.select("event_id", html.alias("html"))


LD_SQL = EV_SQL + """,
ld AS (SELECT event_id,
  '<script type="application/ld+json">' || CASE WHEN k % 3 = 0 THEN '{bad' ELSE '{"@type":"Thing","k":' || k || '}' END || '</script>'
  || CASE WHEN event_type = 'error' THEN '' ELSE '<script type="application/ld+json">' || '[{"@type":"Room","k":' || (k + 1)
     || '},{"offers":{"price":' || k || '},"k":' || (k + 2) || '}]' || '</script>' END
  || '<script type="application/ld+json">' || '{' || CASE WHEN event_type = 'view' THEN '' ELSE '"offers":'
     || CASE WHEN k % 2 = 0 THEN 'null' ELSE '{}' END || ',' END || '"address":"' || event_type || '","k":' || (k + 3) || '}' || '</script>'
  || '<script type="application/ld+json" data-x="1">' || '{"offers":{"p":1},"k":' || (k + 4) || '}' || '</script>' AS html
  FROM ev),
blocks AS (SELECT event_id,
  list_transform(regexp_extract_all(html, '(?s)<script type="application/ld\\+json">(.*?)</script>', 1),
                 lambda b: CASE WHEN json_valid(b) THEN b::JSON END) AS strict_blocks,
  list_transform(regexp_extract_all(html, '(?s)<script type="application/ld\\+json"[^>]*>(.*?)</script>', 1),
                 lambda b: CASE WHEN json_valid(b) THEN b::JSON END) AS attr_blocks FROM ld)"""

FLAT = "flatten(list_transform({src}, lambda v: CASE WHEN json_type(v) = 'ARRAY' THEN CAST(json_extract(v, '$[*]') AS JSON[]) ELSE [v] END))"
TRUTHY = ("CASE WHEN {x} IS NULL THEN false ELSE CASE json_type({x}) WHEN 'NULL' THEN false "
          "WHEN 'BOOLEAN' THEN CAST({x} AS BOOLEAN) WHEN 'VARCHAR' THEN json_extract_string({x}, '$') <> '' "
          "WHEN 'ARRAY' THEN json_array_length({x}) > 0 WHEN 'OBJECT' THEN len(json_keys({x})) > 0 "
          "ELSE CAST({x} AS DOUBLE) <> 0 END END")
_types = ", ".join(q(t) for t in K.JSONLD_TYPES)


@case("jsonld_first_match", f"""WITH {LD_SQL}
SELECT event_id,
  CAST(json_extract(list_filter(strict_blocks, lambda v: json_type(v) = 'OBJECT' AND json_exists(v, '$.offers'))[1], '$.k') AS INTEGER) AS k_offer_block,
  CAST(json_extract(list_filter({FLAT.format(src='strict_blocks')}, lambda v: json_type(v) = 'OBJECT'
       AND json_extract_string(v, '$."@type"') IN ({_types}))[1], '$.k') AS INTEGER) AS k_typed_block,
  CAST(json_extract(list_filter({FLAT.format(src='attr_blocks')}, lambda v: json_type(v) = 'OBJECT'
       AND ({TRUTHY.format(x="json_extract(v, '$.offers')")} OR {TRUTHY.format(x="json_extract(v, '$.address')")}))[1], '$.k') AS INTEGER) AS k_truthy_block
FROM blocks""")
def jsonld_first_match(spark, d):
    h = ld_html(ev(spark, d)).select("event_id", payload.parsed_blocks(payload.script_blocks("html")).alias("parsed"))
    blocks = {"html": F.lit(None), "parsed": F.col("parsed")}
    return h.select(
        "event_id",
        F.try_variant_get(payload.ld_offer_block(**blocks), "$.k", "int").alias("k_offer_block"),
        F.try_variant_get(payload.ld_typed_block(**blocks), "$.k", "int").alias("k_typed_block"),
        F.try_variant_get(payload.ld_offer_or_address_block(**blocks), "$.k", "int").alias("k_truthy_block"),
    )


@case("embedded_value_regex", f"""WITH {EV_SQL},
h AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '<script></script>' ELSE
  '<script>window.cfg={{"cityName":"' || event_type || '","priceCents": ' || (k * 100 + 7) || '}};</script>' END AS html FROM ev)
SELECT event_id, nullif(regexp_extract(html, '"cityName":"([^"]+)"', 1), '') AS city,
       CAST(nullif(regexp_extract(html, '"priceCents":\\s*(\\d+)', 1), '') AS BIGINT) AS price_cents FROM h""")
def embedded_value_regex(spark, d):
    e = ev(spark, d)
    html = F.when(F.col("event_type") == "error", F.lit("<script></script>")).otherwise(
        F.concat(F.lit('<script>window.cfg={"cityName":"'), F.col("event_type"), F.lit('","priceCents": '),
                 s(F.col("k") * 100 + 7), F.lit("};</script>")))
    h = e.select("event_id", html.alias("html"))
    return h.select("event_id", payload.embedded_string("html", "cityName").alias("city"),
                    payload.embedded_integer("html", "priceCents").alias("price_cents"))


# --- structured codes and flags (J4, C5-C9, C13, C14, F4) ----------------------

@case("enum_lookup", f"""WITH {EV_SQL}
SELECT event_id, k % 7 AS code, CASE k % 7 {' '.join(f"WHEN {c} THEN {q(v)}" for c, v in K.UNIT_TYPES.items())} END AS listing_type FROM ev""")
def enum_lookup(spark, d):
    e = ev(spark, d)
    code = F.col("k") % 7
    return e.select("event_id", code.alias("code"), joins.enum_lookup(code).alias("listing_type"))


def _code(spark, d):
    e = ev(spark, d)
    return e.select("*", F.when(F.col("k") % 8 != 7, F.col("k") % 8).alias("code"))


@case("cost_covered", f"""WITH {EV_SQL}, c AS (SELECT *, CASE WHEN k % 8 <> 7 THEN k % 8 END AS code FROM ev)
SELECT event_id, code, code IN (1, 2, 3) AS covered FROM c""")
def cost_covered(spark, d):
    return _code(spark, d).select("event_id", "code", flags.cost_covered("code").alias("covered"))


UTIL_SQL = """CASE WHEN k % 5 = 0 THEN NULL ELSE k % 7 END AS water,
CASE WHEN k % 3 = 0 THEN NULL ELSE (k // 3) % 6 END AS electricity,
CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 5 END AS heating"""


def _util(e: DataFrame) -> DataFrame:
    k, u = F.col("k"), F.col("user_id")
    return e.select(
        "*",
        F.when(k % 5 != 0, k % 7).alias("water"),
        F.when(k % 3 != 0, F.floor(k / 3).cast("int") % 6).alias("electricity"),
        F.when(u % 4 != 0, u % 5).alias("heating"),
    )


@case("all_costs_covered", f"""WITH {EV_SQL}, u AS (SELECT *, {UTIL_SQL} FROM ev),
kn AS (SELECT event_id, list_filter([water, electricity, heating], lambda x: x IS NOT NULL) AS known FROM u)
SELECT event_id, CASE WHEN len(known) > 0 THEN len(list_filter(known, lambda x: x NOT IN (1, 2, 3))) = 0 END
       AS utilities_included FROM kn""")
def all_costs_covered(spark, d):
    u = _util(ev(spark, d))
    return u.select("event_id", flags.all_costs_covered("water", "electricity", "heating").alias("utilities_included"))


OPT_SQL = """CASE WHEN event_type = 'error' THEN NULL ELSE [CAST(k % 13 AS INTEGER), CAST((k + user_id) % 13 AS INTEGER)] END AS options,
CASE WHEN k % 4 = 0 THEN k % 7 END AS inet_cost,
CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS item_bath,
CASE WHEN user_id % 2 = 0 THEN true END AS item_kitchen"""


def _opts(e: DataFrame) -> DataFrame:
    k, u = F.col("k"), F.col("user_id")
    return e.select(
        "*",
        F.when(F.col("event_type") != "error", F.array((k % 13).cast("int"), ((k + u) % 13).cast("int"))).alias("options"),
        F.when(k % 4 == 0, k % 7).alias("inet_cost"),
        F.when(u % 3 == 0, F.lit(True)).when(u % 3 == 2, F.lit(False)).alias("item_bath"),
        F.when(u % 2 == 0, F.lit(True)).alias("item_kitchen"),
    )


@case("internet_flag", f"""WITH {EV_SQL}, o AS (SELECT *, {OPT_SQL} FROM ev)
SELECT event_id, CASE WHEN inet_cost IS NOT NULL THEN inet_cost IN (1, 2, 3)
  WHEN list_has_any(COALESCE(options, []::INTEGER[]), [10, 11]) THEN true END AS internet_included FROM o""")
def internet_flag(spark, d):
    o = _opts(ev(spark, d))
    return o.select("event_id", flags.internet_flag("inet_cost", "options").alias("internet_included"))


@case("facility_flags", f"""WITH {EV_SQL}, o AS (SELECT *, {OPT_SQL} FROM ev)
SELECT event_id, COALESCE(list_contains(options, 12), false) AS furnished,
  COALESCE(list_contains(options, 5), false) OR COALESCE(item_bath, false) AS private_bathroom,
  COALESCE(list_contains(options, 6), false) OR COALESCE(item_kitchen, false) AS private_kitchen FROM o""")
def facility_flags(spark, d):
    o = _opts(ev(spark, d))
    return o.select(
        "event_id",
        flags.facility_flag("options", K.OPT_FURNISHED).alias("furnished"),
        flags.facility_flag("options", K.OPT_PRIVATE_BATHROOM, "item_bath").alias("private_bathroom"),
        flags.facility_flag("options", K.OPT_PRIVATE_KITCHEN, "item_kitchen").alias("private_kitchen"),
    )


@case("count_positive", f"""WITH {EV_SQL}
SELECT event_id, CASE WHEN k % 6 = 0 THEN NULL ELSE k % 3 END > 0 AS shared_bathroom,
       CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 2 END > 0 AS shared_kitchen FROM ev""")
def count_positive(spark, d):
    e = ev(spark, d)
    k, u = F.col("k"), F.col("user_id")
    return e.select("event_id", flags.count_positive(F.when(k % 6 != 0, k % 3)).alias("shared_bathroom"),
                    flags.count_positive(F.when(u % 5 != 0, u % 2)).alias("shared_kitchen"))


@case("furnished_coalesce", f"""WITH {EV_SQL}
SELECT event_id, COALESCE(CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END,
                          CASE WHEN user_id % 2 = 0 THEN true END) AS furnished FROM ev""")
def furnished_coalesce(spark, d):
    e = ev(spark, d)
    k, u = F.col("k"), F.col("user_id")
    furnished = F.when(k % 3 == 1, F.lit(False)).when(k % 3 == 2, F.lit(True))
    is_furnished = F.when(u % 2 == 0, F.lit(True))
    return e.select("event_id", flags.furnished_coalesce(furnished, is_furnished).alias("furnished"))


@case("bath_kitchen_flags", f"""WITH {EV_SQL},
b AS (SELECT *, CASE WHEN k % 4 = 0 THEN 0 WHEN k % 4 = 1 THEN NULL ELSE k % 3 END AS bathrooms,
             CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 2 END AS showers,
             CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN NULL ELSE event_type END AS kitchen_type FROM ev)
SELECT event_id, COALESCE(nullif(bathrooms, 0), showers) > 0 AS private_bathroom,
       CASE WHEN COALESCE(kitchen_type, '') <> '' THEN true END AS private_kitchen FROM b""")
def bath_kitchen_flags(spark, d):
    e = ev(spark, d)
    k, u = F.col("k"), F.col("user_id")
    bathrooms = F.when(k % 4 == 0, F.lit(0)).when(k % 4 != 1, k % 3)
    showers = F.when(u % 3 != 0, u % 2)
    kitchen = F.when(k % 5 == 0, F.lit("")).when(k % 5 != 1, F.col("event_type"))
    return e.select("event_id", flags.bath_flag(bathrooms, showers).alias("private_bathroom"),
                    flags.kitchen_flag(kitchen).alias("private_kitchen"))


@case("sold_flags", f"""WITH {EV_SQL}
SELECT event_id FROM ev WHERE NOT COALESCE(CASE k % 4 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END, false)
  AND NOT COALESCE(user_id % 5 = 0, false)""")
def sold_flags(spark, d):
    e = ev(spark, d)
    k, u = F.col("k"), F.col("user_id")
    sold = F.when(k % 4 == 0, F.lit(True)).when(k % 4 != 1, F.lit(False))
    return e.where(filters.not_sold(sold, u % 5 == 0)).select("event_id")


@case("offer_out_of_stock", f"""WITH {EV_SQL},
o AS (SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN '{{"offers": [{{"availability": "OutOfStock"}}]}}'
  ELSE '{{"offers": {{"availability": "https://schema.org/' || CASE WHEN k % 3 = 0 THEN 'OutOfStock' ELSE 'InStock' END || '"}}}}' END AS JSON) AS ld FROM ev),
f AS (SELECT event_id, json_extract(ld, '$.offers') AS offers FROM o)
SELECT event_id, COALESCE(contains(json_extract_string(offers, '$.availability'), 'OutOfStock'), false) AS out_of_stock,
  NOT COALESCE(contains(json_extract_string(offers, '$.availability'), 'OutOfStock'), false)
  AND (json_type(offers) = 'OBJECT' OR NOT ({TRUTHY.format(x='offers')})) AS kept FROM f""")
def offer_out_of_stock(spark, d):
    e = ev(spark, d)
    ld = F.when(F.col("event_type") == "error", F.lit('{"offers": [{"availability": "OutOfStock"}]}')).otherwise(
        F.concat(F.lit('{"offers": {"availability": "https://schema.org/'),
                 F.when(F.col("k") % 3 == 0, F.lit("OutOfStock")).otherwise(F.lit("InStock")), F.lit('"}}')))
    offers = F.try_variant_get(F.try_parse_json(ld), "$.offers", "variant")
    availability = F.try_variant_get(offers, "$.availability", "string")
    oos = filters.out_of_stock(availability)
    return e.select("event_id", oos.alias("out_of_stock"), (~oos & filters.offer_usable(offers)).alias("kept"))


# --- prices (C10, P15) --------------------------------------------------------

@case("range_from", f"""WITH {EV_SQL}
SELECT event_id, CAST(COALESCE(CASE WHEN event_type NOT IN ('view', 'signup') THEN CAST(value AS DECIMAL(18,4)) END,
                               CAST(value * 2 AS DECIMAL(18,4))) AS DOUBLE) AS price FROM ev""")
def range_from(spark, d):
    e = ev(spark, d)
    t = F.col("event_type")
    total = F.when(t != "signup", F.struct(F.when(t != "view", F.col("value")).alias("from"), F.lit(None).cast("double").alias("to")))
    monthly = F.struct((F.col("value") * 2).alias("from"), F.lit(None).cast("double").alias("to"))
    price = F.coalesce(numbers.range_from(total), numbers.range_from(monthly))
    return e.select("event_id", price.cast("double").alias("price"))


PRICE_SQL = """CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '"€ ' || k || '.250,50"' ELSE CAST(value AS VARCHAR) END AS offer_price,
CASE WHEN user_id % 3 = 0 THEN NULL ELSE k * 100 + 50 END AS price_cents,
CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE value END AS rent,
CASE WHEN k % 5 = 0 THEN NULL ELSE value + 1 END AS txn_price,
CASE WHEN k % 7 = 0 THEN 0 ELSE value + 2 END AS ad_price"""


def _amount_sql(e: str) -> str:
    raw = f"regexp_extract({e}, {q(K.AMOUNT_PATTERN)}, 0)"
    plain = f"replace(replace({raw}, '.', ''), ',', '.')"
    return f"CAST(round_even(TRY_CAST(nullif({plain}, '') AS DECIMAL(38,6)), 2) AS DECIMAL(18,2))"


@case("price_fallback", f"""WITH {EV_SQL}, p AS (SELECT *, {PRICE_SQL} FROM ev),
j AS (SELECT *, CASE WHEN offer_price IS NULL THEN NULL ELSE CAST(offer_price AS JSON) END AS pj FROM p),
t AS (SELECT *, CASE WHEN {TRUTHY.format(x='pj')} THEN json_extract_string(pj, '$') END AS price_text FROM j)
SELECT event_id,
  CAST(COALESCE(CAST({_amount_sql("COALESCE(price_text, '')")} AS DECIMAL(18,4)),
                CAST(CAST(price_cents AS DECIMAL(38,0)) / 100 AS DECIMAL(18,4))) AS DOUBLE) AS price_classifieds,
  CAST(trunc(COALESCE(nullif(rent, 0), nullif(txn_price, 0), nullif(ad_price, 0))) AS BIGINT) AS price_search FROM t""")
def price_fallback(spark, d):
    e = ev(spark, d)
    k, u, v = F.col("k"), F.col("user_id"), F.col("value")
    offer_price = (F.when(k % 4 == 1, F.lit("0")).when(k % 4 == 2, F.concat(F.lit('"€ '), s(k), F.lit('.250,50"')))
                   .when(k % 4 == 3, s(v)))
    price_cents = F.when(u % 3 != 0, k * 100 + 50)
    parsed = numbers.parse_euro_amount(F.coalesce(payload.value_text(F.try_parse_json(offer_price)), F.lit("")))
    classifieds = F.coalesce(parsed.cast(numbers.PRICE_TYPE), compose.price_from_cents(price_cents))
    rent = F.when(k % 3 == 0, F.lit(0.0)).when(k % 3 == 2, v)
    txn = F.when(k % 5 != 0, v + 1)
    ad = F.when(k % 7 == 0, F.lit(0.0)).otherwise(v + 2)
    return e.select("event_id", classifieds.cast("double").alias("price_classifieds"),
                    compose.search_ad_price(rent, txn, ad).alias("price_search"))


# --- candidates and page cut-offs (W3, W5, W6) --------------------------------

CANDIDATES = ["refund", "signup", "purchase", "view", "click", "error"]
RESULT_VALUE = 200.0


@case("first_nonempty_candidate", f"""WITH c AS (
  SELECT CAST(ts AS DATE) AS day, event_type, list_position({list(CANDIDATES)!r}, event_type) AS cand_rank,
         CAST(count_if(value > {RESULT_VALUE}) AS BIGINT) AS n_results FROM events GROUP BY ALL),
w AS (SELECT day, min(cand_rank) AS winning_rank FROM c WHERE n_results > 0 GROUP BY day)
SELECT c.day, c.event_type, c.n_results FROM c JOIN w ON c.day = w.day AND c.cand_rank = w.winning_rank""")
def first_nonempty_candidate(spark, d):
    e = read(spark, d, "events")
    rank = F.array_position(F.array(*[F.lit(c) for c in CANDIDATES]), F.col("event_type")).cast("int")
    counts = e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count_if(F.col("value") > RESULT_VALUE).alias("n_results")).withColumn("cand_rank", rank)
    winners = windows.first_nonempty_candidate(counts, ["day"], "cand_rank", "n_results")
    winners = winners.withColumnRenamed("winning_rank", "cand_rank")
    return counts.join(winners, on=["day", "cand_rank"], how="inner").select("day", "event_type", "n_results")


HIT_VALUE, FAIL_VALUE, PAGE_SIZE_W6, ITEM_VALUE = 60.0, 300.0, 25, 50.0
ORIGIN = "2024-01-01 00:00:00"


def _hour_page(ts: Column) -> Column:
    return (F.timestamp_diff("HOUR", F.lit(ORIGIN).cast("timestamp_ntz"), ts) + 1).cast("int")


# The reading of each search, page by page: a failed page stops it at once,
# the third empty page in a row stops it there.
READING_SQL = f"""log AS (SELECT event_type, page, count_if(value > {HIT_VALUE}) AS n_results, max(value) > {FAIL_VALUE} AS failed
        FROM e GROUP BY event_type, page),
reading AS (
  SELECT event_type, 1 AS page, 0 AS empties, NOT (n_results > 0 AND NOT failed) AS stopped FROM log WHERE page = 1
  UNION ALL
  SELECT r.event_type, r.page + 1, CASE WHEN COALESCE(l.n_results, 0) > 0 THEN 0 ELSE r.empties + 1 END,
         COALESCE(l.failed, false) OR (COALESCE(l.n_results, 0) = 0 AND r.empties + 1 = {K.SEARCH_EMPTY_STREAK})
  FROM reading r LEFT JOIN log l ON l.event_type = r.event_type AND l.page = r.page + 1
  WHERE NOT r.stopped),
cut AS (SELECT event_type, CAST(min(page) AS INTEGER) AS cutoff_page FROM reading WHERE stopped GROUP BY event_type)"""


@case("empty_run_cutoff", f"""WITH RECURSIVE e AS (
  SELECT event_id, event_type, value, CAST(date_diff('hour', TIMESTAMP '{ORIGIN}', ts) + 1 AS INTEGER) AS page FROM events),
{READING_SQL}
SELECT e.event_id, e.event_type, e.page, cut.cutoff_page FROM e JOIN cut ON e.event_type = cut.event_type
WHERE e.page < cut.cutoff_page AND e.value > {HIT_VALUE}""")
def empty_run_cutoff(spark, d):
    e = read(spark, d, "events").select("event_id", "event_type", "value", _hour_page(F.col("ts")).alias("page"))
    log = e.groupBy("event_type", "page").agg(
        F.count_if(F.col("value") > HIT_VALUE).alias("n_results"),
        (F.max("value") > FAIL_VALUE).alias("failed"),
        F.lit(None).cast("bigint").alias("total_items"),
    )
    cut = windows.empty_run_cutoff(log, ["event_type"])
    hits = e.where(F.col("value") > HIT_VALUE)
    return hits.join(cut, "event_type").where(F.col("page") < F.col("cutoff_page")).select(
        "event_id", "event_type", "page", "cutoff_page")


@case("page_prefix", f"""WITH e AS (SELECT event_id, event_type, value, CAST(day(ts) AS INTEGER) AS page FROM events),
log AS (SELECT event_type, page, count_if(value > {ITEM_VALUE}) AS n_items FROM e GROUP BY ALL),
missing AS (SELECT event_type, page + 1 AS p FROM log l WHERE NOT EXISTS (
  SELECT 1 FROM log m WHERE m.event_type = l.event_type AND m.page = l.page + 1)),
flagged AS (SELECT event_type, page AS p FROM log WHERE n_items = 0),
bf AS (SELECT event_type, min(p) AS before_p FROM (SELECT * FROM missing UNION ALL SELECT * FROM flagged) GROUP BY event_type),
st AS (SELECT event_type, min(page) AS first_p, min(CASE WHEN n_items < {PAGE_SIZE_W6} THEN page END) AS after_p FROM log GROUP BY event_type),
lastp AS (SELECT st.event_type, least(CASE WHEN first_p > 1 THEN 1 ELSE before_p END - 1,
                                      COALESCE(after_p, CASE WHEN first_p > 1 THEN 1 ELSE before_p END - 1)) AS last_page
          FROM st LEFT JOIN bf ON st.event_type = bf.event_type)
SELECT e.event_id, e.event_type, e.page FROM e JOIN lastp ON e.event_type = lastp.event_type
WHERE e.page <= lastp.last_page AND e.value > {ITEM_VALUE}""")
def page_prefix(spark, d):
    e = read(spark, d, "events").select("event_id", "event_type", "value", F.dayofmonth("ts").alias("page"))
    log = e.groupBy("event_type", "page").agg(F.count_if(F.col("value") > ITEM_VALUE).alias("n_items"))
    log = log.select("*", (F.col("n_items") == 0).alias("stop_before"), (F.col("n_items") < PAGE_SIZE_W6).alias("stop_after"))
    last = windows.page_prefix(log, ["event_type"])
    items = e.where(F.col("value") > ITEM_VALUE)
    return items.join(last, "event_type").where(F.col("page") <= F.col("last_page")).select("event_id", "event_type", "page")
