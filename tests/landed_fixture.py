"""A small hand-made landed folder covering the five sources' rules.

Hand-written payloads, because the driver tables cannot express Dutch
listing text, JSON-LD offers or the sources' page layouts.
"""

from __future__ import annotations

import json

from roomledger import constants as K
from roomledger.sources.adapters.common import API_SCHEMA, PAGES_SCHEMA

UNIT, CLASSIFIEDS, RENTALS, SEARCH, JS = K.SOURCES[0], K.SOURCES[1], K.SOURCES[2], K.SOURCES[3], K.SOURCES[4]


def _api_rows():
    options = {"data": {"availabilityOptions": [{"id": 6, "label": "2025 - 2026"}, {"id": 7, "label": "2026 - 2027"},
                                                {"id": 9, "label": "later"}]}}
    page1 = {"data": {"items": [
        {"id": 101, "hasPrivateBathroom": True, "hasPrivateKitchen": False, "availableFrom": "2026-08-15T00:00:00"},
        {"id": None},
        {"id": 102},
    ], "totalCount": 3}}
    page2 = {"data": {"items": [{"id": 103}], "totalCount": 3}}
    other_year = {"data": {"items": [{"id": 104}], "totalCount": 1}}
    d101 = {"data": {
        "guid": "g-101", "unitType": 1, "unitNumber": "2B", "surfaceAreaFrom": 16.0,
        "location": {"street": "Naamsestraat", "number": "10", "city": "Leuven"},
        "pricing": {"totalMonthlyRent": {"from": 1250, "to": None}, "monthlyRent": {"from": 1100},
                    "internet": None, "water": 1, "electricity": None, "heating": 5},
        "facilities": {"options": [10, 12], "commonBathrooms": 0, "commonKitchens": 2},
        "availability": {"from": None},
        "descriptions": {"items": [{"property": "<p>Gebouw met lift.</p>", "unit": "Kamer met <b>wasmachine</b>"}]},
    }}
    d103 = {"data": {"guid": "g-103", "unitType": 2}}
    return [
        ("filter_options", None, None, None, json.dumps(options)),
        ("search", 1, 7, None, json.dumps(page1)),
        ("search", 2, 7, None, json.dumps(page2)),
        ("search", 1, 6, None, json.dumps(other_year)),
        ("detail", None, None, 101, json.dumps(d101)),
        ("detail", None, None, 102, json.dumps({"data": {}})),
        ("detail", None, None, 103, json.dumps(d103)),
    ]


def _ld(obj, attrs=""):
    return f'<script type="application/ld+json"{attrs}>{json.dumps(obj)}</script>'


def _page_rows():
    rows = []
    b = K.CLASSIFIEDS_BASE
    rows += [
        (CLASSIFIEDS, "search", None, 1, f"{b}/q/kot+leuven/",
         '<a href="/v/immo/kamers-te-huur/m1-ad1">a</a><a href="/v/immo/gezocht/m2">b</a>'
         '<a href="/v/immo/kamers-te-huur/m1-ad1">a again</a><a href="/v/immo/studentenkamers-te-huur/m3">c</a>'
         f'<a href="{b}/v/immo/kamers-te-huur/abs">abs</a><a href="/q/kot+leuven/p/2/">next</a>', 200),
        (CLASSIFIEDS, "search", None, 2, f"{b}/q/kot+leuven/p/2/", '<a href="/v/immo/kamers-te-huur/m4">d</a>', 200),
        (CLASSIFIEDS, "search", None, 3, f"{b}/q/kot+leuven/p/3/", '<a href="/v/immo/kamers-te-huur/m5">e</a>', 200),
        (CLASSIFIEDS, "detail", None, None, f"{b}/v/immo/kamers-te-huur/m1-ad1",
         "<html><body><h1>ignored</h1>" + _ld({"name": "Kot centrum", "description":
             "Gemeubeld kot, eigen badkamer. Beschikbaar vanaf 01/09/2026", "offers":
             {"price": "450", "availability": "https://schema.org/InStock"}})
         + '<script>var c={"cityName":"Leuven"};</script>'
         '<ul><li class="Attributes-module-item"><span class="Attributes-module-label">Woonoppervlakte</span>'
         '<span class="Attributes-module-value">20 m²</span></li></ul></body></html>', 200),
        (CLASSIFIEDS, "detail", None, None, f"{b}/v/immo/studentenkamers-te-huur/m3",
         _ld({"name": "Kamer", "offers": {"price": "400", "availability": "OutOfStock"}}), 200),
        (CLASSIFIEDS, "detail", None, None, f"{b}/v/immo/kamers-te-huur/m4",
         '<h1>Studio Brussel</h1><script>var c={"cityName":"Brussel","priceCents": 70000};</script>', 200),
    ]
    r = K.RENTALS_BASE
    rows += [
        (RENTALS, "search", 1, 1, f"{r}/s1", "<html>gone</html>", 404),
        (RENTALS, "search", 2, 1, f"{r}/s2",
         '<nav><a href="/verhuurder/huurwoning/abonnementen">Voor verhuurders</a></nav>'
         '<article class="listing-card"><a href="/huurwoning/abc-1">Kamer</a> Mooi</article>'
         '<article class="listing"><a href="/huurwoning/xyz-2">Studio</a> Verhuurd</article>'
         '<a href="/s2?page=2">Volgende</a>', 200),
        (RENTALS, "search", 2, 2, f"{r}/s2?page=2",
         '<article class="card"><a href="/huurwoning/abc-1">Kamer</a></article>'
         '<article class="card"><a href="/huurwoning/new-3">Studio</a></article>', 200),
        (RENTALS, "detail", None, None, f"{r}/huurwoning/abc-1",
         '<html><nav>Voor verhuurders</nav><main><h1>Kamer te huur</h1>'
         + _ld({"@type": "Apartment", "address": {"streetAddress": "Naamsestraat 10", "addressLocality": "Leuven"},
                "offers": {"price": "1.250"}})
         + '<p>Kamer in Leuven van 25 m² met wasmachine, gedeelde keuken.</p></main></html>', 200),
        (RENTALS, "detail", None, None, f"{r}/huurwoning/new-3",
         '<html><main><h1>Studio</h1><div class="address">Tiensestraat 5, Leuven</div>'
         '<span class="price">€ 650,50 per maand</span><p>Studio 3000 Leuven, beschikbaar vanaf 01-10-2026.</p>'
         '</main></html>', 200),
    ]

    def pre(obj):
        return f"<html><body><pre>{json.dumps(obj)}</pre></body></html>"

    def ad(i, pc, loc, price, size, **kw):
        a = {"id": i, "property": {"type": "APARTMENT", "subtype": "STUDENT_ROOM", "netHabitableSurface": size,
                                   "location": {"street": "Bondgenotenlaan", "number": str(i), "postalCode": pc,
                                                "locality": loc}, "bathroomCount": 0, "showerRoomCount": 1,
                                   "kitchen": {"type": "INSTALLED"}},
             "transaction": {"rental": {"monthlyRentalPrice": price}, "availabilityDate": "2026-09-01T00:00:00"}}
        a.update(kw)
        return a

    rows += [
        (SEARCH, "search", 1, 1, "s1p1", pre({"totalItems": 1, "results": [ad(1, "1000", "Brussel", 500, 20)]}), 200),
        (SEARCH, "search", 2, 1, "s2p1", pre({"totalItems": 95, "results": [
            ad(11, "3000", "Leuven", 700.5, 20.9),
            ad(12, "9999", "Heverlee", 600, 18, flags={"isRented": True}),
            ad(13, "3001", "Heverlee", 2000, 150),
        ]}), 200),
        (SEARCH, "search", 2, 2, "s2p2", pre({"results": []}), 200),
        (SEARCH, "search", 2, 3, "s2p3", pre({"results": []}), 200),
        (SEARCH, "search", 2, 4, "s2p4", pre({"results": []}), 200),
        (SEARCH, "search", 2, 5, "s2p5", pre({"results": [ad(15, "3000", "Leuven", 800, 30)]}), 200),
    ]
    z = K.JSPAGES_BASE
    rows += [
        (JS, "search", 1, 1, "z1", '<a href="/nl/leuven/te-huur/kamer/AB12CD/?x=1">k</a><a href="/nl/about">x</a>', 200),
        (JS, "detail", None, None, f"{z}/nl/leuven/te-huur/kamer/AB12CD/",
         "<main><h1>Studentenkamer</h1><p>Kamer nu VERHUURD</p></main>", 200),
        (JS, "search", 2, 1, "z2", '<a href="/nl/leuven-3000/te-huur/studio/K2QJW/">s</a>', 200),
        (JS, "detail", None, None, f"{z}/nl/leuven-3000/te-huur/studio/K2QJW/",
         "<html>" + _ld({"address": {"streetAddress": "Bondgenotenlaan 1", "addressLocality": "Leuven"},
                         "offers": {"price": 550}}, ' data-n="1"')
         + "<main><h1>Studio</h1><p>Studio 30 m2, beschikbaar vanaf 01-10-2026, met lift.</p></main></html>", 200),
        (JS, "search", 3, 1, "z3", '<a href="/nl/gent/te-huur/studio/ZZ99/">s</a>', 200),
    ]
    return rows


def write_landed(spark, root: str) -> str:
    return write_rows(spark, root, _api_rows(), _page_rows())


def write_rows(spark, root: str, api, pages) -> str:
    """Rows in the order in which they were landed."""
    def numbered(rows):
        return [(*r, k) for k, r in enumerate(rows)]

    spark.createDataFrame(numbered(api), API_SCHEMA).write.mode("overwrite").parquet(f"{root}/api")
    (spark.createDataFrame(numbered(pages), PAGES_SCHEMA).write.mode("overwrite")
     .partitionBy("source", "kind").parquet(f"{root}/pages"))
    return root


def write_landed_edges(spark, root: str) -> str:
    """Edge cases: a full unit-API page (so page 2 is read), the __NEXT_DATA__
    fallback and its 2-page cap, an empty price element, a zero JSON-LD price."""
    options = {"data": {"availabilityOptions": [{"id": 1, "label": "2030 - 2031"}]}}
    full = {"data": {"items": [{"id": i} for i in range(1, K.UNIT_PAGE_SIZE + 1)], "totalCount": 101}}
    api = [
        ("filter_options", None, None, None, json.dumps(options)),
        ("search", 1, 1, None, json.dumps(full)),
        ("search", 2, 1, None, json.dumps({"data": {"items": [{"id": 200}], "totalCount": 101}})),
        ("detail", None, None, 1, json.dumps({"data": {"guid": "a", "unitType": 3}})),
        ("detail", None, None, 200, json.dumps({"data": {"guid": "b", "unitType": 2}})),
    ]

    def next_data(ads):
        body = json.dumps({"props": {"pageProps": {"results": ads}}})
        return f'<script id="__NEXT_DATA__" type="application/json">{body}</script>'

    def ad(i):
        return {"id": i, "property": {"location": {"postalCode": "3000", "locality": "Leuven"}},
                "transaction": {"rental": {"monthlyRentalPrice": 500 + i}}}

    z, r = K.JSPAGES_BASE, K.RENTALS_BASE
    pages = [
        (SEARCH, "search", 1, 1, "n1", next_data([ad(1)]), 200),
        (SEARCH, "search", 1, 2, "n2", next_data([ad(2)]), 200),
        (SEARCH, "search", 1, 3, "n3", next_data([ad(3)]), 200),
        (RENTALS, "search", 1, 1, "r1", '<article class="card"><a href="/huurwoning/p-1">x</a></article>', 200),
        (RENTALS, "detail", None, None, f"{r}/huurwoning/p-1",
         '<main><h1>Kamer</h1><span class="prijs">Prijs op aanvraag</span><p>Leuven, € 500 per maand</p></main>', 200),
        (JS, "search", 1, 1, "z", '<a href="/nl/leuven/te-huur/kamer/ZZ11/">k</a>', 200),
        (JS, "detail", None, None, f"{z}/nl/leuven/te-huur/kamer/ZZ11/",
         _ld({"offers": {"price": 0}, "address": {"addressLocality": "Leuven"}})
         + "<main><h1>Kamer</h1><p>Huur € 425 per maand</p></main>", 200),
    ]
    return write_rows(spark, root, api, pages)
