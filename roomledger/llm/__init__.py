"""Operators of a training-data pipeline: WARC derivatives, quality, near
duplicates, fingerprints, rules, mixing, repeated passages, token counts,
packing and chat formatting.  Nothing else in the library imports this.

``queries.QUERIES`` holds one ``opN_<name>`` query per operator.
"""
