"""roomledger: rental-listing extraction, cleaning and deduplication on Spark.

Landed web pages and JSON payloads from several listing sources become
one typed listings table, a per-source summary and an audit of rejected
rows.  Everything is expressed as DataFrame operators.
"""

import sys as _sys

__version__ = "0.1.0"

# The few Python steps (training-data operators) run in executor Python workers.  Shipping this package's functions by value
# means workers need no installed copy of it.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - an older cloudpickle pickles by reference
    pass
