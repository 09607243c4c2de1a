"""carelens: inpatient discharge analytics expressed as Spark DataFrame plans.

Layers (each a set of plain ``DataFrame -> DataFrame`` functions):

* ``sources``    delimited discharge files, the fact table, summary sinks, test fixtures
* ``functions``  column-level helpers (text/number normalisation, exact rounding, formats)
* ``operators``  cleaning, quality counters, incremental load, summaries, serving queries,
                 chart re-aggregations and report fact packs
* ``plans``      job entry points (ingest -> summarise -> serve) and the query catalogue
* ``streaming``  the same ingest driven by a Structured Streaming file source
"""

__version__ = "0.1.0"
