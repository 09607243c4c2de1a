"""Operators for preparing language-model training data.

One module per operator, each a set of ``DataFrame -> DataFrame`` functions, plus:

* ``shared``    column picking, lineage cuts, shipping the package to executors, word helpers
* ``links``     connected components of a link table
* ``tokens``    memoised sub-word encoding and range-ordered token tables
* ``queries``   the registered ``opN_*`` queries and the SQL to check them with

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
