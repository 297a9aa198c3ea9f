"""cohortlens: clinical-note cohort and text analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    readers/writers and the fixture views derived from the shared tables
functions  Column -> Column building blocks (text, time, math)
operators  DataFrame -> DataFrame operators (cohort, outcome, text, vocab, split,
           graph, metrics, reports, relational primitives)
plans      the registered queries (Spark DataFrame + oracle SQL per id)
streaming  incremental (file-stream) drivers that reuse the batch operators
"""

__version__ = "0.1.0"
