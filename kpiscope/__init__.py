"""kpiscope — KPI movement analytics as Spark DataFrame jobs.

Layout
------
sources/    table scans with explicit schemas, the canonical star binding,
            incident / corpus / SQL-text inputs, sinks
functions/  Column-level vocabulary: fixed values, rounding, formatting,
            text normalisation, KPI registry
operators/  DataFrame -> DataFrame operators (views, window comparison,
            slice contribution, decision layer, BM25, SQL audit, evaluation,
            calendar, data quality)
plans/      composed end-to-end jobs (batch investigation, evaluation)
streaming/  Structured Streaming form of the daily KPI view
"""

__version__ = "0.1.0"
