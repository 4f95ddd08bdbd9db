"""Operators of a training-data pipeline: filtering, extraction, deduplication,
decontamination, packing and search over document-sized tables.

Nothing outside this folder imports it. Every operator selects the columns it
needs from its input first, so extra columns (whatever their names) pass by.
"""
