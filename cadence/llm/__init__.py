"""Operators of a training-data pipeline: dedup, PII, LM scoring, packing, BPE.

Each module holds one operator with a general interface; ``queries.py`` holds
the thin ``opN_<name>`` queries. Nothing outside this folder imports it.
"""
