"""Imports every module that registers queries."""

from . import alignment_queries, analysis_queries, chain_queries, compare_queries, mixture_queries, report_queries, result_queries, site_model_queries, source_queries, validity_queries, window_queries  # noqa: F401
