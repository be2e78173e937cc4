"""All registered queries of the engine proper."""

from . import coverage_queries, document_queries, experiment_queries, gate_queries, ledger_queries, ledger_state_queries, report_queries, rtl_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
