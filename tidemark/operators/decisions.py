"""Audit records: what the model suggested beside what the risk layer allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import money

#: The model's suggestion and the risk verdict are separate columns on purpose:
#: folding them into one decision would hide where the two disagree.
DECISION_SCHEMA = (
    "timestamp timestamp, run_id string, symbol string, venue string, regime string, "
    "strategy string, signal string, llm_decision string, confidence decimal(5,4), "
    f"entry {money.PRICE}, stop {money.PRICE}, target {money.PRICE}, size {money.QUANTITY}, "
    f"expected_edge_bps {money.BPS}, expected_costs_bps {money.BPS}, "
    f"net_expected_edge_bps {money.BPS}, risk_verdict string, risk_reason string, outcome string"
)


def contingency(decisions: DataFrame) -> DataFrame:
    """How often each suggestion met each risk verdict; no suggestion is its own row."""
    return decisions.groupBy("llm_decision", "risk_verdict").agg(F.count("*").alias("decisions"))
