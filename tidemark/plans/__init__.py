"""Whole queries: from bars, metadata and snapshots to universe tables."""
