"""Operators over models and data: scoring, lineage, inventories, validation, parity, time intelligence."""
