"""Fiscal inventory and tax-ledger analytics as Spark plans."""
