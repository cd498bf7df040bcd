"""Streaming forms of the ledger's operators."""
