"""Readers of tables, raw records and extracted documents."""
