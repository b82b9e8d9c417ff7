"""Readers (CSV, Parquet), the sales-line adapter and result writers."""
