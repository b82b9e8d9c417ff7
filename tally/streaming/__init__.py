"""Structured Streaming versions of the additive reports."""

from tally.streaming.incremental import additive_reports, distinct_reports, finish, latest, read_line_stream, start_reports

__all__ = ["additive_reports", "distinct_reports", "finish", "latest", "read_line_stream", "start_reports"]
