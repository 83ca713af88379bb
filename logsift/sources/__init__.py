"""Readers, parsers and template miners of logs."""
