"""Sinks: blocks of documents as office packages and printable pages."""
