"""Readers and writers of tables and reports."""
