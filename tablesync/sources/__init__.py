"""Readers and writers: tables, JDBC, staged chunks, ledger, change logs."""
