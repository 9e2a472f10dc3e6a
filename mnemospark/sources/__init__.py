"""Readers and writers: tables, append-only logs, snapshots, folders of files."""
