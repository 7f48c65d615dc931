"""Readers and writers: file inventories, JSON lines, catalog tables, snapshots."""
