"""Readers and writers of keyspaces, logs, node reports and change feeds."""
