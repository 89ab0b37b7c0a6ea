"""Readers and writers of record corpora: XML files, snapshots, ledgers."""
