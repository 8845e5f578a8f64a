"""Readers and writers of rankings, labels and corpora."""
