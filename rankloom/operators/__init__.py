"""Relational operators of retrieval evaluation: ranking, metrics, protocols, comparison, fusion, judgements."""
