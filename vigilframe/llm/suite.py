"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

AREAS = ("sharding", "pii", "decontaminate", "language_id", "simhash", "toxicity", "warc", "nearest", "bpe", "language_model",
         "fill_middle", "prefix_trie", "embedding_dedup")


def load():
    """Import every operator once and return (queries, SQL twins)."""
    for area in AREAS:
        import_module(f"vigilframe.llm.{area}")
    from vigilframe.llm.common import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
