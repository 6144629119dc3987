"""Operators for training-data corpora: one module per operator, thin ``opN_`` queries over the given tables."""

from importlib import import_module

from sightlog.llm.common import ORACLES, QUERIES

MODULES = [
    "quality", "url_filter", "simhash", "vector_graph", "byte_bpe", "extract", "packing", "repeats", "pii", "risk_rules",
    "toxicity", "infill", "prefix_trie",
]


def _load() -> None:
    for name in MODULES:
        import_module(f"sightlog.llm.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return dict(ORACLES)
