"""Graph-retrieval analytics on PySpark. Public names are imported when they are first used."""

from importlib import import_module

_NAMES = {
    "Engine": "graphloom.engine",
    "build_graph": "graphloom.operators.construct",
    "similar_to": "graphloom.operators.similarity",
    "feature_edges": "graphloom.operators.features",
    "detect_communities": "graphloom.operators.communities",
    "summarize": "graphloom.operators.summaries",
    "embed_summaries": "graphloom.operators.summaries",
    "local_search": "graphloom.operators.retrieve",
    "global_search": "graphloom.operators.retrieve",
    "multi_hop": "graphloom.operators.linking",
}
__all__ = sorted(_NAMES)


def __getattr__(name: str):
    if name in _NAMES:
        return getattr(import_module(_NAMES[name]), name)
    raise AttributeError(f"module 'graphloom' has no attribute '{name}'")
