"""The commands as named tools with JSON in and out, for a tool server to expose.

Eight tools and two resources; an error is a payload and never an exception.
"""

from __future__ import annotations

import argparse
import json
import traceback

from stemma import cli
from stemma.schema import LABELS

DEFAULTS = {"pattern": None, "db": None, "direction": "upstream", "depth": 3, "limit": 10, "below": 0.5, "cypher": None, "hotspots": False, "unhealthy": False, "stats": False}


def _stored(spark, path: str):
    from stemma.plans.store import GraphStore

    return GraphStore.opened(spark, path)


def _query(spark, a) -> object:
    return _stored(spark, a.db).query(a.cypher, getattr(a, "parameters", None) or {})


def _hotspots(spark, a) -> object:
    return cli.rows(_stored(spark, a.db).hotspots(a.limit))


def _unhealthy(spark, a) -> object:
    return cli.rows(_stored(spark, a.db).unhealthy(a.below))


TOOLS = {
    "analyze": cli._analyze,
    "health": cli._health,
    "index": cli._index,
    "query": _query,
    "impact": cli._impact_graph,
    "communities": cli._communities,
    "hotspots": _hotspots,
    "unhealthy": _unhealthy,
}


def call(name: str, arguments: dict, spark=None) -> str:
    """The JSON result of a tool, or ``error`` and ``traceback``."""
    try:
        run = TOOLS[name]
        return json.dumps(run(spark or cli.session(), argparse.Namespace(**{**DEFAULTS, **arguments})), default=str)
    except Exception as e:  # the caller gets any failure as a payload
        return json.dumps({"error": f"{type(e).__name__}: {e}", "traceback": traceback.format_exc()})


def resource(name: str, db: str, spark=None) -> str:
    """``status`` (what a store holds) or ``schema`` (its labels and their columns)."""
    from stemma.plans.store import EDGE_SCHEMA, STORED

    if name == "schema":
        return json.dumps({"labels": LABELS, "node_columns": dict(STORED), "relation_columns": {f.name: f.dataType.simpleString() for f in EDGE_SCHEMA}})
    store = _stored(spark or cli.session(), db)
    return json.dumps({"db": db, "nodes": store.count_nodes(), "relations": store.relation_count(), "labels": {r["label"]: r["n"] for r in store.label_counts().collect()}})
