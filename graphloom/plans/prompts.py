"""Prompts for an external model. Lists and texts are cut to fixed limits, so what is collected is small."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schema import Graph

MOST_TYPES, MOST_NAMES = 15, 50
LIMITS = {"analyze": 6000, "extract": 8000, "memory": 6000}
REPLY = '{"entities": [{"name": "", "type": "", "definition": "", "aliases": [], "confidence": 0.0, "evidence_text": ""}], "relations": [{"source": "", "target": "", "type": "", "confidence": 0.0, "evidence_text": ""}]}'


def cut(text: str, most: int) -> str:
    """At most so many bytes, of whole characters."""
    return text.encode()[:most].decode("utf-8", "ignore")


def _known(graph: Graph, most: int = MOST_NAMES) -> tuple[str, str]:
    types = [r[0] for r in graph.nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node_type").limit(MOST_TYPES).collect()]
    names = [r[0] for r in graph.nodes.orderBy(F.desc("created_at"), "seq").limit(most).select("name").collect()]
    return ", ".join(types), ", ".join(names)


def _ontology(graph: Graph | None) -> str:
    """The types that a graph allows, with what joins what; an ontology is small."""
    if graph is None or graph.node_types is None:
        return ""
    lines = [f"- {r['name']} ({r['description']})" for r in graph.node_types.orderBy("seq", "name").collect()]
    if not lines:
        return ""
    for r in graph.edge_types.orderBy("seq", "name").collect() if graph.edge_types is not None else []:
        own = r.asDict()
        lines.append(f"- {r['name']} ({r['description']}) [{', '.join(own.get('from_types') or [])} -> {', '.join(own.get('to_types') or [])}]")
    return "Types that are known; add to them where needed, and remove none:\n" + "\n".join(lines) + "\n\n"


def analyze_content(text: str, graph: Graph | None = None) -> str:
    """Asks for a domain and types for a text, with those that the graph knows. People are always a type."""
    return f"Name the domain of the text, and the types of entities (Person always among them) and relations worth recording. Reply with JSON: domain, suggested_entity_types (name, description, parent), suggested_relation_types (name, description, from_types, to_types).\n\n{_ontology(graph)}{cut(text, LIMITS['analyze'])}"


def prepare_extraction(graph: Graph, text: str, document: str) -> str:
    """Asks for entities and relations of a document's text, with what the graph knows."""
    types, names = _known(graph)
    return f"Extract entities and relations from a part of {document}. Types in use: {types}. Known entities: {names}. Reply with JSON like {REPLY}\n\n{cut(text, LIMITS['extract'])}"


def prepare_memory(graph: Graph, text: str) -> str:
    """Asks for facts of a conversation worth remembering."""
    types, names = _known(graph, 30)
    return f"Extract the facts worth remembering. Types in use: {types}. Known entities: {names}. Reply with JSON like {REPLY}\n\n{cut(text, LIMITS['memory'])}"
