"""Graphs in binary files, against files packed here by hand."""

import io
import struct

import pytest

from graphloom.sources import graph_file as gf

MAGIC = "GRAPHS"


def pack(x) -> bytes:
    if x is None or isinstance(x, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[x]
    if isinstance(x, int):
        return bytes([x]) if 0 <= x < 128 else struct.pack(">BQ", 0xCF, x) if x > 0 else struct.pack(">Bq", 0xD3, x)
    if isinstance(x, float):
        return struct.pack(">Bf", 0xCA, x)
    if isinstance(x, str):
        b = x.encode()
        return (bytes([0xA0 + len(b)]) if len(b) < 32 else struct.pack(">BH", 0xDA, len(b))) + b
    if isinstance(x, list):
        return (bytes([0x90 + len(x)]) if len(x) < 16 else struct.pack(">BI", 0xDD, len(x))) + b"".join(map(pack, x))
    return (bytes([0x80 + len(x)]) if len(x) < 16 else struct.pack(">BH", 0xDE, len(x))) + b"".join(pack(k) + pack(v) for k, v in x.items())


def node(k: int, source="Memory", more=("Critical", None, 7)) -> list:
    return [k, f"node {k} é", "concept", "x" * k, {"a": "text", "n": 3, "l": [1, None]}, ["alias"], 0.5, source, 1000 + k, [["doc", 4, "said", 0, 4]], *more]


def body(nodes: int = 40) -> list:
    own = {k: node(k) for k in range(1, nodes + 1)}
    own[2] = node(2, {"CodeAnalysis": ["src/a.rs"]}, ("Minor", 1, 0))
    own[3] = node(3, {"Document": ["paper", 9]}, ())
    edges = [[k, k, k + 1, "near", {}, 1.0, "Conversation", []] for k in range(1, nodes)]
    return [own, edges, {1: [0]}, ["chemistry", [["concept", "an idea", None]], [["near", "close", ["concept"], []]]], {"node 1": [1]}, {"concept": [1]}, nodes + 1, nodes, ["paper", "other"]]


def whole(content: list, magic: str = MAGIC, version: int = 1) -> bytes:
    data = pack(content)
    return magic.encode() + struct.pack("<HQ", version, len(data)) + data


def test_all_parts_and_slices(spark, tmp_path):
    path = tmp_path / "one.kg"
    path.write_bytes(whole(body()) + b"behind the body")
    g = gf.read_graph(spark, str(path), MAGIC, slice_bytes=500)
    nodes = {r["id"]: r for r in g.nodes.collect()}
    assert g.nodes.rdd.getNumPartitions() > 5 and sorted(nodes) == list(range(1, 41)) and all(n["seq"] == k and n["name"] == f"node {k} é" for k, n in nodes.items())
    assert nodes[1]["properties"] == {"a": "text", "n": "3", "l": "[1,null]"} and nodes[1]["evidence"][0].asDict() == {"document": "doc", "page": 4, "text_snippet": "said", "offset_start": 0, "offset_end": 4}
    assert [tuple(nodes[k]["source"]) for k in (1, 2, 3)] == [("Memory", None, None, None), ("CodeAnalysis", None, None, "src/a.rs"), ("Document", "paper", 9, None)]
    assert [(nodes[k]["tier"], nodes[k]["superseded_by"], nodes[k]["last_referenced"]) for k in (1, 2, 3)] == [("Critical", None, 7), ("Minor", 1, 0), ("Minor", None, 0)]
    assert [(r["id"], r["src"], r["dst"], r["relation_type"], r["confidence"]) for r in g.edges.orderBy("id").collect()] == [(k, k, k + 1, "near", 1.0) for k in range(1, 40)]
    assert sorted(r["name"] for r in g.documents.collect()) == ["other", "paper"] and g.domain.first()["name"] == "chemistry"
    assert g.node_types.first()["description"] == "an idea" and g.edge_types.first()["from_types"] == ["concept"]


def test_empty_graph_and_folder(spark, tmp_path):
    (tmp_path / "a.kg").write_bytes(whole([{}, [], {}, ["", [], []], {}, {}, 1, 1, []]))
    (tmp_path / "b.kg").write_bytes(whole(body(20)))
    (tmp_path / "_ignored").write_bytes(b"x")
    g = gf.read_graph(spark, f"file://{tmp_path}", MAGIC)
    assert g.nodes.count() == 20 and g.edges.count() == 19 and g.domain.count() == 1


@pytest.mark.parametrize(
    "data, error",
    [
        (b"short", gf.InvalidFormat),
        (whole(body(), "OTHERS"), gf.InvalidFormat),
        (whole(body(), version=2), gf.UnsupportedVersion),
        (whole(body())[:12], gf.InvalidFormat),
        (whole(body())[:-1], gf.InvalidFormat),
    ],
)
def test_heads(tmp_path, data, error):
    path = tmp_path / "x.kg"
    path.write_bytes(data)
    with pytest.raises(error):
        gf.check(str(path), len(data), MAGIC.encode())


def test_missing_file(tmp_path):
    with pytest.raises(gf.FileUnreadable):
        gf.files(str(tmp_path / "none"))
    with pytest.raises(gf.FileUnreadable):
        gf.check(str(tmp_path / "none"), 100, MAGIC.encode())


@pytest.mark.parametrize("content", [[1, 2], {"a": 1}, [*body()[:-1]], [[1], *body()[1:]], [{1: [1, "x"]}, *body()[1:]], [{1: 5}, *body()[1:]]])
def test_bodies_that_are_no_graph(content):
    data = pack(content)
    with pytest.raises(gf.BodyUndecodable):
        list(gf.records(io.BytesIO(data), len(data), "nodes"))


def test_bytes_that_are_no_body():
    data = pack(body())
    for cut in (1, 50, len(data) // 3):
        with pytest.raises(gf.BodyUndecodable):
            for part in gf.SCHEMAS:
                list(gf.records(io.BytesIO(data[:cut]), cut, part))
    with pytest.raises(gf.BodyUndecodable):
        list(gf.records(io.BytesIO(b"\xc1"), 1, "nodes"))


def test_imported_graph_answers(spark, tmp_path):
    from graphloom.api import KnowledgeGraph

    (tmp_path / "one.kg").write_bytes(whole(body(10)))
    kg = KnowledgeGraph(spark, f"file://{tmp_path}/store")
    kg.import_file(str(tmp_path / "one.kg"), MAGIC)
    kg.save()
    again = KnowledgeGraph(spark, f"file://{tmp_path}/store")
    assert again.graph.nodes.count() == 10 and again.graph.edges.count() == 9 and again.domain() == "chemistry"
