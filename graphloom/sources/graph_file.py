"""Graphs in single binary files, as a data source: a head of 16 bytes (six letters, a version of two bytes, the body's length of eight,
little-endian) and a body of MessagePack in which a structure is the list of its fields in order.

``spark.read.format("graphfile").option("part", ...)`` reads one part of all files of a path. Heads are checked where partitions are
planned; tasks stream their file, skip what is not theirs and hold one record. The letters that a file begins with are an option.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator
from typing import Any, BinaryIO

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import EDGES, NODES, Graph

# The layout of a file. Names of fields are in the order in which they are written.
HEAD = struct.Struct("<6sHQ")
VERSION = 1
BODY = ["nodes", "edges", "adjacency", "ontology", "index_by_name", "index_by_type", "next_node_id", "next_edge_id", "documents"]
NODE = ["id", "name", "node_type", "definition", "properties", "aliases", "confidence", "source", "created_at", "evidence", "tier", "superseded_by", "last_referenced"]
EDGE = ["id", "src", "dst", "relation_type", "properties", "confidence", "source", "evidence"]
DEFAULTS = {"tier": "Minor", "superseded_by": None, "last_referenced": 0}

ONTOLOGY = ["domain", "node_types", "edge_types"]
SCHEMAS = {
    "nodes": NODES,
    "edges": EDGES,
    "documents": T.StructType([T.StructField("name", T.StringType())]),
    "domain": T.StructType([T.StructField("name", T.StringType())]),
    "node_types": T.StructType([T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("seq", T.IntegerType())]),
    "edge_types": T.StructType([T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("from_types", T.ArrayType(T.StringType())), T.StructField("to_types", T.ArrayType(T.StringType())), T.StructField("seq", T.IntegerType())]),
}
SLICE = 64 << 20


class GraphFileError(Exception):
    """A graph file that cannot be used."""


class FileUnreadable(GraphFileError):
    """There is no such file, or it cannot be read."""


class InvalidFormat(GraphFileError):
    """Too small, other letters, no length of the body, or a body that is cut off."""


class UnsupportedVersion(GraphFileError):
    """A version other than ``VERSION``."""


class BodyUndecodable(GraphFileError):
    """The body is no graph in MessagePack."""




def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files in a folder whose names begin with a letter or digit."""
    try:
        system, place = _located(path)
        info = system.get_file_info(place)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place))
    except (OSError, ValueError) as bad:
        raise FileUnreadable(f"{path}: {bad}") from bad
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and x.base_name[:1].isalnum())


def check(path: str, size: int, magic: bytes) -> int:
    """The length of the body, once the head of a file of ``size`` bytes is in order."""
    try:
        system, place = _located(path)
        with system.open_input_stream(place) as f:
            head = f.read(HEAD.size)
    except OSError as bad:
        raise FileUnreadable(f"{path}: {bad}") from bad
    if len(head) < 8:
        raise InvalidFormat(f"{path}: file too small")
    if head[:6] != magic:
        raise InvalidFormat(f"{path}: begins with other letters")
    if (version := int.from_bytes(head[6:8], "little")) != VERSION:
        raise UnsupportedVersion(f"{path}: version {version}")
    if len(head) < HEAD.size:
        raise InvalidFormat(f"{path}: no length of the body")
    length = HEAD.unpack(head)[2]
    if size < HEAD.size + length:
        raise InvalidFormat(f"{path}: the body is cut off")
    return length


class Values:
    """Values of a MessagePack stream, read or skipped one at a time."""

    #: First byte: how the number behind it is packed.
    NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    SIZED = {0xC4: (">B", "bin"), 0xC5: (">H", "bin"), 0xC6: (">I", "bin"), 0xD9: (">B", "str"), 0xDA: (">H", "str"), 0xDB: (">I", "str"), 0xDC: (">H", "list"), 0xDD: (">I", "list"), 0xDE: (">H", "map"), 0xDF: (">I", "map")}

    def __init__(self, stream: BinaryIO, length: int):
        self.stream, self.left = stream, length

    def take(self, n: int) -> bytes:
        if n > self.left or len(data := self.stream.read(n)) < n:
            raise BodyUndecodable("a value goes beyond the body")
        self.left -= n
        return data

    def number(self, form: str) -> Any:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def head(self) -> tuple[str, Any]:
        """(kind, length or value) of the next value; of strings, bytes, lists and maps what is in them comes next."""
        b = self.take(1)[0]
        if b <= 0x7F or b >= 0xE0:
            return "value", b if b <= 0x7F else b - 0x100
        if b <= 0xBF:
            return ("map", b & 15) if b <= 0x8F else ("list", b & 15) if b <= 0x9F else ("str", b & 31)
        if b in self.NUMBERS:
            return "value", self.number(self.NUMBERS[b])
        if b in self.SIZED:
            form, kind = self.SIZED[b]
            return kind, self.number(form)
        if b in (0xC0, 0xC2, 0xC3):
            return "value", {0xC0: None, 0xC2: False, 0xC3: True}[b]
        raise BodyUndecodable(f"no value begins with {b:#x}")

    def open(self, kind: str) -> int:
        found, n = self.head()
        if found != kind:
            raise BodyUndecodable(f"a {found} where a {kind} belongs")
        return n

    def value(self) -> Any:
        kind, x = self.head()
        if kind == "value":
            return x
        if kind == "list":
            return [self.value() for _ in range(x)]
        if kind == "map":
            return {self.value(): self.value() for _ in range(x)}
        data = self.take(x)
        try:
            return data.decode() if kind == "str" else data
        except UnicodeDecodeError as bad:
            raise BodyUndecodable("a string is no UTF-8") from bad

    def skip(self, n: int = 1) -> None:
        """Over ``n`` values, without recursion and in pieces of bounded size."""
        while n:
            kind, x = self.head()
            n += x if kind == "list" else 2 * x if kind == "map" else 0
            n -= 1
            while kind in ("str", "bin") and x:
                x -= len(self.take(min(x, 1 << 20)))


def _source(x: Any) -> tuple | None:
    """(kind, name, page, file) of a variant: its name, or a map from that to its fields."""
    if isinstance(x, str):
        return (x, None, None, None)
    kind, own = next(iter(x.items()))
    return (kind, own[0], own[1], None) if kind == "Document" else (kind, None, None, own[0])


def _record(fields: list[str], values: list, schema: T.StructType) -> tuple:
    if len(values) > len(fields):
        raise BodyUndecodable(f"{len(values)} fields, {len(fields)} are known")
    row = {**DEFAULTS, **dict(zip(fields, values))}
    try:
        row["seq"] = row["id"]
        row["properties"] = {k: v if isinstance(v, str) else json.dumps(v, separators=(",", ":")) for k, v in row["properties"].items()}
        row["source"], row["evidence"] = _source(row["source"]), [tuple(e) for e in row["evidence"]]
        return tuple(row[c] for c in schema.names)
    except (KeyError, AttributeError, IndexError, TypeError, StopIteration) as bad:
        raise BodyUndecodable(f"a record is incomplete: {bad!r}") from bad


def records(stream: BinaryIO, length: int, part: str, slice_: int = 0, slices: int = 1) -> Iterator[tuple]:
    """The rows of one part of a body; of nodes and edges those of one slice, ranges of equal numbers of records."""
    body = Values(stream, length)
    fields = body.open("list")
    if fields < len(BODY):
        raise BodyUndecodable(f"{fields} fields, {len(BODY)} belong to a graph")
    field = part if part in BODY else "ontology"
    body.skip(BODY.index(field))
    if field == "ontology":
        values = body.value()
        if not isinstance(values, list) or len(values) != len(ONTOLOGY):
            raise BodyUndecodable("no ontology")
        own = values[ONTOLOGY.index(part)]
        yield from ([(own,)] if own else []) if part == "domain" else [(*x, k) for k, x in enumerate(own)]
        return
    n = body.open("map" if part == "nodes" else "list")
    each = 2 if part == "nodes" else 1
    first, last = n * slice_ // slices, n * (slice_ + 1) // slices
    body.skip(first * each)
    for _ in range(first, last):
        if part == "documents":
            yield (body.value(),)
            continue
        if part == "nodes":
            body.skip()
        values = body.value()
        if not isinstance(values, list):
            raise BodyUndecodable("a record is no list")
        yield _record(NODE if part == "nodes" else EDGE, values, SCHEMAS[part])


class Slice(InputPartition):
    def __init__(self, path: str, length: int, slice_: int, slices: int):
        self.path, self.length, self.slice, self.slices = path, length, slice_, slices


class _Reader(DataSourceReader):
    def __init__(self, path: str, part: str, magic: bytes, size: int):
        self.path, self.part, self.magic, self.size = path, part, magic, size

    def partitions(self) -> list[Slice]:
        """A partition for each ``sliceBytes`` of a body; small parts have one for each file."""
        out = []
        for path, size in files(self.path):
            length = check(path, size, self.magic)
            slices = max(1, -(-length // self.size)) if self.part in ("nodes", "edges") else 1
            out += [Slice(path, length, k, slices) for k in range(slices)]
        return out

    def read(self, partition: Slice) -> Iterator[tuple]:
        system, place = _located(partition.path)
        with system.open_input_file(place) as f:
            f.seek(HEAD.size)
            yield from records(io.BufferedReader(f, 1 << 20), partition.length, self.part, partition.slice, partition.slices)


class GraphFile(DataSource):
    """Options: path, part (nodes, edges, documents, domain, node_types or edge_types), magic (six letters), sliceBytes (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "graphfile"

    def schema(self) -> T.StructType:
        return SCHEMAS[self.options.get("part", "nodes")]

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], self.options.get("part", "nodes"), self.options["magic"].encode(), int(self.options.get("sliceBytes", SLICE)))


def read_graph(spark: SparkSession, path: str, magic: str, slice_bytes: int = SLICE) -> Graph:
    """The graph of a file, or of the files of a folder that share one graph; ``seq`` is the id. Heads are checked first, on the driver."""
    for file, size in files(path):
        check(file, size, magic.encode())
    spark.dataSource.register(GraphFile)
    read = spark.read.format("graphfile").option("magic", magic).option("sliceBytes", slice_bytes)
    return Graph(**{part: read.option("part", part).load(path) for part in SCHEMAS})
