"""RDF/XML files as triples, cut into the node elements below their root where they lie.

Spark reads a file in records that each begin behind a `<`, so a record is a tag and the text after it. What a record does to the
depth depends on whether it stands in a comment or CDATA section, and what a stretch does is the composition of that; so, as with
Turtle, each stretch is scanned for every state it could begin in, a small table of stretches is composed in file order, and a second scan
knows where it stands. Pieces of an element that reaches over an edge are brought together by its number; every element is then parsed by
itself, under the root tag and the entities of its file.

Cases: an element that is not well-formed gives one row of kind `malformed`; blank nodes are named by their file; an element below the root
has to fit in a row, a file does not.
"""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regolith.operators.graph import materialised

from .rdf import BROADCAST_ROWS, RDF, TRIPLE, XSD, _batched, _rows

XML = "http://www.w3.org/XML/1998/namespace"
_TAG = re.compile(r"[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>", re.S)
_ENTITY = re.compile(r"!ENTITY\s+(\S+)\s+(\"[^\"]*\"|'[^']*')")


def step(record: str, state: int) -> tuple[int, int]:
    """The state after a record (1 in a comment, 2 in a CDATA section), and how much deeper it leads."""
    if state:
        return (0 if ("-->", "]]>")[state - 1] in record else state), 0
    if record.startswith("!--"):
        return (0 if "-->" in record[3:] else 1), 0
    if record.startswith("![CDATA["):
        return (0 if "]]>" in record else 2), 0
    if record[:1] in ("?", "!", ""):
        return 0, 0
    if record[0] == "/":
        return 0, -1
    tag = _TAG.match(record)
    return 0, 0 if tag and tag.group().endswith("/>") else 1 if tag else 0


def triples(spark: SparkSession, path: str) -> DataFrame:
    """TRIPLE rows of the RDF/XML files at path."""
    records = spark.read.option("lineSep", "<").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    does = records.mapInArrow(_composed, "file string, block long, s0 int, n0 long, s1 int, n1 long, s2 int, n2 long")
    stretches = does.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "s0", "n0", "s1", "n1", "s2", "n2"))).alias("all"))

    def onward(acc, b):
        after = F.when(acc["state"] == 0, b["s0"]).when(acc["state"] == 1, b["s1"]).otherwise(b["s2"])
        deeper = F.when(acc["state"] == 0, b["n0"]).when(acc["state"] == 1, b["n1"]).otherwise(b["n2"])
        at = F.struct(b["block"].alias("block"), acc["state"].alias("state"), acc["depth"].alias("depth"))
        return F.struct(after.alias("state"), (acc["depth"] + deeper).alias("depth"), F.concat(acc["told"], F.array(at)).alias("told"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("depth"), F.array().cast("array<struct<block:bigint,state:int,depth:bigint>>").alias("told"))
    begins = stretches.select("file", F.explode(F.aggregate("all", start, onward)["told"]).alias("b")).select("file", "b.block", "b.state", "b.depth")
    few = begins.count() <= BROADCAST_ROWS
    numbered = records.mapInArrow(_numbered, "file string, block long, line long, value string")
    known = numbered.join(F.broadcast(begins) if few else begins, ["file", "block"])
    ordered = (known if few else known.repartition("file", "block")).sortWithinPartitions("file", "block", "line")
    pieces = materialised(ordered.select("file", "block", "state", "depth", "value").mapInArrow(_cut, "file string, block long, n long, whole boolean, kind string, text string"), "pieces")
    # an element's number is its number in the stretch, after those that began in stretches before
    began = pieces.filter("kind = 'node'").groupBy("file", "block").agg(F.max("n").alias("n"))
    base = began.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("base"))
    nodes = pieces.filter("kind = 'node'").join(F.broadcast(base) if few else base, ["file", "block"]).select("file", "block", "whole", (F.col("n") + F.col("base")).alias("n"), "text")
    edges = nodes.filter("not whole").groupBy("file", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"))
    head = pieces.filter("kind <> 'node'").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("kind", "text"))).alias("head"))
    every = nodes.filter("whole").select("file", "n", "text").unionByName(edges)
    return every.join(F.broadcast(head) if few else head, "file").select("file", "n", "text", "head").mapInArrow(_told, TRIPLE)


def _composed(batches):
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), *((f"{c}{i}", pa.int32() if c == "s" else pa.int64()) for i in range(3) for c in "sn")])

    def told():
        held, states, depths = None, [], []
        for file, block, record in _rows(batches):
            if (file, block) != held:
                if held:
                    yield (*held, *(x for pair in zip(states, depths) for x in pair))
                held, states, depths = (file, block), [0, 1, 2], [0, 0, 0]
                if block == 0:
                    continue  # what stands before the first tag is no record
            for i in range(3):
                states[i], deeper = step(record, states[i])
                depths[i] += deeper
        if held:
            yield (*held, *(x for pair in zip(states, depths) for x in pair))

    yield from _batched(told(), schema)


def _numbered(batches):
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("value", pa.string())])

    def told():
        held, n = None, 0
        for file, block, record in _rows(batches):
            first = (file, block) != held
            held, n = (file, block), 0 if first else n + 1
            if not (first and block == 0):
                yield file, block, n, record

    yield from _batched(told(), schema)


def _cut(batches):
    """Pieces of the elements below the root (kind node), the root's tag (root), and entities (entity)."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_()), ("kind", pa.string()), ("text", pa.string())])

    def told():
        held, state, depth, n, own, parts = None, 0, 0, 0, False, []
        for file, block, begin, deep, record in _rows(batches):
            if (file, block) != held:
                if held and parts:
                    yield (*held, n, False, "node", "".join(parts))
                held, state, depth, n, own, parts = (file, block), begin, deep, 0, False, []
                if depth >= 2:
                    parts = [""]
            before, was = depth, state
            state, deeper = step(record, state)
            depth += deeper
            if before == 0:
                if not was and (m := _ENTITY.match(record)):
                    yield file, block, 0, True, "entity", f"<{m.group()}>"
                elif depth == 1:
                    yield file, block, 0, True, "root", "<" + _TAG.match(record).group()
                continue
            if before == 1 and (was or state or record[:1] in ("/", "!", "?", "")):
                continue  # between elements, or the end of the root
            if before == 1:
                n, own, parts = n + 1, True, []
            parts.append("<" + record)
            if depth == 1:
                yield file, block, n, own, "node", "".join(parts)
                own, parts = False, []
        if held and parts:
            yield (*held, n, False, "node", "".join(parts))

    yield from _batched(told(), schema, 1024)


def _told(batches):
    schema = pa.schema([(c.split()[0], pa.string()) for c in TRIPLE.split(", ")])

    def rows():
        for file, n, text, head in _rows(batches):
            root = next((h["text"] for h in head if h["kind"] == "root"), "<x>")
            name = re.match(r"<([^\s/>]+)", root).group(1)
            entities = "".join(h["text"] for h in head if h["kind"] == "entity")
            end = text.rfind(">") + 1  # blanks or text after the element belong to the root
            try:
                doc = ET.fromstring(f"<!DOCTYPE {name} [{entities}]>{root.removesuffix('/>') + '>' if root.endswith('/>') else root}{text[:end]}</{name}>")
                yield from Element(doc, file, n).read()
            except (ET.ParseError, ValueError):
                yield file, None, None, None, text.strip(), "malformed", None, None

    yield from _batched(rows(), schema)


class Element:
    """The triples of a node element, with all that it nests."""

    def __init__(self, root: ET.Element, file: str, n: int):
        self.root, self.file, self.n = root, file, n
        self.of_file = hashlib.md5(file.encode()).hexdigest()[:8]
        self.fresh, self.out = 0, []

    def read(self) -> list[tuple]:
        base, lang = self.root.get(f"{{{XML}}}base", ""), self.root.get(f"{{{XML}}}lang")
        for node in self.root:
            self._node(node, base, lang)
        return self.out

    def _say(self, s, p, o, kind, datatype=None, lang=None) -> None:
        self.out.append((self.file, None, s, p, o, kind, datatype, lang))

    def _text(self, s, p, value, lang, datatype=None) -> None:
        self._say(s, p, value, "literal", datatype or (RDF + "langString" if lang else XSD + "string"), None if datatype or not lang else lang.lower())

    def _new(self) -> str:
        self.fresh += 1
        return f"_:{self.of_file}_{self.n}_{self.fresh}"

    @staticmethod
    def _name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag[:1] == "{" else tag

    def _within(self, x: ET.Element, base: str, lang):
        inner = x.get(f"{{{XML}}}base")
        return urljoin(base, inner) if inner is not None else base, x.get(f"{{{XML}}}lang", lang) or None

    def _node(self, x: ET.Element, base: str, lang) -> tuple[str, str]:
        base, lang = self._within(x, base, lang)
        if (about := x.get(f"{{{RDF}}}about")) is not None:
            subject, kind = urljoin(base, about) if base else about, "iri"
        elif (own := x.get(f"{{{RDF}}}ID")) is not None:
            subject, kind = base.split("#")[0] + "#" + own, "iri"
        elif (label := x.get(f"{{{RDF}}}nodeID")) is not None:
            subject, kind = f"_:{self.of_file}_{label}", "blank"
        else:
            subject, kind = self._new(), "blank"
        if x.tag != f"{{{RDF}}}Description":
            self._say(subject, RDF + "type", self._name(x.tag), "iri")
        self._attributes(subject, x, base, lang)
        self._properties(subject, x, base, lang)
        return subject, kind

    def _attributes(self, subject: str, x: ET.Element, base: str, lang) -> bool:
        told = False
        for key, value in x.attrib.items():
            if key == f"{{{RDF}}}type":
                self._say(subject, RDF + "type", urljoin(base, value) if base else value, "iri")
            elif key.startswith(f"{{{RDF}}}") and not re.match(r"_\d+$", key[len(RDF) + 2 :]) or key.startswith(f"{{{XML}}}") or key[:1] != "{":
                continue
            else:
                self._text(subject, self._name(key), value, lang)
            told = True
        return told

    def _properties(self, subject: str, x: ET.Element, base: str, lang) -> None:
        for k, e in enumerate((e for e in x if isinstance(e.tag, str)), 1):
            verb = self._name(e.tag)
            if verb == RDF + "li":
                verb = f"{RDF}_{k}"
            inner, tongue = self._within(e, base, lang)
            form, resource, label = e.get(f"{{{RDF}}}parseType"), e.get(f"{{{RDF}}}resource"), e.get(f"{{{RDF}}}nodeID")
            if form == "Resource":
                node = self._new()
                self._say(subject, verb, node, "blank")
                self._properties(node, e, inner, tongue)
            elif form == "Collection":
                items = [self._node(c, inner, tongue) for c in e]
                nodes = [self._new() for _ in items]
                self._say(subject, verb, *((nodes[0], "blank") if nodes else (RDF + "nil", "iri")))
                for node, item, after in zip(nodes, items, [*nodes[1:], None]):
                    self._say(node, RDF + "first", *item)
                    self._say(node, RDF + "rest", *((after, "blank") if after else (RDF + "nil", "iri")))
            elif form is not None:
                self._text(subject, verb, (e.text or "") + "".join(ET.tostring(c, "unicode") for c in e), None, RDF + "XMLLiteral")
            elif resource is not None or label is not None:
                node, kind = (urljoin(inner, resource) if inner else resource, "iri") if resource is not None else (f"_:{self.of_file}_{label}", "blank")
                self._say(subject, verb, node, kind)
                self._attributes(node, e, inner, tongue)
            elif len(e):
                self._say(subject, verb, *self._node(e[0], inner, tongue))
            elif not (e.text or "") and any(a[:1] == "{" and not a.startswith((f"{{{RDF}}}", f"{{{XML}}}")) for a in e.attrib):
                node = self._new()
                self._say(subject, verb, node, "blank")
                self._attributes(node, e, inner, tongue)
            else:
                self._text(subject, verb, e.text or "", tongue, e.get(f"{{{RDF}}}datatype"))

