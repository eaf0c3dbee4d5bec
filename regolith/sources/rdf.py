"""RDF files as tables of triples: N-Triples, N-Quads and Turtle; RDF/XML is read by rdf_xml.

Turtle is cut into statements by a machine over lines that knows three states: outside of long strings, and inside either
kind of them. What a line does depends on the state before it, and what a stretch of a file does is the composition of what its lines do. So
each stretch that Spark reads is scanned for all three states it could begin in; the small table of stretches is composed in
file order, which tells the state and the number of statements before each; and the stretch is scanned once more, now knowing
where it stands. Statements that lie in one stretch stay where they are; only the pieces of those that reach over an edge are shuffled.

Prefixes and bases hold from where they stand to the end of their file; each statement gets those before it. Blank nodes are named by
their file, so that equal labels of two files stay apart.

Cases: comments, empty files and files without a last line feed are read; a statement that is not Turtle gives one row of kind
`malformed` and harms no other; one statement has to fit in a row, a file does not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLE = "file string, graph string, s string, p string, o string, kind string, datatype string, lang string"
RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
SUFFIXES = {".nt": "nt", ".nq": "nq", ".ttl": "ttl", ".rdf": "xml", ".owl": "xml", ".xml": "xml"}
#: Stretches and prefixes that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def triples(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """TRIPLE rows of the files at path. s and o are IRIs, `_:` blank nodes, or an o of kind literal; form is told by the suffix, if not given."""
    form = form or next((f for s, f in SUFFIXES.items() if path.lower().endswith(s)), None)
    if form in ("nt", "nq"):
        return _lines(spark, path)
    if form == "ttl":
        return _parsed(_statements(spark, path))
    if form == "xml":
        from . import rdf_xml

        return rdf_xml.triples(spark, path)
    raise ValueError(f"no RDF format {form!r}; there are {', '.join(sorted(set(SUFFIXES.values())))}")


# --- a line a triple


def _lines(spark: SparkSession, path: str) -> DataFrame:
    node = r"(?:<[^>]*>|_:[^\s<\"]+?)"
    literal = r'"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?'
    form = rf"^\s*({node})\s*(<[^>]*>)\s*({node}|{literal})\s*({node})?\s*\.\s*(?:#.*)?$"
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    parts = raw.select("file", "value", *(F.regexp_extract("value", form, i).alias(n) for i, n in ((1, "s"), (2, "p"), (3, "o"), (4, "g"))))
    bad, text = F.col("s") == "", F.col("o").startswith('"')
    of_file = F.substring(F.md5("file"), 1, 8)

    def named(c: Column) -> Column:
        return F.when(c.startswith("_:"), F.concat(F.lit("_:"), of_file, F.lit("_"), F.substr(c, F.lit(3)))).when(c.startswith("<"), _unescaped(F.regexp_replace(c, "^<|>$", "")))

    lang = F.nullif(F.regexp_extract("o", r'"@([A-Za-z0-9-]+)$', 1), F.lit(""))
    told = F.nullif(F.regexp_extract("o", r'"\^\^<([^>]*)>$', 1), F.lit(""))
    kind = F.when(bad, "malformed").when(text, "literal").when(F.col("o").startswith("_:"), "blank").otherwise("iri")
    return parts.select(
        "file", named(F.col("g")).alias("graph"), named(F.col("s")).alias("s"), named(F.col("p")).alias("p"),
        F.when(bad, F.col("value")).when(text, _unescaped(F.regexp_extract("o", r'(?s)^"((?:[^"\\]|\\.)*)"', 1))).otherwise(named(F.col("o"))).alias("o"), kind.alias("kind"),
        F.when(text & ~bad, F.coalesce(told, F.when(lang.isNotNull(), F.lit(RDF + "langString")), F.lit(XSD + "string"))).alias("datatype"), F.when(text, F.lower(lang)).alias("lang"),
    )


@F.pandas_udf(T.StringType())
def _decoded(text: pd.Series) -> pd.Series:
    return text.map(_unescape, na_action="ignore")


def _unescaped(c: Column) -> Column:
    """Escapes resolved; only texts with a backslash go to Python."""
    return F.when(F.contains(c, F.lit("\\")), _decoded(c)).otherwise(c)


_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(text: str) -> str:
    def one(m):
        x = m.group(1)
        return chr(int(x[1:], 16)) if x[0] in "uU" and len(x) > 1 else _ESCAPES.get(x, x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S) if "\\" in text else text


# --- Turtle: statements

#: What decides where statements end: long strings' quotes, IRIs, short strings, comments, and dots that end a statement.
_MARKS = re.compile(r'"""|\'\'\'|<[^<>"{}|^`\\\s]*>|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|#.*|\\.|\.(?=\s|$|#)|(?<=[\])>"\'])\.|(?<=[\])>"\'] )\.')
_CLOSE = {1: re.compile(r'(?:[^"\\]|\\.|"(?!""))*?("""+)', re.S), 2: re.compile(r"(?:[^'\\]|\\.|'(?!''))*?('''+)", re.S)}


def scan(line: str, state: int) -> tuple[int, list[int]]:
    """The state after a line, and the places behind the dots that end statements; 1 and 2 are inside of long strings."""
    at, ends = 0, []
    while at < len(line):
        if state:
            m = _CLOSE[state].match(line, at)
            if not m:
                return state, ends
            at, state = m.end(), 0
            continue
        m = _MARKS.search(line, at)
        if not m:
            return state, ends
        mark, at = m.group(), m.end()
        if mark in ('"""', "'''"):
            state = 1 if mark[0] == '"' else 2
        elif mark == ".":
            ends.append(at)
    return state, ends


def _statements(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, text): the statements of each file, numbered in order."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    does = lines.mapInArrow(_composed, "file string, block long, s0 int, n0 long, s1 int, n1 long, s2 int, n2 long")
    stretches = does.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "s0", "n0", "s1", "n1", "s2", "n2"))).alias("all"))

    def onward(acc, b):
        state, n = acc["state"], acc["n"]
        after = F.when(state == 0, b["s0"]).when(state == 1, b["s1"]).otherwise(b["s2"])
        count = F.when(state == 0, b["n0"]).when(state == 1, b["n1"]).otherwise(b["n2"])
        return F.struct(after.alias("state"), (n + count).alias("n"), F.concat(acc["told"], F.array(F.struct(b["block"].alias("block"), state.alias("state"), n.alias("n")))).alias("told"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<block:bigint,state:int,n:bigint>>").alias("told"))
    begins = stretches.select("file", F.explode(F.aggregate("all", start, onward)["told"]).alias("b")).select("file", "b.block", "b.state", "b.n")
    known = F.broadcast(begins) if begins.count() <= BROADCAST_ROWS else begins
    both = lines.mapInArrow(_numbered, "file string, block long, line long, value string").join(known, ["file", "block"])
    ordered = both.sortWithinPartitions("file", "block", "line") if begins.count() <= BROADCAST_ROWS else both.repartition("file", "block").sortWithinPartitions("file", "block", "line")
    pieces = ordered.select("file", "block", "state", "n", "value").mapInArrow(_cut, "file string, n long, block long, whole boolean, text string")
    whole = pieces.filter("whole").select("file", "n", "text")
    edges = pieces.filter("not whole").groupBy("file", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(edges).filter(F.col("text").rlike(r"\S"))


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batched(rows, schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _composed(batches):
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), *((f"{c}{i}", pa.int32() if c == "s" else pa.int64()) for i in range(3) for c in "sn")])

    def told():
        held, states, counts = None, [], []
        for file, block, line in _rows(batches):
            if (file, block) != held:
                if held:
                    yield (*held, *(x for pair in zip(states, counts) for x in pair))
                held, states, counts = (file, block), [0, 1, 2], [0, 0, 0]
            for i in range(3):
                states[i], ends = scan(line, states[i])
                counts[i] += len(ends)
        if held:
            yield (*held, *(x for pair in zip(states, counts) for x in pair))

    yield from _batched(told(), schema)


def _numbered(batches):
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("value", pa.string())])

    def told():
        held, n = None, 0
        for file, block, line in _rows(batches):
            held, n = (file, block), n + 1 if (file, block) == held else 0
            yield file, block, n, line

    yield from _batched(told(), schema)


def _cut(batches):
    schema = pa.schema([("file", pa.string()), ("n", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])

    def told():
        held, state, n, own, parts = None, 0, 0, False, []
        for file, block, begin, base, line in _rows(batches):
            if (file, block) != held:
                if held and parts:
                    yield held[0], n, held[1], False, "\n".join(parts)
                held, state, n, own, parts = (file, block), begin, base, False, []
            state, ends = scan(line, state)
            at = 0
            for end in ends:
                yield file, n, block, own, "\n".join([*parts, line[at:end]])
                at, n, own, parts = end, n + 1, True, []
            parts.append(line[at:])
        if held and parts:
            yield held[0], n, held[1], False, "\n".join(parts)

    yield from _batched(told(), schema)


# --- Turtle: what a statement says

_DIRECTIVE = re.compile(r"(?:\s|#[^\n]*(?:\n|$))*(?:(@)?(prefix)\s+([^\s:]*):\s*<([^>]*)>|(@)?(base)\s+<([^>]*)>)\s*(\.)?", re.I)
_TOKENS = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\s]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"{3,5}|'''(?:[^'\\]|\\.|'(?!''))*'{3,5})|(?P<short>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d+[eE][+-]?\d+|\d*\.\d+|\d+)(?![\w:]))"""
    r"""|(?P<blank>_:[\w](?:[\w.·-]*[\w·-])?)|(?P<name>(?:[^\W\d_](?:[\w.·-]*[\w·-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-])(?:(?:[\w.:·-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-])*(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-]))?)?)"""
    r"""|(?P<word>true|false|a)(?![\w:])|(?P<mark>[.;,()\[\]])""",
    re.S,
)


def _directives(text: str) -> tuple[list[tuple[str, str]], str]:
    """(prefix, iri) of what a statement begins with ('@' stands for the base), and the rest of it."""
    found, at = [], 0
    while (m := _DIRECTIVE.match(text, at)) and (m.end() > at):
        found.append((m.group(3), m.group(4)) if m.group(2) else ("@", m.group(7)))
        at = m.end()
    return found, text[at:]


def _parsed(statements: DataFrame) -> DataFrame:
    def declared(batches):
        schema = pa.schema([("file", pa.string()), ("n", pa.int64()), ("k", pa.int32()), ("prefix", pa.string()), ("iri", pa.string())])
        yield from _batched(((f, n, k, p, i) for f, n, text in _rows(batches) for k, (p, i) in enumerate(_directives(text)[0])), schema)

    own = statements.filter(F.col("text").rlike(r"(?i)(?:^|\n)\s*@?(?:prefix|base)\s")).mapInArrow(declared, "file string, n long, k int, prefix string, iri string")
    of_file = own.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", "k", "prefix", "iri"))).alias("declared"))
    beside = statements.join(F.broadcast(of_file) if of_file.count() <= BROADCAST_ROWS else of_file, "file", "left")
    # of the declarations before a statement, the last one of each prefix
    before = F.filter(F.coalesce("declared", F.array().cast("array<struct<n:bigint,k:int,prefix:string,iri:string>>")), lambda d: d["n"] < F.col("n"))
    return beside.select("file", "n", "text", before.alias("before")).mapInArrow(_told, TRIPLE)


def _told(batches):
    schema = pa.schema([(c.split()[0], pa.string()) for c in TRIPLE.split(", ")])

    def rows():
        for file, n, text, before in _rows(batches):
            prefixes, base = {}, ""
            found, rest = _directives(text)
            for prefix, iri in [(d["prefix"], d["iri"]) for d in before] + found:
                iri = urljoin(base, _unescape(iri)) if base else _unescape(iri)
                if prefix == "@":
                    base = iri
                else:
                    prefixes[prefix] = iri
            try:
                yield from Statement(rest, prefixes, base, file, n).read()
            except (ValueError, KeyError, IndexError):
                yield file, None, None, None, text.strip(), "malformed", None, None

    yield from _batched(rows(), schema)


class Statement:
    """Reads one statement: a subject with predicates and objects, nested brackets and collections included."""

    def __init__(self, text: str, prefixes: dict[str, str], base: str, file: str, n: int):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise ValueError(text[at : at + 20])
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
        self.prefixes, self.base, self.file, self.n = prefixes, base, file, n
        self.of_file = hashlib.md5(file.encode()).hexdigest()[:8]
        self.at, self.fresh, self.out = 0, 0, []

    def read(self) -> list[tuple]:
        if not self.tokens:
            return []
        alone = self.tokens[0] == ("mark", "[")
        subject = self._term()
        if subject[1] == "literal":
            raise ValueError("a literal as subject")
        if not (alone and self._next() == ("mark", ".")):  # `[ ... ] .` says all it has to say
            self._properties(subject[0])
        if self._take() != ("mark", ".") or self.at != len(self.tokens):
            raise ValueError("no end")
        return self.out

    def _next(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def _take(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def _new(self) -> str:
        self.fresh += 1
        return f"_:{self.of_file}_{self.n}_{self.fresh}"

    def _iri(self, text: str) -> str:
        iri = _unescape(text[1:-1])
        return urljoin(self.base, iri) if self.base else iri

    def _name(self, text: str) -> str:
        prefix, local = text.split(":", 1)
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def _say(self, s: str, p: str, o: tuple) -> None:
        self.out.append((self.file, None, s, p, *o))

    def _properties(self, subject: str) -> None:
        while True:
            kind, text = self._take()
            if kind == "iri":
                verb = self._iri(text)
            elif kind == "name":
                verb = self._name(text)
            elif (kind, text) == ("word", "a"):
                verb = RDF + "type"
            else:
                raise ValueError(f"no verb: {text}")
            while True:
                self._say(subject, verb, self._term())
                if self._next() != ("mark", ","):
                    break
                self._take()
            if self._next() != ("mark", ";"):
                return
            while self._next() == ("mark", ";"):
                self._take()
            if self._next()[1] in (".", "]", None):
                return

    def _term(self) -> tuple[str, str, str | None, str | None]:
        """(value, kind, datatype, lang)"""
        kind, text = self._take()
        if kind == "iri":
            return self._iri(text), "iri", None, None
        if kind == "name":
            return self._name(text), "iri", None, None
        if kind == "blank":
            return f"_:{self.of_file}_{text[2:]}", "blank", None, None
        if kind in ("long", "short"):
            value = _unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self._next()[0] == "lang":
                return value, "literal", RDF + "langString", self._take()[1][1:].lower()
            if self._next()[0] == "type":
                self._take()
                of, name = self._take()
                return value, "literal", self._iri(name) if of == "iri" else self._name(name), None
            return value, "literal", XSD + "string", None
        if kind == "number":
            return text, "literal", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None
        if kind == "word" and text != "a":
            return text, "literal", XSD + "boolean", None
        if (kind, text) == ("mark", "["):
            node = self._new()
            if self._next() != ("mark", "]"):
                self._properties(node)
            if self._take() != ("mark", "]"):
                raise ValueError("no ]")
            return node, "blank", None, None
        if (kind, text) == ("mark", "("):
            items = []
            while self._next() != ("mark", ")"):
                items.append(self._term())
            self._take()
            nodes = [self._new() for _ in items]
            for node, item, after in zip(nodes, items, [*nodes[1:], None]):
                self._say(node, RDF + "first", item)
                self._say(node, RDF + "rest", (after, "blank", None, None) if after else (RDF + "nil", "iri", None, None))
            return (nodes[0], "blank", None, None) if nodes else (RDF + "nil", "iri", None, None)
        raise ValueError(f"no term: {text}")
