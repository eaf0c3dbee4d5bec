"""RDF/XML against the N-Triples of the same graph, however Spark cuts the files."""

import pytest

from regolith.sources import ontologies, rdf
from tests.test_rdf import rows, same_graph

DOC = """<?xml version="1.0"?>
<!-- a comment with <tags> and </ends> -->
<!DOCTYPE rdf:RDF [
  <!ENTITY ex "http://x.org/" >
  <!ENTITY xsd 'http://www.w3.org/2001/XMLSchema#'>
]>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:ex="http://x.org/" xml:base="http://base.org/doc" xml:lang="en">
  <ex:Thing rdf:about="&ex;a" ex:note="an > attribute">
    <rdfs:label xml:lang="de-AT">ein &lt;Wort&gt; &amp; mehr</rdfs:label>
    <rdfs:label xml:lang="">plain</rdfs:label>
    <ex:n rdf:datatype="&xsd;integer">5</ex:n>
    <ex:p rdf:resource="#frag"/>
    <!-- <ex:no rdf:resource="no"/> -->
    <ex:nested><rdf:Description rdf:nodeID="n1"><ex:q rdf:nodeID="n2"/></rdf:Description></ex:nested>
    <ex:cdata><![CDATA[<not> & a </tag>]]></ex:cdata>
  </ex:Thing>
  <rdf:Description rdf:ID="own">
    <ex:anon rdf:parseType="Resource"><ex:r>x</ex:r></ex:anon>
    <ex:list rdf:parseType="Collection"><ex:Item rdf:about="i1"/><rdf:Description rdf:about="i2"/></ex:list>
    <ex:none rdf:parseType="Collection"/>
    <ex:short ex:r="y"/>
    <ex:empty></ex:empty>
  </rdf:Description>
  <rdf:Bag><rdf:li>one</rdf:li><rdf:li rdf:resource="http://two"/></rdf:Bag>
  <ex:Alone/>
</rdf:RDF>
"""
TRIPLES = """
<http://x.org/a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x.org/Thing> .
<http://x.org/a> <http://x.org/note> "an > attribute"@en .
<http://x.org/a> <http://www.w3.org/2000/01/rdf-schema#label> "ein <Wort> & mehr"@de-at .
<http://x.org/a> <http://www.w3.org/2000/01/rdf-schema#label> "plain" .
<http://x.org/a> <http://x.org/n> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .
<http://x.org/a> <http://x.org/p> <http://base.org/doc#frag> .
<http://x.org/a> <http://x.org/nested> _:n1 .
_:n1 <http://x.org/q> _:n2 .
<http://x.org/a> <http://x.org/cdata> "<not> & a </tag>"@en .
<http://base.org/doc#own> <http://x.org/anon> _:a .
_:a <http://x.org/r> "x"@en .
<http://base.org/doc#own> <http://x.org/list> _:l1 .
<http://base.org/i1> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x.org/Item> .
_:l1 <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> <http://base.org/i1> .
_:l1 <http://www.w3.org/1999/02/22-rdf-syntax-ns#rest> _:l2 .
_:l2 <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> <http://base.org/i2> .
_:l2 <http://www.w3.org/1999/02/22-rdf-syntax-ns#rest> <http://www.w3.org/1999/02/22-rdf-syntax-ns#nil> .
<http://base.org/doc#own> <http://x.org/none> <http://www.w3.org/1999/02/22-rdf-syntax-ns#nil> .
<http://base.org/doc#own> <http://x.org/short> _:s .
_:s <http://x.org/r> "y"@en .
<http://base.org/doc#own> <http://x.org/empty> ""@en .
_:bag <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/1999/02/22-rdf-syntax-ns#Bag> .
_:bag <http://www.w3.org/1999/02/22-rdf-syntax-ns#_1> "one"@en .
_:bag <http://www.w3.org/1999/02/22-rdf-syntax-ns#_2> <http://two> .
_:alone <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x.org/Alone> .
"""


@pytest.mark.parametrize("cut", [100_000, 400, 60])
def test_same_triples_as_n_triples(spark, tmp_path, cut):
    (tmp_path / "g.owl").write_text(DOC, encoding="utf-8")
    (tmp_path / "g.nt").write_text(TRIPLES, encoding="utf-8")
    want = rows(rdf.triples(spark, f"file://{tmp_path}/g.nt"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = rows(rdf.triples(spark, f"file://{tmp_path}/g.owl"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(want) == TRIPLES.count(" .\n") and same_graph(got, want)


def test_files_and_bad_elements(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    head = '<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:s="http://www.w3.org/2000/01/rdf-schema#">'
    (folder / "a.rdf").write_text(head + '<r:Description r:nodeID="b"><s:label>one</s:label></r:Description></r:RDF>')
    (folder / "b.rdf").write_text(head + '<r:Description r:nodeID="b"><s:label>two</s:label></r:Description><r:Description r:about="u"><s:x>&unknown;</s:x></r:Description><r:Description r:about="t"><s:label>three</s:label></r:Description></r:RDF>')
    (folder / "c.rdf").write_text(head + "</r:RDF>")
    (folder / "d.rdf").write_text("")
    got = rdf.triples(spark, f"file://{folder}", "xml").collect()
    assert len({r.s for r in got if r.o in ("one", "two")}) == 2 and sum(r.kind == "malformed" for r in got) == 1
    terms = ontologies.rdf_terms(spark, f"file://{folder}", "o", "xml").filter("uri = 't'").collect()
    assert [(t.uri, t.label) for t in terms] == [("t", "three")]
