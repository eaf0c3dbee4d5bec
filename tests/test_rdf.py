"""Turtle against the N-Triples of the same graph, however Spark cuts the files."""

import re

import pytest

from regolith.sources import ontologies, rdf

TURTLE = r'''# a comment with a dot. and a "quote
@prefix ex: <http://x.org/> .
@prefix : <http://x.org/own#>.
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
BASE <http://base.org/dir/>
ex:a.b a ex:Thing ; rdfs:label "plain", 'single'@EN , """long "quoted" text.
with lines. # no comment
endé"""@fr-BE ; ex:p <rel#frag.x>, <http://abs.org/a.b> ;; .
<s> ex:num 1, -2.5, 3.0e4, .5 , true, false; ex:typed "5"^^ex:T , "x"^^<http://t.org/> .
_:n1 ex:knows _:n2 . _:n2 ex:list ( 1 "two" [ ex:p ex:q ; ex:r ( ) ] ) .
[ ex:alone "yes" ] . [] ex:p ex:esc\-aped , ex:pct%20x .
ex:last ex:text '''+"""'''three 'single' quotes.
\\tescaped\\n. '''"""+r''' , "a.b. \"c\" \\" .
@prefix ex: <http://redefined.org/> .
ex:a ex:b ex:c.
ex:d ex:e "str".ex:f ex:g 5 .
'''
TRIPLES = r'''
<http://x.org/a.b> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x.org/Thing> .
<http://x.org/a.b> <http://www.w3.org/2000/01/rdf-schema#label> "plain" .
<http://x.org/a.b> <http://www.w3.org/2000/01/rdf-schema#label> "single"@en .
<http://x.org/a.b> <http://www.w3.org/2000/01/rdf-schema#label> "long \"quoted\" text.\nwith lines. # no comment\nendé"@fr-be .
<http://x.org/a.b> <http://x.org/p> <http://base.org/dir/rel#frag.x> .
<http://x.org/a.b> <http://x.org/p> <http://abs.org/a.b> .
<http://base.org/dir/s> <http://x.org/num> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .
<http://base.org/dir/s> <http://x.org/num> "-2.5"^^<http://www.w3.org/2001/XMLSchema#decimal> .
<http://base.org/dir/s> <http://x.org/num> "3.0e4"^^<http://www.w3.org/2001/XMLSchema#double> .
<http://base.org/dir/s> <http://x.org/num> ".5"^^<http://www.w3.org/2001/XMLSchema#decimal> .
<http://base.org/dir/s> <http://x.org/num> "true"^^<http://www.w3.org/2001/XMLSchema#boolean> .
<http://base.org/dir/s> <http://x.org/num> "false"^^<http://www.w3.org/2001/XMLSchema#boolean> .
<http://base.org/dir/s> <http://x.org/typed> "5"^^<http://x.org/T> .
<http://base.org/dir/s> <http://x.org/typed> "x"^^<http://t.org/> .
_:n1 <http://x.org/knows> _:n2 .
_:n2 <http://x.org/list> _:l1 .
_:l1 <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .
_:l1 <http://www.w3.org/1999/02/22-rdf-syntax-ns#rest> _:l2 .
_:l2 <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> "two" .
_:l2 <http://www.w3.org/1999/02/22-rdf-syntax-ns#rest> _:l3 .
_:l3 <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> _:b .
_:l3 <http://www.w3.org/1999/02/22-rdf-syntax-ns#rest> <http://www.w3.org/1999/02/22-rdf-syntax-ns#nil> .
_:b <http://x.org/p> <http://x.org/q> .
_:b <http://x.org/r> <http://www.w3.org/1999/02/22-rdf-syntax-ns#nil> .
_:c <http://x.org/alone> "yes" .
_:d <http://x.org/p> <http://x.org/esc-aped> .
_:d <http://x.org/p> <http://x.org/pct%20x> .
<http://x.org/last> <http://x.org/text> "three 'single' quotes.\n\tescaped\n. " .
<http://x.org/last> <http://x.org/text> "a.b. \"c\" \\" .
<http://redefined.org/a> <http://redefined.org/b> <http://redefined.org/c> .
<http://redefined.org/d> <http://redefined.org/e> "str" .
<http://redefined.org/f> <http://redefined.org/g> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .
'''


def same_graph(a, b):
    """Rows equal but for the names of blank nodes, which are told apart by what is said of them."""

    def shaped(rows):
        said = {}
        for r in rows:
            for x in (r[0], r[2]):
                if (x or "").startswith("_:"):
                    said.setdefault(x, set())
        name = dict.fromkeys(said, "_")
        for _ in range(6):
            about = {x: [] for x in said}
            for s, p, o, *more in rows:
                if s in said:
                    about[s].append(("says", p, name.get(o, o), *map(str, more)))
                if o in said:
                    about[o].append(("of", p, name.get(s, s), *map(str, more)))
            name = {x: "_" + str(hash(tuple(sorted(v)))) for x, v in about.items()}
        return sorted((name.get(s, s), p, name.get(o, o), *map(str, more)) for s, p, o, *more in rows)

    return shaped(a) == shaped(b)


def rows(df):
    return [(r.s, r.p, r.o, r.kind, r.datatype, r.lang) for r in df.collect()]


@pytest.mark.parametrize("cut", [100_000, 700, 90, 17])
def test_same_triples_as_n_triples(spark, tmp_path, cut):
    (tmp_path / "g.ttl").write_text(TURTLE, encoding="utf-8")
    (tmp_path / "g.nt").write_text(TRIPLES, encoding="utf-8")
    want = rows(rdf.triples(spark, f"file://{tmp_path}/g.nt"))
    assert len(want) == TRIPLES.count(" .\n") and not [r for r in want if r[3] == "malformed"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = rows(rdf.triples(spark, f"file://{tmp_path}/g.ttl"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(want) and same_graph(got, want)


def test_files_stay_apart_and_bad_statements_harm_no_other(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.ttl").write_text("@prefix e: <http://a/> . _:x e:p e:o .")
    (folder / "b.ttl").write_text("@prefix e: <http://b/> . _:x e:p e:o . e:s unknown:p 5 . e:s e:p 'ok' . e:s e:p")
    (folder / "c.ttl").write_text("")
    (folder / "d.ttl").write_text("# nothing. at all\n")
    got = rdf.triples(spark, f"file://{folder}", "ttl").collect()
    assert len({r.s for r in got if r.o in ("http://a/o", "http://b/o")}) == 2
    assert sorted(r.o for r in got if r.kind == "malformed") == ["e:s e:p", "e:s unknown:p 5 ."]
    assert [(r.s, r.p) for r in got if r.o == "ok"] == [("http://b/s", "http://b/p")]
    with pytest.raises(ValueError):
        rdf.triples(spark, f"file://{folder}/a.xyz")


def test_quads_and_escapes(spark, tmp_path):
    (tmp_path / "g.nq").write_text('<s> <p> "a\\tb \\"q\\" \\U0001F642" <http://g> .\n<s> <p> _:b _:g . # told\n# no triple\n\n<s> <p> .\n<s> <p> "x"@en-GB .\n')
    got = sorted((r.graph or "", r.o, r.kind, r.lang) for r in rdf.triples(spark, f"file://{tmp_path}/g.nq").collect())
    blank = [re.sub("_:[0-9a-f]{8}_", "_:", x) if x else x for r in got for x in r]
    assert blank == ["", "<s> <p> .", "malformed", None, "", "x", "literal", "en-gb", "_:g", "_:b", "blank", None, "http://g", 'a\tb "q" 🙂', "literal", None]


def test_terms_of_turtle_and_triples(spark, tmp_path):
    (tmp_path / "o.ttl").write_text('@prefix r: <http://www.w3.org/2000/01/rdf-schema#> . @prefix o: <http://www.geneontology.org/formats/oboInOwl#> . @prefix w: <http://www.w3.org/2002/07/owl#> .\n<t1> r:label "one" ; o:hasExactSynonym "uno", "eins" ; r:subClassOf <t0> , [ w:onProperty <p> ] . <t2> r:label "two" ; w:deprecated true .')
    got = {r.uri: (r.label, r.synonyms, r.deprecated, r.parents) for r in ontologies.rdf_terms(spark, f"file://{tmp_path}/o.ttl", "o").collect()}
    assert got == {"t1": ("one", ["eins", "uno"], False, ["t0"]), "t2": ("two", [], True, [])}
