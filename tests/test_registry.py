"""Literal cases of the registry's functions and operators."""

import hashlib
import json

from pyspark.sql import functions as F

from regolith.functions import identity, infer, parse, similarity, units
from regolith.operators import align, browse, curate, graph, merge, ontology, quality, resolve, search, transforms, vectors
from regolith.operators.table_log import TableLog
from regolith.streaming import commit, windows


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_canonical_corners(spark):
    cases = [
        ({}, "{}"),
        ({"b": 1, "a": None}, '{"b":1}'),
        ({"a": [], "b": {}, "c": ""}, '{"c":""}'),
        ({"unit": "kg", "unit_uri": "q:KG"}, '{"unit":"q:KG"}'),
        ({"description": "d", "x": {"value_domain": "t", "y": 1}}, '{"x":{"y":1}}'),
        ({"constraints": {"minimum": 1, "pattern": "p"}}, '{"constraints":{"pattern":"p"}}'),
        ({"response_options": [{"value": "b"}, {"value": "a", "label": "é"}]}, '{"response_options":[{"label":"\\u00e9","value":"a"},{"value":"b"}]}'),
        ({"response_options": [{"label": "z"}, {"value": "a"}]}, '{"response_options":[{"label":"z"},{"value":"a"}]}'),
        ({"members": ["b", "a", None]}, '{"members":["b","a"]}'),
        ({"members": [{"description": "only"}]}, '{"members":[null]}'),
        ({"n": 1e20, "m": 2.0}, '{"m":2.0,"n":1e+20}'),
    ]
    got = values(spark, identity.canonical(F.col("s")), [(json.dumps(c),) for c, _ in cases] + [(None,)], "s string")
    assert got == [w for _, w in cases] + [None]
    flat = values(spark, identity.canonical_flat({"unit": F.col("u"), "data_type": F.col("t"), "description": F.col("u")}), [("kg", "float")], "u string, t string")
    assert flat == [identity.canonical_json({"unit": "kg", "data_type": "float"})]


def test_hash_modes(spark):
    exact, element, close = ("u1", "skos:exactMatch", "concept_match"), ("u2", "skos:closeMatch", "element_match"), ("u3", "skos:closeMatch", "concept_match")
    cases = [([], None), (None, None), ([(*exact, False)], "u1"), ([(*close, False), (*exact, False)], None), ([(*exact, False), (*element, True)], "u2"), ([(*exact, False), (*close, True)], None)]
    schema = "a array<struct<term_uri:string,mapping_relation:string,match_level:string,primary:boolean>>"
    assert values(spark, identity.anchor_uri(F.col("a")), [(c,) for c, _ in cases], schema) == [w for _, w in cases]
    rows = [('{"data_type":"float"}', [("C", "n", None)], [(*exact, True)]), ('{"data_type":"float","description":"d"}', [("C", "n", None)], None), ('{"data_type":"float"}', [("", "n", "p")], [])]
    got = values(spark, identity.identity_json(F.col("s"), F.col("p"), F.col("a")), rows, "s string, p array<struct<class:string,name:string,description:string>>, " + schema)
    assert got == ['{"_primary_ontology_uri":"u1","data_type":"float"}', '{"_attribute":"n","_class":"C","_description":"d","data_type":"float"}', '{"_attribute":"n","_description":"p","data_type":"float"}']
    sha = hashlib.sha256(b"x").hexdigest()
    assert values(spark, identity.entity_uri("elements", F.lit("Age"), F.col("s")), [(sha,)], "s string") == [f"{identity.BASE_URI}/elements/age_{sha[:12]}"]


def test_inference(spark):
    texts = ["Age in years", "ISO 8601, e.g. P3Y years", "length in millimeters", "field of 3 T", "nothing", None]
    assert values(spark, infer.unit(F.col("t")), [(t,) for t in texts], "t string") == ["years", "ISO8601", "meters", "tesla", None, None]
    assert values(spark, infer.unit(F.col("t"), corrected=True), [("length in millimeters",)], "t string") == ["millimeters"]
    least, most = infer.bounds(F.col("t"))
    assert values(spark, F.struct(least, most), [("at least 3, capped at 4.5",), ("min 1",), ("x",)], "t string") == [(3.0, 4.5), (1.0, None), (None, None)]
    assert values(spark, infer.pattern(F.col("t")), [("a DOI",)], "t string") == [r"^10\.\d{4,}"]
    assert values(spark, infer.ontology_prefix(F.col("t")), [("http://purl.obolibrary.org/obo/UBERON_1",), ("x",)], "t string") == ["uberon", "unknown"]
    assert values(spark, infer.curie_to_uri(F.col("t")), [("GO:1",), ("http://x",)], "t string") == ["http://purl.obolibrary.org/obo/GO_1", "http://x"]


def test_parsing(spark):
    raw = ["1, Male | 2, Female, old|x", "a; b;;", "a,b ,", " one ", " "]
    assert values(spark, parse.choices(F.col("t")), [(t,) for t in raw], "t string") == [["Male", "Female, old", "x"], ["a", "b"], ["a", "b"], ["one"], []]
    a, b = parse.value_range(F.col("t"))
    assert values(spark, F.struct(a, b), [("0 :: 100",), ("-1::",), (":: x",), ("1::2::3",), (None,)], "t string") == [(0.0, 100.0), (-1.0, None), (None, None), (None, None), (None, None)]
    assert [[tuple(o) for o in v] for v in values(spark, parse.notes(F.col("t")), [("1=Male; -1 = a=b ;x",), (None,)], "t string")] == [[("1", "Male"), ("-1", "a=b")], []]
    assert values(spark, parse.keyword_type(F.col("t")), [("interval",), ("YesNo",), ("radio",), ("",)], "t string") == ["integer", "boolean", "string", "string"]
    for column, want in (["1", " 2", "n/a", ""], "integer"), (["1", "2.5", "1e3"], "float"), (["yes", "No"], "boolean"), (["a", "1"], "string"), (["", None], "string"), (["1", "0"], "integer"):
        assert spark.createDataFrame([(c,) for c in column], "v string").agg(parse.column_type(F.col("v"))).first()[0] == want


def test_similarity(spark):
    s = "a double, b double, c double, d double"
    rows = [(0.0, 10.0, 5.0, 15.0), (0.0, 1.0, 2.0, 3.0), (1.0, 1.0, 1.0, 1.0), (None, 1.0, 0.0, 1.0)]
    got = values(spark, similarity.range_overlap(*(F.col(c) for c in "abcd")), rows, s)
    assert [round(x, 6) for x in got] == [round(1 / 3, 6), 0.0, 1.0, 0.0]
    assert values(spark, similarity.jaccard(F.col("x"), F.col("y")), [(["A", "b"], ["a"]), ([], ["a"]), (None, ["a"])], "x array<string>, y array<string>") == [0.5, 0.0, 0.0]
    assert values(spark, similarity.cosine(F.col("x"), F.col("y")), [([1.0, 0.0], [1.0, 0.0]), ([0.0], [1.0])], "x array<float>, y array<float>") == [1.0, 0.0]
    got = values(spark, similarity.relation(F.col("e"), *(F.col(c) for c in "abcd")), [(0.96, 0.0, 1.0, 0.0, 1.0), (0.1, 0.0, 9.0, 1.0, 2.0), (0.1, 1.0, 2.0, 0.0, 9.0), (0.85, None, 1.0, 0.0, 1.0), (0.2, None, 1.0, 0.0, 1.0)], "e double, " + s)
    assert got == ["skos:exactMatch", "skos:broadMatch", "skos:narrowMatch", "skos:closeMatch", "none"]
    assert values(spark, similarity.name_ratio(F.col("x"), F.col("y")), [("Age_Years", "age years"), (None, "a")], "x string, y string") == [1.0, None]
    assert values(spark, units.known_factor(F.lit("year"), F.col("u")), [("month",), ("day",)], "u string") == [12.0, None]
    assert values(spark, units.alias_uri(F.col("u")), [(" KG ",), ("x",)], "u string") == [units.UNIT_NS + "KiloGM", None]


def test_merge_keeps_first_seen(spark):
    rows = [("h", 2, [("b", "n"), ("a", "n")]), ("h", 1, [("a", "n"), ("a", "m"), ("a", "n")]), ("k", 1, [])]
    df = spark.createDataFrame(rows, "sha256 string, ord int, provenance array<struct<source:string,name:string>>")
    got = {r.sha256: ([tuple(p) for p in r.provenance], r.n_rows) for r in merge.merge_by_hash(df).collect()}
    assert got == {"h": ([("a", "n"), ("a", "m"), ("b", "n")], 2), "k": ([], 1)}


def test_upsert(spark):
    schema = "sha256 string, version int, x string, provenance array<struct<source:string,name:string>>"
    old = spark.createDataFrame([("h", 1, "old", [("a", "n")]), (None, 1, "bare", [])], schema)
    new = spark.createDataFrame([("h", 2, "new", [("b", "n")]), ("", 2, "bare2", [])], schema)
    for keep, want in ((True, ["a", "b"]), (False, ["b"])):
        got = {r.x: [p.source for p in r.provenance] for r in merge.upsert(old, new, merge=keep).collect()}
        assert got == {"new": want, "bare": [], "bare2": []}


def test_pages_reach_every_row_once(spark):
    rows = [(i, [None, "a", "b", "b"][i % 4]) for i in range(23)]
    df = spark.createDataFrame(rows, "id int, name string")
    for descending in (False, True):
        seen, cursor = [], None
        while True:
            got = browse.page(df, "name", "id", 5, cursor, descending).collect()
            seen += [r.id for r in got[:5]]
            if len(got) <= 5:
                break
            cursor = browse.decode_cursor(browse.encode_cursor(got[4].name, got[4].id))
        assert sorted(seen) == list(range(23)) and len(seen) == 23


def test_graph(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(49)] + [(100, 101), (101, 102), (102, 100), (7, 7)], "a int, b int")
    got = {r.node: r.component for r in graph.components(path).collect()}
    assert got == {i: 0 for i in range(50)} | {100: 100, 101: 100, 102: 100}
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "_:x")], "child string, parent string")
    up = {(r.ancestor, r.depth) for r in graph.ancestors(edges, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert up == {("b", 1), ("c", 1), ("d", 2)}


def test_gap_cutoff(spark):
    rows = [("q", f"i{k}", s, k + 1) for k, s in enumerate([0.9, 0.85, 0.84, 0.6, 0.59])]
    df = spark.createDataFrame(rows, "query string, item string, score double, rank int")
    assert [r.item for r in vectors.gap_cutoff(df, 0.5).orderBy("rank").collect()] == ["i0", "i1", "i2"]
    assert [r.item for r in vectors.gap_cutoff(df, 0.5, deprecated=F.col("item") == "i1").orderBy("rank").collect()] == ["i0", "i2"]
    anns = [("x/NCBITaxon_1", "Mus"), ("x/NCBITaxon_2", "Mus musculus"), ("x/GO_1", "Mus")]
    got = values(spark, vectors.species_over_genus(F.col("a")), [(anns,)], "a array<struct<term_uri:string,term_label:string>>")
    assert [a.term_uri for a in got[0]] == ["x/NCBITaxon_2", "x/GO_1"]


def test_references(spark):
    h = "0" * 64
    elements = spark.createDataFrame([("C", "Age", "s1", 1), ("C", "Age", "s2", 2), ("D", "age", "s3", 3), ("", "Sex", "s4", 4)], "class string, name string, sha256 string, ord int")
    schemas = spark.createDataFrame([("x", "C", ["Age", "AGE", "sex", "SEX", "none", h]), ("y", "Z", ["Age", "age"]), ("z", "C", [])], "schema_id string, class string, properties array<string>")
    got = {r.schema_id: r.properties for r in resolve.properties(schemas, elements).collect()}
    assert got == {"x": ["s2", "s2", "s4", "s4", "none", h], "y": ["s1", "s1"], "z": []}


def test_alignment(spark):
    pairs = spark.createDataFrame([("a", "b", "skos:exactMatch"), ("b", "c", "skos:exactMatch"), ("c", "d", "skos:closeMatch")], "a_id string, b_id string, relation string")
    assert [r.members for r in align.groups(pairs).collect()] == [["a", "b", "c"]]
    rows = [(1, "age", "s1", False, 1), (2, "age", "s2", True, 2), (3, "age", "s2", True, 3), (4, "sex", "s1", False, 4), (5, "sex", "s1", True, 5)]
    df = spark.createDataFrame(rows, "id int, label string, source string, annotated boolean, ord int")
    assert [(r.id, r.donor) for r in align.transfer(df).collect()] == [(1, 2)]


def test_transform_patterns(spark):
    schema = "a_data_type string, a_unit string, a_value_domain string, a_choices array<string>, b_data_type string, b_unit string, b_value_domain string, b_choices array<string>"
    n = None
    rows = [
        ("string", "year", n, n, "string", "year", n, n), ("float", "year", n, n, "float", "month", n, n), ("float", "year", n, n, "string", "iso8601_duration", n, n), ("string", "ISO8601", n, n, "integer", n, n, n),
        ("string", n, n, ["a", "b"], "string", n, n, ["b", "a", "c"]), ("object", n, n, n, "string", n, n, n), ("float", n, n, n, "boolean", n, n, n), ("float", "year", n, n, "float", "day", n, n), ("string", n, n, ["a"], "string", n, n, ["a"]),
    ]
    got = spark.createDataFrame(rows, schema)
    got = transforms.detect(got).withColumn("back", F.when(F.col("function").isNotNull(), transforms.reverse(F.col("function")))).collect()
    assert [r.function and r.function.function_type for r in got] == ["identity", "unit_conversion", "type_conversion", "type_conversion", "value_mapping", "structural", "unknown", None, "identity"]
    assert got[1].function.factor == 12.0 and abs(got[1].back.factor - 1 / 12) < 1e-12 and got[2].back.expression == "years_from_iso8601_duration"
    assert json.loads(got[4].function.expression) == {"a": "a", "b": "b"}


def test_curation(spark):
    df = spark.createDataFrame([("e", [0.8, 0.79]), ("f", [0.96]), ("g", [])], "id string, scores array<double>")
    assert {(r.entity_ref, r.reason) for r in curate.annotation_flags(df).collect()} == {("e", "unsure_score"), ("e", "close_candidates")}
    flags = spark.createDataFrame([(1, "pending"), (2, "resolved")], "flag_id int, status string")
    done = spark.createDataFrame([(1, "resolved", "me"), (2, "rejected", "me")], "flag_id int, status string, resolved_by string")
    assert {r.flag_id: (r.status, r.resolved_by) for r in curate.resolve_flags(flags, done, F.current_timestamp()).collect()} == {1: ("resolved", "me"), 2: ("resolved", None)}
    rows = spark.createDataFrame([("a", "pending"), ("b", "done")], "id string, state string")
    moves = spark.createDataFrame([("a", "approved"), ("b", "pending")], "id string, to string")
    assert {r.id: (r.state, r.moved) for r in curate.step(rows, moves).collect()} == {"a": ("approved", True), "b": ("done", False)}


def test_ontology_and_quality(spark):
    terms = spark.createDataFrame([("u", "o1", "short", ["s"], False), ("u", "o2", "longer", None, False), ("v", "o1", "gone", None, True)], "uri string, ontology string, label string, synonyms array<string>, deprecated boolean")
    assert [(r.uri, r.label, r.synonyms) for r in ontology.merge_terms(terms).collect()] == [("u", "longer", ["s", "short"])]
    names = spark.createDataFrame([("e", "u", "shorts"), ("f", "x", "n"), ("g", "v", "gone")], "id string, term_uri string, name string")
    assert {(r.id, r.problem) for r in ontology.verify(names, terms.filter("ontology = 'o1'")).collect()} == {("f", "missing"), ("g", "deprecated")}
    rows = spark.createDataFrame([("a", "float"), ("b", "odd"), ("c", None)], "id string, data_type string")
    assert {(r.id, r.rule) for r in quality.violations(rows, {"type": F.col("data_type").isin(*quality.DATA_TYPES)}).collect()} == {("b", "type"), ("c", "type")}
    hits = spark.createDataFrame([("s", "b", 1.0), ("t", "a", 1.0)], "sha256 string, name string, score double")
    assert [r.sha256 for r in search.hybrid(hits, hits.withColumn("score", F.lit(0.5)), 5).collect()] == ["t", "s"]


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = windows.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.hour, r.event_type): r.n for r in spark.sql("select * from counts").collect()}
    batch = {(r.hour, r.event_type): r.n for r in windows.event_counts(spark.read.parquet(f"{sf}/events.parquet")).collect()}
    assert got and set(got.items()) <= set(batch.items())  # windows that the watermark has not passed are held back


def test_incremental_commit(spark, tmp_path):
    schema = "sha256 string, version int, x string, provenance array<struct<source:string,name:string>>"
    table = TableLog.create(spark, f"{tmp_path}/registry", spark.createDataFrame([], schema).schema)
    for i, rows in enumerate([[("h", 1, "a", [("s", "n")])], [("h", 2, "b", [("t", "n")]), ("k", 2, "c", [])]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/staged")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/staged")
        commit.commit_stream(stream, table, f"{tmp_path}/checkpoint").awaitTermination(120)
    got = {r.sha256: (r.x, [p.source for p in r.provenance]) for r in table.read(2).collect()}
    assert got == {"h": ("b", ["s", "t"]), "k": ("c", [])}


def test_candidates_need_a_threshold_that_meetings_reach(spark):
    schema = "id int, data_type string, term_uri string, min_value double, max_value double, choices array<string>, vector array<float>, hints array<string>, name string"
    rows = [(i, "s", None, 0.0, 1.0, ["yes", "no", f"c{i // 2}"], [1.0, 0.0], None, None) for i in range(6)] + [(6, "s", None, 0.0, 1.0, None, [1.0, 0.0], None, None), (7, "s", None, None, None, [], None, ["h"], "x"), (8, "s", None, None, None, None, None, ["h"], "")]
    df = spark.createDataFrame(rows, schema)
    try:
        align.candidates(df, 0.45)
        raise AssertionError("pairs that share nothing would be lost")
    except ValueError:
        pass
    got = {(r.a_id, r.b_id): r.score for r in align.candidates(df, 0.5).collect()}
    # 0.45 from vectors and ranges; 2 of 4 choices are 0.075, 3 of 3 are 0.15
    want = {(a, b): 0.6 if a // 2 == b // 2 else 0.525 for a in range(6) for b in range(a + 1, 6)} | {(7, 8): 0.95}
    assert {k: round(v, 4) for k, v in got.items()} == want
    assert {k for k, v in want.items() if v >= 0.55} == {(r.a_id, r.b_id) for r in align.candidates(df, 0.55).collect()}


def test_flags_resolved_twice_keep_both_resolvers(spark):
    stored = spark.createDataFrame([(i, "pending") for i in range(3)], "flag_id int, status string")
    for i, by in ((0, "a"), (1, "b"), (0, "c")):
        stored = curate.resolve_flags(stored, spark.createDataFrame([(i, "done", by)], "flag_id int, status string, resolved_by string"), F.lit(f"t{i}"))
    assert sorted((r.flag_id, r.status, r.resolved_by, r.resolved_at) for r in stored.collect() if r.status == "done") == [(0, "done", "a", "t0"), (1, "done", "b", "t1")]


def test_pages_refuse_other_columns(spark):
    try:
        browse.page_of("values", spark.range(1), "unit", 5)
        raise AssertionError("values do not sort by unit")
    except ValueError:
        pass


def test_queries_meet_entities_in_blocks(spark, monkeypatch):
    from regolith.operators import search

    monkeypatch.setattr(search, "BLOCK", 2)
    entities = spark.createDataFrame([(1, "element", "a", "Alpha beta"), (2, "value", "b", "beta"), (3, "other", "c", None)], "sha256 int, kind string, name string, text string")
    asked = spark.createDataFrame([(10, "BETA"), (11, "alpha"), (12, ""), (13, None), (14, "gamma"), (15, "beta"), (16, "a b")], "query int, phrase string")
    hits = search.lexical_each(entities, asked)
    assert sorted((r.query, r.sha256, r.score) for r in hits.collect()) == [(10, 1, 1.0), (10, 2, 0.8), (11, 1, 1.0), (15, 1, 1.0), (15, 2, 0.8), (16, 1, 1.0)]
    near = spark.createDataFrame([(10, 2, "z", 0.9), (10, 3, "c", 1.0)], "query int, sha256 int, name string, score double")
    best = search.hybrid_each(hits, near, 2)
    assert sorted((r.query, r["rank"], r.sha256, r.score) for r in best.collect()) == [(10, 1, 1, 1.0), (10, 2, 3, 1.0), (11, 1, 1, 1.0), (15, 1, 1, 1.0), (15, 2, 2, 0.8), (16, 1, 1, 1.0)]
    assert search.lexical_each(entities, asked.limit(0)).count() == 0


def test_one_result_for_any_order_of_rows(spark):
    """Contradicting decisions, flags, moves and datasets: the same rows in two orders give one result."""

    def both(rows, schema, of):
        out = [sorted(map(str, of(spark.createDataFrame(r, schema).coalesce(1)).collect())) for r in (rows, rows[::-1])]
        assert out[0] == out[1]
        return out[0]

    flags = spark.createDataFrame([(1, "pending")], "flag_id int, status string")
    decisions = [(1, "rejected", "a", 2), (1, "approved", "b", 3), (1, "waived", "c", 1)]
    schema = "flag_id int, status string, resolved_by string, at int"
    (got,) = both(decisions, schema, lambda d: curate.resolve_flags(flags, d, F.lit("t")))
    assert "status='approved'" in got
    (got,) = both(decisions, schema, lambda d: curate.resolve_flags(flags, d, F.lit("t"), ("at",)))
    assert "status='waived'" in got
    rows = spark.createDataFrame([("x", "pending")], "id string, state string")
    (got,) = both([("x", "rejected"), ("x", "approved")], "id string, to string", lambda d: curate.step(rows, d))
    assert "state='approved'" in got
    none = spark.createDataFrame([], "entity_ref string, flag_type string, reason string")
    both([("e", "f", "z"), ("e", "f", None), ("e", "f", "y")], "entity_ref string, flag_type string, reason string", lambda d: curate.add_flags(none, d))
    jobs = spark.createDataFrame([], "repository_url string")
    (got,) = both([("u", "s2", "b"), ("u", "s1", "c")], "url string, source string, adapter string", lambda d: curate.queued_datasets(d, jobs, {}))
    assert "adapter_type='c'" in got
    stored = spark.createDataFrame([("k0", 1)], "k string, v int")
    got = both([("k1", 5), ("k1", 3), ("k0", 7), (None, 2), (None, 1)], "k string, v int", lambda d: merge.insert_absent(stored, d, ["k"]))
    assert got == sorted(["Row(k='k1', v=3)", "Row(k=None, v=1)"])
    both([("r", 2), ("r", 1)], "run_id string, v int", lambda d: merge.imported({}, {"runs": d})["runs"])


def test_specs_of_known_sources(spark):
    from regolith.sources import extraction_specs
    from regolith.sources.documents import entities

    rows = entities(spark.createDataFrame([("columns", "age", "attribute", "integer"), ("enums", "CASL", "attribute", None)], "c string, n string, t string, d string"), entity_type=F.col("t"), **{"class": F.col("c")}, name=F.col("n"), data_type=F.col("d"))
    got = quality.extraction_issues(rows, extraction_specs.spec_of("bids")).collect()
    assert [(r["name"], r.expected) for r in got if r.issue == "classification"] == [("CASL", "enum_value")] * 2  # by category and by name
    assert [(r["name"], r.expected) for r in got if r.issue == "field"] == [("CASL", "data_type")]
    assert {r["name"] for r in got if r.issue == "missing" and r["name"]} == {"sex", "RepetitionTime", "TaskName", "left_hemisphere", "T1w", "bold", "anat"}
    assert {r.entity_type for r in got if r.issue == "missing" and not r["name"]} == {"attribute", "enum_value", "valueset", "class"}
    for source in ("dandi", "nwb", "openminds", "aind"):
        assert quality.extraction_issues(rows, extraction_specs.spec_of(source)).count() > 3
    assert quality.extraction_issues(rows, {}).collect() == []
