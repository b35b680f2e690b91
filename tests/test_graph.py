import pytest
from pyspark.sql import functions as F

from quadlake.functions import terms as T
from quadlake.operators import closure as K
from quadlake.operators import context as C
from quadlake.operators import provenance as P
from quadlake.operators import quads as Q
from quadlake.operators import rules as R
from quadlake.sources import turtle


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sets_and_stats(quads):
    q = quads(("u:g", "u:a", "u:p", "u:b"), ("u:h", "u:a", "u:p", "u:b"), ("u:g", "u:a", "u:p", '"x'))
    assert Q.triples(q).count() == 2 and Q.union(q, q).count() == 3
    assert rows(Q.stats(q)) == [(3, 2, 1, 3)]
    assert Q.match(q, g="u:h").count() == 1 and Q.minus(q, Q.match(q, g="u:h")).count() == 2


def test_save_and_prune(quads, spark, tmp_path):
    q = quads(("u:g", "u:a", "u:p", "u:b"), ("u:g", "u:a", "u:q", "u:b"))
    Q.save(q, str(tmp_path / "q"))
    back = Q.match(Q.load(spark, str(tmp_path / "q")), p="u:p")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(p" in back._jdf.queryExecution().toString()


def test_records_and_assertions(spark):
    df = spark.createDataFrame([(0, "x"), (1, "x")], "row long, v string")
    recs = P.records(df.select("row", "v"), "u:", F.lit("u:snap"), T.row_locator(F.col("row")), F.col("v"), T.canonical_json(F.struct("v")))
    assert recs.select("record_id").distinct().count() == 2 and recs.select("payload_json").distinct().count() == 1
    assert P.unique_records(recs).count() == 2
    with pytest.raises(Exception, match="duplicate physical row"):
        P.unique_records(recs.unionByName(recs)).collect()
    facts = recs.select(F.lit("u:g").alias("g"), F.lit("u:s").alias("s"), F.lit("u:p").alias("p"), F.col("v").alias("o"), F.lit("literal").alias("o_kind"), F.lit(T.STRING).alias("o_dt"), F.lit(None).cast("string").alias("o_lang"), "record_id")
    said = P.assertions(facts, "u:", "u:act")
    assert said.count() == 2 and P.reify(said, "u:", "u:prov").count() == 16
    assert P.reify(said, "u:", "u:prov", F.lit(True)).count() == 20
    snaps = spark.createDataFrame([("u:snap",)], "snapshot_id string")
    assert rows(P.coverage(facts, said, recs, snaps)) == [(1, 1, 100.0, 0)]
    assert rows(P.coverage(facts.withColumn("s", F.lit("u:untracked")), said, recs, snaps)) == [(0, 1, 0.0, 0)]


@pytest.mark.parametrize("graphs", [("u:g", "u:g"), ("u:g", "u:h")])
def test_conflicts(quads, graphs):
    q = quads((graphs[0], "u:a", "u:has", "u:x"), (graphs[1], "u:a", "u:not", "u:x"), ("u:g", "u:a", "u:not", "u:y"))
    assert rows(P.conflicts(q, "u:has", "u:not")) == [("u:a", "u:x", *graphs)]


def test_candidates_and_isolation(spark, quads):
    xrefs = spark.createDataFrame([("u:a", "D:1"), ("u:a", "D:2"), ("u:a", "Z:3")], "s string, xref string")
    maps = spark.createDataFrame([("u:a", "u:d/1")], "s string, object string")
    assert [r["identifier"] for r in P.candidates(xrefs, maps, {"D": "u:d/"}, "u:").orderBy("identifier").collect()] == ["D:2", "Z:3"]
    q = quads(("u:g", "u:a", "u:stage", '"2'), ("u:g", "u:b", "u:stage", '"3'), ("u:g", "u:a", "u:one", '"1'))
    assert P.misplaced(q, "u:stage", q.filter("s = 'u:a'").select("s")).count() == 1
    assert rows(P.not_exactly_one(q, q, ["u:stage", "u:one"])) == [("u:b", "u:one", 0)]
    kept, gone = P.projection(q, ["u:stage"])
    assert Q.difference(q, kept.unionByName(gone)).isEmpty() and gone.count() == 2


def context(spark, ind=True, mech=True):
    ct = spark.createDataFrame([("d1", "t1"), ("d2", "t9")], "drug string, target string")
    i = spark.createDataFrame([("d1", "i1")] if ind else [], "drug string, rec string")
    m = spark.createDataFrame([("d1", "t1", "m1"), ("d1", "t1", "m2")] if mech else [], "drug string, target string, rec string")
    return ct, i, m


def test_supported_paths(spark):
    ct, i, m = context(spark)
    legs = [(i, ["drug"]), (m, ["drug", "target"])]
    assert rows(C.supported_paths(ct, legs)) == [("d1", "t1")]
    assert rows(C.unsupported_paths(ct, legs).select("drug", "missing_legs")) == [("d2", 2)]
    assert rows(C.path_evidence(C.supported_paths(ct, legs), ["drug", "target"], [(i, ["drug"], "rec"), (m, ["drug", "target"], "rec")]).select("evidence")) == [("i1",), ("m1",), ("m2",)]
    with pytest.raises(Exception, match="no support"):
        C.supported_paths(ct, legs, strict=True).collect()


@pytest.mark.parametrize("missing", ["ind", "mech"])
def test_missing_leg(spark, missing):
    ct, i, m = context(spark, **{missing: False})
    assert C.supported_paths(ct, [(i, ["drug"]), (m, ["drug", "target"])]).isEmpty()


def test_selection_and_resolution(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, ["z"]), (3, None)], "id long, x array<string>")
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    assert [r["id"] for r in C.overlapping(df, "x", keys, "k", "id").collect()] == [1]
    refs = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "r string")
    cat = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    assert {r["r"]: r["status"] for r in C.resolve(refs, cat, "r", "id").collect()} == {"a": "resolved", "b": "ambiguous", "c": "unresolved", None: "unresolved"}
    assert C.exactly_one(df.filter("id = 1")).count() == 1
    for bad, what in ((df, "more than one"), (df.limit(0), "no row")):
        with pytest.raises(Exception, match=what):
            C.exactly_one(bad).collect()
    twins = spark.createDataFrame([(1, [("x", 1), ("x", 1)]), (2, None)], "id long, e array<struct<a: string, b: int>>")
    assert rows(twins.select("id", C.duplicate_elements(F.col("e")))) == [(1, 1), (2, 0)]


@pytest.mark.parametrize(("edges", "want"), [([("a", "b"), ("b", "c"), ("c", "d"), ("b", "d")], 6), ([("a", "b"), ("b", "c"), ("c", "d"), ("b", "d"), ("d", "b")], 12)])
def test_closure(spark, edges, want):
    got = K.closure(spark.createDataFrame(edges, "s string, o string"))
    assert got.count() == want and got.filter("s = o").count() == (3 if want == 12 else 0)


def test_shortest_path_and_hierarchy(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "s string, o string")
    assert [r["path"] for r in K.shortest_paths(e, e.filter("s = 'a'")).filter("o = 'd'").collect()] == [["a", "c", "d"]]
    assert K.acyclic_closure(e).count() == K.closure(e).count()
    with pytest.raises(ValueError, match="missing parent u:B of u:A"):
        K.hierarchy(spark.createDataFrame([("u:A", ["u:B"])], "uri string, parents array<string>"))


ONTOLOGY = """@prefix u: <urn:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
u:Disease rdfs:subClassOf u:Concept . u:has rdfs:subPropertyOf u:annotated ; rdfs:domain u:Disease ; rdfs:range u:Term ; owl:inverseOf u:of . u:hasNot rdfs:domain u:Concept .
u:part a owl:TransitiveProperty .
u:Annotated owl:equivalentClass [ owl:intersectionOf ( u:Disease [ owl:onProperty u:has ; owl:someValuesFrom u:Term ] ) ] ."""
AX = R.Axioms.of(turtle.skolemise(turtle.parse(ONTOLOGY), "urn:node/"))
TYPE = Q.TYPE


def test_rules(quads):
    got = {(r["s"], r["p"], r["o"]) for r in R.infer(quads(("g", "urn:d", "urn:has", "urn:t"), ("g", "urn:x", "urn:part", "urn:y"), ("g", "urn:y", "urn:part", "urn:z"), ("g", "urn:d", "urn:has", '"lit')), AX).collect()}
    assert {("urn:d", TYPE, "urn:Annotated"), ("urn:t", "urn:of", "urn:d"), ("urn:d", "urn:annotated", "urn:t"), ("urn:t", TYPE, "urn:Term"), ("urn:d", TYPE, "urn:Concept"), ("urn:x", "urn:part", "urn:z")} <= got
    assert not any(s == "lit" for s, _, _ in got)


def test_rules_need_the_positive_premise(quads):
    q = quads(("g", "urn:d", "urn:hasNot", "urn:t"), ("g", "urn:t", TYPE, "urn:Term"))
    got = {(r["s"], r["p"], r["o"]) for r in R.infer(q, AX).collect()}
    assert got == {("urn:d", TYPE, "urn:Concept")}
    both = q.unionByName(quads(("g", "urn:d", "urn:has", "urn:t")))
    assert ("urn:d", TYPE, "urn:Annotated") in {(r["s"], r["p"], r["o"]) for r in R.ablate(both, AX, "urn:has").collect()}
    assert R.generalized(quads(("g", "urn:d", "urn:has", '"lit')), AX).first()["n"] == 2
    want = quads(("g", "urn:d", TYPE, "urn:Annotated"))
    assert R.absent(R.infer(q, AX), want).count() == 1 and R.absent(R.infer(both, AX), want).isEmpty()
    assert R.statements(R.infer(q, AX), "u:", "u:event", "u:inf").count() == 1


def test_reasoning_projection_fails_closed(quads):
    asserted = quads((None, "u:a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "u:C"), (None, "u:C", "http://www.w3.org/2000/01/rdf-schema#subClassOf", "u:D"))
    schema = quads((None, "u:Hidden", "u:p", "u:x"))
    full = P.review(asserted, schema, ["u:note"], ["u:rel"])
    kept, gone = P.reasoning(full, asserted, ["u:Hidden"])
    assert Q.difference(kept.unionByName(gone), full).isEmpty() and gone.count() == 1
    for wrong in (quads((None, "u:a", "u:p", "u:Hidden")), quads((None, "u:Hidden", "u:p", "u:y"))):
        with pytest.raises(Exception, match="excluded term"):
            P.reasoning(P.review(asserted.unionByName(wrong), schema, [], []), asserted.unionByName(wrong), ["u:Hidden"])[0].collect()


def test_closures_have_no_length_cap(spark):
    e = spark.createDataFrame([(f"u:{k:03d}", f"u:{k + 1:03d}") for k in range(60)], "s string, o string")
    assert K.acyclic_closure(e).count() == 60 * 61 // 2
    with pytest.raises(Exception, match="RECURSION"):
        K.acyclic_closure(e, max_depth=20).collect()
    with pytest.raises(ValueError, match="no fixpoint"):
        K.closure(e.limit(4), max_steps=1)


def test_anchor(spark):
    from quadlake.operators import context as C

    classes = spark.createDataFrame([("u:a", ["x"], False), ("u:b", ["x"], True), ("u:c", ["y"], False)], "uri string, labels array<string>, deprecated boolean")
    assert C.anchor(classes, "x", "u:a").count() == 1
    for label, expected in (("y", "u:a"), ("z", "u:a")):
        with pytest.raises(Exception, match="anchor"):
            C.anchor(classes, label, expected).collect()


def test_recursive_closure_has_no_row_limit(spark):
    e = spark.createDataFrame([(f"u:{k:03d}", f"u:{k + 1:03d}") for k in range(30)], "s string, o string")
    before = spark.conf.get(limit := "spark.sql.cteRecursionRowLimit")
    spark.conf.set(limit, "100")
    try:
        assert K.acyclic_closure(e).count() == 30 * 31 // 2
    finally:
        spark.conf.set(limit, before)
