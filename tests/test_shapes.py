import pytest
from pyspark.sql import functions as F

from quadlake.operators import shapes as S
from quadlake.operators.quads import TYPE
from quadlake.sources import turtle

SHAPES = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix u: <urn:> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
u:RecordShape a sh:NodeShape ; sh:targetClass u:Record ; sh:nodeKind sh:IRI ;
  sh:property [ sh:path u:id ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:string ; sh:minLength 2 ; sh:pattern "^[a-z]+$" ] ;
  sh:property [ sh:path u:status ; sh:in ( "open" "done" ) ] ; sh:property [ sh:path u:stage ; sh:maxCount 0 ] ;
  sh:property [ sh:path u:row ; sh:datatype xsd:integer ; sh:minInclusive 0 ] ; sh:property [ sh:path u:kind ; sh:hasValue u:K ] ;
  sh:property [ sh:path u:from ; sh:nodeKind sh:IRI ; sh:class u:Snapshot ] ;
  sh:property [ sh:path u:by ; sh:qualifiedValueShape [ sh:class u:Snapshot ] ; sh:qualifiedMinCount 1 ] .
u:LinkShape a sh:NodeShape ; sh:targetSubjectsOf u:from ; sh:class u:Entity ."""
SHAPE = S.from_turtle(turtle.parse(SHAPES))


@pytest.fixture
def good(spark, quads):
    q = quads(
        ("g", "u:r", TYPE, "urn:Sub"), ("g", "urn:Sub", "http://www.w3.org/2000/01/rdf-schema#subClassOf", "urn:Record"), ("g", "urn:Record", "http://www.w3.org/2000/01/rdf-schema#subClassOf", "urn:Entity"), ("g", "u:r", "urn:id", '"abc'),
        ("g", "u:r", "urn:status", '"open'), ("g", "u:r", "urn:kind", "urn:K"), ("g", "u:r", "urn:from", "u:s"), ("g", "u:r", "urn:by", "u:s"), ("g", "u:s", TYPE, "urn:Snapshot"),
    )
    return q.unionByName(spark.createDataFrame([("g", "u:r", "urn:row", "3", "literal", "http://www.w3.org/2001/XMLSchema#integer", None)], q.schema))


def test_good_conforms(good):
    bad = S.mutate_drop(good, "urn:id")
    v = S.validate(bad, SHAPE)
    assert S.report_quads(v, "u:", "g:v").filter(F.col("p") == TYPE).count() == 1
    assert S.conforms(S.validate(good, SHAPE))  # the mutation didn't touch the original


LIT = ("literal", "http://www.w3.org/2001/XMLSchema#string", None)
IRI = ("iri", None, None)


@pytest.mark.parametrize(
    ("drop", "add", "want"),
    [
        ("urn:id", [], {"MinCount"}), (None, [("urn:id", "other", *LIT)], {"MaxCount"}), ("urn:id", [("urn:id", "abc", "literal", "u:dt", None)], {"Datatype"}), ("urn:id", [("urn:id", "a", *LIT)], {"MinLength"}), ("urn:id", [("urn:id", "A1", *LIT)], {"Pattern"}),
        ("urn:status", [("urn:status", "lost", *LIT)], {"In"}), (None, [("urn:stage", "2", *LIT)], {"MaxCount"}), ("urn:row", [("urn:row", "-1", "literal", "http://www.w3.org/2001/XMLSchema#integer", None)], {"MinInclusive"}), ("urn:kind", [], {"HasValue"}),
        (None, [("urn:from", "x", *LIT)], {"NodeKind", "Class"}), (None, [("urn:from", "u:untyped", *IRI)], {"Class"}), ("urn:by", [], {"QualifiedMinCount"}),
    ],
)
def test_mutations(good, drop, add, want):
    q = S.mutate_drop(good, drop, "u:r") if drop else good
    q = S.mutate_add(q, *[("g", "u:r", *x) for x in add]) if add else q
    v = S.validate(q, SHAPE)
    assert {r["component"] for r in v.collect()} == want
