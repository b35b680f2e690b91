import pytest

from quadlake.plans.compiler import query
from quadlake.plans.parser import SparqlError, parse
from quadlake.streaming import incremental

P = "PREFIX : <u:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "


@pytest.fixture
def q(quads):
    return quads(("u:g", "u:a", "u:p", "u:b"), ("u:g", "u:b", "u:p", "u:c"), ("u:g", "u:c", "u:p", "u:a"), ("u:g", "u:a", "u:l", '"one'), ("u:h", "u:b", "u:l", '"two'), ("u:h", "u:a", "u:l", '"one'))


def run(q, text):
    return sorted(tuple(r) for r in query(q, P + text).collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT ?x { ?x :p ?y }", []),  # the default graph is empty
        ("SELECT ?x ?l { GRAPH :g { ?x :p :b ; :l ?l } }", [("u:a", "one")]),
        ("SELECT ?g ?l { GRAPH ?g { :a :l ?l } }", [("u:g", "one"), ("u:h", "one")]),
        ("SELECT DISTINCT ?l { GRAPH ?g { :a :l ?l } }", [("one",)]),
        ("SELECT ?y { GRAPH :g { :a :p+ ?y } }", [("u:a",), ("u:b",), ("u:c",)]),
        ("SELECT ?y { GRAPH :g { ?y :p+ :b } }", [("u:a",), ("u:b",), ("u:c",)]),
        ("SELECT ?y { GRAPH :g { :a :p? ?y } }", [("u:a",), ("u:b",)]),
        ("SELECT ?y { GRAPH :g { :a :p/:p ?y } }", [("u:c",)]),
        ("SELECT ?y { GRAPH :g { :b ^:p ?y } }", [("u:a",)]),
        ("SELECT ?x { GRAPH :g { ?x :p ?y } MINUS { GRAPH :h { ?x :l ?l } } }", [("u:c",)]),
        ("SELECT ?x { GRAPH :g { ?x :p ?y } MINUS { GRAPH :h { ?z :l ?l } } }", [("u:a",), ("u:b",), ("u:c",)]),
        ("SELECT ?x { GRAPH :g { ?x :p ?y } FILTER NOT EXISTS { GRAPH :h { ?x :l ?l } } }", [("u:c",)]),
        ('SELECT ?x { GRAPH :g { ?x :l ?l } FILTER EXISTS { GRAPH :h { ?z :l ?m FILTER(?m = ?l) } } }', [("u:a",)]),
        ('SELECT ?x { GRAPH :g { ?x :p ?y } OPTIONAL { GRAPH :h { ?x :l ?l } } FILTER NOT EXISTS { GRAPH :g { ?z :l ?m FILTER(?m = ?l) } } }', [("u:b",), ("u:c",)]),
        ('SELECT ?x { GRAPH :h { ?x :l ?l } FILTER NOT EXISTS { GRAPH :g { { ?z :l ?m } UNION { ?z :p ?m } FILTER(STR(?m) = STR(?l) && ?z != :q) } } }', [("u:b",)]),
        ('SELECT ?x { GRAPH :h { ?x :l ?l } FILTER EXISTS { GRAPH :g { ?x :p ?y OPTIONAL { ?y :l ?m } FILTER(?l = "one") } } }', [("u:a",)]),
        ('SELECT ?x { GRAPH :h { ?x :l ?l } FILTER EXISTS { BIND(?l AS ?m) FILTER(?m = "two") } }', [("u:b",)]),
        ("SELECT ?x { GRAPH :g { ?x :p ?y } OPTIONAL { GRAPH :h { ?x :l ?l } } MINUS { GRAPH :g { ?z :l ?l } } }", [("u:b",), ("u:c",)]),
        ("SELECT ?x { GRAPH :g { ?x :p ?y } MINUS { OPTIONAL { GRAPH :g { ?x :l ?l } } } }", [("u:b",), ("u:c",)]),
        ("SELECT ?x { GRAPH :g { ?x :p/:p ?y } FILTER NOT EXISTS { GRAPH :h { ?x ^:p/:l ?l } } FILTER EXISTS { GRAPH :g { ?x :p/:p/:p ?x } } }", [("u:a",), ("u:b",), ("u:c",)]),
        ("SELECT ?x { GRAPH :g { ?x :p ?y } FILTER(?nope = 1 || ?x = :a) }", [("u:a",)]),
        ("SELECT ?x ?v { GRAPH :g { ?x :p ?y } VALUES (?x ?v) { (:a 1) (UNDEF 2) } }", [("u:a", "1"), ("u:a", "2"), ("u:b", "2"), ("u:c", "2")]),
        ("SELECT (COUNT(*) AS ?n) (MIN(?l) AS ?m) { GRAPH :none { ?x :l ?l } }", [("0", None)]),
        ('SELECT (CONCAT(STR(?x), "!") AS ?z) { GRAPH :g { ?x :p :b } }', [("u:a!",)]),
        ("SELECT ?x { GRAPH :g { ?x :p [ :p :c ] } }", [("u:a",)]),
        ('SELECT ?v { BIND("1"^^xsd:integer + 1.0 AS ?v) }', [("2",)]),
        ("SELECT ?x ?y { { SELECT ?x { GRAPH :g { ?x :l ?l } } } GRAPH :g { ?x :p ?y } }", [("u:a", "u:b")]),
    ],
)
def test_queries(q, text, want):
    assert run(q, text) == want


def test_optional_and_order(q):
    got = [tuple(r) for r in query(q, P + "SELECT ?x ?l { GRAPH :g { ?x :p ?y } OPTIONAL { GRAPH :h { ?x :l ?l FILTER(?l != \"one\") } } } ORDER BY ?l ?x").collect()]
    assert got == [("u:a", None), ("u:c", None), ("u:b", "two")]


def test_maybe_bound_join(q):
    text = "SELECT ?x ?l { GRAPH :g { ?x :p ?y } OPTIONAL { GRAPH :h { ?x :l ?l } } GRAPH :h { :b :l ?l } }"
    assert run(q, text) == [("u:b", "two"), ("u:c", "two")]


def test_maybe_bound_sides_are_joined_by_equality(q):
    both = "SELECT ?x ?l ?z { { GRAPH :g { ?x :p ?y } OPTIONAL { GRAPH :h { ?x :l ?l } } } { GRAPH :g { ?z :p ?w } OPTIONAL { GRAPH :g { ?z :l ?l } } } }"
    assert sorted(str(tuple(r)) for r in query(q, P + both).collect()) == sorted(map(str, [("u:a", "one", "u:a"), ("u:a", "one", "u:b"), ("u:a", "one", "u:c"), ("u:b", "two", "u:b"), ("u:b", "two", "u:c"), ("u:c", "one", "u:a"), ("u:c", None, "u:b"), ("u:c", None, "u:c")]))
    left = "SELECT ?x ?l ?z { GRAPH :g { ?x :p ?y } OPTIONAL { GRAPH :h { ?x :l ?l } } OPTIONAL { GRAPH :g { ?z :l ?l } } }"
    assert {tuple(r) for r in query(q, P + left).collect()} == {("u:a", "one", "u:a"), ("u:b", "two", None), ("u:c", "one", "u:a")}
    seen = "SELECT ?x { GRAPH :g { ?x :p ?y } OPTIONAL { GRAPH :h { ?x :l ?l } } GRAPH :h { :b :l ?l } }"
    plan = query(q, P + seen)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x]
    assert any("=" in x for x in joins)  # the bound rows; the unbound ones fit any row


@pytest.mark.parametrize("text", ["SELECT ?x { SERVICE <u:s> { ?x ?y ?z } }", "SELECT ?x FROM <u:g> { ?x ?y ?z }", "LOAD <u:x>", "ASK { ?x ?y ?z }", "SELECT { ?x ?y ?z }", "SELECT ?x { ?x nope:y ?z }", "SELECT ?x { ?x ?y ?z } extra"])
def test_refusals(text):
    with pytest.raises(SparqlError):
        parse(text)


def test_theta_is_an_equi_join(q):
    df = query(q, P + "SELECT ?x ?m { GRAPH :g { :a :p ?m } GRAPH :g { ?x :p ?y } FILTER(?x = :a || ?x = ?m) }")
    assert sorted(tuple(r) for r in df.collect()) == [("u:a", "u:b"), ("u:b", "u:b")]
    assert "NestedLoop" not in df._jdf.queryExecution().toString() and "CartesianProduct" not in df._jdf.queryExecution().toString()


def test_stream_lift(spark, q, tmp_path):
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        incremental.lift_stream(stream, lambda b: b.filter("p = 'u:p'"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


BODIES = [
    ("GRAPH :g { ?z :l ?m FILTER(?m = ?l && ?z != ?x) }", "="), ("GRAPH :g { ?z :l ?m FILTER(?m = ?l && ?z != ?x) } GRAPH :h { ?x :q ?k FILTER(?k > 1) }", "="), ("GRAPH :g { ?z :p ?w . ?z :l ?m . ?x :l ?k FILTER(?w = ?y && STR(?m) < STR(?k)) }", "="),
    ("GRAPH :g { ?z :l ?m } FILTER(?m < ?l)", None), ("GRAPH :g { ?z :l ?m } FILTER(?l <= ?m && ?z = ?y)", "="), ("GRAPH :h { ?z :q ?m } FILTER(?m > ?l)", None), ("GRAPH :h { ?z :q ?m } FILTER(?l >= ?m)", None), ("GRAPH :h { ?z :q ?m } FILTER(?l != ?m)", None),
    ("GRAPH :h { ?z :q ?m } FILTER(?l != ?m && ?z != ?x && ?z = ?y)", "="), ("GRAPH :g { ?z :l ?m } FILTER(CONTAINS(STR(?z), STR(?l)) || ?m = ?l)", None), ("GRAPH ?h { ?x :q ?m } GRAPH ?h { ?z :q ?n } FILTER(?n > ?m && ?l != \"x\")", "="), ("GRAPH :g { ?x :p ?y . ?z :l ?m } GRAPH :h { :n0 :q ?k } FILTER(?k + ?m = ?l)", None),
    ("{ GRAPH :g { ?z :l ?m } FILTER(?n = ?l) } GRAPH :h { ?z :q ?n }", None), ("{ GRAPH :g { ?z :l ?m } FILTER(?m = ?l) } UNION { GRAPH :h { ?x :q ?m . ?z :q ?n FILTER(?n = ?l) } }", None),
]


@pytest.mark.parametrize(("body", "keys"), BODIES)
def test_correlated_exists_pairs_no_rows(spark, monkeypatch, body, keys):
    import random

    from quadlake.plans import compiler

    draw, xsd = random.Random(5), "http://www.w3.org/2001/XMLSchema#"
    value = lambda: draw.choice([("1", "integer"), ("1.0", "decimal"), ("2", "integer"), ("2", "string"), ("10", "integer"), ("x", "string"), ("y", "string"), ("", "string"), ("-0.0", "double"), ("0", "integer"), ("NaN", "double")])
    rows = [(f"u:{g}", f"u:n{k}", f"u:{p}", v, "literal", xsd + t, None) for k in range(9) for g, p in (("g", "l"), ("h", "q")) for v, t in {value() for _ in range(draw.randrange(3))}]
    rows += [("u:g", f"u:n{k}", "u:p", f"u:n{draw.randrange(9)}", "iri", None, None) for k in range(9)]
    quads = spark.createDataFrame(rows, "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string").cache()
    texts = [P + f"SELECT ?x ?y ?l {{ GRAPH :g {{ ?x :p ?y ; :l ?l }} FILTER {how} {{ {body} }} }}" for how in ("EXISTS", "NOT EXISTS")]
    got = [query(quads, t, terms=True) for t in texts]
    if keys:
        plan = got[0]._jdf.queryExecution().optimizedPlan().toString()
        assert all("=" in x for x in plan.splitlines() if "Join " in x)
    monkeypatch.setattr(compiler.Compiler, "supported", lambda *_: None)
    want = [sorted(tuple(r) for r in query(quads, t, terms=True).collect()) for t in texts]
    assert [sorted(tuple(r) for r in df.collect()) for df in got] == want and sum(map(len, want)) == query(quads, P + "SELECT ?x ?l { GRAPH :g { ?x :p ?y ; :l ?l } }").count()
