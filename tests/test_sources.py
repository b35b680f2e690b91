import pytest
from pyspark.sql import functions as F

from quadlake.operators import integrity as I
from quadlake.operators import quads as Q
from quadlake.sources import readers, sinks, turtle

OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#">
<owl:Class rdf:about="u:A"><rdfs:label xml:lang="en">a</rdfs:label><rdfs:subClassOf rdf:resource="u:B"/><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="u:p"/></owl:Restriction></rdfs:subClassOf></owl:Class>
<owl:Class rdf:about="u:C"><rdfs:label>c</rdfs:label><owl:deprecated>true</owl:deprecated></owl:Class>
</rdf:RDF>"""


def test_owl_classes(spark, tmp_path):
    (tmp_path / "o.owl").write_text(OWL)
    rows = {r["uri"]: r for r in readers.owl_classes(spark, str(tmp_path / "o.owl")).collect()}
    assert rows["u:A"]["parents"] == ["u:B"] and rows["u:A"]["n_restrictions"] == 1 and rows["u:A"]["labels"] == ["a"] and not rows["u:A"]["deprecated"]
    assert rows["u:C"]["deprecated"]


def test_delimited(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text('#version: 7\n#x\nid\tname\n1\tone\n2\t"two\t2"\n')
    got = readers.delimited(spark, str(p), "id string, name string").orderBy("line").collect()
    assert [tuple(r) for r in got] == [(4, "1", "one"), (5, "2", "two\t2")]
    assert readers.delimited_header(spark, str(p)).first()["version"] == "7"
    p.write_text("id\tname\n1\tone\tmore\n")
    with pytest.raises(Exception, match="wrong number of fields"):
        readers.delimited(spark, str(p), "id string, name string").collect()


def test_row_index_survives_filters(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    assert [r["row_index"] for r in readers.parquet_rows(spark, str(tmp_path / "t")).filter("id = 42").collect()] == [42]


def test_nquads_round_trip(spark, tmp_path, quads):
    q = quads(("u:g", "u:s", "u:p", "u:o"), ("u:g", "u:s", "u:p", '"a"b\\c\nd\té'), ("u:h", "u:s", "u:p", '"')).unionByName(spark.createDataFrame([("u:g", "u:s", "u:p", "1", "literal", "http://www.w3.org/2001/XMLSchema#integer", None), ("u:g", "u:s", "u:p", "hi", "literal", None, "en")], q_schema()))
    sinks.write_sorted(q, str(tmp_path / "q"), single=True)
    back = readers.nquads(spark, str(tmp_path / "q"))
    assert Q.difference(q, back.select(*Q.QUAD)).isEmpty()
    lines = [r[0] for r in spark.read.text(str(tmp_path / "q")).collect()]
    assert lines == sorted(lines)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.nq").write_text("<u:s> nonsense .\n")
    with pytest.raises(Exception, match="not a statement"):
        readers.nquads(spark, str(tmp_path / "bad")).collect()


def test_nquads_escapes_and_blank_nodes(spark):
    lines = [r'_:b0 <u:p> "caf\u00e9 \\u00e9 \U0001F600 \"q\" \t\b" .', r"<u:a\u0062> <u:p> _:b0 _:g .", '<u:s><u:p>"x"@en<u:g>. # note', '<u:s> <u:p> "" .', "# only a note", " "]
    q = readers.parse_nquads(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {(r["g"], r["s"], r["o"], r["o_kind"], r["o_lang"]) for r in q.collect()}
    assert got == {(None, "_:b0", 'café \\u00e9 😀 "q" \t\b', "literal", None), ("_:g", "u:ab", "_:b0", "bnode", None), ("u:g", "u:s", "x", "literal", "en"), (None, "u:s", "", "literal", None)}
    back = readers.parse_nquads(q.select(sinks.line().alias("value")))
    assert Q.difference(q.select(*Q.QUAD), back.select(*Q.QUAD)).isEmpty()
    for bad in ('<u:s> <u:p> "a"b" .', '<u:s> <u:p> "a\\" .', '<u:s> <u:p> "a .', "<u:s> <u:p> <u:o> <u:g>", '"x" <u:p> <u:o> .'):
        with pytest.raises(Exception, match="not a statement"):
            readers.parse_nquads(spark.createDataFrame([(bad,)], "value string")).collect()


def test_policy_and_inventory(spark, tmp_path):
    text = "project:\n  scope: one # a note\npolicy:\n  downloads: false\n"
    assert readers.policy(text, {"project.scope": "one", "policy.downloads": "false"})["project.scope"] == "one"
    with pytest.raises(ValueError, match="downloads"):
        readers.policy(text, {"policy.downloads": "true"})
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.txt").write_text("x")
    assert tuple(readers.inventory(spark, str(tmp_path), {"src": ("1.2", "header")}).select("source", "version", "version_basis", "bytes").first()) == ("src", "1.2", "header", 1)


def test_equal_blank_nodes_stay_apart():
    twice = turtle.skolemise(turtle.parse("@prefix u: <urn:> . u:a u:p [ u:q 1 ], [ u:q 1 ] ."), "u:n/")
    assert len(twice) == 4 and twice == turtle.skolemise(turtle.parse("@prefix u: <urn:> . u:a u:p [ u:q 1 ] , [ u:q 1 ] . "), "u:n/")


def q_schema():
    return "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string"


def test_turtle():
    text = """@prefix u: <urn:> . # a comment
    u:a a u:C ; u:n 1, 2.5, true ; u:l "x"@en, "y\\"z" ; u:list ( u:b "c" ) ; u:blank [ u:p u:q ] .
    """
    got = turtle.parse(text)
    assert ("urn:a", "1") in {(s.value, o.value) for s, _, o in got}
    assert any(o.value == 'y"z' for _, _, o in got) and any(o.lang == "en" for _, _, o in got)
    assert sum(p.value.endswith("first") for _, p, _ in got) == 2
    assert turtle.skolemise(got, "u:") == turtle.skolemise(turtle.parse(text.replace("u:blank", "u:blank ")), "u:")
    assert all(t.kind != "bnode" for x in turtle.skolemise(got, "u:") for t in x)
    with pytest.raises(ValueError):
        turtle.parse("u:a u:b u:c .")


def test_integrity(spark, tmp_path):
    for n in ("a", "b", "c"):
        (tmp_path / n).write_text(n * 5)
    files = readers.files(spark, str(tmp_path)).withColumn("path", F.substring_index("path", "/", -1))
    I.verify(files, files)
    (tmp_path / "a").write_text("x" * 5)
    assert [tuple(r) for r in I.compare(readers.files(spark, str(tmp_path)).withColumn("path", F.substring_index("path", "/", -1)), spark.createDataFrame([(n, 5, __import__("hashlib").sha256(n.encode() * 5).hexdigest()) for n in "abd"], "path string, bytes long, sha256 string")).orderBy("path").collect()] == [("a", "checksum"), ("c", "unregistered file"), ("d", "missing file")]
    with pytest.raises(ValueError):
        I.verify(files, files.filter("path <> 'b'"))
    I.freeze(files, str(tmp_path / "frozen"))
    with pytest.raises(Exception, match="(?i)exists"):
        I.freeze(files, str(tmp_path / "frozen"))
    assert [r[0] for r in I.outside(spark.createDataFrame([("/in/a",), ("/in/../b",), ("/out",)], "path string"), "/in").collect()] == ["/in/../b", "/out"]
    assert [tuple(r) for r in I.coverage(files, files, files.filter("path <> 'c'")).collect()] == [("c", "file,listing")]


def test_views_and_report(quads):
    q = quads(("u:src", "u:a", "u:maps", "u:b"), ("u:inf", "u:a", "u:t", "u:c"), ("u:prov", "u:r", "u:t", "u:d"))
    v = sinks.views(q, "u:inf", "u:prov", ["u:maps"])
    assert {k: x.count() for k, x in v.items()} == {"asserted": 1, "inferred": 1, "provenance": 1, "mappings": 1, "reasoning": 2}
    assert "| b | 2 |" in sinks.report("t", {"b": 2, "a": 1})
