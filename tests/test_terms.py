import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quadlake.functions import terms as T

POSITIVE = {"P": "u:has", "I": "u:inherits", "C": "u:modifies"}


@pytest.mark.parametrize(("aspect", "negative", "want"), [("P", False, "u:has"), ("I", False, "u:inherits"), ("C", False, "u:modifies"), ("P", True, "u:hasNot"), ("I", True, None), ("X", False, None), ("P", None, "u:has")])
def test_evidence_predicate(spark, aspect, negative, want):
    df = spark.createDataFrame([(aspect, negative)], "a string, n boolean")
    assert df.select(T.evidence_predicate(F.col("a"), F.col("n"), POSITIVE, ("P", "u:hasNot"))).first()[0] == want


@pytest.mark.parametrize(("curie", "want"), [("A:1", "u:a/1"), ("B:1", None), ("A:", None), ("A", None), ("A:1:2", "u:a/1:2"), (None, None)])
def test_curie(spark, curie, want):
    assert spark.createDataFrame([(curie,)], "c string").select(T.curie_to_iri(F.col("c"), {"A": "u:a/"})).first()[0] == want


def test_canonical_json_and_ids(spark):
    df = spark.createDataFrame([(2, "é\"", None, ["b", "a"])], "z int, a string, n string, l array<string>")
    text = df.select(T.canonical_json(F.struct("*"))).first()[0]
    assert text == json.dumps({"z": 2, "a": 'é"', "n": None, "l": ["b", "a"]}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    want = "urn:x/" + hashlib.sha256(b'["a","1"]').hexdigest()
    assert df.select(T.stable_id("urn:", "x", F.lit("a"), F.lit(1))).first()[0] == want


def test_validated_ids(spark):
    df = spark.createDataFrame([("N1",), ("N1\n",), ("xN1",), (None,)], "v string")
    assert [r[0] for r in df.select(T.matches(F.col("v"), r"N\d+")).collect()] == [True, False, False, False]
    assert df.limit(1).select(T.valid_iri(F.col("v"), r"N\d+", "u:")).first()[0] == "u:N1"
    with pytest.raises(Exception, match="invalid identifier"):
        df.select(T.valid_iri(F.col("v"), r"N\d+", "u:")).collect()


@pytest.mark.parametrize(("drugs", "diseases", "want"), [(["d1"], ["a"], "exact"), ([None, "d1"], ["x"], "disease missing"), (["x"], ["a"], "drug missing"), (None, None, "neither"), ([None], [None], "neither")])
def test_context_label(spark, drugs, diseases, want):
    df = spark.createDataFrame([(drugs, diseases)], "drugs array<string>, diseases array<string>")
    hit = lambda c, v: T.any_match(F.col(c), lambda x: x == v)
    assert df.select(T.context_label(hit("diseases", "a"), hit("drugs", "d1"))).first()[0] == want


def test_field_states(spark):
    df = spark.createDataFrame([(None, ""), ([], "x"), (["q"], None)], "a array<string>, s string")
    assert [tuple(r) for r in df.select(T.field_state(df, "a"), T.field_state(df, "s"), T.field_state(df, "gone")).collect()] == [("null", "empty", "absent"), ("empty", "present", "absent"), ("present", "null", "absent")]


def test_small_rules(spark):
    df = spark.createDataFrame([("a;;b", "http://x/HP_1", 0, True, None)], "r string, i string, z int, f boolean, q string")
    row = df.select(T.split_references(F.col("r")), T.to_curie(F.col("i")), T.percent(F.lit(1), F.col("z")), T.negated(F.col("f"), F.col("q")), T.negated(F.lit(None).cast("boolean"), F.lit("NOT")), T.local_name(F.lit("http://a/b#c")), T.punctuate(F.lit("HP:1"), "u:")).first()
    assert list(row) == [["a", "b"], "HP:1", 0.0, True, True, "c", "u:HP_1"]


def test_escapes_round_trip(spark):
    s = 'a"b\\n\n\t\\ é'
    df = spark.createDataFrame([(s,)], "s string")
    assert df.select(T.unescape(T.escape(F.col("s")))).first()[0] == s
