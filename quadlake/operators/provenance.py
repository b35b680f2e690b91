"""Records, reified assertions, lineage and its checks, conflicts, mapping candidates, exclusion views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import JSON, OWL, PROV, RDF, RDFS, canonical_json, curie_to_iri, n3, stable_id
from . import quads as Q


def records(rows: DataFrame, ns: str, snapshot: Column, locator: Column, original: Column, payload: Column | None = None) -> DataFrame:
    """A record for each physical row: record_id from snapshot and locator, so equal payloads at different places stay apart."""
    payload = canonical_json(F.struct(*rows.columns)) if payload is None else payload
    return rows.withColumns({"snapshot_id": snapshot, "locator": locator, "original_id": original.cast("string"), "payload_json": payload}).withColumn("record_id", stable_id(ns, "record", F.col("snapshot_id"), F.col("locator")))


def unique_records(recs: DataFrame) -> DataFrame:
    """recs, or an error at run time if a physical row was recorded twice."""
    n = F.count("*").over(Window.partitionBy("record_id"))
    return recs.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate physical row: "), "record_id")).cast("boolean")).otherwise(True)).drop("_n")


def assertions(facts: DataFrame, ns: str, activity: str) -> DataFrame:
    """A statement for each (graph, triple, record): one fact may have several. facts: a quad's columns and record_id."""
    parts = [F.col("g"), F.col("s"), F.col("p"), n3(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")), F.col("record_id")]
    return facts.withColumn("stmt_id", stable_id(ns, "assertion", *parts)).withColumn("activity_id", F.lit(activity)).dropDuplicates(["stmt_id"])


def reify(statements: DataFrame, ns: str, graph: str, mapping: Column | None = None, method: str = "mapping read from the source", **how) -> DataFrame:
    """The eight quads of each statement, and two more for mapping statements. how: as lift() takes it."""
    o = F.struct(F.lit(RDF + "object").alias("p"), F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"))
    facts = [
        Q.fact(Q.TYPE, F.lit(ns + "ImportedAssertion")), Q.fact(Q.TYPE, F.lit(RDF + "Statement")), Q.fact(RDF + "subject", F.col("s")), Q.fact(RDF + "predicate", F.col("p")), o,
        Q.fact(PROV + "wasDerivedFrom", F.col("record_id")), Q.fact(PROV + "wasGeneratedBy", F.col("activity_id")), Q.fact(ns + "assertedIn", F.col("g")),
    ]
    if mapping is not None:
        facts += [Q.fact(Q.TYPE, F.when(mapping, ns + "MappingAssertion")), Q.text(ns + "mappingMethod", F.when(mapping, method))]
    return Q.lift(statements, graph, F.col("stmt_id"), *facts, **how)


def record_quads(recs: DataFrame, ns: str, graph: str, **how) -> DataFrame:
    return Q.lift(recs, graph, F.col("record_id"), Q.fact(Q.TYPE, F.lit(ns + "SourceRecord")), Q.fact(PROV + "wasDerivedFrom", F.col("snapshot_id")), Q.text(ns + "locator", F.col("locator")), Q.text(ns + "originalIdentifier", F.col("original_id")), Q.text(ns + "payload", F.col("payload_json"), JSON), **how)


def snapshot_quads(snapshots: DataFrame, ns: str, graph: str, activity: str) -> DataFrame:
    """snapshot_id and any of source, version, version_basis, path, sha256, provider."""
    names = {"source": "source", "version": "version", "version_basis": "versionBasis", "path": "path", "sha256": "sha256", "provider": "provider"}
    facts = [Q.fact(Q.TYPE, F.lit(ns + "SourceSnapshot")), *(Q.text(ns + p, F.col(c)) for c, p in names.items() if c in snapshots.columns)]
    used = Q.lift(snapshots, graph, F.lit(activity), Q.fact(PROV + "used", F.col("snapshot_id")), Q.fact(Q.TYPE, F.lit(PROV + "Activity")))
    return Q.union(Q.lift(snapshots, graph, F.col("snapshot_id"), *facts), used)


def coverage(facts: DataFrame, statements: DataFrame, recs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: facts, those with a statement whose record and snapshot are there, their percentage, and malformed statements."""
    known = snapshots.select("snapshot_id").distinct()
    sound = recs.select("record_id", "snapshot_id").join(known, "snapshot_id", "left_semi").select("record_id").distinct()
    malformed = statements.join(sound, "record_id", "left_anti").agg(F.count("*").alias("malformed"))
    good = statements.join(sound, "record_id", "left_semi").select(*Q.QUAD).distinct()
    cond = (F.col("a.g") == F.col("b.g")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.o") == F.col("b.o")) & F.col("a.o_kind").eqNullSafe(F.col("b.o_kind")) & F.col("a.o_dt").eqNullSafe(F.col("b.o_dt")) & F.col("a.o_lang").eqNullSafe(F.col("b.o_lang"))
    facts = facts.select(*Q.QUAD).distinct()
    both = facts.agg(F.count("*").alias("total")).withColumn("k", F.lit(1)).join(facts.alias("a").join(good.alias("b"), cond, "left_semi").agg(F.count("*").alias("covered")).withColumn("k", F.lit(1)), "k").join(malformed.withColumn("k", F.lit(1)), "k")
    return both.select("covered", "total", F.coalesce(F.round(100 * F.col("covered") / F.nullif(F.col("total"), F.lit(0)), 3), F.lit(0.0)).alias("percent"), "malformed")


def malformed(statements: DataFrame, recs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """stmt_id and problem of the statements whose record, or whose record's snapshot, isn't there."""
    known = snapshots.select("snapshot_id").distinct().withColumn("_snap", F.lit(True))
    have = recs.select("record_id", "snapshot_id").distinct().join(known, "snapshot_id", "left").groupBy("record_id").agg(F.max("_snap").alias("_snap"), F.lit(True).alias("_rec"))
    problem = F.when(F.col("_rec").isNull(), "no record").when(F.col("_snap").isNull(), "no snapshot")
    return statements.join(have, "record_id", "left").select("stmt_id", problem.alias("problem")).filter("problem IS NOT NULL")


def conflicts(quads: DataFrame, positive: str, excluded: str) -> DataFrame:
    """(s, o) asserted both ways, in one graph or across graphs, with the graphs of either side."""
    pair = lambda p, n: quads.filter(F.col("p") == p).groupBy("s", "o").agg(F.array_join(F.array_sort(F.collect_set("g")), " ").alias(n))
    return pair(positive, "positive_in").join(pair(excluded, "excluded_in"), ["s", "o"])


def candidates(xrefs: DataFrame, mappings: DataFrame, prefixes: dict[str, str], ns: str) -> DataFrame:
    """Cross references (s, xref) whose IRI no explicit mapping (s, object) names: unresolved, each with a stable id. Syntax alone maps nothing."""
    iri = curie_to_iri(F.col("xref"), prefixes)
    known = mappings.select(F.col("s").alias("_s"), F.col("object").alias("_o")).distinct()
    open_ = xrefs.withColumn("iri", iri)
    return open_.join(known, (F.col("s") == F.col("_s")) & (F.col("iri") == F.col("_o")), "left_anti").select("s", F.col("xref").alias("identifier"), F.lit("unresolved").alias("status"), stable_id(ns, "candidate", F.col("s"), F.col("xref")).alias("candidate_id"))


def not_exactly_one(quads: DataFrame, subjects: DataFrame, predicates: list[str]) -> DataFrame:
    """(s, p, n) for each subject and predicate without exactly one value, none included."""
    wanted = subjects.select("s").distinct().withColumn("p", F.explode(F.array(*[F.lit(p) for p in predicates])))
    have = quads.filter(F.col("p").isin(predicates)).select("s", "p", "o", "o_kind", "o_dt", "o_lang").distinct().groupBy("s", "p").agg(F.count("*").alias("n"))
    return wanted.join(have, ["s", "p"], "left").select("s", "p", F.coalesce("n", F.lit(0)).alias("n")).filter("n <> 1")


def misplaced(quads: DataFrame, predicate: str, allowed: DataFrame) -> DataFrame:
    """Quads of a predicate on subjects outside the allowed ones: a stage must stay on its own records."""
    return quads.filter(F.col("p") == predicate).join(allowed.select("s").distinct(), "s", "left_anti")


#: What a reasoning projection leaves out: annotations of the ontology itself, and class or property declarations.
DECLARATIONS = [OWL + x for x in ("Class", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "Ontology")]


def projection(quads: DataFrame, annotation_predicates: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded): together the input again. Excluded are the given annotations and bare declarations."""
    out = F.col("p").isin(annotation_predicates or [RDFS + "comment", RDFS + "isDefinedBy", RDFS + "seeAlso"]) | ((F.col("p") == Q.TYPE) & F.col("o").isin(DECLARATIONS))
    return quads.filter(~out), quads.filter(out)


def canonical_union(quads: DataFrame, inferred: list[str]) -> DataFrame:
    """The triples of all graphs but the inferred ones, each once: what is validated before and apart from inference."""
    return Q.triples(quads.filter(F.col("g").isNull() | ~F.col("g").isin(inferred)))


def review(asserted: DataFrame, schema: DataFrame, annotation: list[str], relations: list[str]) -> DataFrame:
    """The review view: the asserted triples and the schema's, with what an ontology editor needs declared: superclasses as classes, the given
    predicates as annotation or object properties, and instances, and objects of the relations, as individuals."""
    both = asserted.select(*Q.QUAD[1:]).unionByName(schema.select(*Q.QUAD[1:]))
    declare = lambda df, type_: df.select(F.col("n").alias("s"), F.lit(Q.TYPE).alias("p"), F.lit(type_).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    spark, named = asserted.sparkSession, (F.col("o_kind") == "iri")
    classes = both.filter((F.col("p") == RDFS + "subClassOf") & named).select(F.col("o").alias("n"))
    things = asserted.filter((F.col("p") == Q.TYPE) & (F.col("o") != OWL + "Class")).select(F.col("s").alias("n")).unionByName(asserted.filter(F.col("p").isin(relations) & named).select(F.col("o").alias("n")))
    parts = [both, declare(classes, OWL + "Class"), declare(things, OWL + "NamedIndividual")]
    for names, type_ in ((annotation, "AnnotationProperty"), (relations, "ObjectProperty")):
        if names:
            parts.append(declare(spark.createDataFrame([(n,) for n in names], "n string"), OWL + type_))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct()


def reasoning(full: DataFrame, asserted: DataFrame, subjects: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded) of a review view: triples about the given subjects are left out, and together both are the view again. Fails closed: asserted or
    kept triples that use an excluded term are an error when they are read."""
    gone = F.col("s").isin(subjects)
    used = lambda c: F.col("s").isin(subjects) | F.col("p").isin(subjects) | F.col("o").isin(subjects)
    fail = lambda what: F.raise_error(F.concat(F.lit(f"{what} use the excluded term of: "), F.concat_ws(" ", "s", "p", "o"))).cast("boolean")
    sound = asserted.filter(F.when(used(asserted), fail("asserted triples")).otherwise(False)).select(*Q.QUAD[1:])  # no rows, or an error
    kept = full.filter(~gone).select(*Q.QUAD[1:]).filter(F.when(used(full), fail("kept triples")).otherwise(True))
    return kept.unionByName(sound), full.filter(gone).select(*Q.QUAD[1:])
