"""Record lifts: sources' rows to facts, each with the record that it came from.

A lift gives (facts, records). facts: a quad's columns, record_id and mapping (true for statements of mappings), one row for each fact and
record; records as provenance.records() makes them. What a record says is kept even where no edge follows from it. Predicates, classes
and namespaces are arguments; nothing is matched by label.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import OWL, PROV, RDFS, SKOS, evidence_predicate, field_state, negated, split_references, stable_id
from . import provenance as P
from . import quads as Q
from .context import first_occurrence, resolve

FACT = [*Q.QUAD, "record_id", "mapping"]


@dataclass(frozen=True)
class Vocabulary:
    """The namespace of ids and the predicates that lifts use besides the standard ones."""

    ns: str = "urn:"

    def __getattr__(self, name: str) -> str:
        if name.startswith("__"):
            raise AttributeError(name)
        return f"{self.ns}{name}"


def facts(recs: DataFrame, graph: str | Column, subject: Column, *said: Column, mapping: bool = False) -> DataFrame:
    """Facts about a subject, with the row's record."""
    g = F.lit(graph) if isinstance(graph, str) else graph
    parts = [recs.select(g.alias("g"), subject.alias("s"), f.alias("f"), "record_id").select("g", "s", "f.*", "record_id", F.lit(mapping).alias("mapping")) for f in said]
    return functools.reduce(DataFrame.unionByName, parts).select(*FACT).filter("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")


def each(recs: DataFrame, graph: str, subject: Column, p: str | Column, values: Column, kind: str = "iri", mapping: bool = False) -> DataFrame:
    """A fact for each element of an array; null arrays, null elements and empty ones give none."""
    many = recs.withColumn("_v", F.explode(values)).filter("_v IS NOT NULL AND _v <> ''")
    return facts(many, graph, subject, Q.text(p, F.col("_v")) if kind == "literal" else Q.fact(p, F.col("_v")), mapping=mapping)


def together(*parts: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def entity(recs: DataFrame, graph: str, subject: Column, type_: str | Column, identifier: Column, label: Column, voc: Vocabulary) -> DataFrame:
    """Type, identifier and label of an entity."""
    return facts(recs, graph, subject, Q.fact(Q.TYPE, F.lit(type_) if isinstance(type_, str) else type_), Q.text(voc.identifier, identifier), Q.text(RDFS + "label", label))


def type_by_pattern(iri: Column, patterns: dict[str, str], otherwise: str) -> Column:
    """The class of an IRI by the first pattern that it holds."""
    out = F.lit(otherwise)
    for part, type_ in reversed(patterns.items()):
        out = F.when(F.coalesce(iri.contains(part), F.lit(False)), type_).otherwise(out)
    return out


def concepts(recs: DataFrame, graph: str, voc: Vocabulary, type_: str | Column, anchor: Column | None = None) -> DataFrame:
    """Classes of a hierarchy: uri, identifier, labels (the first is taken), parents; and of the anchor alone synonyms, xrefs and
    mappings (predicate, object)."""
    uri = F.col("uri")
    out = [entity(recs, graph, uri, type_, F.col("identifier"), F.get("labels", F.lit(0)), voc), facts(recs, graph, uri, Q.fact(Q.TYPE, F.lit(OWL + "Class"))), each(recs, graph, uri, RDFS + "subClassOf", F.col("parents"))]
    if anchor is not None:
        own = recs.filter(anchor)
        out += [each(own, graph, uri, SKOS + "altLabel", F.col("synonyms"), "literal"), each(own, graph, uri, voc.sourceXref, F.col("xrefs"), "literal")]
        out.append(facts(own.withColumn("_m", F.explode("mappings")), graph, uri, Q.fact(F.col("_m.predicate"), F.col("_m.object")), mapping=True))
    return together(*out)


def evidence(recs: DataFrame, graph: str, voc: Vocabulary, **said: Column) -> DataFrame:
    """What a record says beside its edge, on the record itself. Columns are kept as texts, null as empty; arrays give a fact for each element."""
    out = []
    for name, c in said.items():
        if isinstance(recs.select(c.alias("c")).schema["c"].dataType.jsonValue(), dict):
            out.append(each(recs, graph, F.col("record_id"), getattr(voc, name), c, "literal"))
        else:
            out.append(facts(recs, graph, F.col("record_id"), Q.text(getattr(voc, name), F.coalesce(c.cast("string"), F.lit("")))))
    return together(*out)


def annotations(recs: DataFrame, graph: str, voc: Vocabulary, type_: str, positive: dict[str, str], excluded: tuple[str, str], order: list) -> tuple[DataFrame, DataFrame]:
    """Annotation rows (subject, identifier, label, aspect, qualifier, object, references): the subject's entity once, from its first row; an
    edge where the aspect has one; the evidence of every row. (facts, evidence)."""
    first = first_occurrence(recs, "subject", order)
    p = evidence_predicate(F.col("aspect"), negated(F.lit(None).cast("boolean"), F.col("qualifier")), positive, excluded)
    edges = facts(recs, graph, F.col("subject"), Q.fact(p, F.col("object")))
    said = evidence(recs, graph, voc, aspect=F.col("aspect"), qualifier=F.col("qualifier"), reference=split_references(F.col("references")))
    return together(entity(first, graph, F.col("subject"), type_, F.col("identifier"), F.col("label"), voc), edges), said


def nested(rows: DataFrame, ns: str, snapshot: Column, locator: Column, original: Column, elements: str, keep: list[str]) -> DataFrame:
    """A record for each element of an array column, at locator/evidence:i, with the kept columns and the element as its payload; equal
    elements at two places are two records."""
    many = rows.select(*rows.columns, F.posexplode(elements).alias("_i", "element")).withColumn("_at", F.concat(locator, F.lit("/evidence:"), F.col("_i").cast("string")))
    from ..functions.terms import canonical_json

    return P.records(many, ns, snapshot, F.col("_at"), original, canonical_json(F.struct(*keep, F.col("element").alias("evidence")))).drop("_at", "_i")


def links(paths: DataFrame, keys: list[str], legs: list[tuple[DataFrame, list[str], str]], ns: str, graph: str, type_: str, predicates: dict[str, str], activity: str, strict: bool = True) -> DataFrame:
    """Link quads of paths: the id is a hash of the keys, so paths with equal keys are one link; it's derived from every record of the legs
    that support it. A leg: rows, the keys it shares, its record. strict makes a path without support by some leg an error."""
    from .context import path_evidence, supported_paths

    good = supported_paths(paths.select(*keys).distinct(), [(leg, k) for leg, k, _ in legs], strict)
    link = stable_id(ns, "link", *[F.col(k) for k in keys])
    said = Q.lift(good, graph, link, Q.fact(Q.TYPE, F.lit(type_)), *[Q.fact(p, F.col(k)) for k, p in predicates.items()], Q.fact(PROV + "wasGeneratedBy", F.lit(activity)), distinct=False)
    from_ = Q.lift(path_evidence(good, keys, legs), graph, link, Q.fact(PROV + "wasDerivedFrom", F.col("evidence")), distinct=False)
    return said.unionByName(from_)


def reports(recs: DataFrame, graph: str, voc: Vocabulary, type_: str, identifier: str, fields: dict[str, str], state_of: str | None = None, ids: dict[str, str] | None = None) -> DataFrame:
    """Facts of report records: each field is a typed property, or named by an unresolvedField marker where it's null or empty; the state of
    one array field (absent, null, empty, present) and its elements; identifiers in arrays, null and empty ones left out."""
    node = F.col("record_id")
    out = [facts(recs, graph, node, Q.fact(Q.TYPE, F.lit(type_)), Q.text(voc.reportIdentifier, F.col(identifier)))]
    for f, p in fields.items():
        value = F.col(f).cast("string")
        out.append(facts(recs, graph, node, Q.text(p, F.nullif(value, F.lit(""))), Q.text(voc.unresolvedField, F.when(F.coalesce(value, F.lit("")) == "", f))))
    if state_of:
        out.append(facts(recs, graph, node, Q.text(voc.fieldState, field_state(recs, state_of))))
        if state_of in recs.columns:
            out.append(each(recs, graph, node, voc.flag, F.col(state_of), "literal"))
    for f, p in (ids or {}).items():
        out.append(each(recs, graph, node, p, F.col(f), "literal"))
    return together(*out)


def resolutions(references: DataFrame, catalog: DataFrame, ref: str, key: str, node: str, graph: str, voc: Vocabulary) -> DataFrame:
    """Quads of references (s, type, ref): an edge to the one catalog row that has the identifier, else the identifier as unresolved."""
    unique = catalog.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.min(node).alias("_node")).filter("_n = 1")
    found = references.join(unique, F.col(ref) == F.col("_k"), "left")
    return Q.lift(found, graph, F.col("s"), Q.fact(voc.resolvedReport, F.col("_node")), Q.text(voc.unresolvedReportIdentifier, F.when(F.col("_node").isNull(), F.col(ref))))


def resolution_counts(references: DataFrame, catalog: DataFrame, ref: str, key: str, by: str = "type") -> DataFrame:
    """(by, status, n): how many references of each class are resolved, ambiguous and unresolved."""
    return resolve(references, catalog, ref, key).groupBy(by, "status").agg(F.count("*").alias("n"))


def payload_differences(stored: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """keys and problem, of stored and raw payloads (keys, payload_json in canonical form): changed, no row of that place, a place stored twice. Raw rows
    that nothing stored are no problem, as a selection stores some."""
    n = stored.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("payload_json").alias("_a"), F.max("payload_json").alias("_z"))
    both = n.join(raw.select(*keys, F.col("payload_json").alias("_raw")), keys, "left")
    problem = F.when(F.col("_n") > 1, "stored twice").when(F.col("_raw").isNull(), "no such row").when((F.col("_a") != F.col("_raw")) | (F.col("_z") != F.col("_raw")), "changed")
    return both.select(*keys, problem.alias("problem")).filter("problem IS NOT NULL")
