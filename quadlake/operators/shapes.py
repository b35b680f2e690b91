"""Shape constraints over quads: every component gives rows of violations; a graph conforms if there are none.

One focus table and one value table are made for each shape; components are filters, joins and counts on them, and all of them end in one union.
Targets by class are subclass-aware, by the subClassOf edges of the data itself; targets by subject aren't subproperty-aware.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF, RDFS, SH, XSD
from ..session import cut
from ..sources.turtle import Term, Triple
from .closure import closure
from .quads import QUAD, TYPE

VALUE = ["o", "o_kind", "o_dt", "o_lang"]
NUMERIC = [XSD + x for x in ("integer", "decimal", "double", "float", "int", "long", "nonNegativeInteger")]
# Lexical forms of datatypes that are checked.
LEXICAL = {XSD + "integer": r"[+-]?[0-9]+", XSD + "decimal": r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", XSD + "boolean": "true|false|0|1"}


@dataclass
class Property:
    path: str
    min_count: int | None = None
    max_count: int | None = None
    node_kind: str | None = None  # iri, literal or bnode
    datatype: str | None = None
    min_length: int | None = None
    pattern: str | None = None
    class_: str | None = None
    in_: list[str] | None = None
    has_value: str | None = None
    min_inclusive: float | None = None
    qualified_class: str | None = None
    qualified_min: int | None = None


@dataclass
class Shape:
    name: str
    target_classes: list[str] = field(default_factory=list)
    target_subjects_of: list[str] = field(default_factory=list)
    node_kind: str | None = None
    class_: list[str] = field(default_factory=list)
    properties: list[Property] = field(default_factory=list)


def from_turtle(triples: list[Triple]) -> list[Shape]:
    """The shapes that a shapes graph declares."""
    by: dict[str, list[tuple[str, Term]]] = {}
    for s, p, o in triples:
        by.setdefault(s.value, []).append((p.value, o))
    all_ = lambda s, p: [o for q, o in by.get(s, []) if q == SH + p]
    one = lambda s, p: next(iter(all_(s, p)), None)
    kinds = {SH + "IRI": "iri", SH + "Literal": "literal", SH + "BlankNode": "bnode"}

    def items(head: str) -> list[str]:
        out = []
        while head != RDF + "nil":
            out.append(next(o.value for q, o in by[head] if q == RDF + "first"))
            head = next(o.value for q, o in by[head] if q == RDF + "rest")
        return out

    def number(t: Term | None, to=int):
        return None if t is None else to(t.value)

    def prop(s: str) -> Property:
        text = lambda p: t.value if (t := one(s, p)) else None
        qualified = one(s, "qualifiedValueShape")
        return Property(
            path=one(s, "path").value, min_count=number(one(s, "minCount")), max_count=number(one(s, "maxCount")), node_kind=kinds.get(text("nodeKind")), datatype=text("datatype"), min_length=number(one(s, "minLength")), pattern=text("pattern"), class_=text("class"),
            in_=items(one(s, "in").value) if one(s, "in") else None, has_value=text("hasValue"), min_inclusive=number(one(s, "minInclusive"), float), qualified_class=one(qualified.value, "class").value if qualified else None, qualified_min=number(one(s, "qualifiedMinCount")),
        )

    return [
        Shape(s, [o.value for o in all_(s, "targetClass")], [o.value for o in all_(s, "targetSubjectsOf")], kinds.get(one(s, "nodeKind").value) if one(s, "nodeKind") else None, [o.value for o in all_(s, "class")], [prop(o.value) for o in all_(s, "property")])
        for s in by
        if any(q == RDF + "type" and o.value == SH + "NodeShape" for q, o in by[s])
    ]


class Validator:
    def __init__(self, quads: DataFrame):
        """quads: the graphs to check, as their union. The triples are made distinct once and kept, as every component reads them."""
        self.triples = cut(quads.select(*QUAD[1:]).distinct(), "p")
        sub = self.triples.filter((F.col("p") == RDFS + "subClassOf") & (F.col("o_kind") != "literal")).select("s", "o")
        types = self.triples.filter(F.col("p") == TYPE).select("s", F.col("o").alias("c"))
        self.subclassed = not sub.isEmpty()
        if self.subclassed:
            up = closure(sub).select(F.col("s").alias("c"), F.col("o").alias("_up"))
            types = cut(types.unionByName(types.join(up, "c").select("s", F.col("_up").alias("c"))).distinct())
        self.types = types

    def instances(self, *classes: str) -> DataFrame:
        return self.types.filter(F.col("c").isin(*classes)).select("s").distinct()

    def focus(self, shape: Shape) -> DataFrame:
        """focus and its kind."""
        parts = []
        if shape.target_classes:
            parts.append(self.instances(*shape.target_classes))
        if shape.target_subjects_of:
            parts.append(self.triples.filter(F.col("p").isin(shape.target_subjects_of)).select("s"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct().select(F.col("s").alias("focus"))

    def violations(self, shapes: list[Shape]) -> DataFrame:
        """shape, focus, path, component, value: a row for each failure."""
        parts: list[DataFrame] = []

        def add(df: DataFrame, shape: Shape, path: str | None, component: str, value: Column | None = None) -> None:
            parts.append(df.select(F.lit(shape.name).alias("shape"), "focus", F.lit(path).cast("string").alias("path"), F.lit(component).alias("component"), (F.lit(None) if value is None else value).cast("string").alias("value")))

        for shape in shapes:
            focus = self.focus(shape)
            if shape.node_kind:
                add(focus.filter(_node_kind(F.col("focus")) != shape.node_kind), shape, None, "NodeKind", F.col("focus"))
            for c in shape.class_:
                add(focus.join(self.instances(c), F.col("focus") == F.col("s"), "left_anti"), shape, None, "Class", F.col("focus"))
            for p in shape.properties:
                values = self.triples.filter(F.col("p") == p.path).select(F.col("s").alias("focus"), *VALUE).join(focus, "focus", "left_semi")
                o, literal = F.col("o"), F.col("o_kind") == "literal"
                if p.min_count:
                    if p.min_count == 1:
                        short = focus.join(values, "focus", "left_anti")
                    else:
                        n = values.groupBy("focus").agg(F.count("*").alias("n"))
                        short = focus.join(n, "focus", "left").filter(F.coalesce("n", F.lit(0)) < p.min_count)
                    add(short, shape, p.path, "MinCount")
                if p.max_count is not None:
                    add(values.groupBy("focus").agg(F.count("*").alias("n")).filter(F.col("n") > p.max_count), shape, p.path, "MaxCount")
                if p.node_kind:
                    add(values.filter(F.col("o_kind") != p.node_kind), shape, p.path, "NodeKind", o)
                if p.datatype:
                    form = o.rlike(f"\\A(?:{LEXICAL[p.datatype]})\\z") if p.datatype in LEXICAL else F.lit(True)
                    good = literal & (F.col("o_dt") == p.datatype) & F.col("o_lang").isNull() & form
                    add(values.filter(~F.coalesce(good, F.lit(False))), shape, p.path, "Datatype", o)
                if p.min_length:
                    add(values.filter((F.char_length("o") < p.min_length) | (F.col("o_kind") == "bnode")), shape, p.path, "MinLength", o)
                if p.pattern:
                    add(values.filter(~o.rlike(p.pattern) | (F.col("o_kind") == "bnode")), shape, p.path, "Pattern", o)
                if p.class_:
                    own = values.withColumn("s", F.when(~literal, o))
                    add(own.join(self.instances(p.class_), "s", "left_anti"), shape, p.path, "Class", o)
                if p.in_ is not None:
                    add(values.filter(~o.isin(*p.in_)), shape, p.path, "In", o)
                if p.has_value is not None:
                    add(focus.join(values.filter(o == p.has_value), "focus", "left_anti"), shape, p.path, "HasValue")
                if p.min_inclusive is not None:
                    ok = literal & F.col("o_dt").isin(NUMERIC) & (o.try_cast("double") >= p.min_inclusive)
                    add(values.filter(~F.coalesce(ok, F.lit(False))), shape, p.path, "MinInclusive", o)
                if p.qualified_class and p.qualified_min:
                    have = values.filter(~literal).join(self.instances(p.qualified_class).withColumnRenamed("s", "o"), "o", "left_semi").groupBy("focus").agg(F.count("*").alias("n"))
                    add(focus.join(have, "focus", "left").filter(F.coalesce("n", F.lit(0)) < p.qualified_min), shape, p.path, "QualifiedMinCount")
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out


def _node_kind(c: Column) -> Column:
    return F.when(c.startswith("_:"), "bnode").when(c.startswith('"'), "literal").otherwise("iri")


def validate(quads: DataFrame, shapes: list[Shape]) -> DataFrame:
    return Validator(quads).violations(shapes)


def conforms(violations: DataFrame) -> bool:
    return violations.isEmpty()


def components(violations: DataFrame) -> DataFrame:
    return violations.groupBy("component").agg(F.count("*").alias("n"))


def report_quads(violations: DataFrame, ns: str, graph: str) -> DataFrame:
    """The violations as a validation graph that queries can read."""
    from ..functions.terms import stable_id
    from .quads import fact, lift, text

    rid = stable_id(ns, "result", *[F.coalesce(F.col(c), F.lit("")) for c in ("shape", "focus", "path", "component", "value")])
    return lift(
        violations, graph, rid, fact(TYPE, F.lit(SH + "ValidationResult")), fact(SH + "focusNode", F.col("focus")), fact(SH + "resultPath", F.col("path")), fact(SH + "sourceConstraintComponent", F.concat(F.lit(SH), F.col("component"), F.lit("ConstraintComponent"))),
        text(SH + "resultMessage", F.concat_ws(" ", "component", F.lit("of"), "shape", F.lit("fails"))),
    )


def mutate_drop(quads: DataFrame, p: str, s: str | None = None) -> DataFrame:
    """A copy without a predicate's quads (of one subject)."""
    gone = (F.col("p") == p) if s is None else (F.col("p") == p) & (F.col("s") == s)
    return quads.filter(~gone)


def mutate_add(quads: DataFrame, *rows: tuple) -> DataFrame:
    """A copy with more quads; rows in the order of QUAD."""
    return quads.unionByName(quads.sparkSession.createDataFrame(rows, ", ".join(f"{c} string" for c in QUAD)))
