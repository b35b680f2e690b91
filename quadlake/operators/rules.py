"""OWL 2 RL inference for the constructs of small ontologies over large facts: each rule is a join, iterated semi-naively to a fixpoint.

Axioms (the schema's triples) are small by nature, closed on the driver, and bounded by MAX_AXIOMS; facts stay distributed. Rules: scm-sco,
cax-sco, scm-spo, prp-spo1, prp-dom, prp-rng, prp-inv1/2, prp-trp, prp-symp, scm-eqc, cax-eqc, cls-int1/2, cls-svf1. Bookkeeping
(reflexive triples) is left out. The result doesn't depend on the order of rules.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import OWL, RDF, RDFS
from ..session import Tables
from ..sources.turtle import Triple

TYPE, MAX_AXIOMS = RDF + "type", 20_000
TRIPLE = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]


def _closed(pairs: set[tuple[str, str]]) -> set[tuple[str, str]]:
    out, up = set(), defaultdict(set)
    for a, b in pairs:
        up[a].add(b)
    for a in list(up):
        seen, work = set(), list(up[a])
        while work:
            b = work.pop()
            if b not in seen:
                seen.add(b)
                work += up.get(b, ())
        out |= {(a, b) for b in seen if b != a}
    return out


@dataclass
class Axioms:
    sub_class: set[tuple[str, str]] = field(default_factory=set)
    sub_property: set[tuple[str, str]] = field(default_factory=set)
    domain: set[tuple[str, str]] = field(default_factory=set)
    range: set[tuple[str, str]] = field(default_factory=set)
    inverse: set[tuple[str, str]] = field(default_factory=set)
    transitive: set[str] = field(default_factory=set)
    symmetric: set[str] = field(default_factory=set)
    intersections: dict[str, list[str]] = field(default_factory=dict)
    some_values: dict[str, tuple[str, str]] = field(default_factory=dict)

    @classmethod
    def of(cls, schema: list[Triple]) -> Axioms:
        """From an ontology's triples."""
        if len(schema) > MAX_AXIOMS:
            raise ValueError(f"{len(schema)} schema triples; this engine takes {MAX_AXIOMS}")
        by, a = defaultdict(dict), cls()
        for s, p, o in schema:
            by[p.value].setdefault(s.value, []).append(o.value)
        pairs = lambda p: {(s, o) for s, os in by[p].items() for o in os}

        def items(head: str) -> list[str]:
            out = []
            while head != RDF + "nil" and by[RDF + "first"].get(head):
                out.append(by[RDF + "first"][head][0])
                head = by[RDF + "rest"].get(head, [RDF + "nil"])[0]
            return out

        same = pairs(OWL + "equivalentClass")
        a.intersections = {s: items(os[0]) for s, os in by[OWL + "intersectionOf"].items()}
        a.some_values = {s: (by[OWL + "onProperty"][s][0], os[0]) for s, os in by[OWL + "someValuesFrom"].items() if s in by[OWL + "onProperty"]}
        member = {(s, m) for s, ms in a.intersections.items() for m in ms}
        a.sub_class = _closed(pairs(RDFS + "subClassOf") | same | {(y, x) for x, y in same} | member)
        a.sub_property = _closed(pairs(RDFS + "subPropertyOf"))
        inherit = lambda direct: direct | {(p, c) for p, q in a.sub_property for r, c in direct if r == q}
        wider = lambda got: got | {(p, c2) for p, c in got for c1, c2 in a.sub_class if c1 == c}
        a.domain, a.range = (wider(inherit(pairs(RDFS + x))) for x in ("domain", "range"))
        a.inverse = pairs(OWL + "inverseOf") | {(q, p) for p, q in pairs(OWL + "inverseOf")}
        a.transitive = {s for s, os in by[TYPE].items() if OWL + "TransitiveProperty" in os}
        a.symmetric = {s for s, os in by[TYPE].items() if OWL + "SymmetricProperty" in os}
        return a


def _table(spark: SparkSession, pairs, names: str) -> DataFrame:
    """A broadcast of axioms: MAX_AXIOMS bounds its size before closure, and the schema's depth after it."""
    return F.broadcast(spark.createDataFrame(sorted(pairs), ", ".join(f"{n} string" for n in names.split())))


def _iri(s: Column, p: Column, o: Column, rule: str, a: Column, b: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [s.alias("s"), p.alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"), F.lit(rule).alias("rule"), a.alias("premise"), (none if b is None else b).alias("axiom")]


def _said(p: str = "p", o: str = "o") -> Column:
    return F.concat_ws(" ", "s", p, o)


def _step(facts: DataFrame, delta: DataFrame, ax: Axioms) -> list[DataFrame]:
    """What each rule derives with at least one premise from delta."""
    spark, out, c = facts.sparkSession, [], F.col
    types, t = delta.filter(c("p") == TYPE), F.lit(TYPE)
    single = [("cax-sco", f"c {x}", x, y) for x, y in ax.sub_class]  # the rules with one premise, in one pass: key, the axiom's two sides
    for rule, pairs in (("prp-spo1", ax.sub_property), ("prp-dom", ax.domain), ("prp-rng", ax.range), ("prp-inv", ax.inverse | {(p, p) for p in ax.symmetric})):
        single += [(rule, f"p {x}", x, y) for x, y in pairs]
    if single:
        keys = F.array_compact(F.array(F.concat(F.lit("p "), "p"), F.when(c("p") == TYPE, F.concat(F.lit("c "), "o"))))
        j = delta.withColumn("_k", F.explode(keys)).join(_table(spark, single, "_rule _k _a _b"), "_k")
        j = j.filter((c("o_kind") != "literal") | ~c("_rule").isin("prp-rng", "prp-inv"))  # a literal has no type triple: that would be a generalized triple, see generalized()
        of, none = c("_rule"), F.lit(None).cast("string")
        turned, moved = of.isin("prp-rng", "prp-inv"), of == "prp-spo1"
        word = F.create_map(*[F.lit(x) for kv in {"cax-sco": "subClassOf", "prp-spo1": "subPropertyOf", "prp-dom": "domain", "prp-rng": "range", "prp-inv": "inverseOf"}.items() for x in kv])
        out.append(
            j.select(
                F.when(turned, c("o")).otherwise(c("s")).alias("s"), F.when(of.isin("prp-spo1", "prp-inv"), c("_b")).otherwise(t).alias("p"), F.when(moved, c("o")).when(of == "prp-inv", c("s")).otherwise(c("_b")).alias("o"),
                F.when(moved, c("o_kind")).otherwise("iri").alias("o_kind"), F.when(moved, c("o_dt")).otherwise(none).alias("o_dt"), F.when(moved, c("o_lang")).otherwise(none).alias("o_lang"),
                of.alias("rule"), _said().alias("premise"), F.concat_ws(" ", "_a", F.element_at(word, of), "_b").alias("axiom"),
            )
        )
    for p in sorted(ax.transitive):
        all_, new = facts.filter(c("p") == p), delta.filter(c("p") == p)
        for a, b in ((new, all_), (all_, new)):
            b = b.select(c("s").alias("_m"), c("o").alias("_o"))
            out.append(a.join(b, c("o") == c("_m")).select(*_iri(c("s"), c("p"), c("_o"), "prp-trp", _said())))
    for node, (p, filler) in sorted(ax.some_values.items()):
        of = lambda df, p=p: df.filter((c("p") == p) & (c("o_kind") != "literal"))
        fill = lambda df, filler=filler: df.filter((c("p") == TYPE) & (c("o") == filler)).select(c("s").alias("_y")).distinct()
        if filler == OWL + "Thing":
            out.append(of(delta).select(*_iri(c("s"), t, F.lit(node), "cls-svf", _said(), F.lit(f"some {p} {filler}"))))
        else:
            for a, b in ((of(delta), fill(facts)), (of(facts), fill(delta))):
                out.append(a.join(b, c("o") == c("_y")).select(*_iri(c("s"), t, F.lit(node), "cls-svf", _said(), F.lit(f"some {p} {filler}"))))
    for node, members in sorted(ax.intersections.items()):
        touched = types.filter(c("o").isin(members)).select("s").distinct()
        held = facts.filter((c("p") == TYPE) & c("o").isin(members)).join(touched, "s", "left_semi").groupBy("s").agg(F.countDistinct("o").alias("n")).filter(c("n") == len(set(members)))
        out.append(held.select(*_iri(c("s"), t, F.lit(node), "cls-int", F.concat_ws(" ", "s", F.lit("type"), F.lit(" and ".join(members))))))
    return out


def derived(ax: Axioms) -> list[str]:
    """The predicates that rules can give."""
    return sorted({TYPE} | {q for _, q in ax.sub_property | ax.inverse} | ax.transitive | ax.symmetric)


def infer(facts: DataFrame, ax: Axioms, max_steps: int | None = None) -> DataFrame:
    """What follows and isn't among the facts: a triple's columns, a rule, its premise and axiom (of several derivations, the one that sorts first), and the step.
    A step reads the last one's triples and writes only new ones; facts are known again by their predicates, which are few. It ends by
    itself, as no rule makes new terms; max_steps, if given, makes more an error."""
    why = ["rule", "premise", "axiom"]
    total = Tables(facts.sparkSession, "p")
    delta, found, n = total.add(facts.select(*TRIPLE).distinct()), Tables(facts.sparkSession, "p"), 0
    key = F.coalesce(F.col("o_dt"), F.lit("")), F.coalesce(F.col("o_lang"), F.lit(""))
    while True:
        n += 1
        if max_steps and n > max_steps:
            raise ValueError(f"no fixpoint after {max_steps} steps")
        parts = _step(total.all(), delta, ax)
        if not parts:
            break
        new = parts[0]
        for x in parts[1:]:
            new = new.unionByName(x)
        new = new.groupBy(*TRIPLE).agg(F.min(F.struct(*why)).alias("why")).select(*TRIPLE, "why.*")
        known = total.all().filter(F.col("p").isin(derived(ax))).select("s", "p", "o", "o_kind", key[0].alias("_d"), key[1].alias("_l"))
        new = new.withColumns({"_d": key[0], "_l": key[1]}).join(known, ["s", "p", "o", "o_kind", "_d", "_l"], "left_anti").select(*TRIPLE, *why, F.lit(n).alias("step"))
        new = found.add(new)
        if new.isEmpty():
            break
        delta = new.select(*TRIPLE)
        total.paths.append(found.paths[-1])  # the same files, read for their triples
    if found.schema is None:
        return facts.select(*TRIPLE).withColumns({k: F.lit(None).cast("string") for k in why} | {"step": F.lit(0)}).limit(0)
    return found.all()


def generalized(facts: DataFrame, ax: Axioms) -> DataFrame:
    """How many triples with a literal as subject the range and inverse rules would give; they're never made."""
    lit = facts.filter("o_kind = 'literal'")
    n = lambda pairs: lit.join(_table(facts.sparkSession, pairs, "_a _b"), F.col("p") == F.col("_a")).select("o", "o_dt", "o_lang", "_b").distinct() if pairs else None
    parts = [x for x in (n(ax.range), n(ax.inverse)) if x is not None]
    if not parts:
        return lit.limit(0).agg(F.count("*").alias("n"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.agg(F.count("*").alias("n"))


def ablate(facts: DataFrame, ax: Axioms, predicate: str) -> DataFrame:
    """The inferences that are lost when a predicate's facts are taken away."""
    return infer(facts, ax).select(*TRIPLE).subtract(infer(facts.filter(F.col("p") != predicate), ax).select(*TRIPLE)).filter(F.lit(True))


def absent(inferred: DataFrame, required: DataFrame) -> DataFrame:
    """Required (s, p, o) that weren't inferred."""
    return required.select("s", "p", "o").distinct().join(inferred.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")


def statements(inferred: DataFrame, ns: str, event: str, graph: str) -> DataFrame:
    """A statement for each inferred triple, generated by the reasoning event."""
    from ..functions.terms import n3, stable_id

    sid = stable_id(ns, "inference", F.lit(event), F.col("s"), F.col("p"), n3(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")))
    return inferred.select(sid.alias("stmt_id"), *TRIPLE, "rule", F.lit(event).alias("activity_id"), F.lit(graph).alias("g"))


