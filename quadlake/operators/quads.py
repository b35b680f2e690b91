"""The quad table: g, s, p, o, o_kind, o_dt, o_lang. A graph is a set, so lifts drop duplicates once; assertions stay bags."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF, STRING

QUAD = ["g", "s", "p", "o", "o_kind", "o_dt", "o_lang"]
TYPE = RDF + "type"


def fact(p: str | Column, o: Column, kind: str = "iri", datatype: str | None = None) -> Column:
    """A predicate and object to lift; a null object gives no quad."""
    return F.struct((F.lit(p) if isinstance(p, str) else p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype or (STRING if kind == "literal" else None)).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))


def text(p: str | Column, o: Column, datatype: str = STRING) -> Column:
    return fact(p, o, "literal", datatype)


def lift(rows: DataFrame, graph: str | Column, subject: Column, *facts: Column, distinct: bool = True, by_predicate: bool = False) -> DataFrame:
    """A quad for each row and fact with a predicate and an object, in one pass over the rows; by_predicate: in a branch for each fact, so that a
    filter on a constant predicate leaves only the branches, tables and columns it needs."""
    g = F.lit(graph) if isinstance(graph, str) else graph
    if by_predicate:
        parts = [rows.select(g.alias("g"), subject.alias("s"), f.alias("f")).select("g", "s", "f.*").filter("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL") for f in facts]
        return union(*parts) if distinct else functools.reduce(DataFrame.unionByName, parts)
    out = rows.select(g.alias("g"), subject.alias("s"), F.explode(F.array(*facts)).alias("f")).select("g", "s", "f.*").filter("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
    return out.dropDuplicates(QUAD) if distinct else out


def lift_each(rows: DataFrame, graph: str, subject: Column, p: str, values: Column, kind: str = "iri") -> DataFrame:
    """A quad for each element of an array; nulls and empty strings give none."""
    return lift(rows.withColumn("_v", F.explode(values)).filter("_v IS NOT NULL AND _v <> ''"), graph, subject, fact(p, F.col("_v"), kind))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.dropDuplicates(QUAD)


def match(quads: DataFrame, g: str | None = None, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """The quads with the given terms; constants reach the scan as filters and partition filters."""
    for c, v in (("g", g), ("s", s), ("p", p), ("o", o)):
        if v is not None:
            quads = quads.filter(F.col(c) == v)
    return quads


def triples(quads: DataFrame) -> DataFrame:
    """The union graph: a triple that several graphs hold counts once."""
    return quads.select(*QUAD[1:]).distinct()


def same(a: DataFrame, b: DataFrame) -> Column:
    """Null-safe equality of two quad tables' terms, without the graph."""
    cond = F.lit(True)
    for c in QUAD[1:]:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*QUAD).subtract(b.select(*QUAD))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, as bags, with their side; empty if and only if both are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def stats(quads: DataFrame) -> DataFrame:
    """One row: quads, distinct triples, subjects, and IRIs in any position, in one scan. Things are counted by two 64-bit hashes of theirs, so a
    few numbers are shuffled for each, once each after those of a part became one."""
    twice = lambda k, *c: F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), *c).alias("a"), F.xxhash64(F.lit(-1 - k), *c).alias("b"))
    each = F.array(twice(0, *QUAD), twice(1, *QUAD[1:]), twice(2, "s"), twice(3, "s"), twice(3, "p"), F.when(F.col("o_kind") == "iri", twice(3, "o")))
    found = quads.select(F.explode(F.array_compact(each)).alias("x")).select("x.*").distinct().groupBy("k").agg(F.count("*").alias("n"))
    n = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0))
    return found.agg(n(0).alias("n_quads"), n(1).alias("n_triples"), n(2).alias("n_subjects"), n(3).alias("n_iris"))


def counts(quads: DataFrame) -> DataFrame:
    return quads.groupBy("g").agg(F.count("*").alias("n_quads"))


def split_legal(quads: DataFrame) -> DataFrame:
    """Adds legal: the subject isn't a literal and the predicate is an IRI. Generalized triples are counted, then dropped by the caller."""
    return quads.withColumn("legal", ~F.col("s").startswith('"') & ~F.col("p").startswith('"') & ~F.col("p").startswith("_:"))


def uses(quads: DataFrame, terms: list[str]) -> DataFrame:
    """The quads with one of the terms in any position: empty is what a closed vocabulary wants."""
    return quads.filter(F.col("s").isin(terms) | F.col("p").isin(terms) | F.col("o").isin(terms))


def save(quads: DataFrame, path: str) -> None:
    """Partitioned by predicate, so patterns with a constant predicate read only its files. One shuffle keeps files few; a hot predicate is spread over salts."""
    quads.repartition("p", F.pmod(F.xxhash64("s"), F.lit(16))).write.partitionBy("p").mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*QUAD)
