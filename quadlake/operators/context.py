"""The relational core: anchored selections, array joins, supported paths with their evidence, reference resolution, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exactly_one(df: DataFrame, what: str = "row") -> DataFrame:
    """df, or an error at run time unless it has one row; made for lookups by a key, where a second row is the error."""
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    found = df.limit(2).withColumn("_n", n)
    rest = found.filter(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"more than one {what}")).cast("boolean")).otherwise(True)).drop("_n")
    none = df.limit(1).agg(F.count("*").alias("c")).filter(F.when(F.col("c") == 0, F.raise_error(F.lit(f"no {what}")).cast("boolean")).otherwise(False))
    return rest.unionByName(none.select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes]))


def anchor(classes: DataFrame, label: str, expected: str) -> DataFrame:
    """The one class (uri, labels, deprecated) that has the label and isn't deprecated, or an error unless it's the expected one."""
    found = exactly_one(classes.filter(F.array_contains("labels", label) & ~F.col("deprecated")), "anchor")
    return found.filter(F.when(F.col("uri") != expected, F.raise_error(F.concat(F.lit("another anchor: "), F.col("uri"))).cast("boolean")).otherwise(True))


def overlapping(df: DataFrame, array: str, keys: DataFrame, key: str, row_id: str) -> DataFrame:
    """Rows whose array has an element among the keys; the keys are a table, so the array is exploded, semi-joined and the row taken once."""
    hit = df.select(row_id, F.explode(array).alias(key)).join(keys.select(key).distinct(), key, "left_semi").select(row_id).distinct()
    return df.join(hit, row_id, "left_semi")


def supported_paths(targets: DataFrame, legs: list[tuple[DataFrame, list[str]]], strict: bool = False) -> DataFrame:
    """Targets that every leg supports by its keys. strict makes a target without support an error, as a build gate; else it's left out."""
    out = targets
    for leg, keys in legs:
        support = leg.select(*keys).distinct().withColumn("_ok", F.lit(True))
        out = out.join(support, keys, "left")
        out = out.filter(F.when(F.col("_ok").isNull(), F.raise_error(F.lit(f"no support by {', '.join(keys)}")).cast("boolean")).otherwise(True)) if strict else out.filter("_ok")
        out = out.drop("_ok")
    return out


def unsupported_paths(targets: DataFrame, legs: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """The targets that some leg doesn't support, with the number of missing legs."""
    out, missing = targets, F.lit(0)
    for k, (leg, keys) in enumerate(legs):
        out = out.join(leg.select(*keys).distinct().withColumn(f"_ok{k}", F.lit(1)), keys, "left")
        missing = missing + F.col(f"_ok{k}").isNull().cast("int")
    return out.withColumn("missing_legs", missing).filter("missing_legs > 0").drop(*[f"_ok{k}" for k in range(len(legs))])


def path_evidence(paths: DataFrame, key: list[str], legs: list[tuple[DataFrame, list[str], str]]) -> DataFrame:
    """key and evidence: the distinct records of all legs that support a path. A leg: its rows, the keys it shares, the column of its record."""
    out = None
    for leg, keys, record in legs:
        part = paths.select(*key).distinct().join(leg.select(*keys, F.col(record).cast("string").alias("evidence")), keys).select(*key, "evidence")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def resolve(references: DataFrame, catalog: DataFrame, ref: str, key: str) -> DataFrame:
    """references with status: resolved by exactly one catalog row, ambiguous by more, unresolved by none (or a null reference)."""
    n = catalog.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    status = F.when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "ambiguous").otherwise("unresolved")
    return references.join(n, F.col(ref) == F.col("_k"), "left").withColumn("status", status).drop("_k", "_n")


def missing(references: DataFrame, catalog: DataFrame, ref: str, key: str) -> DataFrame:
    """The distinct references that the catalog lacks."""
    return references.select(ref).filter(F.col(ref).isNotNull()).distinct().join(catalog.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def catalog_audit(rows: DataFrame, arrays: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """For each array column: references, distinct ones, and those that its catalog (table, key) lacks."""
    parts = []
    for name, (catalog, key) in arrays.items():
        each = rows.select(F.explode(name).alias("ref"))
        n = each.agg(F.countDistinct("ref").alias("ids")).withColumn("k", F.lit(name))
        n = rows.agg(F.coalesce(F.sum(F.size(F.array_compact(name))), F.lit(0)).alias("refs")).withColumn("k", F.lit(name)).join(n, "k")
        gone = missing(each, catalog, "ref", key).agg(F.count("*").alias("missing"))
        parts.append(n.join(gone.withColumn("k", F.lit(name)), "k"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("k", "column")


def unresolved_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) for each field that is null or empty."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(key, F.explode(each).alias("x")).select(key, "x.*").filter("value IS NULL OR value = ''").select(key, "field")


def frequency(df: DataFrame, *keys: str, null_as: str = "None") -> DataFrame:
    """Counts by key, with nulls under a name of their own."""
    return df.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit(null_as)).alias(k) for k in keys]).agg(F.count("*").alias("n"))


def zero_filled(df: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Counts for each wanted value, zeros included."""
    names = df.sparkSession.createDataFrame([(w,) for w in wanted], f"{key} string")
    return names.join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_elements(array: Column) -> Column:
    """How many elements of an array repeat an earlier one; structs are compared by their JSON. Null arrays count 0."""
    as_json = F.transform(array, lambda x: F.to_json(F.struct(x)))
    return F.coalesce(F.size(array) - F.size(F.array_distinct(as_json)), F.lit(0))


def first_occurrence(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys found more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
