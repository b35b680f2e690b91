"""Transitive closure and shortest paths over edge tables, safe on cycles, with set semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Tables, cut

MAX_DEPTH = 10_000


def closure(edges: DataFrame, seeds: DataFrame | None = None, key: str | None = None, max_steps: int | None = None) -> DataFrame:
    """(s, o[, key], depth): all pairs with a path of one edge or more, and the length of the shortest. A node reaches itself only on a cycle.
    seeds (s) starts from some nodes only. Semi-naive: each step joins only the pairs found last, drops the known ones, and writes only the
    new. It ends by itself, as pairs are finite; max_steps, if given, makes longer paths an error."""
    keys = ["s", "o"] + ([key] if key else [])
    edges = cut(edges.select(*keys).filter("s IS NOT NULL AND o IS NOT NULL").distinct())
    delta = edges.join(seeds.select("s").distinct(), "s", "left_semi") if seeds is not None else edges
    total = Tables(edges.sparkSession)
    delta, n = total.add(delta.withColumn("depth", F.lit(1))), 1
    step = edges.withColumnsRenamed({"s": "_m", "o": "_o"} | ({key: "_k"} if key else {}))
    on = F.col("o") == F.col("_m")
    if key:
        on = on & (F.col(key) == F.col("_k"))
    while not delta.isEmpty():
        n += 1
        if max_steps and n > max_steps + 1:
            raise ValueError(f"no fixpoint after {max_steps} steps")
        new = delta.join(step, on).select("s", F.col("_o").alias("o"), *([key] if key else []), F.lit(n).alias("depth")).distinct()
        delta = total.add(new.join(total.all().select(*keys), keys, "left_anti"))
    return total.all()


def acyclic_closure(edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(s, o, depth) by a recursive CTE: for shallow graphs known to have no cycle; all path lengths are kept, then the least taken. A path of
    over max_depth edges is an error when the rows are read, as on a cycle. LIMIT ALL lifts spark.sql.cteRecursionRowLimit, a million rows else."""
    edges.select("s", "o").distinct().createOrReplaceTempView("_closure_edges")
    return edges.sparkSession.sql(f"WITH RECURSIVE r(s, o, depth) MAX RECURSION LEVEL {int(max_depth)} AS (SELECT s, o, 1 FROM _closure_edges UNION ALL SELECT r.s, e.o, r.depth + 1 FROM r JOIN _closure_edges e ON r.o = e.s) SELECT s, o, min(depth) AS depth FROM (SELECT * FROM r LIMIT ALL) GROUP BY s, o")


def undeclared(classes: DataFrame) -> DataFrame:
    """(uri, parent) where a named parent has no record of its own: an error for hierarchies. classes: uri, parents."""
    each = classes.select("uri", F.explode("parents").alias("parent"))
    return each.join(classes.select(F.col("uri").alias("parent")).distinct(), "parent", "left_anti").select("uri", "parent")


def hierarchy(classes: DataFrame, start: str | None = None) -> DataFrame:
    """The closure of a hierarchy; a missing parent raises."""
    if gone := undeclared(classes).take(1):
        raise ValueError(f"missing parent {gone[0]['parent']} of {gone[0]['uri']}")
    edges = classes.select(F.col("uri").alias("s"), F.explode("parents").alias("o"))
    seeds = edges.sparkSession.createDataFrame([(start,)], "s string") if start else None
    return closure(edges, seeds)


def shortest_paths(edges: DataFrame, seeds: DataFrame, max_steps: int | None = None) -> DataFrame:
    """(s, o, depth, path): a shortest path from each seed to each node it reaches; of several the one that sorts first."""
    edges = cut(edges.select("s", "o").distinct())
    step = edges.withColumnsRenamed({"s": "_m", "o": "_o"})
    total, n = Tables(edges.sparkSession), 1
    delta = total.add(edges.join(seeds.select("s").distinct(), "s", "left_semi").select("s", "o", F.lit(1).alias("depth"), F.array("s", "o").alias("path")))
    while not delta.isEmpty():
        n += 1
        if max_steps and n > max_steps + 1:
            raise ValueError(f"no fixpoint after {max_steps} steps")
        new = delta.join(step, F.col("o") == F.col("_m")).groupBy("s", F.col("_o").alias("o")).agg(F.min(F.concat("path", F.array("_o"))).alias("path"))
        delta = total.add(new.join(total.all().select("s", "o"), ["s", "o"], "left_anti").select("s", "o", F.lit(n).alias("depth"), "path"))
    return total.all()
