"""Sinks: sorted N-Triples and N-Quads, sorted JSON, query results, view exports, Markdown reports, checksums."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import n3


def line(graph: bool = True) -> Column:
    """A quad's line; subjects that begin with _: are blank nodes."""
    s = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))
    tail = F.when(F.col("g").startswith("_:"), F.concat(F.lit(" "), "g")).when(F.col("g").isNotNull(), F.concat(F.lit(" <"), "g", F.lit(">"))).otherwise("") if graph else F.lit("")
    return F.concat(s, F.lit(" <"), "p", F.lit("> "), n3(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")), tail, F.lit(" ."))


def lines(quads: DataFrame, graph: bool = True) -> DataFrame:
    """The distinct lines in code-point order; sorted by range over all partitions."""
    return quads.select(line(graph).alias("line")).distinct().orderBy("line")


def write_sorted(quads: DataFrame, path: str, graph: bool = True, single: bool = False) -> None:
    """Sorted lines as text. single gives one file with the same bytes in every run; otherwise the parts' order is the order."""
    out = lines(quads, graph)
    (out.coalesce(1).sortWithinPartitions("line") if single else out).write.mode("errorifexists").text(path)


def write_results(results: dict[str, DataFrame], root: str) -> None:
    for name, df in results.items():
        df.write.mode("overwrite").json(f"{root}/{name}")


def views(quads: DataFrame, inferred: str, provenance: str, mapping_predicates: list[str]) -> dict[str, DataFrame]:
    """The export views: asserted facts, inferred facts, provenance, mappings, and what a reasoner gets (facts without provenance)."""
    facts = quads.filter((F.col("g") != inferred) & (F.col("g") != provenance))
    return {"asserted": facts, "inferred": quads.filter(F.col("g") == inferred), "provenance": quads.filter(F.col("g") == provenance), "mappings": facts.filter(F.col("p").isin(mapping_predicates)), "reasoning": quads.filter(F.col("g") != provenance)}


def dump_json(value, path: str) -> None:
    """Small driver-side values: keys sorted, indented, one line break at the end."""
    Path(path).write_text(json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def report(title: str, metrics: dict[str, object]) -> str:
    """A Markdown table of metrics."""
    return "\n".join([f"# {title}", "", "| Metric | Value |", "|---|---|", *(f"| {k} | {metrics[k]} |" for k in sorted(metrics)), ""])
