"""Sources: Parquet with physical row numbers, commented delimited text, XML ontologies, N-Quads, JSON manifests, listings, raw bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import STRING, unescape

CLASS_SCHEMA = """`_rdf:about` STRING, `rdfs:label` ARRAY<STRUCT<_VALUE: STRING, `_xml:lang`: STRING>>, `rdfs:subClassOf` ARRAY<STRUCT<`_rdf:resource`: STRING>>,
 `oboInOwl:hasDbXref` ARRAY<STRUCT<_VALUE: STRING>>, `oboInOwl:hasExactSynonym` ARRAY<STRUCT<_VALUE: STRING>>, `skos:exactMatch` ARRAY<STRUCT<`_rdf:resource`: STRING>>, `owl:deprecated` STRUCT<_VALUE: STRING>"""


def parquet_rows(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows with row_index, their zero-based physical place in their file (kept under pushed filters), and file_path."""
    df = spark.read.parquet(path)
    return df.select(*(columns or df.columns), F.col("_metadata.row_index").alias("row_index"), F.col("_metadata.file_path").alias("file_path"))


def parquet_meta(spark: SparkSession, path: str) -> DataFrame:
    """Field names and types, and the row count that the footers give."""
    df = spark.read.parquet(path)
    n = df.count()
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), n) for f in df.schema], "field string, type string, n_rows long")


def ids(spark: SparkSession, paths: list[str], column: str = "id") -> DataFrame:
    """The distinct identifiers of a table in parts."""
    return spark.read.parquet(*paths).select(F.col(column).cast("string").alias("id")).distinct()


def delimited(spark: SparkSession, path: str, schema: str, comment: str = "#", sep: str = "\t") -> DataFrame:
    """Rows of a delimited text with line, the one-based physical line number. Comment lines are skipped, the first other line is the
    header, quoting is CSV's; a row with another number of fields than the header is an error. Line numbers are per file."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.posexplode(F.split("value", "\r?\n")).alias("k", "value"))
    body = lines.filter((F.col("value") != "") & ~F.col("value").startswith(comment))
    head = body.groupBy("file_path").agg(F.min_by("value", "k").alias("header"), F.min("k").alias("first"))
    rows = body.join(head, "file_path").filter(F.col("k") > F.col("first"))
    options = {"sep": sep, "mode": "FAILFAST", "quote": '"', "escape": '"'}
    n = F.size(F.split("header", sep))
    arity = F.size(F.split(F.regexp_replace("value", '"[^"]*"', "q"), sep))
    row = F.when(arity == n, F.from_csv("value", schema, options)).otherwise(F.from_csv(F.raise_error(F.concat(F.lit("wrong number of fields in line "), (F.col("k") + 1).cast("string"))).cast("string"), schema, options))
    return rows.select((F.col("k") + 1).cast("long").alias("line"), row.alias("row")).select("line", "row.*")


def delimited_header(spark: SparkSession, path: str, key: str = "version", lines: int = 4) -> DataFrame:
    """The value of `#key: value` among the first lines of each file."""
    text = spark.read.text(path, wholetext=True)
    first = F.array_join(F.slice(F.split("value", "\r?\n"), 1, lines), "\n")
    return text.select(F.col("_metadata.file_path").alias("file_path"), F.nullif(F.regexp_extract(first, f"(?m)^#\\s*{key}:\\s*(.*?)\\s*$", 1), F.lit("")).alias(key))


def owl_classes(spark: SparkSession, path: str) -> DataFrame:
    """Named top-level classes: uri, labels, parents (named ones only), n_restrictions (anonymous parents, never flattened), xrefs, synonyms, mappings, deprecated."""
    df = spark.read.format("xml").option("rowTag", "owl:Class").schema(CLASS_SCHEMA).load(path).filter("`_rdf:about` IS NOT NULL")
    values = lambda c: F.transform(F.coalesce(F.col(f"`{c}`"), F.array()), lambda x: x["_VALUE"])
    named = lambda c: F.filter(F.transform(F.coalesce(F.col(f"`{c}`"), F.array()), lambda x: x["_rdf:resource"]), lambda x: x.isNotNull())
    return df.select(
        F.col("`_rdf:about`").alias("uri"), values("rdfs:label").alias("labels"), named("rdfs:subClassOf").alias("parents"), (F.size(F.coalesce(F.col("`rdfs:subClassOf`"), F.array())) - F.size(named("rdfs:subClassOf"))).alias("n_restrictions"),
        values("oboInOwl:hasDbXref").alias("xrefs"), values("oboInOwl:hasExactSynonym").alias("synonyms"), named("skos:exactMatch").alias("mappings"), F.coalesce(F.lower(F.col("`owl:deprecated`._VALUE")).isin("true", "1"), F.lit(False)).alias("deprecated"),
    )


def nquads(spark: SparkSession, path: str) -> DataFrame:
    """Quads of N-Quads or N-Triples files (g is null for triples). A line that isn't a statement is an error."""
    return parse_nquads(spark.read.text(path))


def parse_nquads(lines: DataFrame, column: str = "value") -> DataFrame:
    """Quads of N-Quads lines. Escapes are decoded in strings and IRIs; blank nodes keep their _: in any place, so they join."""
    term = r'(?:<([^>]*)>|(_:[^\s<>"]*[^\s<>".]))'
    value = F.col(column)
    start, end = rf"^\s*{term}\s*<([^>]*)>\s*", rf"\s*(?:{term})?\s*\.\s*(?:#[^\"]*)?$"
    said = lambda c: (F.trim(c) != "") & ~F.ltrim(c).startswith("#")
    text = lines.filter(said(value))
    x = lambda c, pattern, k: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    node = lambda c, pattern, k: F.coalesce(unescape(x(c, pattern, k)), x(c, pattern, k + 1))
    # A literal ends at the line's last quote, so a long one is found without a pattern over its text.
    rest = text.select(value.alias("v"), F.regexp_replace(value, start, "").alias("r"), value.rlike(start).alias("sound"))
    literal, last = F.col("r").startswith('"'), F.char_length("r") - F.locate('"', F.reverse("r")) + 1
    parts = rest.select("v", "r", "sound", literal.alias("literal"), F.when(literal, F.substr("r", F.lit(2), last - 2)).alias("said"), F.when(literal, F.substr("r", last + 1)).alias("tail"))
    tail, thing = rf"^(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?{end}", rf"^{term}{end}"
    whole = F.regexp_replace("said", r"\\.", "")  # a quote or backslash that is left wasn't escaped
    good = F.col("sound") & F.when(F.col("literal"), F.col("tail").rlike(tail) & ~whole.contains('"') & ~whole.contains("\\") & (F.char_length("r") > 1)).otherwise(F.col("r").rlike(thing))
    bad = F.when(said(F.col("v")), F.raise_error(F.concat(F.lit("not a statement: "), F.col("v"))).cast("string"))  # filters may come after this
    of = lambda k, j: F.when(F.col("literal"), node(F.col("tail"), tail, k)).otherwise(node(F.col("r"), thing, j))
    return parts.select(
        of(3, 3).alias("g"), F.when(good, node(F.col("v"), start, 1)).otherwise(bad).alias("s"), unescape(x(F.col("v"), start, 3)).alias("p"),
        F.when(F.col("literal"), unescape(F.col("said"))).otherwise(node(F.col("r"), thing, 1)).alias("o"),
        F.when(F.col("literal"), "literal").when(x(F.col("r"), thing, 2).isNotNull(), "bnode").otherwise("iri").alias("o_kind"),
        F.when(F.col("literal") & x(F.col("tail"), tail, 2).isNull(), F.coalesce(unescape(x(F.col("tail"), tail, 1)), F.lit(STRING))).alias("o_dt"), F.when(F.col("literal"), x(F.col("tail"), tail, 2)).alias("o_lang"),
    )


def policy(text: str, required: dict[str, str]) -> dict[str, str]:
    """The settings of a small YAML text (nested keys of scalars, as section.key), or an error where one isn't as required."""
    out: dict[str, str] = {}
    above: list[tuple[int, str]] = []
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth, (key, _, value) = len(body) - len(body.lstrip()), body.strip().partition(":")
        above = [x for x in above if x[0] < depth]
        if value.strip():
            out[".".join([k for _, k in above] + [key])] = value.strip().strip("\"'")
        else:
            above.append((depth, key))
    if wrong := {k: out.get(k) for k, v in required.items() if out.get(k) != v}:
        raise ValueError(f"settings aren't supported: {wrong}")
    return out


def inventory(spark: SparkSession, root: str, version: dict[str, tuple[str, str]], glob: str = "*") -> DataFrame:
    """path, source (the file's folder), version and its basis (by source; unknown where none is given), bytes and sha256."""
    table = spark.createDataFrame([(k, *v) for k, v in sorted(version.items())], "source string, version string, version_basis string")
    found = files(spark, root, glob).withColumn("source", F.element_at(F.split("path", "/"), -2))
    return found.join(F.broadcast(table), "source", "left").select("path", "source", F.coalesce("version", F.lit("unknown")).alias("version"), F.coalesce("version_basis", F.lit("none")).alias("version_basis"), "bytes", "sha256")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def links(pages: DataFrame, html: str = "html", suffix: str = "") -> DataFrame:
    """The targets of a page's or listing's links, one row each, in order; suffix keeps those that end with it."""
    found = pages.withColumn("href", F.explode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)))
    return found.filter(F.col("href").endswith(suffix)) if suffix else found


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, bytes and sha256 of the files under root."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return df.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
