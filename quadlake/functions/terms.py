"""RDF terms as columns, deterministic identifiers, canonical JSON, CURIEs, and the scalar rules of record lifting. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
PROV = "http://www.w3.org/ns/prov#"
SH = "http://www.w3.org/ns/shacl#"
STRING, INTEGER, BOOLEAN, JSON = XSD + "string", XSD + "integer", XSD + "boolean", RDF + "JSON"


def canonical_json(value: Column) -> Column:
    """Key-sorted compact JSON of a struct, map or array: the form that identifiers hash. Nulls are kept."""
    return F.to_json(F.to_variant_object(value))


def canonical_text(json: Column) -> Column:
    """The same form of a JSON text; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def stable_id(namespace: str, kind: str, *parts: Column) -> Column:
    """namespace + kind + '/' + SHA-256 of the JSON array of the parts as strings; the same wherever and whenever it's computed."""
    return F.concat(F.lit(f"{namespace}{kind}/"), F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256))


def evidence_predicate(aspect: Column, negative: Column, positive: dict[str, str], excluded: tuple[str, str]) -> Column:
    """The edge's predicate: by aspect if positive; the excluded predicate for its one aspect if negative; else null, no edge."""
    out = F.when(F.coalesce(negative, F.lit(False)), F.when(aspect == excluded[0], excluded[1]))
    for k, p in positive.items():
        out = out.when(aspect == k, p)
    return out


def negated(flag: Column, qualifier: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | (F.coalesce(qualifier, F.lit("")) == "NOT")


def curie_to_iri(curie: Column, prefixes: dict[str, str], separator: str = ":") -> Column:
    """prefix:local to an IRI by dictionary; an unknown prefix or an empty local name gives null. The split is at the first separator."""
    prefix, at = F.substring_index(curie, separator, 1), F.locate(separator, curie)
    local = F.when(at > 0, F.substr(curie, at + len(separator)))
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    return F.when((at > 0) & (local != ""), F.concat(F.try_element_at(table, prefix), local))


def punctuate(curie: Column, base: str) -> Column:
    """HP:1 to base + HP_1."""
    return F.concat(F.lit(base), F.replace(curie, F.lit(":"), F.lit("_")))


def to_curie(iri: Column) -> Column:
    """The last part of an IRI's path, with its _ as a colon."""
    return F.replace(F.substring_index(iri, "/", -1), F.lit("_"), F.lit(":"))


def local_name(iri: Column) -> Column:
    """What follows the last # or, without one, the last /."""
    return F.substring_index(F.substring_index(iri, "#", -1), "/", -1)


def matches(value: Column, pattern: str) -> Column:
    """Whether the whole value matches; unlike ^...$ a trailing line break doesn't."""
    return F.coalesce(value.rlike(f"\\A(?:{pattern})\\z"), F.lit(False))


def valid_iri(value: Column, pattern: str, base: str) -> Column:
    """base + value, or an error for a value that doesn't match as a whole."""
    return F.when(matches(value, pattern), F.concat(F.lit(base), value)).otherwise(F.raise_error(F.concat(F.lit("invalid identifier: "), F.coalesce(value, F.lit("null")))).cast("string"))


def split_references(value: Column, separator: str = ";") -> Column:
    return F.filter(F.split(F.coalesce(value, F.lit("")), separator), lambda x: x != "")


def field_state(df: DataFrame, name: str) -> Column:
    """absent (no such column), null, empty (array or text) or present."""
    if name not in df.columns:
        return F.lit("absent")
    kind, c = dict(df.dtypes)[name], F.col(name)
    empty = F.size(c) == 0 if kind.startswith(("array", "map")) else c == "" if kind == "string" else F.lit(False)
    return F.when(c.isNull(), "null").when(empty, "empty").otherwise("present")


def context_label(anchor: Column, partner: Column, labels: tuple[str, str, str, str] = ("exact", "disease missing", "drug missing", "neither")) -> Column:
    """Four-way co-presence; both flags may be null, which counts as false."""
    a, b = F.coalesce(anchor, F.lit(False)), F.coalesce(partner, F.lit(False))
    return F.when(a & b, labels[0]).when(b, labels[1]).when(a, labels[2]).otherwise(labels[3])


def any_match(array: Column, test) -> Column:
    """Whether some non-null element passes; null arrays and null results count as false."""
    return F.coalesce(F.exists(array, lambda x: F.coalesce(x.isNotNull() & test(x), F.lit(False))), F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(100 * part / F.nullif(whole, F.lit(0)), 3), F.lit(0.0))


def row_locator(index: Column, nested: Column | None = None) -> Column:
    return F.concat(F.lit("row:"), index.cast("string"), *([F.lit("/evidence:"), nested.cast("string")] if nested is not None else []))


def line_locator(line: Column) -> Column:
    return F.concat(F.lit("line:"), line.cast("string"))


def class_locator(iri: Column) -> Column:
    return F.concat(F.lit("owl:Class:"), iri)


def escape(text: Column) -> Column:
    """A literal's text as N-Triples writes it."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    """What an N-Triples string or IRI with escapes says: \\t \\b \\n \\r \\f \\" \\' \\\\ and code points as \\u with four or \\U with eight digits."""

    def simple(whole: Column) -> Column:
        whole = F.replace(whole, F.lit("\\\\"), F.lit("\x00"))  # escaped backslashes apart, so that what follows them isn't an escape
        for a, b in (('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f")):
            whole = F.replace(whole, F.lit(a), F.lit(b))
        return whole

    def piece(x: Column) -> Column:
        n = F.when(x.rlike("^\\\\u[0-9A-Fa-f]{4}"), 4).when(x.rlike("^\\\\U[0-9A-Fa-f]{8}"), 8)
        rest = lambda y: F.replace(y, F.lit("\x00"), F.lit("\\"))
        code = F.lpad(F.substr(x, F.lit(3), n), 8, "0")
        return F.when(n.isNull(), rest(x)).otherwise(F.concat(F.decode(F.unhex(code), "UTF-32"), rest(F.substr(x, n + 3))))

    def decoded(whole: Column) -> Column:
        codes = whole.contains("\\u") | whole.contains("\\U")
        return F.when(codes, F.array_join(F.transform(F.split(whole, "(?=\\\\[uU])"), piece), "")).otherwise(F.replace(whole, F.lit("\x00"), F.lit("\\")))

    def of(t: Column) -> Column:
        return F.when(t.contains("\\"), F.transform(F.array(simple(t)), decoded)[0]).otherwise(t)

    return F.transform(F.array(text), of)[0]  # each value is bound once, so plans stay small


def n3(value: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    """A term as N-Triples writes it."""
    quoted = F.concat(F.lit('"'), escape(value), F.lit('"'))
    tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(datatype.isNotNull() & (datatype != STRING), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise("")
    return F.when(kind == "literal", F.concat(quoted, tail)).when(kind == "bnode", F.concat(F.lit("_:"), F.regexp_replace(value, "^_:", ""))).otherwise(F.concat(F.lit("<"), value, F.lit(">")))
