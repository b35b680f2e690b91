"""Registered queries of the engine's own operators over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms as T
from .operators import closure as K
from .operators import context as C
from .operators import integrity as I
from .operators import lifts as L
from .operators import provenance as P
from .operators import quads as Q
from .operators import rules as R
from .operators import shapes as S
from .plans.compiler import query as sparql
from .session import cut
from .sources import readers, sinks, turtle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NS = "urn:"
SALES, DOCS, LABELS = "urn:g/sales", "urn:g/docs", "urn:g/labels"


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def iri(kind: str, column: str):
    return F.concat(F.lit(f"urn:{kind}/"), F.col(column).cast("string"))


def hierarchy_edges(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select(iri("c", "c_custkey").alias("s"), iri("n", "c_nationkey").alias("o"))
    n = t(spark, d, "nation").select(iri("n", "n_nationkey").alias("s"), iri("r", "n_regionkey").alias("o"))
    return c.unionByName(n).unionByName(t(spark, d, "region").select(iri("r", "r_regionkey").alias("s"), F.lit("urn:root").alias("o")))


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Customers, their place in the world, orders, parts and suppliers as quads."""
    sub = T.RDFS + "subClassOf"
    customer = Q.lift(t(spark, d, "customer"), SALES, iri("c", "c_custkey"), Q.fact(Q.TYPE, F.lit("urn:Customer")), Q.text(T.RDFS + "label", F.col("c_name")), Q.fact(sub, iri("n", "c_nationkey")), distinct=False, by_predicate=True)
    nation = Q.lift(t(spark, d, "nation"), SALES, iri("n", "n_nationkey"), Q.text(T.RDFS + "label", F.col("n_name")), Q.fact(sub, iri("r", "n_regionkey")), distinct=False, by_predicate=True)
    region = Q.lift(t(spark, d, "region"), SALES, iri("r", "r_regionkey"), Q.text(T.RDFS + "label", F.col("r_name")), Q.fact(sub, F.lit("urn:root")), distinct=False, by_predicate=True)
    order = Q.lift(t(spark, d, "orders"), SALES, iri("o", "o_orderkey"), Q.fact("urn:placedBy", iri("c", "o_custkey")), Q.text("urn:status", F.col("o_orderstatus")), distinct=False, by_predicate=True)
    line = t(spark, d, "lineitem")
    part = Q.lift(line.select("l_orderkey", "l_partkey").distinct(), SALES, iri("o", "l_orderkey"), Q.fact("urn:hasPart", iri("p", "l_partkey")), distinct=False, by_predicate=True)
    supplier = Q.lift(line.select("l_partkey", "l_suppkey").distinct(), SALES, iri("p", "l_partkey"), Q.fact("urn:suppliedBy", iri("s", "l_suppkey")), distinct=False, by_predicate=True)
    out = customer
    for x in (nation, region, order, part, supplier):  # keys are unique in each part, so no quad repeats and none needs a shuffle to drop
        out = out.unionByName(x)
    return out


def documents(spark: SparkSession, d: str) -> DataFrame:
    docs = Q.lift(t(spark, d, "documents").select("doc_id", "lang", "source"), DOCS, iri("d", "doc_id"), Q.fact(Q.TYPE, F.lit("urn:Document")), Q.text("urn:lang", F.col("lang")), Q.text("urn:origin", F.col("source")), distinct=False, by_predicate=True)
    labels = Q.lift(t(spark, d, "labels"), LABELS, iri("d", "doc_id"), Q.text("urn:quality", F.col("quality"), T.INTEGER), Q.text("urn:toxic", F.col("toxic"), T.INTEGER), distinct=False, by_predicate=True)
    return docs.unionByName(labels)


# --- sources, projections, scalar rules


@register("scan_project", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def scan_project(spark, d):
    return t(spark, d, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_orderstatus")


@register("row_locator", "SELECT c_custkey, 'row:' || CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS VARCHAR) AS locator FROM customer")
def row_locator(spark, d):
    return readers.parquet_rows(spark, f"{d}/customer.parquet", ["c_custkey"]).select("c_custkey", T.row_locator(F.col("row_index")).alias("locator"))


@register("parquet_meta", "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) AS v(field, type), (SELECT count(*) AS n_rows FROM nation)")
def parquet_meta(spark, d):
    return readers.parquet_meta(spark, f"{d}/nation.parquet")


@register("catalog_ids", "SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS id FROM part")
def catalog_ids(spark, d):
    return readers.ids(spark, [f"{d}/part.parquet"], "p_partkey")


@register("listing_links", "SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1, 2")
def listing_links(spark, d):
    return readers.links(t(spark, d, "pages")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@register("json_props", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_props(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@register("canonical_props", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS canonical FROM events")
def canonical_props(spark, d):
    return t(spark, d, "events").select("event_id", T.canonical_text(F.col("props")).alias("canonical"))


@register("stable_record_id", "SELECT o_orderkey, 'urn:record/' || sha256('[\"orders\",\"' || CAST(o_orderkey AS VARCHAR) || '\"]') AS record_id FROM orders")
def stable_record_id(spark, d):
    return t(spark, d, "orders").select("o_orderkey", T.stable_id(NS, "record", F.lit("orders"), F.col("o_orderkey")).alias("record_id"))


ASPECTS = {"purchase": "urn:bought", "view": "urn:viewed", "click": "urn:clicked"}
ASPECT_CASE = "CASE event_type WHEN 'purchase' THEN 'urn:bought' WHEN 'view' THEN 'urn:viewed' WHEN 'click' THEN 'urn:clicked' END"


@register("aspect_predicate", f"SELECT event_id, {ASPECT_CASE} AS predicate FROM events")
def aspect_predicate(spark, d):
    return t(spark, d, "events").select("event_id", T.evidence_predicate(F.col("event_type"), F.lit(False), ASPECTS, ("purchase", "urn:notBought")).alias("predicate"))


@register("negation_edge", f"SELECT event_id, CASE WHEN value > 100 THEN CASE WHEN event_type = 'purchase' THEN 'urn:notBought' END ELSE {ASPECT_CASE} END AS predicate FROM events")
def negation_edge(spark, d):
    return t(spark, d, "events").select("event_id", T.evidence_predicate(F.col("event_type"), T.negated(F.col("value") > 100, F.lit(None).cast("string")), ASPECTS, ("purchase", "urn:notBought")).alias("predicate"))


@register("curie_to_iri", "SELECT p_partkey, CASE WHEN split_part(p_brand, '#', 1) = 'Brand' THEN 'urn:brand/' || split_part(p_brand, '#', 2) END AS brand FROM part")
def curie_to_iri(spark, d):
    return t(spark, d, "part").select("p_partkey", T.curie_to_iri(F.col("p_brand"), {"Brand": "urn:brand/"}, "#").alias("brand"))


@register("unknown_prefix_null", "SELECT DISTINCT p_brand, CASE WHEN p_size % 2 = 0 THEN 'urn:make/' || split_part(p_brand, '#', 2) END AS brand FROM part")
def unknown_prefix_null(spark, d):
    return t(spark, d, "part").select("p_brand", T.curie_to_iri(F.when(F.col("p_size") % 2 == 0, F.replace("p_brand", F.lit("Brand"), F.lit("Make"))).otherwise(F.col("p_brand")), {"Make": "urn:make/"}, "#").alias("brand")).distinct()


@register("validated_ids", "SELECT p_partkey, regexp_full_match(p_brand, 'Brand#[0-9]+') AS valid FROM part")
def validated_ids(spark, d):
    return t(spark, d, "part").select("p_partkey", T.matches(F.col("p_brand"), "Brand#[0-9]+").alias("valid"))


@register("valid_iris", "SELECT c_custkey, 'urn:name/' || c_name AS name FROM customer")
def valid_iris(spark, d):
    return t(spark, d, "customer").select("c_custkey", T.valid_iri(F.col("c_name"), r"Customer#\d+", "urn:name/").alias("name"))


LABELLED = "(SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def labelled(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left")


@register("missing_field_markers", f"SELECT doc_id, 'quality' AS field FROM {LABELLED} WHERE quality IS NULL UNION ALL SELECT doc_id, 'toxic' FROM {LABELLED} WHERE toxic IS NULL")
def missing_field_markers(spark, d):
    return C.unresolved_fields(labelled(spark, d), "doc_id", ["quality", "toxic"])


@register("field_state", f"SELECT doc_id, CASE WHEN quality IS NULL THEN 'null' ELSE 'present' END AS quality_state, 'absent' AS review_state FROM {LABELLED}")
def field_state(spark, d):
    df = labelled(spark, d)
    return df.select("doc_id", T.field_state(df, "quality").alias("quality_state"), T.field_state(df, "review").alias("review_state"))


@register("reference_split", "SELECT p_partkey, unnest(list_filter(string_split(p_type, ' '), lambda x: x <> '')) AS ref FROM part")
def reference_split(spark, d):
    return t(spark, d, "part").select("p_partkey", F.explode(T.split_references(F.col("p_type"), " ")).alias("ref"))


ORDER_FLAGS = "SELECT l_orderkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_linestatus = 'F') AS f FROM lineitem GROUP BY 1"


@register("context_classify", f"SELECT o_orderkey, CASE WHEN coalesce(a, false) AND coalesce(f, false) THEN 'exact' WHEN coalesce(f, false) THEN 'disease missing' WHEN coalesce(a, false) THEN 'drug missing' ELSE 'neither' END AS context FROM orders LEFT JOIN ({ORDER_FLAGS}) x ON o_orderkey = l_orderkey")
def context_classify(spark, d):
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"), F.collect_set("l_linestatus").alias("states"))
    j = t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", T.context_label(T.any_match(F.col("flags"), lambda x: x == "A"), T.any_match(F.col("states"), lambda x: x == "F")).alias("context"))


@register("array_any_match", "SELECT l_orderkey, bool_or(l_quantity > 45 AND l_returnflag = 'R') AS hit FROM lineitem GROUP BY 1")
def array_any_match(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_returnflag")).alias("x"))
    return g.select("l_orderkey", T.any_match(F.col("x"), lambda x: (x.l_quantity > 45) & (x.l_returnflag == "R")).alias("hit"))


@register("array_intersects", "SELECT DISTINCT l_orderkey FROM lineitem SEMI JOIN (SELECT p_partkey FROM part WHERE p_size = 1) p ON l_partkey = p_partkey")
def array_intersects(spark, d):
    orders = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return C.overlapping(orders, "parts", t(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("k")), "k", "l_orderkey").select("l_orderkey")


@register("anchor_unique", "SELECT r_regionkey, r_name FROM region WHERE r_name = 'ASIA'")
def anchor_unique(spark, d):
    return C.exactly_one(t(spark, d, "region").filter("r_name = 'ASIA'"), "anchor").select("r_regionkey", "r_name")


# --- joins


@register("mapping_semi_join", "SELECT c_custkey FROM customer SEMI JOIN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE') x ON c_nationkey = n_nationkey")
def mapping_semi_join(spark, d):
    mapped = t(spark, d, "nation").join(t(spark, d, "region").filter("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"))
    return t(spark, d, "customer").join(mapped, "c_nationkey", "left_semi").select("c_custkey")


@register("term_resolution", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def term_resolution(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality")


@register("term_missing", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def term_missing(spark, d):
    return C.missing(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id", "doc_id")


@register("catalog_audit", "SELECT 'parts' AS \"column\", count(*) AS refs, count(DISTINCT l_partkey) AS ids, count(DISTINCT CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 1) THEN l_partkey END) AS missing FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def catalog_audit(spark, d):
    orders = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return C.catalog_audit(orders, {"parts": (t(spark, d, "part").filter("p_size > 1"), "p_partkey")})


PATHS = "SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_returnflag = 'R'"


def legs(spark, d):
    line = t(spark, d, "lineitem").withColumnsRenamed({"l_partkey": "part", "l_suppkey": "supp"})
    paths = line.filter("l_returnflag = 'R'").select("part", "supp").distinct()
    return paths, line.filter("l_returnflag = 'A'"), line.filter("l_returnflag = 'N'")


@register("supported_paths", f"SELECT part, supp FROM ({PATHS}) SEMI JOIN (SELECT l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_returnflag = 'A') a USING (part, supp) SEMI JOIN (SELECT l_partkey AS part FROM lineitem WHERE l_returnflag = 'N') n USING (part)")
def supported_paths(spark, d):
    paths, a, n = legs(spark, d)
    return C.supported_paths(paths, [(a, ["part", "supp"]), (n, ["part"])]).select("part", "supp")


@register("unsupported_paths", f"SELECT part, supp, CAST((a.x IS NULL)::INT + (n.y IS NULL)::INT AS INT) AS missing_legs FROM ({PATHS}) LEFT JOIN (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp, 1 AS x FROM lineitem WHERE l_returnflag = 'A') a USING (part, supp) LEFT JOIN (SELECT DISTINCT l_partkey AS part, 1 AS y FROM lineitem WHERE l_returnflag = 'N') n USING (part) WHERE a.x IS NULL OR n.y IS NULL")
def unsupported_paths(spark, d):
    paths, a, n = legs(spark, d)
    return C.unsupported_paths(paths, [(a, ["part", "supp"]), (n, ["part"])]).select("part", "supp", "missing_legs")


@register("path_evidence", "SELECT DISTINCT s.part, s.supp, CAST(l_orderkey AS VARCHAR) AS evidence FROM (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_returnflag = 'R') s JOIN lineitem ON l_partkey = s.part AND ((l_returnflag = 'A' AND l_suppkey = s.supp) OR l_returnflag = 'N')")
def path_evidence(spark, d):
    paths, a, n = legs(spark, d)
    return C.path_evidence(paths, ["part", "supp"], [(a, ["part", "supp"], "l_orderkey"), (n, ["part"], "l_orderkey")])


@register("reference_resolution", "SELECT doc_id, CASE coalesce(n, 0) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1) l USING (doc_id)")
def reference_resolution(spark, d):
    labels = t(spark, d, "labels")
    return C.resolve(t(spark, d, "documents").select("doc_id"), labels.unionByName(labels.filter("toxic = 1")), "doc_id", "doc_id")


@register("ambiguous_refs", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def ambiguous_refs(spark, d):
    return C.repeated(t(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@register("lineage_chain", "SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def lineage_chain(spark, d):
    j = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))


@register("quad_membership", "SELECT 'urn:d/' || CAST(doc_id AS VARCHAR) AS s, CAST(quality AS VARCHAR) AS o FROM labels WHERE quality = 1")
def quad_membership(spark, d):
    q = documents(spark, d).filter("p = 'urn:quality'")
    good = q.filter("o = '1'")
    return q.alias("a").join(good.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.o") == F.col("b.o")) & F.col("a.o_dt").eqNullSafe(F.col("b.o_dt")) & F.col("a.o_lang").eqNullSafe(F.col("b.o_lang")), "left_semi").select("s", "o")


PAIRS = "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = "


@register("conflict_pairs", f"{PAIRS}'A' INTERSECT {PAIRS}'R'")
def conflict_pairs(spark, d):
    line = t(spark, d, "lineitem")
    return line.filter("l_returnflag = 'A'").select("l_partkey", "l_suppkey").intersect(line.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey"))


@register("conflict_evidence", f"SELECT 'urn:p/' || CAST(l_partkey AS VARCHAR) AS s, 'urn:s/' || CAST(l_suppkey AS VARCHAR) AS o, 'urn:g/a' AS positive_in, 'urn:g/r' AS excluded_in FROM ({PAIRS}'A' INTERSECT {PAIRS}'R')")
def conflict_evidence(spark, d):
    line = t(spark, d, "lineitem")
    side = lambda flag, g, p: Q.lift(line.filter(F.col("l_returnflag") == flag), g, iri("p", "l_partkey"), Q.fact(p, iri("s", "l_suppkey")))
    return P.conflicts(side("A", "urn:g/a", "urn:has").unionByName(side("R", "urn:g/r", "urn:hasNot")), "urn:has", "urn:hasNot")


@register("signature_diff", "(SELECT 'left' AS side, n_nationkey + 3 AS k FROM nation EXCEPT SELECT 'left', c_nationkey FROM customer) UNION ALL (SELECT 'right', c_nationkey FROM customer EXCEPT SELECT 'right', n_nationkey + 3 FROM nation)")
def signature_diff(spark, d):
    a, b = t(spark, d, "nation").select((F.col("n_nationkey") + 3).alias("k")), t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    return Q.difference(a, b).select("side", "k")


# --- aggregation


@register("multi_source_count", "SELECT o_orderstatus, count(DISTINCT c_nationkey) AS sources FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 1 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1")
def multi_source_count(spark, d):
    allowed = t(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey")).unionByName(spark.createDataFrame([(1,)], "c_nationkey int")).distinct()
    j = t(spark, d, "orders").join(t(spark, d, "customer").join(allowed, "c_nationkey", "left_semi"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("o_orderstatus").agg(F.countDistinct("c_nationkey").alias("sources")).filter("sources > 1")


@register("frequency_tables", f"SELECT coalesce(CAST(quality AS VARCHAR), 'None') AS quality, count(*) AS n FROM {LABELLED} GROUP BY 1")
def frequency_tables(spark, d):
    return C.frequency(labelled(spark, d), "quality")


@register("nested_frequency", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def nested_frequency(spark, d):
    return C.frequency(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@register("conditional_counts", "SELECT event_type, count(*) FILTER (value > 50) AS high, count(*) AS n FROM events GROUP BY 1")
def conditional_counts(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.count("*").alias("n"))


@register("graph_counts", "SELECT 'urn:g/docs' AS g, 3 * count(*) AS n_quads FROM documents UNION ALL SELECT 'urn:g/labels', 2 * count(*) FROM labels")
def graph_counts(spark, d):
    return Q.counts(documents(spark, d))


@register("graph_stats", "SELECT (SELECT 3 * count(*) FROM documents) + (SELECT 2 * count(*) FROM labels) AS n_quads, (SELECT 3 * count(*) FROM documents) + (SELECT 2 * count(*) FROM labels) AS n_triples, (SELECT count(*) FROM documents) AS n_subjects, (SELECT count(*) FROM documents) + 6 AS n_iris")
def graph_stats(spark, d):
    return Q.stats(documents(spark, d))


@register("zero_filled_counts", "SELECT s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1")
def zero_filled_counts(spark, d):
    return C.zero_filled(t(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@register("duplicate_evidence", "SELECT l_orderkey, count(*) - count(DISTINCT (l_partkey, l_suppkey)) AS extra FROM lineitem GROUP BY 1")
def duplicate_evidence(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_suppkey")).alias("x"))
    return g.select("l_orderkey", C.duplicate_elements(F.col("x")).cast("long").alias("extra"))


@register("duplicate_texts", "SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, d):
    return t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("k")


def lifted_labels(spark, d):
    """Label facts with their records and statements; a third of the snapshots is unknown."""
    recs = P.records(t(spark, d, "labels"), NS, F.concat(F.lit("urn:snapshot/"), (F.col("doc_id") % 3).cast("string")), T.row_locator(F.col("doc_id")), F.col("doc_id"))
    facts = recs.select(F.lit(LABELS).alias("g"), iri("d", "doc_id").alias("s"), F.lit("urn:quality").alias("p"), F.col("quality").cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit(T.INTEGER).alias("o_dt"), F.lit(None).cast("string").alias("o_lang"), "record_id")
    return recs, facts, P.assertions(facts, NS, "urn:activity/1")


@register("coverage", "SELECT count(*) FILTER (doc_id % 3 <> 2) AS covered, count(*) AS total, round(100.0 * count(*) FILTER (doc_id % 3 <> 2) / count(*), 3)::DOUBLE AS percent, count(*) FILTER (doc_id % 3 = 2) AS malformed FROM labels")
def coverage(spark, d):
    recs, facts, said = lifted_labels(spark, d)
    return P.coverage(facts, said, recs, spark.createDataFrame([("urn:snapshot/0",), ("urn:snapshot/1",)], "snapshot_id string"))


@register("assertion_ids", "SELECT 'urn:d/' || CAST(doc_id AS VARCHAR) AS s, 'urn:assertion/' || sha256('[\"urn:g/labels\",\"urn:d/' || CAST(doc_id AS VARCHAR) || '\",\"urn:quality\",\"\\\"' || CAST(quality AS VARCHAR) || '\\\"^^<http://www.w3.org/2001/XMLSchema#integer>\",\"urn:record/' || sha256('[\"urn:snapshot/' || CAST(doc_id % 3 AS VARCHAR) || '\",\"row:' || CAST(doc_id AS VARCHAR) || '\"]') || '\"]') AS stmt_id FROM labels")
def assertion_ids(spark, d):
    return lifted_labels(spark, d)[2].select("s", "stmt_id")


@register("reified_counts", "SELECT p, CASE WHEN p = 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' THEN 2 * n ELSE n END AS n FROM (SELECT count(*) AS n FROM labels), (SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#subject', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#predicate', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#object', 'http://www.w3.org/ns/prov#wasDerivedFrom', 'http://www.w3.org/ns/prov#wasGeneratedBy', 'urn:assertedIn']) AS p)")
def reified_counts(spark, d):
    return P.reify(lifted_labels(spark, d)[2], NS, "urn:g/provenance").groupBy("p").agg(F.count("*").alias("n"))


@register("record_payloads", "SELECT doc_id, '{\"doc_id\":' || CAST(doc_id AS VARCHAR) || ',\"quality\":' || CAST(quality AS VARCHAR) || ',\"toxic\":' || CAST(toxic AS VARCHAR) || '}' AS payload FROM labels")
def record_payloads(spark, d):
    return lifted_labels(spark, d)[0].select("doc_id", F.col("payload_json").alias("payload"))


@register("unresolved_candidates", "SELECT 'urn:p/' || CAST(p_partkey AS VARCHAR) AS s, p_brand AS identifier, 'unresolved' AS status FROM part WHERE p_partkey % 2 = 1")
def unresolved_candidates(spark, d):
    xrefs = t(spark, d, "part").select(iri("p", "p_partkey").alias("s"), F.col("p_brand").alias("xref"), "p_partkey")
    mapped = xrefs.filter("p_partkey % 2 = 0").select("s", F.concat(F.lit("urn:brand/"), F.substring_index("xref", "#", -1)).alias("object"))
    return P.candidates(xrefs.drop("p_partkey").withColumn("xref", F.replace("xref", F.lit("#"), F.lit(":"))), mapped, {"Brand": "urn:brand/"}, NS).select("s", F.replace("identifier", F.lit(":"), F.lit("#")).alias("identifier"), "status")


@register("multiset_equal", "SELECT 'left' AS side, l_orderkey FROM (SELECT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders) UNION ALL SELECT 'right', o_orderkey FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem)")
def multiset_equal(spark, d):
    return Q.difference(t(spark, d, "lineitem").select("l_orderkey"), t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))).select("side", "l_orderkey")


@register("first_occurrence", "SELECT c_nationkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k = 1")
def first_occurrence(spark, d):
    return C.first_occurrence(t(spark, d, "customer"), "c_nationkey", ["c_custkey"]).select("c_nationkey", "c_name")


# --- graph queries through the compiler

PREFIX = f"PREFIX u: <urn:> PREFIX g: <urn:g/> PREFIX rdf: <{T.RDF}> PREFIX rdfs: <{T.RDFS}> PREFIX xsd: <{T.XSD}> PREFIX prov: <{T.PROV}> PREFIX sh: <{T.SH}> "


def graph_query(name: str, graph: Callable, text: str, sql: str) -> None:
    register(name, sql)(lambda spark, d: sparql(graph(spark, d), PREFIX + text))


V = "CAST({} AS VARCHAR)".format
S1 = "'urn:{}/' || CAST({} AS VARCHAR)".format

graph_query("sparql_star", sales, "SELECT ?o ?s ?c WHERE { GRAPH g:sales { ?o u:status ?s ; u:placedBy ?c } } ORDER BY ?o", f"SELECT {S1('o', 'o_orderkey')} AS o, o_orderstatus AS s, {S1('c', 'o_custkey')} AS c FROM orders")
graph_query("sparql_cross_graph", documents, 'SELECT DISTINCT ?d ?l ?g WHERE { GRAPH ?g { ?d u:quality "1"^^xsd:integer } GRAPH g:docs { ?d u:lang ?l } FILTER(STRSTARTS(STR(?g), CONCAT(STR(u:), "g/"))) } ORDER BY ?d', f"SELECT {S1('d', 'doc_id')} AS d, lang AS l, 'urn:g/labels' AS g FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
graph_query("sparql_optional", sales, "SELECT ?o ?c ?p WHERE { GRAPH ?g { ?o u:placedBy ?c } OPTIONAL { GRAPH ?h { ?o u:hasPart ?p } } } ORDER BY ?o ?p", f"SELECT DISTINCT {S1('o', 'o_orderkey')} AS o, {S1('c', 'o_custkey')} AS c, CASE WHEN l_partkey IS NOT NULL THEN {S1('p', 'l_partkey')} END AS p FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
graph_query("sparql_union_bind", documents, 'SELECT ?d ?status WHERE { { GRAPH g:labels { ?d u:quality ?q } BIND("source-asserted" AS ?status) } UNION { GRAPH g:docs { ?d u:lang "de" } BIND("german" AS ?status) } } ORDER BY ?d', f"SELECT {S1('d', 'doc_id')} AS d, 'source-asserted' AS status FROM labels UNION ALL SELECT {S1('d', 'doc_id')}, 'german' FROM documents WHERE lang = 'de'")
graph_query("sparql_values", documents, 'SELECT ?d ?l WHERE { GRAPH g:docs { ?d u:lang ?l } VALUES ?l { "fr" "es" } } ORDER BY ?d', f"SELECT {S1('d', 'doc_id')} AS d, lang AS l FROM documents WHERE lang IN ('fr', 'es')")
graph_query("sparql_not_exists", documents, "SELECT ?d WHERE { GRAPH g:docs { ?d a u:Document } FILTER NOT EXISTS { GRAPH g:labels { ?d u:quality ?q } } } ORDER BY ?d", f"SELECT {S1('d', 'doc_id')} AS d FROM documents ANTI JOIN labels USING (doc_id)")
graph_query("sparql_exists", documents, "SELECT ?d WHERE { GRAPH g:docs { ?d a u:Document } FILTER EXISTS { GRAPH g:labels { ?d u:toxic 1 } } }", f"SELECT {S1('d', 'doc_id')} AS d FROM labels WHERE toxic = 1")
graph_query("sparql_path_plus", sales, "SELECT DISTINCT ?ancestor ?label WHERE { GRAPH g:sales { <urn:c/5> rdfs:subClassOf+ ?ancestor . ?ancestor rdfs:label ?label } } ORDER BY ?ancestor", f"SELECT {S1('n', 'n_nationkey')} AS ancestor, n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 5 UNION ALL SELECT {S1('r', 'r_regionkey')}, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = 5")
graph_query("sparql_path_star", sales, "SELECT ?a WHERE { GRAPH g:sales { <urn:n/3> rdfs:subClassOf* ?a } }", f"SELECT 'urn:n/3' AS a UNION ALL SELECT {S1('r', 'n_regionkey')} FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'urn:root'")
graph_query("sparql_path_seq", sales, "SELECT ?o ?r WHERE { GRAPH g:sales { ?o u:placedBy/rdfs:subClassOf/rdfs:subClassOf ?r } } ORDER BY ?o", f"SELECT {S1('o', 'o_orderkey')} AS o, {S1('r', 'n_regionkey')} AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
graph_query("sparql_path_inverse_alt", sales, "SELECT ?x WHERE { GRAPH g:sales { <urn:c/7> ^u:placedBy|rdfs:subClassOf ?x } }", f"SELECT {S1('o', 'o_orderkey')} AS x FROM orders WHERE o_custkey = 7 UNION ALL SELECT {S1('n', 'c_nationkey')} FROM customer WHERE c_custkey = 7")
graph_query("sparql_path_negated", sales, "SELECT ?x WHERE { GRAPH g:sales { <urn:c/7> !(rdf:type|rdfs:label) ?x } }", f"SELECT {S1('n', 'c_nationkey')} AS x FROM customer WHERE c_custkey = 7")
graph_query("sparql_group_having", sales, "SELECT ?s (COUNT(DISTINCT ?n) AS ?nations) WHERE { GRAPH g:sales { ?o u:status ?s ; u:placedBy/rdfs:subClassOf ?n } } GROUP BY ?s HAVING(COUNT(DISTINCT ?n) > 1) ORDER BY ?s", f"SELECT o_orderstatus AS s, {V('count(DISTINCT c_nationkey)')} AS nations FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1")
graph_query("sparql_theta", sales, "SELECT ?c ?x WHERE { GRAPH g:sales { <urn:n/1> rdfs:subClassOf ?m } GRAPH g:sales { ?c rdfs:subClassOf ?x } FILTER(?x = <urn:n/1> || ?x = ?m) }", f"SELECT {S1('c', 'c_custkey')} AS c, 'urn:n/1' AS x FROM customer WHERE c_nationkey = 1 UNION ALL SELECT {S1('n', 'a.n_nationkey')}, {S1('r', 'a.n_regionkey')} FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey = 1")
graph_query("sparql_filter_bool", sales, 'SELECT ?s ?p ?o WHERE { GRAPH g:sales { ?s ?p ?o } FILTER((?p = u:status && ?o != "F") || ?o = u:root) }', f"SELECT {S1('o', 'o_orderkey')} AS s, 'urn:status' AS p, o_orderstatus AS o FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT {S1('r', 'r_regionkey')}, '{T.RDFS}subClassOf', 'urn:root' FROM region")
graph_query("sparql_minus", documents, "SELECT ?d WHERE { GRAPH g:labels { ?d u:quality 1 } MINUS { GRAPH g:labels { ?d u:toxic 1 } } }", f"SELECT {S1('d', 'doc_id')} AS d FROM labels WHERE quality = 1 AND toxic <> 1")
graph_query("sparql_subselect", documents, "SELECT ?l ?n WHERE { { SELECT ?l (COUNT(?d) AS ?n) WHERE { GRAPH g:docs { ?d u:lang ?l } } GROUP BY ?l } FILTER(?n > 100) }", f"SELECT lang AS l, {V('count(*)')} AS n FROM documents GROUP BY 1 HAVING count(*) > 100")
graph_query("sparql_order_limit", sales, "SELECT ?o ?c WHERE { GRAPH g:sales { ?o u:placedBy ?c } } ORDER BY DESC(?c) ?o LIMIT 20 OFFSET 5", f"SELECT {S1('o', 'o_orderkey')} AS o, {S1('c', 'o_custkey')} AS c FROM orders ORDER BY c DESC, o LIMIT 20 OFFSET 5")
graph_query("sparql_agg_all", documents, "SELECT ?l (COUNT(*) AS ?n) (SUM(?q) AS ?good) (MIN(?q) AS ?lo) (MAX(?q) AS ?hi) (GROUP_CONCAT(DISTINCT ?s; SEPARATOR=\",\") AS ?sources) WHERE { GRAPH g:docs { ?d u:lang ?l ; u:origin ?s } GRAPH g:labels { ?d u:quality ?q } } GROUP BY ?l", f"SELECT lang AS l, {V('count(*)')} AS n, {V('CAST(sum(quality) AS BIGINT)')} AS good, {V('min(quality)')} AS lo, {V('max(quality)')} AS hi, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents JOIN labels USING (doc_id) GROUP BY 1")
graph_query("sparql_string_fns", sales, 'SELECT ?c (UCASE(?l) AS ?up) (STRLEN(?l) AS ?n) (STRAFTER(?l, "#") AS ?tail) (STRBEFORE(?l, "#") AS ?head) (SUBSTR(?l, 1, 3) AS ?three) (SHA256(?l) AS ?hash) (REPLACE(?l, "0+", "z") AS ?z) WHERE { GRAPH g:sales { ?c a u:Customer ; rdfs:label ?l } FILTER(REGEX(?l, "^customer", "i") && CONTAINS(?l, "1")) }', f"SELECT {S1('c', 'c_custkey')} AS c, upper(c_name) AS up, {V('length(c_name)')} AS n, split_part(c_name, '#', 2) AS tail, split_part(c_name, '#', 1) AS head, substr(c_name, 1, 3) AS three, sha256(c_name) AS hash, regexp_replace(c_name, '0+', 'z', 'g') AS z FROM customer WHERE contains(c_name, '1')")
graph_query("sparql_expressions", documents, 'SELECT ?d (?q + ?x * 2 AS ?v) (IF(?q > ?x, "good", "other") AS ?w) (COALESCE(?nothing, ?q) AS ?k) WHERE { GRAPH g:labels { ?d u:quality ?q ; u:toxic ?x } FILTER(?q IN (0, 1) && BOUND(?x) && isLiteral(?q) && isIRI(?d) && DATATYPE(?q) = xsd:integer) }', f"SELECT {S1('d', 'doc_id')} AS d, {V('quality + toxic * 2')} AS v, CASE WHEN quality > toxic THEN 'good' ELSE 'other' END AS w, {V('quality')} AS k FROM labels")


def lineage(spark, d):
    recs, facts, said = lifted_labels(spark, d)
    snaps = spark.createDataFrame([(f"urn:snapshot/{k}", f"part {k}") for k in range(3)], "snapshot_id string, source string")
    how = {"distinct": False, "by_predicate": True}  # statements are distinct, and so are records once their rows are
    return P.reify(said, NS, "urn:g/provenance", **how).unionByName(P.record_quads(recs.dropDuplicates(["record_id"]), NS, "urn:g/provenance", **how)).unionByName(P.snapshot_quads(snaps, NS, "urn:g/provenance", "urn:activity/1"))


graph_query(
    "sparql_lineage", lineage, "SELECT ?subject ?object ?id ?locator ?source WHERE { GRAPH g:provenance { ?a a u:ImportedAssertion ; rdf:subject ?subject ; rdf:object ?object ; prov:wasDerivedFrom ?record ; prov:wasGeneratedBy ?event . ?record u:originalIdentifier ?id ; u:locator ?locator ; prov:wasDerivedFrom ?snapshot . ?snapshot u:source ?source } } ORDER BY ?subject",
    f"SELECT {S1('d', 'doc_id')} AS subject, {V('quality')} AS object, {V('doc_id')} AS id, 'row:' || {V('doc_id')} AS locator, 'part ' || {V('doc_id % 3')} AS source FROM labels",
)

graph_query("sparql_exists_correlated", documents, "SELECT ?d WHERE { GRAPH g:docs { ?d u:lang ?l ; u:origin ?o } FILTER EXISTS { GRAPH g:docs { ?e u:lang ?m FILTER(?m = ?l && ?e != ?d) } GRAPH g:labels { ?d u:quality ?q FILTER(?q = 0 && ?l != \"en\") } } }", f"SELECT {S1('d', 'doc_id')} AS d FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND lang <> 'en' AND lang IN (SELECT lang FROM documents GROUP BY 1 HAVING count(*) > 1)")
graph_query("sparql_not_exists_correlated", sales, "SELECT ?n WHERE { GRAPH g:sales { ?n rdfs:subClassOf ?r . ?r rdfs:subClassOf <urn:root> } FILTER NOT EXISTS { GRAPH g:sales { ?m rdfs:subClassOf ?x . ?m rdfs:label ?l . ?n rdfs:label ?k FILTER(?x = ?r && STR(?l) < STR(?k)) } } }", f"SELECT {S1('n', 'n_nationkey')} AS n FROM nation WHERE n_name = (SELECT min(b.n_name) FROM nation b WHERE b.n_regionkey = nation.n_regionkey)")
graph_query("sparql_not_exists_path", sales, "SELECT ?c WHERE { GRAPH g:sales { ?c a u:Customer } FILTER NOT EXISTS { GRAPH g:sales { ?c ^u:placedBy/u:status \"F\" } } }", f"SELECT {S1('c', 'c_custkey')} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
graph_query("sparql_minus_unbound", documents, "SELECT ?d WHERE { GRAPH g:docs { ?d a u:Document } OPTIONAL { GRAPH g:labels { ?d u:toxic ?q } } MINUS { GRAPH g:labels { ?e u:quality ?q FILTER(?q = 1) } } }", f"SELECT {S1('d', 'doc_id')} AS d FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL OR toxic <> 1")
graph_query("sparql_maybe_join", documents, "SELECT ?l ?q (COUNT(*) AS ?n) WHERE { GRAPH g:docs { ?d u:lang ?l ; u:origin \"src3\" } OPTIONAL { GRAPH g:labels { ?d u:quality ?q } } VALUES ?q { 0 1 } } GROUP BY ?l ?q", f"SELECT lang AS l, {V('v.q')} AS q, {V('count(*)')} AS n FROM documents LEFT JOIN labels USING (doc_id) JOIN (VALUES (0), (1)) v(q) ON quality IS NULL OR quality = v.q WHERE source = 'src3' GROUP BY 1, 2")

# --- lifts

VOC = L.Vocabulary(NS)


def recorded(rows, table: str, key: str):
    return P.records(rows, NS, F.lit(f"urn:snapshot/{table}"), T.row_locator(F.col(key)), F.col(key))


def spelt(facts):
    return facts.select("s", "p", "o")


@register("lift_hierarchy", f"""SELECT {S1('n', 'n_nationkey')} AS s, u.p, u.o FROM nation, LATERAL (SELECT * FROM (VALUES ('{Q.TYPE}', CASE WHEN n_name LIKE '%1%' THEN 'urn:First' ELSE 'urn:Place' END), ('urn:identifier', {V('n_nationkey')}), ('{T.RDFS}label', n_name), ('{Q.TYPE}', '{T.OWL}Class'),
 ('{T.RDFS}subClassOf', {S1('r', 'n_regionkey')}), ('{T.SKOS}altLabel', CASE WHEN n_nationkey = 3 THEN lower(n_name) END), ('urn:sourceXref', CASE WHEN n_nationkey = 3 THEN 'x:3' END), ('{T.SKOS}exactMatch', CASE WHEN n_nationkey = 3 THEN 'urn:m/3' END)) v(p, o)) u WHERE u.o IS NOT NULL""")
def lift_hierarchy(spark, d):
    rows = t(spark, d, "nation").select(
        iri("n", "n_nationkey").alias("uri"), F.col("n_nationkey").cast("string").alias("identifier"), F.array("n_name").alias("labels"), F.array(iri("r", "n_regionkey")).alias("parents"), F.array(F.lower("n_name")).alias("synonyms"),
        F.array(F.concat(F.lit("x:"), F.col("n_nationkey").cast("string")), F.lit(None).cast("string")).alias("xrefs"), F.array(F.struct(F.lit(T.SKOS + "exactMatch").alias("predicate"), iri("m", "n_nationkey").alias("object"))).alias("mappings"), "n_name", "n_nationkey",
    )
    return spelt(L.concepts(recorded(rows, "nation", "n_nationkey"), SALES, VOC, L.type_by_pattern(F.col("n_name"), {"1": "urn:First"}, "urn:Place"), F.col("n_nationkey") == 3))


NOTE = "SELECT event_id, user_id, event_type, CASE WHEN value > 100 THEN 'NOT' END AS qualifier FROM events"


@register("lift_annotations", f"""SELECT p, count(*) AS n FROM (SELECT DISTINCT 'urn:u/' || user_id AS s, '{Q.TYPE}' AS p, '' AS o FROM events UNION ALL SELECT DISTINCT 'urn:u/' || user_id, 'urn:identifier', '' FROM events UNION ALL SELECT DISTINCT 'urn:u/' || user_id, '{T.RDFS}label', '' FROM events
 UNION ALL SELECT 'urn:u/' || user_id, CASE WHEN qualifier = 'NOT' THEN CASE WHEN event_type = 'purchase' THEN 'urn:notBought' END ELSE {ASPECT_CASE} END, {V('event_id')} FROM ({NOTE}) UNION ALL SELECT '', unnest(['urn:aspect', 'urn:qualifier', 'urn:reference', 'urn:reference']), '' FROM events) WHERE p IS NOT NULL GROUP BY 1""")
def lift_annotations(spark, d):
    user = F.col("user_id").cast("string")
    rows = t(spark, d, "events").select(
        iri("u", "user_id").alias("subject"), user.alias("identifier"), F.concat(F.lit("user "), user).alias("label"), F.col("event_type").alias("aspect"), F.when(F.col("value") > 100, "NOT").alias("qualifier"),
        iri("e", "event_id").alias("object"), F.concat(user, F.lit(";;"), F.col("event_type")).alias("references"), "event_id",
    )
    facts, said = L.annotations(recorded(rows, "events", "event_id"), SALES, VOC, "urn:User", ASPECTS, ("purchase", "urn:notBought"), ["event_id"])
    return facts.unionByName(said).groupBy("p").agg(F.count("*").alias("n"))


@register("lift_evidence", f"SELECT l_orderkey, 'row:' || {V('l_orderkey')} || '/evidence:' || {V('row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1')} AS locator, '{{\"evidence\":{{\"l_linenumber\":' || {V('l_linenumber')} || ',\"l_partkey\":' || {V('l_partkey')} || ',\"l_suppkey\":' || {V('l_suppkey')} || '}},\"l_orderkey\":' || {V('l_orderkey')} || '}}' AS payload FROM lineitem")
def lift_evidence(spark, d):
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("parts"))
    recs = L.nested(rows, NS, F.lit("urn:snapshot/lineitem"), T.row_locator(F.col("l_orderkey")), F.col("l_orderkey"), "parts", ["l_orderkey"])
    return recs.select("l_orderkey", "locator", F.col("payload_json").alias("payload"))


@register("lift_links", f"WITH a AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_returnflag = 'A') SELECT 'urn:link/' || sha256('[\"' || {S1('p', 'part')} || '\",\"' || {S1('s', 'supp')} || '\"]') AS s, 5 + count(*) AS n FROM a JOIN lineitem ON l_partkey = part AND l_suppkey = supp AND l_returnflag = 'A' GROUP BY part, supp".replace("5 + count(*)", "4 + count(DISTINCT (l_orderkey, l_linenumber))"))
def lift_links(spark, d):
    line = t(spark, d, "lineitem").filter("l_returnflag = 'A'").select(iri("p", "l_partkey").alias("part"), iri("s", "l_suppkey").alias("supp"), F.concat_ws("/", F.lit("urn:line"), "l_orderkey", "l_linenumber").alias("record"))
    quads = L.links(line, ["part", "supp"], [(line, ["part", "supp"], "record")], NS, SALES, "urn:Link", {"part": "urn:part", "supp": "urn:supplier"}, "urn:activity/1")
    return quads.groupBy("s").agg(F.count("*").alias("n"))


REPORTS = "SELECT doc_id, nullif(lang, 'de') AS lang, CASE WHEN source = 'src1' THEN '' ELSE source END AS source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)"


def report_rows(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.nullif("lang", F.lit("de")).alias("lang"), F.when(F.col("source") != "src1", F.col("source")).otherwise("").alias("source"))
    rows = rows.join(t(spark, d, "labels"), "doc_id", "left").withColumn("flags", F.when(F.col("toxic") == 1, F.array(F.lit("toxic"), F.lit(""))).when(F.col("toxic") == 0, F.array().cast("array<string>")))
    return recorded(rows, "documents", "doc_id")


@register("lift_reports", f"""SELECT p, o, count(*) AS n FROM (SELECT unnest([struct_pack(p := 'urn:lang', o := lang), struct_pack(p := 'urn:origin', o := nullif(source, '')), struct_pack(p := 'urn:quality', o := {V('quality')}), struct_pack(p := 'urn:unresolvedField', o := CASE WHEN lang IS NULL THEN 'lang' END), struct_pack(p := 'urn:unresolvedField', o := CASE WHEN source = '' OR source IS NULL THEN 'source' END),
 struct_pack(p := 'urn:unresolvedField', o := CASE WHEN quality IS NULL THEN 'quality' END), struct_pack(p := 'urn:fieldState', o := CASE WHEN toxic = 1 THEN 'present' WHEN toxic = 0 THEN 'empty' ELSE 'null' END), struct_pack(p := 'urn:flag', o := CASE WHEN toxic = 1 THEN 'toxic' END)], recursive := true) FROM ({REPORTS})) WHERE o IS NOT NULL GROUP BY 1, 2""")
def lift_reports(spark, d):
    facts = L.reports(report_rows(spark, d), DOCS, VOC, "urn:Report", "doc_id", {"lang": "urn:lang", "source": "urn:origin", "quality": "urn:quality"}, "flags")
    return facts.filter(~F.col("p").isin(Q.TYPE, "urn:reportIdentifier")).groupBy("p", "o").agg(F.count("*").alias("n"))


def catalog_with_doubles(spark, d):
    """Labels, where some ids stand twice."""
    labels = t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), iri("l", "doc_id").alias("node"))
    return labels.unionByName(labels.filter("CAST(id AS long) % 7 = 0"))


def references(spark, d):
    return t(spark, d, "documents").select(iri("d", "doc_id").alias("s"), F.col("lang").alias("type"), F.col("doc_id").cast("string").alias("ref"))


@register("lift_resolutions", f"SELECT {S1('d', 'doc_id')} AS s, CASE WHEN l.doc_id IS NOT NULL AND doc_id % 7 <> 0 THEN 'urn:resolvedReport' ELSE 'urn:unresolvedReportIdentifier' END AS p, CASE WHEN l.doc_id IS NOT NULL AND doc_id % 7 <> 0 THEN {S1('l', 'doc_id')} ELSE {V('doc_id')} END AS o FROM documents LEFT JOIN labels l USING (doc_id)")
def lift_resolutions(spark, d):
    return spelt(L.resolutions(references(spark, d), catalog_with_doubles(spark, d), "ref", "id", "node", DOCS, VOC))


@register("resolution_counts", "SELECT lang AS type, CASE WHEN l.doc_id IS NULL THEN 'unresolved' WHEN doc_id % 7 = 0 THEN 'ambiguous' ELSE 'resolved' END AS status, count(*) AS n FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2")
def resolution_counts(spark, d):
    return L.resolution_counts(references(spark, d), catalog_with_doubles(spark, d), "ref", "id")


@register("payload_differences", "SELECT 'row:' || CAST(doc_id AS VARCHAR) AS locator, CASE doc_id % 5 WHEN 0 THEN 'changed' WHEN 1 THEN 'no such row' ELSE 'stored twice' END AS problem FROM labels WHERE doc_id % 5 < 3")
def payload_differences(spark, d):
    raw = recorded(t(spark, d, "labels"), "labels", "doc_id").select("doc_id", "locator", "payload_json")
    stored = raw.withColumn("payload_json", F.when(F.col("doc_id") % 5 == 0, "{}").otherwise(F.col("payload_json")))
    stored = stored.unionByName(stored.filter("doc_id % 5 = 2"))
    return L.payload_differences(stored, raw.filter("doc_id % 5 <> 1"), ["locator"])


@register("malformed_statements", "SELECT CASE WHEN doc_id % 3 = 2 THEN 'no snapshot' ELSE 'no record' END AS problem, count(*) AS n FROM labels WHERE doc_id % 3 = 2 OR doc_id % 5 = 0 GROUP BY ALL".replace("CASE WHEN doc_id % 3 = 2 THEN 'no snapshot' ELSE 'no record' END", "CASE WHEN doc_id % 5 = 0 THEN 'no record' ELSE 'no snapshot' END"))
def malformed_statements(spark, d):
    recs, _, said = lifted_labels(spark, d)
    return P.malformed(said, recs.filter("doc_id % 5 <> 0"), spark.createDataFrame([("urn:snapshot/0",), ("urn:snapshot/1",)], "snapshot_id string")).groupBy("problem").agg(F.count("*").alias("n"))


@register("canonical_union", "SELECT count(*) AS n FROM (SELECT doc_id, 'l', lang FROM documents UNION SELECT doc_id, 'o', source FROM documents UNION SELECT doc_id, 't', '' FROM documents)")
def canonical_union(spark, d):
    docs = documents(spark, d)
    return P.canonical_union(docs.unionByName(docs.filter(F.col("g") == DOCS).withColumn("g", F.lit("urn:g/again"))), [LABELS]).agg(F.count("*").alias("n"))


@register("review_projection", f"SELECT 'kept' AS part, '{T.OWL}Class' AS o, (SELECT count(*) FROM region) + 1 AS n UNION ALL SELECT 'kept', '{T.OWL}NamedIndividual', count(*) FROM customer UNION ALL SELECT 'kept', '{T.OWL}AnnotationProperty', 1 UNION ALL SELECT 'kept', 'urn:Customer', count(*) FROM customer UNION ALL SELECT 'excluded', '{T.OWL}ObjectProperty', 1".replace("(SELECT count(*) FROM region) + 1", "(SELECT count(*) FROM region) + 1 + (SELECT count(DISTINCT c_nationkey) FROM customer)"))
def review_projection(spark, d):
    asserted = sales(spark, d).filter(F.col("p").isin(Q.TYPE, T.RDFS + "subClassOf"))
    schema = spark.createDataFrame([(None, "urn:SourceRecord", Q.TYPE, T.OWL + "ObjectProperty", "iri", None, None)], "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string")
    full = P.review(asserted, schema, ["urn:identifier"], [])
    kept, gone = P.reasoning(full, asserted, ["urn:SourceRecord"])
    both = kept.withColumn("part", F.lit("kept")).unionByName(gone.withColumn("part", F.lit("excluded")))
    return both.filter(F.col("p") == Q.TYPE).groupBy("part", "o").agg(F.count("*").alias("n"))


@register("nquads_round_trip", "SELECT 'urn:d/' || CAST(doc_id AS VARCHAR) AS s, coalesce(text, '') AS o, 'literal' AS o_kind FROM documents UNION ALL SELECT '_:b1', 'café 😀 \\u0041', 'literal' UNION ALL SELECT 'urn:é', '_:b1', 'bnode'")
def nquads_round_trip(spark, d):
    """Documents' texts as statements, and lines with escapes and blank nodes, written, read, written and read again."""
    said = Q.lift(t(spark, d, "documents"), DOCS, iri("d", "doc_id"), Q.text("urn:text", F.coalesce("text", F.lit(""))), distinct=False).select(sinks.line().alias("value"))
    given = spark.createDataFrame([(r'_:b1 <urn:text> "caf\u00e9 \U0001F600 \\u0041" <urn:g/docs> .',), (r"<urn:\u00e9> <urn:text> _:b1 <urn:g/docs> .",)], "value string")
    again = cut(readers.parse_nquads(cut(said.unionByName(given))).select(sinks.line().alias("value")))
    return readers.parse_nquads(again).select("s", "o", "o_kind")


# --- shapes


def violations(name: str, graph: Callable, shape: S.Shape, sql: str) -> None:
    register(name, sql)(lambda spark, d: S.validate(graph(spark, d), [shape]).select("focus", "path", "component", "value"))


def _v(focus: str, path: str | None, component: str, value: str | None, rest: str) -> str:
    return f"SELECT DISTINCT {focus} AS focus, {'CAST(NULL AS VARCHAR)' if path is None else repr(path)} AS path, '{component}' AS component, {value or 'CAST(NULL AS VARCHAR)'} AS value {rest}"


DOC = S1("d", "doc_id")
violations("shacl_min_count", documents, S.Shape("x", ["urn:Document"], properties=[S.Property("urn:quality", min_count=1)]), _v(DOC, "urn:quality", "MinCount", None, "FROM documents ANTI JOIN labels USING (doc_id)"))
violations("shacl_max_count", sales, S.Shape("x", target_subjects_of=["urn:suppliedBy"], properties=[S.Property("urn:suppliedBy", max_count=1)]), _v(S1("p", "l_partkey"), "urn:suppliedBy", "MaxCount", None, "FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1"))
violations("shacl_node_kind", sales, S.Shape("x", target_subjects_of=["urn:status"], node_kind="iri", properties=[S.Property("urn:status", node_kind="iri")]), _v(S1("o", "o_orderkey"), "urn:status", "NodeKind", "o_orderstatus", "FROM orders"))
violations("shacl_datatype", documents, S.Shape("x", ["urn:Document"], properties=[S.Property("urn:quality", datatype=T.STRING), S.Property("urn:lang", datatype=T.STRING)]), _v(DOC, "urn:quality", "Datatype", V("quality"), "FROM labels SEMI JOIN documents USING (doc_id)"))
violations("shacl_min_length", documents, S.Shape("x", ["urn:Document"], properties=[S.Property("urn:origin", min_length=5)]), _v(DOC, "urn:origin", "MinLength", "source", "FROM documents WHERE length(source) < 5"))
violations("shacl_pattern", documents, S.Shape("x", ["urn:Document"], properties=[S.Property("urn:origin", pattern="^src[0-9]$")]), _v(DOC, "urn:origin", "Pattern", "source", "FROM documents WHERE NOT regexp_matches(source, '^src[0-9]$')"))
violations("shacl_class", sales, S.Shape("x", target_subjects_of=["urn:placedBy"], properties=[S.Property("urn:placedBy", class_="urn:Customer"), S.Property("urn:hasPart", class_="urn:Part")]), _v(S1("o", "o_orderkey"), "urn:hasPart", "Class", S1("p", "l_partkey"), "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"))
violations("shacl_in", documents, S.Shape("x", ["urn:Document"], properties=[S.Property("urn:lang", in_=["en", "de"])]), _v(DOC, "urn:lang", "In", "lang", "FROM documents WHERE lang NOT IN ('en', 'de')"))
violations("shacl_has_value", documents, S.Shape("x", target_subjects_of=["urn:toxic"], properties=[S.Property("urn:toxic", has_value="0")]), _v(DOC, "urn:toxic", "HasValue", None, "FROM labels WHERE toxic <> 0"))
violations("shacl_min_inclusive", documents, S.Shape("x", target_subjects_of=["urn:quality"], properties=[S.Property("urn:quality", min_inclusive=1)]), _v(DOC, "urn:quality", "MinInclusive", V("quality"), "FROM labels WHERE quality < 1"))
violations("shacl_qualified", sales, S.Shape("x", target_subjects_of=["urn:status"], properties=[S.Property("urn:placedBy", qualified_class="urn:Customer", qualified_min=1), S.Property("urn:hasPart", qualified_class="urn:Part", qualified_min=1)]), _v(S1("o", "o_orderkey"), "urn:hasPart", "QualifiedMinCount", None, "FROM orders"))
violations("shacl_subjects_of_class", documents, S.Shape("x", target_subjects_of=["urn:quality"], class_=["urn:Reviewed"]), _v(DOC, None, "Class", DOC, "FROM labels"))


@register("shacl_components", "SELECT 'MinCount' AS component, count(*) AS n FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT 'In', count(*) FROM documents WHERE lang <> 'en'")
def shacl_components(spark, d):
    shape = S.Shape("x", ["urn:Document"], properties=[S.Property("urn:quality", min_count=1), S.Property("urn:lang", in_=["en"])])
    return S.components(S.validate(documents(spark, d), [shape]))


graph_query("sparql_validation_report", lambda spark, d: S.report_quads(S.validate(documents(spark, d), [S.Shape("doc", ["urn:Document"], properties=[S.Property("urn:quality", min_count=1)])]), NS, "urn:g/validation"), "SELECT ?focus ?path ?constraint WHERE { GRAPH g:validation { ?r a sh:ValidationResult ; sh:focusNode ?focus ; sh:sourceConstraintComponent ?constraint . OPTIONAL { ?r sh:resultPath ?path } } }", f"SELECT {DOC} AS focus, 'urn:quality' AS path, '{T.SH}MinCountConstraintComponent' AS \"constraint\" FROM documents ANTI JOIN labels USING (doc_id)")

SOUND = S.Shape("doc", ["urn:Document"], target_subjects_of=["urn:quality"], properties=[S.Property("urn:lang", min_count=1, max_count=1, in_=["en", "de", "fr", "es"]), S.Property("urn:origin", min_count=1, datatype=T.STRING), S.Property("urn:partner", node_kind="iri", class_="urn:Document")])


def mutation(name: str, change: Callable, component: str, n: int = 1) -> None:
    rows = " UNION ALL ".join(f"SELECT 'urn:d/0' AS focus, '{c}' AS component" for c in component.split())
    register(f"shacl_mutation_{name}", rows)(lambda spark, d: S.validate(change(documents(spark, d).filter(F.col("g") == DOCS)), [SOUND]).select("focus", "component"))


_row = lambda p, o, kind="literal", dt=T.STRING: (DOCS, "urn:d/0", p, o, kind, dt, None)
mutation("no_lang", lambda q: S.mutate_drop(q, "urn:lang", "urn:d/0"), "MinCount")
mutation("no_origin", lambda q: S.mutate_drop(q, "urn:origin", "urn:d/0"), "MinCount")
mutation("second_lang", lambda q: S.mutate_add(q.filter("NOT (s = 'urn:d/0' AND p = 'urn:lang')"), _row("urn:lang", "en"), _row("urn:lang", "de")), "MaxCount")
mutation("unknown_lang", lambda q: S.mutate_add(S.mutate_drop(q, "urn:lang", "urn:d/0"), _row("urn:lang", "tlh")), "In")
mutation("literal_partner", lambda q: S.mutate_add(q, _row("urn:partner", "someone")), "NodeKind Class")
mutation("untyped_partner", lambda q: S.mutate_add(q, _row("urn:partner", "urn:elsewhere", "iri", None)), "Class")

# --- closure and rules


@register("closure_hierarchy", f"WITH RECURSIVE e AS (SELECT {S1('c', 'c_custkey')} AS s, {S1('n', 'c_nationkey')} AS o FROM customer UNION ALL SELECT {S1('n', 'n_nationkey')}, {S1('r', 'n_regionkey')} FROM nation UNION ALL SELECT {S1('r', 'r_regionkey')}, 'urn:root' FROM region), r AS (SELECT s, o, 1 AS depth FROM e UNION ALL SELECT r.s, e.o, depth + 1 FROM r JOIN e ON r.o = e.s) SELECT s, o, CAST(min(depth) AS INT) AS depth FROM r GROUP BY 1, 2")
def closure_hierarchy(spark, d):
    return K.closure(hierarchy_edges(spark, d))


TURNS = "SELECT a.conv_id, a.turn AS s, min(b.turn) AS o FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn GROUP BY 1, 2"


@register("closure_turns", f"WITH RECURSIVE e AS ({TURNS}), r AS (SELECT conv_id, s, o, 1 AS depth FROM e UNION ALL SELECT r.conv_id, r.s, e.o, depth + 1 FROM r JOIN e ON r.conv_id = e.conv_id AND r.o = e.s) SELECT conv_id, s, o, CAST(min(depth) AS INT) AS depth FROM r GROUP BY 1, 2, 3")
def closure_turns(spark, d):
    from pyspark.sql import Window

    turns = t(spark, d, "conversations").select("conv_id", F.col("turn").alias("s")).distinct()
    edges = turns.withColumn("o", F.lead("s").over(Window.partitionBy("conv_id").orderBy("s"))).filter("o IS NOT NULL")
    return K.closure(edges, key="conv_id").select("conv_id", "s", "o", "depth")


@register("closure_recursive_cte", f"SELECT {S1('c', 'c_custkey')} AS s, {S1('n', 'c_nationkey')} AS o, 1 AS depth FROM customer UNION ALL SELECT {S1('c', 'c_custkey')}, {S1('r', 'n_regionkey')}, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT {S1('c', 'c_custkey')}, 'urn:root', 3 FROM customer UNION ALL SELECT {S1('n', 'n_nationkey')} AS s, {S1('r', 'n_regionkey')} AS o, 1 AS depth FROM nation UNION ALL SELECT {S1('n', 'n_nationkey')}, 'urn:root', 2 FROM nation UNION ALL SELECT {S1('r', 'r_regionkey')}, 'urn:root', 1 FROM region")
def closure_recursive_cte(spark, d):
    return K.acyclic_closure(hierarchy_edges(spark, d))


@register("shortest_path", f"SELECT {S1('c', 'c_custkey')} AS s, 'urn:root' AS o, 3 AS depth, concat_ws('>', {S1('c', 'c_custkey')}, {S1('n', 'c_nationkey')}, {S1('r', 'n_regionkey')}, 'urn:root') AS path FROM customer JOIN nation ON c_nationkey = n_nationkey")
def shortest_path(spark, d):
    edges = hierarchy_edges(spark, d)
    return K.shortest_paths(edges, edges.filter("startswith(s, 'urn:c/')")).filter("o = 'urn:root'").select("s", "o", "depth", F.array_join("path", ">").alias("path"))


ONTOLOGY = f"""@prefix u: <urn:> . @prefix rdfs: <{T.RDFS}> . @prefix owl: <{T.OWL}> .
u:Customer rdfs:subClassOf u:Party . u:Party rdfs:subClassOf u:Thing .
u:placedBy rdfs:domain u:Order ; rdfs:range u:Customer ; rdfs:subPropertyOf u:relatedTo ; owl:inverseOf u:placed .
u:ActiveCustomer owl:equivalentClass [ owl:intersectionOf ( u:Customer [ owl:onProperty u:placed ; owl:someValuesFrom u:Order ] ) ] .
"""


def facts_of_orders(spark, d):
    return sales(spark, d).filter(F.col("p").isin("urn:placedBy", Q.TYPE))


def inferred(spark, d):
    schema = turtle.skolemise(turtle.parse(ONTOLOGY), "urn:schema-node/")
    return R.infer(facts_of_orders(spark, d), R.Axioms.of(schema))


def rule_query(name: str, keep: Callable, sql: str) -> None:
    register(name, sql)(lambda spark, d: keep(inferred(spark, d)))


_types = lambda c: lambda x: x.filter((F.col("p") == Q.TYPE) & (F.col("o") == c)).select("s")
rule_query("rl_type_inheritance", _types("urn:Thing"), f"SELECT {S1('c', 'c_custkey')} AS s FROM customer")
rule_query("rl_domain_range", _types("urn:Order"), f"SELECT {S1('o', 'o_orderkey')} AS s FROM orders")
rule_query("rl_inverse", lambda x: x.filter("p = 'urn:placed'").select("s", "o"), f"SELECT {S1('c', 'o_custkey')} AS s, {S1('o', 'o_orderkey')} AS o FROM orders")
rule_query("rl_subproperty", lambda x: x.filter("p = 'urn:relatedTo'").select("s", "o"), f"SELECT {S1('o', 'o_orderkey')} AS s, {S1('c', 'o_custkey')} AS o FROM orders")
rule_query("rl_intersection_existential", _types("urn:ActiveCustomer"), f"SELECT DISTINCT {S1('c', 'o_custkey')} AS s FROM orders")
rule_query("rl_delta", lambda x: x.filter(~F.col("o").startswith("urn:schema-node/")).groupBy("p").agg(F.count("*").alias("n")), f"SELECT 'urn:placed' AS p, count(*) AS n FROM orders UNION ALL SELECT 'urn:relatedTo', count(*) FROM orders UNION ALL SELECT '{Q.TYPE}', (SELECT 2 * count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT o_custkey) FROM orders)")
rule_query("rl_explanations", lambda x: x.filter("o = 'urn:Order' OR p = 'urn:placed'").select("s", "rule", "axiom"), f"SELECT {S1('o', 'o_orderkey')} AS s, 'prp-dom' AS rule, 'urn:placedBy domain urn:Order' AS axiom FROM orders UNION ALL SELECT {S1('c', 'o_custkey')}, 'prp-inv', 'urn:placedBy inverseOf urn:placed' FROM orders")


@register("rl_ablation", "SELECT 0 AS inferred_orders, (SELECT 2 * count(*) FROM customer) AS inferred_types")
def rl_ablation(spark, d):
    """Without the placedBy premises nothing that rests on them is inferred; class inheritance stays."""
    ax = R.Axioms.of(turtle.skolemise(turtle.parse(ONTOLOGY), "urn:schema-node/"))
    left = R.infer(facts_of_orders(spark, d).filter("p <> 'urn:placedBy'"), ax)
    return left.agg(F.count_if(F.col("o") == "urn:Order").cast("int").alias("inferred_orders"), F.count("*").alias("inferred_types"))


# --- exports, integrity, isolation


@register("export_nquads", f"SELECT '<urn:d/' || CAST(doc_id AS VARCHAR) || '> <urn:quality> \"' || CAST(quality AS VARCHAR) || '\"^^<{T.INTEGER}> <urn:g/labels> .' AS line FROM labels UNION ALL SELECT '<urn:d/' || CAST(doc_id AS VARCHAR) || '> <urn:toxic> \"' || CAST(toxic AS VARCHAR) || '\"^^<{T.INTEGER}> <urn:g/labels> .' FROM labels")
def export_nquads(spark, d):
    return sinks.lines(documents(spark, d).filter(F.col("g") == LABELS))


@register("stage_isolation", f"SELECT {DOC} AS s, CAST(quality AS VARCHAR) AS o FROM labels JOIN documents USING (doc_id) WHERE lang <> 'en'")
def stage_isolation(spark, d):
    q = documents(spark, d)
    return P.misplaced(q, "urn:quality", q.filter("p = 'urn:lang' AND o = 'en'").select("s")).select("s", "o")


@register("lineage_cardinality", f"SELECT {DOC} AS s, 'urn:quality' AS p, 0 AS n FROM documents ANTI JOIN labels USING (doc_id)")
def lineage_cardinality(spark, d):
    q = documents(spark, d)
    return P.not_exactly_one(q, q.filter(F.col("g") == DOCS), ["urn:quality", "urn:lang"]).select("s", "p", F.col("n").cast("int").alias("n"))


@register("exclusion_projection", "SELECT 'kept' AS part, 3 * count(*) AS n FROM documents UNION ALL SELECT 'excluded', 2 * count(*) FROM labels")
def exclusion_projection(spark, d):
    kept, gone = P.projection(documents(spark, d), ["urn:quality", "urn:toxic"])
    return kept.agg(F.lit("kept").alias("part"), F.count("*").alias("n")).unionByName(gone.agg(F.lit("excluded").alias("part"), F.count("*").alias("n")))


@register("vocabulary_guard", f"SELECT {DOC} AS s FROM documents WHERE source = 'src3'")
def vocabulary_guard(spark, d):
    return Q.uses(documents(spark, d), ["src3"]).select("s")


@register("content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@register("inventory_problems", "SELECT 'f' || CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 0 THEN 'checksum' WHEN doc_id % 5 = 1 THEN 'size' WHEN doc_id % 5 = 2 THEN 'unregistered file' ELSE 'registered twice' END AS problem FROM documents WHERE doc_id % 5 < 4")
def inventory_problems(spark, d):
    files = t(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 5).alias("k"))
    receipts = files.filter("k <> 2").select("path", (F.col("bytes") + (F.col("k") == 1).cast("int")).alias("bytes"), F.when(F.col("k") == 0, "0").otherwise(F.col("sha256")).alias("sha256"), "k")
    return I.compare(files, receipts.unionByName(receipts.filter("k = 3")))


@register("table_digest", "SELECT count(*) AS n_rows FROM orders")
def table_digest(spark, d):
    orders = t(spark, d, "orders")
    a, b = (I.table_digest(x) for x in (orders, orders.repartition(5, "o_custkey")))
    return a.join(b, ["n_rows", "xor", "sum"]).select("n_rows")


@register("legal_triples", "SELECT true AS legal, (SELECT 3 * count(*) FROM documents) + (SELECT 2 * count(*) FROM labels) AS n UNION ALL SELECT false, 2 * count(*) FROM labels")
def legal_triples(spark, d):
    odd = documents(spark, d).filter(F.col("g") == LABELS).withColumns({"s": F.concat(F.lit('"'), "o", F.lit('"')), "o": F.col("s")})  # literals as subjects
    return Q.split_legal(documents(spark, d).unionByName(odd)).groupBy("legal").agg(F.count("*").alias("n"))


@register("generalized_triples", "SELECT count(DISTINCT lang) AS n FROM documents")
def generalized_triples(spark, d):
    return R.generalized(documents(spark, d), R.Axioms(range={("urn:lang", "urn:Language")}))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Lineage of customers' labels: records, statements and snapshots as quads, read back by one SPARQL star."""
    return QUERIES["sparql_lineage"](spark, d)
