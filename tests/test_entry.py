"""Each registered query of the engine against its SQL in DuckDB, on the smallest tables; QUICK ones always, all with ALL_QUERIES=1."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quadlake import queries

DATA = "/root/testdata/sf0.001"
QUICK = ["row_locator", "stable_record_id", "context_classify", "supported_paths", "path_evidence", "coverage", "assertion_ids", "graph_stats", "sparql_optional", "sparql_theta", "sparql_agg_all", "sparql_lineage", "shacl_components", "closure_turns", "rl_intersection_existential", "export_nquads", "inventory_problems"]
NAMES = sorted(queries.SQL) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    a = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    b = sorted(repr([plain(dict(zip(want.columns, r, strict=True))[c]) for c in columns]) for r in want.fetchall())
    assert a and a == b


def test_registry():
    assert set(queries.SQL) == set(queries.QUERIES)
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
