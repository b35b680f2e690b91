"""File inventories against receipts, coverage, freezing once, fingerprints, repeatability."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(inventory: DataFrame, receipts: DataFrame) -> DataFrame:
    """(path, problem) for files without a receipt, receipts without a file, doubly registered paths, and other sizes or checksums."""
    a = inventory.select("path", F.col("bytes").alias("a_bytes"), F.col("sha256").alias("a_sha"))
    b = receipts.groupBy("path").agg(F.count("*").alias("n"), F.min("bytes").alias("b_bytes"), F.min("sha256").alias("b_sha"))
    problem = (
        F.when(F.col("n").isNull(), "unregistered file").when(F.col("a_sha").isNull(), "missing file").when(F.col("n") > 1, "registered twice")
        .when(F.col("a_bytes") != F.col("b_bytes"), "size").when(F.col("a_sha") != F.col("b_sha"), "checksum")
    )
    return a.join(b, "path", "full").select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def verify(inventory: DataFrame, receipts: DataFrame) -> None:
    """Raises ValueError with the first problems, if there are any."""
    if found := compare(inventory, receipts).orderBy("path").take(5):
        raise ValueError("; ".join(f"{p}: {what}" for p, what in found))


def outside(receipts: DataFrame, root: str) -> DataFrame:
    """Receipts whose path leaves the allowed directory."""
    return receipts.filter(~F.col("path").startswith(root.rstrip("/") + "/") | F.col("path").contains("/../"))


def coverage(listing: DataFrame, inventory: DataFrame, receipts: DataFrame) -> DataFrame:
    """Names that aren't in all three of listing, files and receipts, with where they are."""
    tag = lambda df, k: df.select(F.substring_index("path", "/", -1).alias("name"), F.lit(k).alias("k"))
    every = tag(listing, "listing").unionByName(tag(inventory, "file")).unionByName(tag(receipts, "receipt"))
    return every.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("found_in")).filter("found_in <> 'file,listing,receipt'")


def freeze(receipts: DataFrame, path: str) -> None:
    """Writes the receipts once; a second time is an error."""
    receipts.write.mode("errorifexists").json(path)


def fingerprint(parts: Iterable[object]) -> str:
    """One identifier for a build's inputs and code, whatever the parts' order of keys."""
    return hashlib.sha256(json.dumps(list(parts), sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str).encode()).hexdigest()


def table_digest(df: DataFrame) -> DataFrame:
    """One row: rows, and an order-free digest of all columns. Equal tables have equal digests, whatever their partitions."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"))
