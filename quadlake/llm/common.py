"""What the operators share: tables, the shared work folder, workers' import path, small column helpers."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: The white space that parts words: space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"
BATCH_ROWS, BATCH_BYTES, HEAP_SHARE = 1000, 16 << 20, 0.6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package, and bounds the Arrow batches by rows and bytes."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in (paths := env.get("PYTHONPATH", "").split(":")):
        env["PYTHONPATH"] = ":".join([root, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Work:
    """Tables written to the shared folder, to cut lineage where a result is read more than once; they outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        conf, clean = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(clean, None)
        conf.set(clean, "true")  # what was shuffled to write the table is freed with it
        try:
            df.write.option("compression", "zstd").parquet(path := f"{self.root}/{self.n}")
        finally:
            conf.set(clean, before) if before is not None else conf.unset(clean)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.work_path = path
        self.tidy()
        return out

    def tidy(self, share: float = HEAP_SHARE) -> None:
        """Collects the driver's garbage, of plans that are done, if its heap has grown over this share of its limit: else it grows to the limit."""
        heap = self.spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
        if heap.totalMemory() > share * heap.maxMemory():
            self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Frees a table that nothing reads any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.work_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot if over 1/HOT of all rows have it, so there are under HOT hot keys, whatever the data.
HOT = 4096


def spread(big: DataFrame, small: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """big join small (how: inner or left), where no task gets a hot key's rows. small has each key once, and in _n its rows in big; total: the
    rows of big. Hot keys, under HOT of them, are broadcast; the others are shuffled."""
    hot, cold = F.col("_n") * HOT > total, F.col("_n") * HOT <= total
    hot = F.broadcast(small.filter(hot).drop("_n"))
    return big.join(hot, keys).unionByName(big.join(hot.select(*keys), keys, "left_anti").join(small.filter(cold).drop("_n"), keys, how))


def words(text: Column) -> Column:
    """The words of a text, without the empty strings that leading and trailing white space leaves; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, use) -> Column:
    """use(value), with the value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def bitmap(hashes: DataFrame, each: int, most: int):
    """use -> use(seen), where seen(hash) holds for every hash h of a table, and for few others: a Bloom filter with two bits of each hash, of at
    least so many bits for each and 1 << most (at most 24) in all. However often use tests hashes, the plan holds the filter once."""
    n = hashes.agg(F.approx_count_distinct("h")).first()[0]
    bits = min(most, max(16, (each * n).bit_length()))
    last = (1 << (bits - 6)) - 1
    word = lambda h, by: F.shiftright(h, by).bitwiseAND(last).cast("int")
    places = lambda h: [(word(h, 6), h.bitwiseAND(63).cast("int")), (word(h, 32), F.shiftright(h, 26).bitwiseAND(63).cast("int"))]
    table = [0] * (last + 1)
    rows = hashes.select(F.explode(F.array(*[F.struct(k.alias("k"), bit.alias("bit")) for k, bit in places(F.col("h"))])).alias("x"))
    for k, x in rows.groupBy("x.k").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x.bit")))).collect():  # a row for each word of the bitmap at most
        table[k] = x
    map_ = F.from_json(F.lit(json.dumps(table)), "array<bigint>")

    def of(map_: Column):
        holds = lambda k, bit: F.getbit(F.get(map_, k), bit) == 1

        def seen(h: Column) -> Column:
            one, two = places(h)
            return F.when(holds(*one), holds(*two)).otherwise(False)

        return seen

    return lambda use: let(map_, lambda m: use(of(m)))
