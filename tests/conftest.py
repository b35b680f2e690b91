import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "2").config("spark.default.parallelism", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


QUAD = "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string"


@pytest.fixture
def quads(spark):
    def make(*rows):
        """Rows (g, s, p, o) with o an IRI, or a literal if it begins with a quote."""
        out = []
        for g, s, p, o in rows:
            lit = o.startswith('"')
            out.append((g, s, p, o[1:] if lit else o, "literal" if lit else "iri", "http://www.w3.org/2001/XMLSchema#string" if lit else None, None))
        return spark.createDataFrame(out, QUAD)

    return make
