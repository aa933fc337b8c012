import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def reads_of(spark):
    """Reads of one segment or several from lists of (name, seq, qual); a missing quality is all I."""
    from strandloom.model import Reads

    def make(*rows, **segments):
        segments = segments or {"read1": rows}
        names = sorted(segments)
        full = lambda r: (r[0], r[1], r[2] if len(r) > 2 else "I" * len(r[1]))
        data = [(k, *(full(segments[s][k]) for s in names)) for k in range(len(segments[names[0]]))]
        schema = "read_no long, " + ", ".join(f"{s} struct<name:string,seq:string,qual:string>" for s in names)
        return Reads(spark.createDataFrame(data, schema), tuple(names))

    return make
