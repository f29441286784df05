import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from meetlake.session import build_session
    session = build_session("meetlake-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def results(spark):
    """Canonical rows from dicts; fields not given take the defaults of a sound result."""
    from meetlake.schema import RESULT_SCHEMA
    from pyspark.sql import types as T

    base = dict(athlete_id="A1", athlete_name="ANN EXAMPLE", identity_confidence="CANDIDATE", competition="Meet A",
                year=2020, division="Open", weight_class="66", equipment="CLASSIC", bodyweight=65.0,
                squat_1=200.0, squat_2=210.0, squat_3=220.0, best_squat=220.0, bench_1=120.0, bench_2=130.0,
                bench_3=135.0, best_bench=135.0, deadlift_1=220.0, deadlift_2=230.0, deadlift_3=245.0,
                best_deadlift=245.0, total=600.0, place=1)
    schema = T.StructType([T.StructField("seq", T.LongType()),
                           *[T.StructField(f.name, f.dataType, True) for f in RESULT_SCHEMA.fields]])

    def make(*rows):
        filled = [{"seq": i, **base, **r} for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in filled], schema)

    return make
