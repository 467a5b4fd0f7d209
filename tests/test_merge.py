"""The checkpointed merge: restarts at every point, lost answers, revisions that moved on."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from florilege.streaming import merge

KEY = StructField("k", LongType())
COLUMNS = [StructField("name", StringType()), StructField("note", StringType())]
PLAN = "k long, name string, note string, base long"


def state(store):
    return {r["k"]: (r["name"], r["note"], r["revision"]) for r in store.current().collect()}


def test_actions_and_revisions(spark, tmp_path):
    store = merge.Store(spark, str(tmp_path / "s"), KEY, COLUMNS)
    assert store.current().count() == 0
    store.append(spark.createDataFrame([(1, "manual", None, 1, "x"), (1, "manual", None, 2, "y"), (2, "b", "n", 1, "x"), (4, "d", None, 5, "x")], store.schema))
    rows = [(1, "a", "note", 2), (2, "other", "other", 1), (3, "c", None, None), (4, "d", "n", 4), (2, "b", "n", None), (6, "f", "g", 1), (3, "c", None, None)]
    merge.merger(store)(spark.createDataFrame(rows, PLAN), 0)
    done = {r["k"]: (r["action"], r["revision"]) for r in merge.journaled(store).collect()}
    assert done[1] == ("augmented", 3) and done[3] == ("created", 1) and done[4] == ("stale", 5) and done[6] == ("stale", None)
    assert done[2][0] in ("unchanged", "stale")  # of two requests for one entity the smaller counts
    assert state(store) == {1: ("manual", "note", 3), 2: ("b", "n", 1), 3: ("c", None, 1), 4: ("d", None, 5)}
    merge.merger(store)(spark.createDataFrame(rows, PLAN), 0)  # the batch is journaled
    merge.merger(store)(spark.createDataFrame(rows, PLAN), 1)  # the same requests in another batch
    assert state(store) == {1: ("manual", "note", 3), 2: ("b", "n", 1), 3: ("c", None, 1), 4: ("d", None, 5)}
    again = {r["k"]: (r["action"], r["recovered"]) for r in merge.journaled(store).where("batch = 1").collect()}
    assert again[1] == ("augmented", True) and again[3] == ("created", True) and again[4] == ("stale", False)
    assert store.log().count() == 6


@pytest.mark.parametrize("failing", [(0, 0), (0, 1), (1, 1), (2, 0)])
def test_restarts_write_nothing_twice(spark, tmp_path, failing):
    for k in range(3):
        rows = [(i, f"n{i}", "plan", None if i % 2 else 1) for i in range(10 * k, 10 * k + 10)]
        spark.createDataFrame(rows, PLAN).coalesce(1).write.mode("append").parquet(str(tmp_path / "plan"))
    store = merge.Store(spark, str(tmp_path / "s"), KEY, COLUMNS)
    store.append(spark.createDataFrame([(i, "live", None, 1, "before") for i in range(0, 30, 2)], store.schema))
    stream = spark.readStream.schema(PLAN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "plan"))
    asked = []

    def broken(batch, part):
        asked.append((batch, part))
        if (batch, part) == failing:
            raise ConnectionError("gone")

    with pytest.raises(Exception, match="gone"):
        merge.run(stream, merge.merger(store, before_part=broken), str(tmp_path / "cp"))
    assert asked[-1] == failing
    merge.run(stream, merge.merger(store), str(tmp_path / "cp"))
    assert state(store) == {i: ("live", "plan", 2) if i % 2 == 0 else (f"n{i}", "plan", 1) for i in range(30)}
    assert store.log().where("request <> 'before'").groupBy("k").count().where("count > 1").count() == 0
    journal = merge.journaled(store)
    assert journal.count() == 30 and journal.where("recovered").count() == (0 if failing[1] == 0 else journal.where("recovered").count())
    assert failing[1] == 0 or 0 < journal.where("recovered").count() < 10
    merge.run(stream, merge.merger(store), str(tmp_path / "cp"))
    assert merge.journaled(store).count() == 30 and merge.journaled(store).agg(F.max("batch")).first()[0] == 2
