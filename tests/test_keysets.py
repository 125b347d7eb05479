import pytest
from pyspark.sql import functions as F

from corpuscle.operators import keysets
from corpuscle.sources.store import Table

KEY = ["a", "b"]


def keyed(spark, n):
    """Keys of two columns with nulls in either; every seventh row is there twice."""
    rows = spark.range(n).select(
        F.when(F.col("id") % 29 != 0, F.concat(F.lit("r"), F.col("id") % 3)).alias("a"),
        F.when(F.col("id") % 31 != 0, F.col("id").cast("string")).alias("b"),
        F.col("id").alias("payload"),
    )
    return rows.unionByName(rows.where("payload % 7 = 0"))


@pytest.mark.parametrize("bits, most", [(1 << 26, 0), (1 << 16, 0), (1 << 8, 0), (1 << 26, 10**6)])
def test_rows_are_told_apart_as_joins_do(spark, monkeypatch, bits, most):
    """Also where most keys share their bit with one of the set."""
    monkeypatch.setattr(keysets, "BITS", bits)
    monkeypatch.setattr(keysets, "BROADCAST_ROWS", most)
    rows = keyed(spark, 3000)
    keys = rows.where("payload % 10 = 3 or payload % 29 = 0 or payload % 31 = 0").select(*KEY)
    for found, how in ((keysets.within, "left_semi"), (keysets.without, "left_anti")):
        wanted = rows.join(keys, KEY, how).select(*rows.columns).collect()
        assert sorted(found(rows, keys, KEY).collect(), key=str) == sorted(wanted, key=str)
    assert keysets.within(rows, keys.limit(0), KEY).count() == 0
    assert keysets.without(rows, keys.limit(0), KEY).count() == rows.count()


def test_payloads_are_not_shuffled_by_key(spark, monkeypatch):
    monkeypatch.setattr(keysets, "BROADCAST_ROWS", 0)
    rows = keyed(spark, 3000)
    keys = rows.where("payload % 10 = 3").select(*KEY)
    monkeypatch.setattr(keysets, "BITS", 1 << 30)
    plan = keysets.without(rows, keys, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_keys_of_another_type(spark, monkeypatch):
    monkeypatch.setattr(keysets, "BROADCAST_ROWS", 0)
    rows = spark.range(5)
    keys = rows.where("id > 2").select(F.col("id").cast("int").alias("id"))
    assert keysets.within(rows, keys, ["id"]).count() == 2
    assert keysets.without(rows, keys, ["id"]).count() == 3


@pytest.mark.parametrize("most", [0, 10**6])
def test_replace_with_rows_laid_out_before(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(keysets, "BROADCAST_ROWS", most)
    table = Table(spark, str(tmp_path / "t"), "repo_id string, id string, n long", ["repo_id", "id"], 3)
    files = spark.range(200).select(F.lit("r").alias("repo_id"), F.col("id").cast("string").alias("path"), F.col("id").alias("n"))

    def store(rows, touched):
        made = table.dealt(rows, "repo_id", "path").withColumnRenamed("path", "id")
        table.replace(made, touched.select("repo_id", F.col("path").alias("id")), dealt=True)

    store(files, files)
    store(files.where("n % 4 = 1").withColumn("n", -F.col("n")), files.where("n % 4 < 2"))
    wanted = {(str(i), -i if i % 4 == 1 else i) for i in range(200) if i % 4}
    rows = table.read().collect()
    assert {(r["id"], r["n"]) for r in rows} == wanted and len(rows) == len(wanted)
