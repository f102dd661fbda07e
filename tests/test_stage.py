import pytest
from pyspark.sql import functions as F

from lodestone.operators import passages
from lodestone.plans import stage


@pytest.fixture
def without_adaptive(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_counted_is_a_join(spark, how, without_adaptive):
    rows = spark.range(2000).select(F.col("id").alias("n"), F.when(F.col("id") % 10 > 0, F.lit(7)).when(F.col("id") % 20 > 0, F.col("id") % 40).alias("k"))
    groups = rows.where("k is not null and k <> 30").groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"))
    plain = rows.join(groups, "k", how)
    found = stage.join_counted(rows, groups, "k", "size", 2000, how).select(*plain.columns)
    assert sorted(found.collect(), key=str) == sorted(plain.collect(), key=str)


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_a_hot_key_is_in_no_task_alone(spark, without_adaptive):
    rows = spark.range(8000).repartition(4).select(F.col("id").alias("n"), F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("size"))
    assert most_in_a_task(stage.join_counted(rows, groups, "k", "size", 8000)) < 4000
    texts = rows.select(F.col("n").alias("doc_id"), F.col("k").alias("text"))
    kept = passages.first_of_equal(texts, ["doc_id"])
    assert kept.count() == 801 and kept.where("text = 'hot'").first()["doc_id"] == 1


def test_shared_folder_is_local_only_on_a_local_master(spark):
    class Elsewhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        stage.shared_folder(Elsewhere)


def test_tables_can_be_discarded(spark):
    table = stage.staged(spark.range(5), "gone")
    path = table.staged_at
    assert table.count() == 5
    stage.discard(table)
    with pytest.raises(Exception):
        spark.read.parquet(path)
