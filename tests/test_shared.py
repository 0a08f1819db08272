"""Session helpers: the shared folder, lineage cuts, registries."""

from pyspark.sql import functions as F

from tests.conftest import ROOT

from tessera.plans import catalog, shared


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared.shared_dir(spark) == configured
    df = spark.range(10).withColumn("x", F.rand(3))
    once = shared.stored(df)
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in once.collect()} and once.count() == 10
    assert shared.cut(df).count() == 10 and shared.stored(df.limit(0)).count() == 0


def test_a_stored_table_leaves_nothing_that_was_shuffled_and_can_be_discarded(spark):
    import os

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = shuffled()
    once = shared.stored(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffled() - before and once.count() == 7
    folder = os.path.dirname(once.inputFiles()[0].removeprefix("file://"))
    shared.discard(once)
    assert folder and not os.path.exists(folder)


def test_spread_deals_out_few_partitions_only(spark):
    least = 4 * spark.sparkContext.defaultParallelism
    assert shared.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == least
    assert shared.spread(spark.range(10).repartition(least + 3)).rdd.getNumPartitions() == least + 3


def test_rows_are_counted_as_they_pass(spark):
    df, seen = shared.observed(spark.range(7), "passed", F.max("id").alias("most"))
    assert df.where("id > 2").count() == 4 and seen.get == {"rows": 7, "most": 6}


def test_entry_goes_on_without_what_the_training_data_operators_need():
    import subprocess
    import sys

    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True, cwd=ROOT)


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and "p3_found" in catalog.queries()
