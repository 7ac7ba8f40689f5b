from pathlib import Path

from pyspark.sql import functions as F

from verdara.sources import scratch

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffles(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {Path(files.apply(i).getPath()).name for i in range(files.size())
            if files.apply(i).getName().startswith("shuffle_")}


def test_shuffles_go_with_their_action(spark):
    spark.catalog.clearCache()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = shuffles(spark), spark.conf.get(CLEANUP)
    with scratch.brief_shuffles(spark):
        made = scratch.stored(df)
        assert shuffles(spark) <= before
    assert spark.conf.get(CLEANUP) == setting
    assert made.agg(F.sum("count")).first()[0] == 1000


def test_bucketed_table_is_grouped_without_a_shuffle(spark, capsys):
    names = len(spark.catalog.listTables())
    made = scratch.bucketed(spark.range(1000).select((F.col("id") % 7).alias("k"), "id"), "k", 300)
    assert len(spark.catalog.listTables()) == names
    counts = made.groupBy("k").count()
    counts.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert sorted(r["count"] for r in counts.collect()) == [142] + [143] * 6


def test_emptied_table_takes_no_room(spark):
    path = scratch.scratch_dir(spark) + "/table"
    scratch.stored(spark.range(1000), path)
    scratch.emptied(spark, path)
    assert spark.read.parquet(path).count() == 0
