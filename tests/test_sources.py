"""Reading layouts from parquet and writing intermediate tables."""

from pyspark.sql import functions as F

from starqa.operators.sales import sales_view
from starqa.plans import questions
from starqa.sources.schemas import MUSIC_STORE
from starqa.plans.tasks import build_tasks
from starqa.sources import storage
from starqa.sources.storage import shared_folder, stored
from starqa.sources.warehouse import music_store


def test_music_store_reads_wider_exports(spark, music_tables, music, tmp_path):
    """Exports often hold 64-bit integers and dates as text."""
    for name, df in music_tables.items():
        wide = [
            F.col(f.name).cast({"int": "bigint", "timestamp_ntz": "string"}.get(f.dataType.simpleString(), f.dataType.simpleString()))
            for f in df.schema
        ]
        df.select(wide).write.parquet(f"{tmp_path}/{name}.parquet")
    star = music_store(spark, str(tmp_path))
    assert set(MUSIC_STORE) == set(music_tables)
    rows = lambda s: sorted(map(str, sales_view(s).collect()))
    assert rows(star) == rows(music)
    assert questions.total_revenue_in_year(star, 2021).first().year == 2021


def test_stored_tables_go_to_the_shared_folder(spark):
    df = spark.range(10).withColumn("year", F.lit(2020))
    back = stored(df, "numbers", partition_by="year")
    assert back.columns == ["id", "year"] and sorted(back.collect()) == sorted(df.collect())
    folder = shared_folder(spark)
    assert all(folder in path for path in back.inputFiles())


def written(spark):
    return list(storage._WRITTEN.get(spark.sparkContext.applicationId, []))


def test_a_table_is_written_once_for_one_plan_over_the_same_files(spark, tmp_path):
    spark.range(20).write.parquet(f"{tmp_path}/in")
    plan = lambda least=3: spark.read.parquet(f"{tmp_path}/in").filter(F.col("id") > least).groupBy((F.col("id") % 4).alias("m")).count()
    before = written(spark)
    first = stored(plan(), "once", reuse=True)
    second = stored(plan(), "once", reuse=True)
    assert first.inputFiles() == second.inputFiles() and len(written(spark)) == len(before) + 1
    assert stored(plan(4), "once", reuse=True).inputFiles() != first.inputFiles()
    assert stored(plan(), "once").inputFiles() != first.inputFiles()
    spark.range(30).write.mode("overwrite").parquet(f"{tmp_path}/in")
    changed = stored(plan(), "once", reuse=True)
    assert changed.inputFiles() != first.inputFiles() and changed.agg(F.sum("count")).first()[0] == 26


def test_two_task_sets_are_written_once(spark, music_tables, tmp_path):
    for name, df in music_tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    first = build_tasks(music_store(spark, str(tmp_path)))
    before = written(spark)
    second = build_tasks(music_store(spark, str(tmp_path)))
    assert written(spark) == before
    assert first.tasks.inputFiles() == second.tasks.inputFiles() and first.truth.inputFiles() == second.truth.inputFiles()
    build_tasks(music_store(spark, str(tmp_path)), reuse=False)
    assert len(written(spark)) > len(before)


def test_unfinished_tables_are_not_used_again(spark, tmp_path):
    import os

    spark.range(5).write.parquet(f"{tmp_path}/in")
    plan = lambda: spark.read.parquet(f"{tmp_path}/in").select((F.col("id") * 2).alias("twice"))
    first = stored(plan(), "cut", reuse=True)
    os.remove(f"{written(spark)[-1]}/_SUCCESS")
    assert stored(plan(), "cut", reuse=True).inputFiles() != first.inputFiles()


def test_nothing_is_left_behind(tmp_path):
    """A session of its own: its tables go when it ends, also without a call."""
    import subprocess
    import sys

    code = """
import os, sys
from pyspark.sql import SparkSession
from starqa.sources.storage import remove_stored, stored
folder = sys.argv[1]
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", folder).config("spark.ui.enabled", "false").getOrCreate()
own = lambda: sorted(n[0] for n in os.listdir(folder) if n[:2] in ("a-", "b-", "c-"))
stored(spark.range(3), "a"), stored(spark.range(3), "b")
assert own() == ["a", "b"]
assert remove_stored(spark) == 2 and own() == []
stored(spark.range(3), "c")
assert own() == ["c"]
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code, str(tmp_path)], check=True, timeout=300)
    assert not [n for n in tmp_path.iterdir() if n.name[:2] in ("a-", "b-", "c-")]
