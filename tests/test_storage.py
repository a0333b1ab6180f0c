import os
import time

from pyspark.sql import functions as F

from tidemark import storage


def there(df):
    return os.path.exists(df.inputFiles()[0].removeprefix("file://"))


def test_scratch_tables_go_with_their_block(spark):
    made = []
    with storage.scratch():
        with storage.scratch():
            made.append(storage.stash(spark.range(3), "inner"))
            made.append(storage.stash(spark.range(3), "result", outside=True))
            files = [df.inputFiles()[0].removeprefix("file://") for df in made]
        assert [os.path.exists(f) for f in files] == [False, True] and made[1].count() == 3
    assert not os.path.exists(files[1])
    assert there(storage.stash(spark.range(3), "kept"))


def test_shuffle_files_go_with_their_query(spark):
    def shuffled():
        folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in folders for _, _, files in os.walk(d.getPath()) for f in files if f.startswith("shuffle_") and f.endswith(".data")}

    before, setting = shuffled(), spark.conf.get(storage.SHUFFLES, None)
    kept = storage.stash(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "kept")
    assert shuffled() - before  # else the test shows nothing
    before = shuffled()
    with storage.shuffles_dropped(spark):
        table = storage.stash(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "dropped")
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before and table.count() == kept.count() == 7
    assert spark.conf.get(storage.SHUFFLES, None) == setting
