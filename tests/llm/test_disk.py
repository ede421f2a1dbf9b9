"""What queries leave on disk while they go on."""

import os
import time

from pyspark.sql import functions as F

from kerbline.llm import minhash, similar_sets
from kerbline.llm.common import cut, shared_dir


def shuffle_files(spark):
    """Bytes of shuffle files; those that are removed go soon after their query."""
    places = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(os.path.join(p, f)) for place in places for p, _, files in os.walk(str(place)) for f in files if f.startswith("shuffle_"))


def test_a_cut_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    found = cut(spark.range(200_000).groupBy((F.col("id") % 50_000).alias("k")).count())
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert found.count() == 50_000 and found.join(found, "k").count() == 50_000


def test_the_sets_of_candidates_are_removed(spark):
    base = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join([*base, f"x{i}"])) for i in range(6)] + [(9, "other words")], "doc_id long, text string")
    found = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert found == {*((i, 0) for i in range(6)), (9, 9)}
    assert not [x for x in os.listdir(shared_dir(spark).removeprefix("file://").removeprefix("file:")) if x.startswith("sets-")]


def test_sizes_that_cannot_be_similar_give_no_pair(spark):
    keyed = spark.createDataFrame([(1, 10, 100), (1, 11, 81), (1, 12, 79)], "key long, node long, n long").coalesce(1)
    found = similar_sets._candidates(keyed, 1000, 0.8).collect()
    assert sorted((r["u"], r["v"]) for r in found) == [(10, 11), (11, 12)]
