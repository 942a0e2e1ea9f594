"""What the operators leave on disk: shuffle files go with their query, tables of steps with their operator."""

import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

from atomweave.llm import jaccard_join
from atomweave.llm.common import scratch, shared_root, written


def tables(spark) -> set[str]:
    at = urlparse(shared_root(spark)).path + "/atomweave"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_join_leaves_only_what_its_result_reads(spark):
    rows = [(i, " ".join(f"w{i // 3}x{k}" for k in range(40)) + f" own{i}" * (i % 3)) for i in range(30)]
    docs, before = spark.createDataFrame(rows, "doc_id long, text string"), tables(spark)
    got = jaccard_join.one_of_each(docs)
    left = tables(spark) - before
    assert {x.rsplit("-", 1)[0] for x in left} == {"jaccard-docs", "jaccard-gone"}
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 30, 3))
    jaccard_join.jaccard_report(docs).collect()
    assert {x.rsplit("-", 1)[0] for x in tables(spark) - before - left} == {"jaccard-reach", "jaccard-names"}


def test_written_drops_its_shuffle_files(spark):
    tracker, key = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(key, None), tracker.shuffleStatuses().size()
    out = [written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "dropped") for _ in range(5)]
    assert tracker.shuffleStatuses().size() <= before and spark.conf.get(key, None) == was
    assert out[0].agg(F.sum("count")).first()[0] == 1000


def test_scratch_keeps_for_the_one_around(spark):
    before = tables(spark)
    with scratch(spark):
        with scratch(spark, "kept"):
            kept, _ = written(spark.range(3), "kept"), written(spark.range(3), "gone")
        assert kept.count() == 3 and len(tables(spark) - before) == 1
    assert tables(spark) == before
