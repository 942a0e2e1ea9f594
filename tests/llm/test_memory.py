"""What the operators hold of an executor's memory: its Python workers share the limit with the JVM."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark import SparkContext

from atomweave.llm import bpe, mixing, quality
from atomweave.llm.common import text_slices

LEAVES = [("d", "en", "a", 100.0, 300.0), ("d", "en", "b", 10.0, 30.0), ("e", "es", "a", 50.0, 150.0)]


def test_budgets_start_no_python_workers(spark, monkeypatch):
    df = spark.createDataFrame(LEAVES, "domain string, lang string, source string, tokens double, holds double").localCheckpoint()

    def none(*_, **__):
        raise AssertionError("rows of Python start workers of their own kind")

    monkeypatch.setattr(SparkContext, "parallelize", none)
    assert {r.source: r.budget for r in mixing.budgets(df.where("domain = 'd'"), {("d", "en"): 2.0, ("d", "en", "b"): 3.0}, 60.0).collect()} == {"a": 30.0, "b": 30.0}
    assert mixing.budgets(df, {}, 100.0).count() == 3


@pytest.mark.parametrize("what", ["BPE", "passages"])
def test_a_batch_of_texts_is_held_in_parts(what):
    import public_tokenizers

    column = pa.array([" ".join(f"w{(i * k) % 997}" for k in range(400)) for i in range(3000)])  # 5 MB
    run = bpe.load(public_tokenizers.path("word_bpe_49k.json")).encode_batch if what == "BPE" else quality.PassageFeatures()
    run([f"w{k}" for k in range(997)])  # the caches are not the batch's
    tracemalloc.start()
    for _, _, texts in text_slices(column):
        run(texts)
        del texts
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < (20e6 if what == "BPE" else 60e6), peak
