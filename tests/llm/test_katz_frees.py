from pathlib import Path

from pyspark.sql import functions as F

from kinmerge.llm import katz
from kinmerge.session import cut, shared_dir, shuffles


def test_a_model_leaves_neither_texts_nor_answers(spark):
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob("kinmerge-*"))
    model = katz.Katz(spark.createDataFrame([(i, f"a b {i % 3} c") for i in range(40)], "doc_id bigint, text string"))
    new = {p.name.split("-")[1]: p for p in set(shared.glob("kinmerge-*")) - before}
    assert "chunks" not in new and not (new["ngrams"] / "kind=answer").exists()
    assert model.scores.count() == 40 and model.counts.count() > 0


def test_what_was_shuffled_for_a_kept_table_is_gone_with_it(spark):
    cut(spark.range(10).groupBy(F.col("id") % 3).count(), free=True)
    before = shuffles(spark)
    cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), free=True)
    assert shuffles(spark) <= before
