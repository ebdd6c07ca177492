"""The pipeline over null, repeated, empty and very long rows, columns of any kind, and an empty table."""

from __future__ import annotations

import random

from cases import WORDS, benchmark, documents
from pyspark.sql import functions as F

import corpus_pipeline
from lociworks.llm import quality_rules, simhash


def prose(seed: int, n: int = 80) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", " ", "-"]) + rng.choice(WORDS) for _ in range(n))


def table(spark, rows):
    return documents(spark, rows).withColumn("extra", F.create_map(F.lit("k"), F.col("score"))).withColumn("row", F.lit("clash")).withColumn("key", F.lit(1))


def test_every_stage_keeps_columns_and_states(spark, tmp_path):
    plain, other = prose(3), prose(5)
    bench = benchmark(spark)
    passage = "the quick brown foxes jumped over seven lazy sleeping dogs near the river bank"
    rows = [(1, plain), (2, plain), (2, plain), (None, plain), (None, other), (3, None), (None, None), (4, ""), (5, "short"), (6, f"{prose(9)} {passage}"), (7, prose(11) + " password=abcdefghijkl0123"), (8, prose(13, 9000))]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    kept = {(r.doc_id, r.text) for r in docs.collect()}
    verdicts = [r.kept for r in quality_rules.measure(documents(spark, [(i, t) for i, t in rows if i in (1, 7, 8) or t == other])).collect()]
    assert all(verdicts)
    assert kept == {(1, plain), (None, other), (7, prose(11) + " [SECRET]"), (8, prose(13, 9000))}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in kept) and all(r.n_tokens == len(r.ids) for r in got)


def test_an_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_map_column_and_clashing_names(spark):
    kept = simhash.keep_one(table(spark, [(1, prose(3)), (1, prose(3)), (2, prose(5))]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.first().extra == {"k": 9.5}
