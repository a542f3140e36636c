"""What the three learned models do on rows that they have not learned from."""

import os

import pytest
from pyspark.sql import functions as F

from textmill.llm import catalog

SF = os.environ.get("TEST_MODEL_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_classifier_on_the_held_out_fold(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL").select("doc_id", "quality")
    held = catalog.op9_quality_classifier(spark, SF).where("held_out").join(labels, "doc_id")
    right, n = held.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right >= 0.95 * n


def test_rules_on_labelled_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL").select("doc_id", "quality")
    judged = catalog.op7_quality_rules(spark, SF).where("NOT base_failed").join(labels, "doc_id")
    got = {r.quality: (r.kept, r.n) for r in judged.groupBy("quality").agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    assert got[1][0] >= 0.98 * got[1][1]
    if 0 in got:
        assert got[0][0] <= 0.2 * got[0][1]


def test_mixture_beats_the_base_on_held_out_texts(spark):
    held = catalog.op1_deleted_interpolation(spark, SF).where("held_out")
    score, base, n = held.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert n > 1000 and score / n > base / n + 0.5
