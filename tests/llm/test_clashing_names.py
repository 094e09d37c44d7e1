"""Extra columns with the names of helper columns: none is read, changed or lost, and nothing crashes."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import sparkloom.llm
from sparkloom.llm import quality_classifier, toxicity
from sparkloom.llm.queries import fold

DATA = "/root/testdata/sf0.001"
CODE = "\n".join(p.read_text() for p in Path(sparkloom.llm.__file__).parent.glob("*.py"))
#: Every name that the subpackage gives a column.
NAMES = sorted({n for n in re.findall(r'(?:alias|withColumn|withColumnRenamed)\((?:"\w+", )?"(\w+)"', CODE)} - {"doc_id", "text", "lang", "source"})


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").limit(120)
    twice = plain.unionByName(plain.filter("doc_id % 5 = 0").withColumn("doc_id", F.col("doc_id") + 100_000))
    own = F.concat(F.lit("own "), F.col("doc_id").cast("string"))
    return twice.select("*", *(own.alias(n) for n in NAMES)).cache()


def test_the_names_are_those_of_the_code():
    assert {"_marked", "_bucket", "_bit", "_map", "digest", "key", "hot", "best", "stands", "first", "grade", "row", "size"} <= set(NAMES) and len(NAMES) > 40


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_clashing_columns(spark, docs, stage):
    kept = dict(corpus_pipeline.STAGES)[stage](spark, docs, DATA)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert rows and all(r[n] == f"own {r.doc_id}" for r in rows for n in NAMES)
    bare = docs.select("doc_id", "text", "lang", "source")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)[stage](spark, bare, DATA).collect())


def test_packing_takes_clashing_columns(spark, docs):
    assert dict(corpus_pipeline.STAGES)["packing"](spark, docs, DATA).count() >= docs.count()


def test_models_learn_from_tables_with_clashing_columns(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    extra = labels.select("*", *(F.lit("own").alias(n) for n in NAMES if n not in labels.columns))
    ratings = extra.drop("grade").withColumn("grade", F.col("quality"))
    names = [c for c in docs.columns if c != "toxic"]
    graded = quality_classifier.grade(docs, quality_classifier.learn(docs, ratings, fold(4) != 2))
    assert graded.count() == docs.count()
    assert toxicity.score(docs.select(names), toxicity.learn(docs.select(names), extra.select("doc_id", "toxic"), fold(4) != 2)).count() == docs.count()
