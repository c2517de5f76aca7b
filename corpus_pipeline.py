"""A training-data pipeline over the documents table, stage by stage.

Each stage takes the documents that its predecessor kept and is written before
the next one reads them.
"""

from tickloom.llm import decontaminate, importance, lines, mixing, simhash
from tickloom.llm.common import new_folder, written


def quality(spark, docs, sf_dir):
    """Drop documents that importance resampling towards labelled target text rejects."""
    return importance.resample(docs, importance.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark, docs, sf_dir):
    """Drop lines that stand, up to one edit, in an earlier place."""
    return lines.dedup_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """Keep one document of each group of near copies: SimHash of 3-word shingles, 2 bits at most."""
    return simhash.first_of_each(docs)


def decontamination(spark, docs, sf_dir):
    """Drop documents that contain a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark, docs, sf_dir):
    """Give each document its rate; drop those that are never to be drawn."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
]

# No SQL: the stages learn from labels, draw samples and follow links to their
# ends. tests/llm/test_pipeline.py has a plain version of each stage instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows that the last stage returns for the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/stage-{number}")
    return docs
