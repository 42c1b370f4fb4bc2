"""The corpus pipeline: five operators in a row, each on what the one before kept.

Defined cases, beside those of the operators: every stage takes null and empty
texts, texts of any length, rows without id, repeated rows, an empty table and
further columns of any name, which all stages but the last return as they are.
A null or empty text is scored as it is and goes where the classifier rejects it;
else it stays, as a null or empty text, until packing makes its end token.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import free_name, held_out, read_table, saved
from strandline.llm.decontaminate import drop_contaminated
from strandline.llm.jaccard_join import keep_one_of_each
from strandline.llm.line_dedup import drop_repeated_lines
from strandline.llm.packing import pack_documents
from strandline.llm.quality import learn_quality, score_quality
from strandline.llm.queries import tokenizer_path

#: Documents whose quality score is below it go.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule ensemble rejects."""
    model = learn_quality(docs, read_table(spark, sf_dir, "labels"), usable=~held_out("doc_id", 5))
    score = free_name(docs, "score")
    return score_quality(docs, model, name=score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; n_chars follows the text."""
    out = drop_repeated_lines(docs, characters=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingles overlap by 0.8 or more."""
    return keep_one_of_each(docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into windows of 4096."""
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("packing", packing),
]

#: Tokenisation and the classifier have no SQL form; tests check the stages by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
