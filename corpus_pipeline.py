"""From raw documents to packed sequences.

Documents that the quality classifier rejects go; of each group of near duplicates the first
document stays; documents with leaked benchmark items go; secrets are masked; what is left is
packed. Every stage takes all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquery.llm import decontaminate, neardup, packing, quality, secrets
from skyquery.llm.common import held_out, scope, spare_name, stored
from skyquery.llm.queries import table, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a classifier learned from the labelled, not held-out ones among them predicts to be good.

    Null and empty texts have the model's bias as score and are judged by it; repeated rows are judged alike; an empty table stays empty.
    """
    model = quality.fit(docs.filter(~held_out("doc_id")), table(spark, sf_dir, "labels"))
    score, predicted = spare_name(docs.columns, "_score"), spare_name(docs.columns, "_predicted")
    return quality.score(docs, model, score_column=score, predicted_column=predicted).filter(F.col(predicted) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates. Texts without a word and rows without an id stay; rows that repeat an id stay or go together."""
    kept = neardup.classes(docs.select("doc_id", "text")).filter("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no benchmark item contaminates. Null and empty texts and rows without an id stay; rows that repeat an id go together."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked; ``n_chars``, where there is such a column, is that of the masked text. Null and empty texts stay as they are, other columns too, whatever their names."""
    model = secrets.train(secrets.labelled_samples(docs))
    spans = spare_name(docs.columns, "_spans")
    found = secrets.scan(docs, model, base_column=spare_name(docs.columns, "_base"), spans_column=spans)
    text = secrets.redacted(F.col("text"), F.col(spans))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size(spans) > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences. A null text is empty; repeated rows are packed each; an empty table gives no pieces."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", first_of_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", secrets_masked),
    ("best-fit packing", packed),
]

#: Trained models, signatures and tokens have no SQL form; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's result but the last is written as Parquet and read again; what a stage stores on its way is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scope(spark):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{i}", outlives=True)
    return STAGES[-1][1](spark, docs, sf_dir)
