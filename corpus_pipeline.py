"""A training-corpus pipeline: quality, near duplicates, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ngram_join, packing, quality, secrets
from tidemark.llm.common import materialize, ship, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go.

    Null and empty texts are scored like others, repeated rows alike; without labels every score
    is 0.5 and all stay. An empty table stays empty. Extra columns come back, whatever their names.
    """
    ship(spark)
    labels = table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~quality.held_out()))
    return quality.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at five-word Jaccard >= 0.8 stays: that with the least id.

    Of repeated ids, rows are judged by their own texts; of rows with one id and one text, one
    stays. Texts without words (null and empty ones too) are linked with nothing and all stay.
    An empty table stays empty. Extra columns come back, whatever their names.
    """
    ship(spark)
    rows = materialize(ngram_join.jaccard_rows(docs, width=5, num=80, den=100).filter("n_shingles > 0"), "rows")
    return ngram_join.keep_first(docs, rows)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows.

    Null texts stay null, with a null n_chars; empty texts and those without secrets stay as they
    are. Repeated rows all stay; an empty table stays empty. Extra columns come back unchanged.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*(f"`{c}`" for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens.

    A null or empty text is one closing token; longer documents than a sequence are cut, ties in
    length are arbitrary, repeated rows are packed as often as they occur. No row, no sequence.
    """
    ship(spark)
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scans), ("best-fit packing", best_fit_packing)]

#: a learned classifier decides the first stage, so SQL cannot express the result
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
