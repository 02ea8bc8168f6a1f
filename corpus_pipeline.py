"""The corpus pipeline: STAGES applied to documents, each one's output written as Parquet and read again.

Language ID drops what isn't text of a known language, MinHash near-dedup keeps one document of each
group, mixing repeats documents by the sources' weights, and BPE encodes what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import bigru, bpe, dartminhash, mixing
from tidewake.llm.common import doc_crc_mod, unused, written

#: Documents with a smaller score are in none of the languages learnt. Even four labels give 0.25.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: not ``und`` and with a score of LEAST_SCORE at least.

    Null texts and texts without letters go; without a labelled row all go. Rows that repeat are
    judged each; all columns come back as they are; an empty table stays empty.
    """
    model = bigru.train(docs.filter(doc_crc_mod("doc_id", 5) != 0))
    pred, score = unused(docs, "lang_pred", "score")
    scored = bigru.predict_language(docs, model, (pred, score)).filter((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE))
    return scored.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id (null last).

    Texts decide: rows that share a doc_id and differ in text are documents of their own. Texts
    without words stay, null ones too; all columns come back as they are; an empty table stays empty.
    """
    return dartminhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the temperature mix of sources uses it, no source more than twice over.

    Null sources are one source, null texts have no tokens and stay; all columns come back as they
    are; an empty table stays empty.
    """
    return mixing.mixed(docs, max_repeats=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of the decoded text, for each use of a document.

    Null and empty texts have no tokens; repeated rows and null ids give a row each; an empty table gives none.
    """
    made = bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
    return made.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]
#: Neither the network nor the signatures can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
