"""The corpus pipeline: language identification, line dedup, near-dedup, decontamination, packing.

Every stage takes and (but for the last) returns the columns of its documents, whatever these are beside doc_id and text (and lang for
the first): extra columns are kept, whatever their names. Null ids and null texts, empty and very long texts, repeated rows and
empty tables are handled as each stage says. ``run`` writes out each stage, so none is computed twice and no lineage goes over two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweir.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from wordweir.llm.common import table
from wordweir.llm.queries import tokenizer_path
from wordweir.session import scratch

#: A document in which windows of so many benchmark items occur is dropped.
LEAKED_ITEMS = 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted.

    A null text, one without a letter, and every text where no row has a language to learn from, go. Repeated rows stay or go alike.
    """
    return language_id.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many documents share; n_chars, where there is one, follows the text.

    A null text stays null, an empty one empty; rows without an id lose nothing; rows that repeat an id count as one document.
    """
    done = line_dedup.dedup_lines(docs)
    text = F.when(F.col("record.text").isNotNull(), F.col("kept"))
    new = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return done.select(*(new.get(c, F.col(f"record.`{c}`")) for c in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id (null ids last).

    Null and empty texts are one text; texts without words are alike only if equal; rows that repeat both id and text are one row.
    """
    return near_dedup.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Null and empty texts, and all texts where the benchmark is empty, stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), least=LEAKED_ITEMS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, each with its token ids. A null or empty text is one piece, of the end id; repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("near", near), ("benchmark", benchmark), ("packing", pack)]

#: The trained language model, the hashed darts and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read back by the next."""
    docs, place = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{place}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
