"""From documents to token files in five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay, repeated rows and null ids included; null texts and texts without a
    letter go. An empty table stays empty. Further columns are kept, whatever their names."""
    from docloom.llm.langid import keep_identified

    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least id; repeated rows are copies. Texts without a
    word are no copies of each other and stay."""
    from docloom.llm.orderminhash import keep_first_of_class

    return keep_first_of_class(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, repeated rows alike. Null texts hold none; with an empty benchmark all stay."""
    from docloom.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their domains ask, drawn by a hash of the row: repeated rows alike. With an
    empty table there are no rows."""
    from docloom.llm.mixing import mix

    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in the token files, as read back from them, null ids first; a null text has the end id alone."""
    from docloom.llm.tokenbin import read_files, write_files

    return read_files(write_files(docs))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("weights", weights), ("token_files", token_files)]
#: A trained classifier and MinHash are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    from docloom.llm.common import materialise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
