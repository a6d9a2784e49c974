"""A training corpus from ``documents``: quality, line dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``, whatever else these hold. In every
stage an empty table stays empty, texts of any length are taken whole, and rows are told apart by
what they hold, not by their id. What else happens to nulls, ties and repeated rows, each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import byte_bpe, lines, mixture, neardup, quality
from larkspur.llm.common import cut
from larkspur.llm.queries import PATTERN, RANKS
from larkspur.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the base rules or the repetition limits reject go.

    Each row is judged alone: null, empty and blank texts go, repeated rows stay or go together,
    null ids and sources do not matter.
    """
    ship_package(spark)
    return quality.keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: boilerplate lines of a source are cut out of its texts; n_chars follows.

    All rows stay, also those whose text becomes empty; a null text stays null, with a null n_chars;
    rows of a null source form one source; repeated rows count as pages of their own.
    """
    names = docs.columns
    out = lines.drop_boilerplate(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*names) if "n_chars" in names else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each class of near copies the document with the smallest id stays.

    Rows that share that id all stay, since they are one document. Texts without words and rows
    with a null id are copies of nothing and stay.
    """
    ship_package(spark)
    return neardup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: every copy that the mix takes is a row; documents that it does not take go.

    Rows come in the order of the shards and shuffled within each, so the files that are written
    from them hold the shards one after another; the columns of documents have no place for their
    numbers. A null source is a source, a null id an id; rows that repeat an id are taken together;
    documents without words go along with their block.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", "text")  # so no column of docs can clash
    mixed = mixture.mix(rows, mixture.plan_mixture(docs)).select("_row", "doc_id", "copies")
    return mixture.write_order(mixed).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token ids of every text, with the digest of the bytes they decode to.

    One row for each row of the mix: doc_id, ids, n_tokens, decoded_sha256; null and empty texts
    have no ids, null ids are carried along.
    """
    ship_package(spark)
    return byte_bpe.encode_texts(docs, RANKS, PATTERN, outputs=("ids", "n_tokens", "decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]

#: The SimHash forest and the hashes of the mix have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
