"""From raw documents to token ids in training order.

Toxic documents go, of equal texts one stays, of near-duplicate groups one stays,
the sources are mixed to their target weights in curriculum order, and the texts
are encoded.  Each stage reads what its predecessor wrote.

All stages take null ids, texts and sources, repeated rows, texts of any length, extra columns
(which they keep, whatever their names are; the last stage has columns of its own) and empty tables, from which they make empty ones.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellog.llm import bpe_codec, exact_dedup, mixing, near_dedup, queries, toxicity
from tessellog.llm.common import fresh, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier chain, trained on the labelled rows of ``docs``, finds toxic.

    Texts that are null, empty or without letters stay, and without any label all do; a probability of exactly one half is toxic.
    Repeated rows share a verdict.
    """
    models = toxicity.train(docs, queries.chain_labels(spark, sf_dir), queries.CATEGORIES)
    prefix, verdict = fresh(docs, "toxicity_", "toxicity_verdict")
    return toxicity.score(docs, models, queries.CATEGORIES, prefix=prefix, toxic=verdict).where(~F.col(verdict)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest id stays.

    Null texts count as empty.  Of repeated rows with that id one stays; a row without an id stays only if no equal text has one.
    """
    return exact_dedup.keep_rows(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarities of 0.8 or more on five-word shingles connect, the smallest id stays.

    Texts without words all stay.  Of several rows of that id one stays; a row without an id stays only if no connected one has one.
    """
    return near_dedup.keep_rows(docs, k=5, percent=80).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and in the order, as the curriculum uses them.

    The rows are sorted by training position over the files of the result.  Texts without words are not used; rows that share an
    id, or have none, are used each by its own plan, and ties are in the order of ids.
    """
    return mixing.mix(docs)


def place_in(docs: DataFrame) -> Column:
    """A number that rises along the rows of ``docs``: by file and row where it is read from files, else by partition.

    Readers promise no order; the files of a sorted result and their rows are numbered in it.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
    return F.shiftleft(F.when(part != "", part).otherwise("0").cast("long"), 36) + F.col("_metadata.row_index")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, position, token_ids, n_tokens, round_trip): token ids of every text, whether they decode to it, and its place in training.

    Null and empty texts have no tokens.  ``position`` rises in the order of the mix, so sorting by it gives training order.
    """
    ranks, pattern = queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.pattern()
    coded = bpe_codec.round_trip(docs.select("doc_id", "source", place_in(docs).alias("position"), "text"), ranks, pattern)
    return coded.select(
        "doc_id",
        "source",
        "position",
        "token_ids",
        F.expr("cast(octet_length(token_ids) / 4 as bigint)").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe_encoding", encode),
]
#: Trained models, similarity links and byte-pair merges are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
