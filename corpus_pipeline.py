"""A corpus pipeline over ``documents``: quality rules, line dedup, SimHash
near-dedup, mixing to target weights, SentencePiece encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of ``documents``.  ``run`` writes every stage to
the shared folder and reads it again, so a lost executor never repeats more
than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import fresh, load_table, prepare, stored
from eddyline.llm.line_dedup import drop_site_boilerplate
from eddyline.llm.mixing import mix_sources
from eddyline.llm.pieces import sample_pieces
from eddyline.llm.quality import judge_documents
from eddyline.llm.simhash import simhash_groups


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's band.

    Null and empty texts have no words, so they go; null languages are one
    language; null ids count as unlabelled; rows that share an id or repeat
    are judged each; an empty table gives an empty table; all columns stay as
    they are, whatever their names."""
    prepare(spark)
    names = docs.columns
    judged = judge_documents(docs, names, labels=load_table(spark, sf_dir, "labels"))
    kept = judged.columns[len(names) + 6]
    return judged.filter(F.col(f"`{kept}`")).select(*[F.col(f"`{n}`") for n in names])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a large part of their source repeats;
    ``n_chars`` follows the text.

    Null texts stay null and empty ones empty; null sources are one source;
    repeated rows are pages of their own; texts of any length are taken whole;
    an empty table gives an empty table; other columns stay."""
    prepare(spark)
    out = drop_site_boilerplate(docs, F.col("source"), "text").select(*[F.col(f"`{n}`") for n in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: the smallest by id (nulls
    last), hash of the text and hash of the row.  Rows are told apart by all
    their columns, so rows that share an id, or have none, take part as any."""
    prepare(spark)
    row = fresh("_row", docs.columns)
    # a null leaves a hash as it is, so the nulls' places are part of it
    rows = docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns],
                                           *[F.isnull(F.col(f"`{c}`")) for c in docs.columns]))
    groups = simhash_groups(rows, id_col=row).select(row, "component_id").distinct()
    order = F.struct(F.isnull("doc_id").alias("last"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"),
                     F.col(row).alias("row"))
    first = (rows.select(row, order.alias("o")).join(groups, row)
             .groupBy("component_id").agg(F.min("o").alias("o")).select(F.col("o.row").alias(row)))
    return rows.join(first, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).distinct()


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 3 times).

    A null or empty text has size 0 and is taken as the mix decides for that
    size; null sources are one source; repeated rows and null ids are
    documents of their own; an empty table gives an empty table."""
    prepare(spark)
    mixed = mix_sources(docs)
    copies, turn = mixed.columns[-1], fresh("_turn", mixed.columns)
    return (mixed.filter(F.col(copies) > 0)
            .withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
            .select(*[F.col(f"`{n}`") for n in docs.columns]))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document.

    Null and empty texts have one segmentation without pieces, given as the
    operator defines it; repeated rows are sampled alike, as the seed is the
    row's key; texts of any length are encoded whole; an empty table gives an
    empty result."""
    prepare(spark)
    return sample_pieces(docs, k=2, carry=["doc_id", "source", "lang"])


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing to target weights", mix_to_weights),
    ("SentencePiece encoding", encode_pieces),
]

ORACLE_SQL = None      # perplexities, fingerprints and samples have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
