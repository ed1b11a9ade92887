"""A training-data pipeline of five stages, each on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegrid.llm.mixing import mix_sources
from sievegrid.llm.native import free_name
from sievegrid.llm.near_dup import near_duplicates
from sievegrid.llm.packing import pack
from sievegrid.llm.quality_rules import quality_rules
from sievegrid.llm.queries import RANKS
from sievegrid.llm.secrets import redact
from sievegrid.session import discard, recording, stage, table, unstage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the stage called last has staged.
_left: list[str] = []


def tidy(function: Stage) -> Stage:
    """A stage whose beginning deletes what the one before staged on its way, texts with secrets among it.

    The earlier stage's result has been written by then; if this one's documents still read what it staged, that stays.
    """

    @wraps(function)
    def run_tidily(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _left, docs)
        with recording() as paths:
            result = function(spark, docs, sf_dir)
        _left.extend(paths)
        return result

    return run_tidily


@tidy
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is judged by itself, whatever its id."""
    return quality_rules(docs, carry=True).where("kept").select("carried.*")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The table with a column that tells its rows apart."""
    row = free_name(docs, "row_of")
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "keyed"), row


@tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that of the smallest id; rows without an id come last, ties by their order."""
    keyed, row = _keyed(docs)
    groups = near_duplicates(keyed, id_col=row).select(F.col(row).alias("row"), "component_id")
    named = groups.join(keyed.select(F.col(row).alias("row"), "doc_id"), "row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))["row"].alias("first"))
    gone = stage(named.join(first, "component_id").where("row <> first").select(F.col("row").alias(row)), "gone")
    return keyed.join(gone, row, "left_anti").select(*docs.columns)


@tidy
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated as often as the mix takes its words, to the nearest whole number."""
    keyed, row = _keyed(docs)
    taken, _ = mix_sources(keyed, id_col=row)
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    wanted = stage(taken.select(row, copies.alias("copies")).where("copies > 0"), "copies")
    numbered = keyed.join(wanted, row).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(row))
    return numbered.select(*docs.columns)


@tidy
def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, copy, piece, ..., batch, slot, tokens): the texts as token ids, piece by piece with their batches.

    ``copy`` numbers the rows of one document and text from 1: the mix repeats a document, all else has been made single.
    """
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("row_of")
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_of")).withColumn("copy", F.row_number().over(same))
    packed = pack(numbered.select(F.struct("doc_id", "copy", "row_of").alias("key"), "text"), RANKS, id_col="key")
    return packed.select("key.doc_id", "key.copy", *[c for c in packed.columns if c != "key"])


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("near dedup", drop_near_copies),
    ("secret scan", mask_secrets),
    ("mixing", mix),
    ("packing", pack_lengths),
]

#: The near-duplicate and mixing stages are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        if before is not None:
            unstage(before)
        before = docs
    discard(spark, _left)
    return docs
