"""Driver queries of the training-data operators and, where SQL can tell, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.llm import docpairs
from symweave.llm.handwritten import classified
from symweave.llm.leaks import leaked
from symweave.llm.neighbours import nearest, pairs
from symweave.llm.packing import BYTE_BPE, containers, pack_documents
from symweave.llm.quality import qualities
from symweave.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of symbols of which one at least is among the ten nearest of the other."""
    vectors = table(spark, d, "vec_symbols").select(F.col("symbol_id").alias("id"), "embedding")
    return pairs(nearest(vectors, width=384))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods whose docstring tells something."""
    joined = docpairs.pairs(table(spark, d, "symbols"))
    return joined.where("id = documented_id").select("id")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Signatures with descriptions, those of declarations given to definitions without any too."""
    return docpairs.pairs(table(spark, d, "symbols"))


def _origins(spark: SparkSession, d: str) -> DataFrame:
    return classified(table(spark, d, "indexed_files"), table(spark, d, "file_heads"), table(spark, d, "vendor_checksums"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that nobody of the project wrote by hand."""
    return _origins(spark, d).where("origin <> 'handwritten'").select("file_path")


def p4_origins(spark: SparkSession, d: str) -> DataFrame:
    """Every file with where it comes from."""
    return _origins(spark, d).select("file_path", "origin")


def p6_placements(spark: SparkSession, d: str) -> DataFrame:
    """Where each document's tokens lie in the containers of each capacity."""
    return pack_documents(table(spark, d, "documents"), table(spark, d, "token_budgets"), BYTE_BPE)


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Containers, their fill and the least number possible, for each capacity."""
    return containers(p6_placements(spark, d), table(spark, d, "token_budgets"))


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """For each capacity: the documents placed, containers filled beyond it, and documents in more parts than they need."""
    placed = p6_placements(spark, d).join(table(spark, d, "token_budgets").groupBy("budget_id").agg(F.min("capacity").alias("capacity")), "budget_id")
    fills = placed.groupBy("budget_id", "capacity", "container_id").agg(F.sum("n_tokens").alias("fill"))
    over = fills.groupBy("budget_id").agg(F.count(F.when(F.col("fill") > F.col("capacity"), 1)).alias("overfull"))
    texts = placed.groupBy("budget_id", "capacity", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"))
    split = F.count(F.when(F.col("parts") != F.ceil(F.col("n") / F.col("capacity")), 1)).alias("split_wrongly")
    return texts.groupBy("budget_id").agg(F.count("*").alias("documents"), split).join(over, "budget_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that repeat passages of evaluation items, with the items."""
    return leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_leaks_by_item(spark: SparkSession, d: str) -> DataFrame:
    """Number of leaking documents of each evaluation item, those without any included."""
    per_item = p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))
    items = table(spark, d, "eval_items").select("item_id", "task")
    return items.join(per_item, "item_id", "left").select("item_id", "task", F.coalesce("documents", F.lit(0)).alias("documents"))


def p8_qualities(spark: SparkSession, d: str) -> DataFrame:
    """Statistics, share of prose and type of each document."""
    return qualities(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents most of whose characters aren't running sentences."""
    return p8_qualities(spark, d).where("kind = 'other'").select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p4_found": p4_found,
    "p4_origins": p4_origins,
    "p6_placements": p6_placements,
    "p6_containers": p6_containers,
    "p6_invariants": p6_invariants,
    "p7_found": p7_found,
    "p7_leaks_by_item": p7_leaks_by_item,
    "p8_found": p8_found,
    "p8_qualities": p8_qualities,
}
ORACLES: dict[str, str] = {
    # What holds of any solution.
    "p6_invariants": """select budget_id, count(*) as documents, cast(0 as bigint) as overfull, cast(0 as bigint) as split_wrongly
from (select distinct budget_id from token_budgets where capacity >= 1 and budget_id is not null) b, documents d where d.text <> '' group by budget_id""",
}
