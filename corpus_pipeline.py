"""From raw documents to token ids in five stages.

1. quality: documents that the quality rules reject go.
2. near_duplicates: of every group of near copies the document of the smallest id stays.
3. repeated_strings: bytes of strings of 200 bytes that occur more than once go; a document of which nothing is left goes as well.
4. decontamination: documents that hold a benchmark item go.
5. tokens: the rest is encoded to token ids and, as a check on the round trip, decoded; doc_id, ids and their digests are returned, and the other columns go.

The first four stages return all columns of documents, whatever their names, also others than text; n_chars follows the text. Rows that repeat are copies, of which one stays.
Null and empty texts fail the quality rules; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, minhash, quality, suffix
from tessera.llm.common import saved, shared_dir, table, unused


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", "lang")
    return quality.quality(rows, keep=("_row",)).where("kept").select("_row.*")


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    of = unused(docs, "hash")
    marked = docs.withColumn(of, F.xxhash64("text"))
    stay = minhash.near_duplicates(marked, keep=(of,)).where("kept").select(F.col("doc_id").alias("id"), F.col(of).alias("h")).distinct()
    same = marked["doc_id"].eqNullSafe(stay["id"]) & (marked[of] == stay["h"])
    return marked.join(stay, same, "left_semi").dropDuplicates(["doc_id", of]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))
    out = suffix.removed(rows, keep=("_row",), as_text=True).where("n_removed < n_bytes OR n_bytes = 0")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns])


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, hold=False)


STAGES = [
    ("quality", _quality),
    ("near_duplicates", _near_duplicates),
    ("repeated_strings", _repeated_strings),
    ("decontamination", _decontamination),
    ("tokens", _tokens),
]
#: Suffix sorting, Bayesian pruning, retrieval and BPE have no SQL form; tests/llm holds the result against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, where = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"{where}/{k}-{name}")
    return docs
