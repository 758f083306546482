"""Corpus pipeline: from raw documents to token ids, in stages that each act on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; a driver writes it as Parquet and hands what it reads back to the next
one. All stages but the last return the columns of documents.

Defined cases, in every stage: no documents give none. A null or empty text isn't rejected, has no duplicates, no benchmark window and no secret, and has no tokens. Texts are judged whole, a very long one in
one task. Rows with a null or a repeated id are told apart by their texts. Columns that documents has beside the five, whatever their names, are carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantata.functions.signal import scan
from cantata.functions.text import let
from cantata.llm import bpe, decontaminate, minhash, secrets, toxicity
from cantata.llm.common import Scratch, input_bytes, small_side
from cantata.llm.queries import table, vocabulary_path

#: What stands for a secret in a text that stays.
MASK = "[secret]"


def text_hash() -> Column:
    return F.xxhash64(F.col("text"))


def identity() -> Column:
    """Tells rows apart where ids are null or repeat; rows equal in id and text are one document. Null ids come last."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), text_hash().alias("hash"))


def without(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """docs but those whose id and text hash are in rows (columns doc_id and hash). The rows are broadcast while they are few."""
    gone = scratch.keep(rows.select(F.col("doc_id").alias("__gone"), F.col("hash").alias("__hash")).distinct(), "gone", input_bytes(docs))
    return docs.join(small_side(gone, gone.count(), 56), F.col("doc_id").eqNullSafe(F.col("__gone")) & (text_hash() == F.col("__hash")), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go. Rows are judged by their texts: others with the same or no id stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    judged = toxicity.score(docs.withColumn("hash", text_hash()), model, keep=("doc_id", "hash"))
    return without(docs, judged.where("score >= 0.5"), Scratch(spark))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id stays. Rows without an id
    are no one document where their texts are equal, so one of them stays."""
    found = minhash.cluster(docs.select("text", identity().alias("row")), id_col="row").where("not kept")
    out = without(docs, found.select(F.col("row.id").alias("doc_id"), F.col("row.hash").alias("hash")), Scratch(spark))
    alone = F.col("doc_id").isNotNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    copies = out.where(~alone).withColumn("__hash", text_hash()).dropDuplicates(["__hash"]).drop("__hash")
    return out.where(alone).unionByName(copies)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verbatim window of a benchmark item go. Rows are judged by their texts: others with the same or no id stay."""
    keep = ("doc_id", "hash")
    found = decontaminate.digest(decontaminate.find(docs.withColumn("hash", text_hash()), table(spark, sf_dir, "benchmark"), keep=keep), keep)
    return without(docs, found.where("contaminated"), Scratch(spark))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked and their documents stay; n_chars follows the text. Overlapping spans are masked as one. Rows are masked by id
    and text, so repeated ids and null ones make no difference."""
    scratch, columns = Scratch(spark), docs.columns
    mark = F.xxhash64(F.col("text"))
    found = secrets.scan(docs.select("doc_id", "source", "text", mark.alias("__hash")), keep=("doc_id", "__hash")).where(F.size("found") > 0)

    def joined(spans):
        """Runs of spans (by start) that touch: one begins where a span starts behind all ends before it, and reaches to the last end before the next one begins."""
        reach = scan(F.transform(spans, lambda s: s["end"]), F.greatest)
        begins = lambda r: F.filter(F.transform(spans, lambda s, i: F.when((i == 0) | (s["start"] > F.get(r, i - 1)), i)), lambda i: i.isNotNull())
        run = lambda r, b, k, i: F.struct(F.get(spans, i)["start"].alias("start"), F.get(r, F.coalesce(F.get(b, k + 1), F.size(spans)) - 1).alias("end"))
        return let(reach, lambda r: let(begins(r), lambda b: F.transform(b, lambda i, k: run(r, b, k, i))))

    runs = let(F.sort_array(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), joined)
    found = scratch.keep(found.select(F.col("doc_id").alias("__id"), "__hash", runs.alias("__runs")).dropDuplicates(["__id", "__hash"]), "found", input_bytes(docs))
    size = found.agg(F.count("*").alias("n"), F.sum(F.size("__runs")).alias("runs")).first()
    found = small_side(found, size.n, 64 + 16 * (size.runs or 0) // max(size.n, 1))

    part = lambda start, length: F.col("text").substr((start + 1).cast("int"), length.cast("int"))
    last = lambda i: F.coalesce(F.get("__runs", i - 1)["end"], F.lit(0).cast("bigint"))
    kept = F.transform("__runs", lambda s, i: part(last(i), s["start"] - last(i)))
    masked = F.array_join(F.array_append(kept, part(last(F.size("__runs")), F.length("text"))), MASK)
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (mark == F.col("__hash")), "left")
    out = out.withColumn("__masked", F.when(F.col("__runs").isNotNull(), masked))
    new = {"text": F.coalesce("__masked", "text"), "n_chars": F.coalesce(F.length("__masked").cast("bigint"), "n_chars")}
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and offsets of each document, with the digests of the ids and of what they decode to."""
    return bpe.encode(docs, vocabulary_path(), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("byte-level BPE", encode),
]

#: Language models and token merges can't be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
