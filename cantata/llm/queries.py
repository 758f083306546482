"""The training-data operators as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantata.llm import bpe, centroids, chat_format, decontaminate, html_extract, licenses, minhash, oracles, prefix_trie, quality_rules, secrets, suffix_dedup, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path(), digests=True).drop("ids", "offsets")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


#: The rules of the URL query: host, path, action.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.match(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: their source is the repository, and hundreds and thousands of ids are directories in it."""
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), part(1000), part(100), F.col("doc_id").cast("string"))
    return licenses.scan(table(spark, sf_dir, "documents"), path)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(html_extract.extract(table(spark, sf_dir, "pages")))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.cluster(table(spark, sf_dir, "documents"), shingle=4)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digests=True))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(table(spark, sf_dir, "conversations"))


#: A conversation that speaks the marks of chat templates.
MARKS_ID, MARKS_TEXT = -7, "\\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).select(F.lit(MARKS_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS_TEXT).alias("text"))
    segments = chat_format.format_chats(chat_format.log(turns.unionByName(marks)))
    return chat_format.digest(chat_format.read_back(segments))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"op1_quality_rules": op1_quality_rules, "op2_bpe": op2_bpe, "op3_decontaminate": op3_decontaminate, "op4_secrets": op4_secrets, "op5_url_filter": op5_url_filter, "op6_licenses": op6_licenses, "op7_toxicity": op7_toxicity, "op8_html_extract": op8_html_extract, "op9_minhash": op9_minhash, "op10_suffix_dedup": op10_suffix_dedup, "op11_centroid_clustering": op11_centroid_clustering, "op12_prefix_trie": op12_prefix_trie, "op13_chat_format": op13_chat_format, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express. The list of the quality rules, token merges, cosines over growing sets of stretches, language models and block structure can't be
    said in SQL. These queries are tested against brute force."""
    return {
        "op3_decontaminate": oracles.DECONTAMINATE,
        "op4_secrets": oracles.SECRETS,
        "op5_url_filter": oracles.url_filter(URL_RULES),
        "op9_minhash": oracles.NEAR_DUPLICATES,
        "op10_suffix_dedup": oracles.REPEATS,
        "op11_centroid_clustering": oracles.CENTROIDS,
        "op12_prefix_trie": oracles.PREFIX_TRIE,
        "op13_chat_format": oracles.CHATS,
    }
