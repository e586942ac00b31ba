"""One query for each operator, over its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.llm import bpe, classifier, line_dedup, mixing, packing, passages, periods, rules, sharding, simhash, topk, warc, whitening
from recordlake.llm.registry import query, table


@query("op6_sharding")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.manifest(table(spark, folder, "documents"))


@query("op7_quality_rules")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judge(table(spark, folder, "documents"))


@query("op10_quality_classifier")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_mixing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(table(spark, folder, "documents"))


def tokenizer_path() -> str:
    """The tokenizer file of the packing query, at the same place on every machine."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(table(spark, folder, "documents"), tokenizer_path())


@query("op4_exact_top_k")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"))


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op3_warc")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@query("op1_line_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.clean(table(spark, folder, "documents").select("doc_id", "text"))


@query("op9_suffix_array_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


@query("op11_byte_bpe")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(coded, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    out = whitening.whiten(table(spark, folder, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: one document in ten, by the checksum of its id, goes on from a word of its own as a repetition."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.get(F.transform(F.array(words), repeated), 0))
                       .otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.collapse(with_planted_runs(table(spark, folder, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return (found.withColumn("best", best).withColumn("lines", lines)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                    (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
                    F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
