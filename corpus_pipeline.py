"""From raw documents to packed sequences, every stage over all that the one before kept.

1. language ID: documents of no known language, or without text, go;
2. quality rules: documents that fail, or whose source fails as a host, go;
3. n-gram Jaccard join: of each group of near duplicates the least doc_id stays;
4. secret scans: secrets in the texts are replaced by a marker;
5. packing: the texts are tokenized and cut into sequences of powers of two.

All stages but the last return the columns of ``documents``. Rows are removed by doc_id:
repeated rows go or stay together, except that of rows of one doc_id and one text that are
near duplicates all stay; rows without a doc_id cannot be addressed and stay. Empty tables
give empty results; extra columns are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import host_rules, jaccard, language, packing, secret_scan
from terrace.llm.common import folder, put, reach

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BATCH_BYTES = 4 << 20
READ_ROWS = 1024
# Python workers return large arrays to the system when they are freed, rather than keep them
# for the stages that follow.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(1 << 20)}


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents but those rejected by doc_id; few are sent to where the texts are."""
    gone = put(rejected.select("doc_id").filter("doc_id is not null").distinct())
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def bounded(spark: SparkSession) -> SparkSession:
    """Read texts and send them to Python workers in small batches, whatever their lengths:
    executors hold several of them, outside their heaps too, and keep memory from stage to stage."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.sparkContext.environment.update(WORKERS)
    return spark


def stage(function):
    """A stage whose Python workers find this package."""
    return lambda spark, docs, sf_dir: function(bounded(reach(spark)), docs, sf_dir)


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs.withColumn("label", F.col("lang")))
    found = language.identify(docs, model, declared=F.col("lang"), host=F.col("source"))
    return without(docs, found.filter(~F.col("kept")))


@stage
def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, host_rules.judge(docs).filter(~F.col("kept")))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.join(docs)
    return without(docs, found.filter("component_id != doc_id"))


@stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    redacted = secret_scan.redact(docs.select(*COLUMNS), path, public_tokenizers.PATTERN)
    changed = F.char_length("text").cast("bigint")
    return redacted.withColumn("n_chars", F.when(F.col("text").isNotNull(), changed))


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack(packing.decompose(docs, path, public_tokenizers.PATTERN))
    digest = F.crc32("ids").alias("ids_crc32")
    names = ("doc_id", "start", "length", digest, "doc_tokens", "sequence_id", "offset", "bucket")
    return packed.select(*names)


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

# Tokens and language models cannot be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES:
        kept = function(spark, docs, sf_dir)
        path = folder(spark, "pipeline")
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs
