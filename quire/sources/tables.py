"""Reading the corpus tables with declared schemas; no schema is inferred in a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.progress import ProgressSource

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


class EmptyCorpus(ValueError):
    """The table to be opened has no rows."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, dealt over all of them, for work that costs more than moving the rows; others stay as they are.

    Adaptive execution sets the number of parts: small tables get one for each core, large ones so many that none is large.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.hint("rebalance") if len(df.inputFiles()) < n else df


def load_corpus(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """Open a table; an empty one is an error before any use. Only one row is looked at."""
    df = table(spark, sf_dir, name)
    if df.isEmpty():
        raise EmptyCorpus(f"{sf_dir}/{name} has no rows")
    return df


def content_fingerprint(df: DataFrame, column: str = "text") -> DataFrame:
    """SHA-256 of a column's UTF-8 bytes; null stays null, as a missing file has no hash."""
    return df.withColumn("sha256", F.sha2(F.col(column).cast("binary"), 256))


def file_fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and SHA-256 of raw files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def corpus_inventory(documents: DataFrame, least_chars: int = 2000) -> DataFrame:
    """Documents and characters per language, and whether there are enough of them."""
    sums = documents.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_text_chars"))
    return sums.withColumn("enough", F.col("n_text_chars") >= least_chars)


def progress_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines progress as a stream. A line counts once its newline is there, and files that grow are read on from where they were."""
    spark.dataSource.register(ProgressSource)
    return spark.readStream.format("progress_lines").load(path)


QUERIES = {
    "load_corpus": (lambda s, d: load_corpus(s, d).select("doc_id", "lang", "source", "n_chars"), "select doc_id, lang, source, n_chars from documents"),
    "content_fingerprint": (lambda s, d: content_fingerprint(table(s, d, "documents")).select("doc_id", "sha256"), "select doc_id, sha256(text) sha256 from documents"),
    "corpus_inventory": (
        lambda s, d: corpus_inventory(table(s, d, "documents")),
        "select lang, count(*) n_docs, cast(sum(length(text)) as bigint) n_text_chars, sum(length(text)) >= 2000 enough from documents group by lang",
    ),
}
