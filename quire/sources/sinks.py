"""Publishing tables and evidence without ever leaving a half-written or overwritten target."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import content_fingerprint, table


class PublishConflict(RuntimeError):
    """The target is not what the caller last saw, or the candidate did not read back as written."""


def checkpoint_base(setting: str | None, master: str) -> str:
    """The folder that spark.checkpoint.dir names; without it a temporary one, but only where all is one machine."""
    if not setting and not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return setting or tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, under the checkpoint folder; it is deleted when the session's JVM ends."""
    sc = spark.sparkContext
    fs, path, _ = _fs(spark, f"{checkpoint_base(sc.getConf().get('spark.checkpoint.dir'), sc.master)}/{uuid.uuid4().hex}")
    fs.deleteOnExit(path)
    return path.toString()


def written(df: DataFrame) -> DataFrame:
    """The rows, written under the shared folder and read again: what follows doesn't depend on how they came about."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Row count and the sum of row hashes: order doesn't matter, and equal rows don't cancel."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return int(r.n), int(r.h)


def table_fingerprint(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Of a published table; None where there is none."""
    fs, p, _ = _fs(spark, path)
    return fingerprint(spark.read.parquet(path)) if fs.exists(p) else None


def publish_verified(df: DataFrame, target: str, expected: tuple[int, int] | None) -> tuple[int, int]:
    """Write beside the target, read back, compare, check that the target is still as expected, then swap by rename.

    expected is what table_fingerprint gave when the caller last looked (None: no table). The target stays untouched on
    any conflict. Renames are not atomic on object stores: there the check before the swap narrows the gap only.
    """
    spark = df.sparkSession
    if table_fingerprint(spark, target) != expected:
        raise PublishConflict(f"{target} changed since it was read")
    staging = f"{target}.staging-{uuid.uuid4().hex}"
    fs, stage, jvm = _fs(spark, staging)
    try:
        df.write.mode("errorifexists").parquet(staging)
        written = fingerprint(spark.read.parquet(staging))
        if written != fingerprint(df):
            raise PublishConflict(f"{staging} did not read back as it was written")
        if table_fingerprint(spark, target) != expected:
            raise PublishConflict(f"{target} changed while it was being written")
        goal, old = jvm.org.apache.hadoop.fs.Path(target), jvm.org.apache.hadoop.fs.Path(f"{target}.old-{uuid.uuid4().hex}")
        if expected is not None and not fs.rename(goal, old):
            raise PublishConflict(f"{target} could not be moved aside")
        if not fs.rename(stage, goal):
            if expected is not None:
                fs.rename(old, goal)
            raise PublishConflict(f"{target} could not be replaced")
        if expected is not None:
            fs.delete(old, True)
        return written
    finally:
        fs.delete(stage, True)


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless there is one; whether it was created. Of several that try at once, one succeeds."""
    fs, p, jvm = _fs(spark, path)
    fs.mkdirs(p.getParent())
    content = bytearray(text.encode())
    try:
        if fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then
            options = spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 2)
            options[0], options[1] = jvm.java.nio.file.StandardOpenOption.CREATE_NEW, jvm.java.nio.file.StandardOpenOption.WRITE
            jvm.java.nio.file.Files.write(jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)), content, options)
        else:
            out = fs.create(p, False)
            out.write(content)
            out.close()
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def published_versions(spark: SparkSession, target: str) -> dict[int, str]:
    """The folders of a target's versions. A pointer that isn't written to its end doesn't count yet."""
    fs, p, jvm = _fs(spark, f"{target}/_versions")
    if not fs.exists(p):
        return {}
    out = {}
    for status in fs.listStatus(p):
        if status.getPath().getName().isdigit():
            stream = fs.open(status.getPath())
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text.endswith("\n"):
                out[int(status.getPath().getName())] = text.strip()
    return out


def publish_version(df: DataFrame, target: str, expected: int | None) -> int:
    """Publish the rows as the version after `expected` (None: the first): no data is moved, so it is safe on object stores too.

    The rows go to a folder of their own and are read back; then a pointer file with the next number is created unless it is
    there. Of publishers that saw the same version one wins; the others get a conflict, their folders are deleted, and readers
    never see part of a version. A publisher that dies between the creation and the end of its pointer leaves an unfinished
    one, which readers pass over and which has to be deleted before that number can be published.
    """
    spark = df.sparkSession
    if max(published_versions(spark, target), default=None) != expected:
        raise PublishConflict(f"{target} changed since it was read")
    name = uuid.uuid4().hex
    folder, number = f"{target}/data/{name}", 1 if expected is None else expected + 1
    fs, p, _ = _fs(spark, folder)
    try:
        df.write.mode("errorifexists").parquet(folder)
        if fingerprint(spark.read.schema(df.schema).parquet(folder)) != fingerprint(df):
            raise PublishConflict(f"{folder} did not read back as it was written")
        if not _put_if_absent(spark, f"{target}/_versions/{number}", f"{name}\n"):
            raise PublishConflict(f"version {number} of {target} was published meanwhile")
    except BaseException:
        fs.delete(p, True)
        raise
    return number


def read_published(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The newest version of a target, or the one asked for; it stays as it is whatever is published meanwhile."""
    versions = published_versions(spark, target)
    return spark.read.parquet(f"{target}/data/{versions[max(versions) if version is None else version]}")


def evidence_sink(df: DataFrame, path: str) -> None:
    """Evidence rows as JSON lines; an older run's evidence is never overwritten."""
    df.write.mode("errorifexists").json(path)


def _publish_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = content_fingerprint(table(spark, sf_dir, "documents")).select("doc_id", "sha256")
    target = f"{shared_folder(spark)}/fingerprints"
    publish_verified(hashes, target, None)
    return spark.read.parquet(target)


def _version_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = content_fingerprint(table(spark, sf_dir, "documents")).select("doc_id", "sha256")
    target = f"{shared_folder(spark)}/fingerprints"
    first = publish_version(hashes.filter("doc_id % 2 = 0"), target, None)
    publish_version(hashes, target, first)
    return read_published(spark, target)


def _evidence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    path = f"{shared_folder(spark)}/evidence"
    evidence_sink(rows.select(F.col("source").alias("name"), F.when(F.col("n_chars") > 0, "PASS").otherwise("FAIL").alias("status"), "n_docs", "n_chars"), path)
    return spark.read.schema("name string, status string, n_docs bigint, n_chars bigint").json(path)


QUERIES = {
    "publish_verified": (_publish_query, "select doc_id, sha256(text) sha256 from documents"),
    "publish_version": (_version_query, "select doc_id, sha256(text) sha256 from documents"),
    "evidence_sink": (_evidence_query, "select source as name, case when sum(n_chars) > 0 then 'PASS' else 'FAIL' end status, count(*) n_docs, cast(sum(n_chars) as bigint) n_chars from documents group by source"),
}
