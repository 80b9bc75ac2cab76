"""Shared helpers of the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set once per driver process when the session names no shared folder (tests, local mode).
_own_scratch: list[str] = []
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Texts are long: Arrow batches of fewer rows keep Python workers small.  A lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); an own temporary one in local mode only.

    On a cluster a folder of the driver's machine is not seen by executors, so a missing setting is an error there.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_scratch:
        _own_scratch.append("file://" + tempfile.mkdtemp(prefix="textloom-"))
    return _own_scratch[0]


def materialize(df: DataFrame, tag: str, release: bool = False) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back.

    release: the shuffle files of this write go as soon as it has ended.  Else they stay until the driver happens to
    collect its garbage, and add to the disk that later steps take.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/textloom-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_RELEASE)
    spark.conf.set(_RELEASE, "true" if release else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes the tables under frames that materialize wrote and that nothing reads any more.

    Only folders of materialize are touched, never an input.  Their successors must have been written before, so that
    a lost executor never needs them.
    """
    for df in frames:
        spark = df.sparkSession
        jvm, own = spark.sparkContext._jvm, f"{scratch_dir(spark).rstrip('/')}/textloom-"
        plain = lambda path: path.split(":", 1)[-1].replace("///", "/")  # noqa: E731  file:/a and file:///a are one
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if plain(folder).startswith(plain(own)):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_prefix(columns: list[str]) -> str:
    """The shortest run of underscores that no column begins with: for columns that come and go."""
    prefix = "_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def slot_of(bits: int, col: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(col), F.lit(bits))


def bitmap(ids: DataFrame, bits: int, col: str = "doc_id") -> np.ndarray:
    """Packed bitmap over hashed ids, of a fixed size of bits / 8 bytes: bit slot_of(id) is set for every id."""
    slots = ids.select(slot_of(bits, col).alias("s"))
    word = F.floor(F.col("s") / 64).cast("int").alias("w")
    got = slots.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 64).cast("int"))).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return out.view(np.uint8)


def in_bitmap(packed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((packed[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).astype(bool)


def whole_text(col: str = "text") -> Column:
    """Null is the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def fold_of(modulus: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id hashes as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """Bytes of a text column: sizes the number of shuffle buckets, so that one bucket's size is bounded."""
    return int(df.select(F.sum(F.octet_length(F.col(col))).alias("b")).first()["b"] or 0)


def bucket_count(total_bytes: float, per_bucket: float, least: int = 8) -> int:
    """A power of two, so that a bucket is a bit range of a hash."""
    return 1 << max(int(math.log2(least)), math.ceil(math.log2(max(1.0, total_bytes / per_bucket))))


def bounded_labels(labels: DataFrame, label: str, keep: Column, rows: int) -> DataFrame:
    """At most `rows` labelled ids, one row each: (doc_id, y).

    `rows` bounds what a classifier is fitted on; ids are taken in the order of a hash.  Null ids or labels are
    no evidence and are left out; an id with contradicting labels counts as its mean rounded up.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
    one = one.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
