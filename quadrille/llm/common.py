"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: with texts of 3 KB a batch is about 3 MB.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a Python worker's memory does not depend on text lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a new temporary one if all runs in this process, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quadrille-")
        spark.sparkContext.setCheckpointDir(found)
    return str(found).rstrip("/")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that ``df`` does not have, whatever the case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A name that means the column of just that name, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def save(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet under the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quadrille-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quadrille_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what save() wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_quadrille_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id belongs to fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0))


#: Labels (languages, classes) that a classifier can learn at most.
MOST_LABELS = 1000


def sample_threshold(df: DataFrame, by: Column, most: int) -> dict:
    """For each value of ``by``, the hash below which there are about ``most`` rows, or all if there are no more.

    One count by value with map-side sums; the driver gets a row for each value.  More than MOST_LABELS values are an error.
    """
    rows = df.groupBy(by.alias("g")).count().limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} different labels")
    return {r.g: HASHES if r["count"] <= most else HASHES * most // r["count"] for r in rows}


HASHES = 1 << 62


def key_hash(key: Column) -> Column:
    """0 … HASHES - 1, evenly."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(7)), 2)


def chosen_by(limits: dict, by: Column, key: Column) -> Column:
    """Whether a row is in the sample of sample_threshold."""
    if not limits:
        return F.lit(False)
    table = F.create_map(*[x for g, n in sorted(limits.items()) for x in (F.lit(g), F.lit(n).cast("long"))])
    return F.coalesce(key_hash(key) < table[by], F.lit(False))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with plain column names: mapInArrow cannot take names with dots."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def ngram_hashes(words: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of words with their ends marked: (word number, bucket) of each."""
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.cumsum(codes == 2) - 1
    codes = codes.astype(np.uint64)
    owners, found = [], []
    for n in sizes:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        same = word[: len(h)] == word[n - 1 :]
        owners.append(word[: len(h)][same])
        found.append((h[same] % np.uint64(buckets)).astype(np.int64))
    return (np.concatenate(owners), np.concatenate(found)) if owners else (np.empty(0, np.int64), np.empty(0, np.int64))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
