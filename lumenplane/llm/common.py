"""What the operators share: table access, the shared work folder and word hashing in numpy."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only where that is unset, as in tests on local[*], a folder of this machine is taken; on a
    cluster without it the warehouse is used instead.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        base = tempfile.mkdtemp(prefix="lumenplane-") if local else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a work folder when the driver ends; a session that is gone has nothing to do."""
    if spark.sparkContext._jsc is not None and spark.sparkContext._jvm is not None:
        try:
            jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
        except Exception as error:  # at exit the JVM may have gone first
            print(f"work folder {path} stays: {type(error).__name__}")


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table to the work folder and read it back: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (names with __ for dots) for what runs within; then as they were."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Arrow batches between the JVM and a Python worker hold about so many bytes (Spark's own bound is 64 MB, or 10,000
#: rows), and batches out of Parquet so many rows: each of a task's workers holds some of them, and the JVM their buffers.
BATCH_BYTES, READ_ROWS = 2 << 20, 512


def frugal(spark: SparkSession) -> SparkSession:
    """A copy of the session, with its settings as they are now, in which batches are small.

    What is read or made through it keeps to that whenever it runs; the session itself stays as it is.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    own.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    return own


def frugally(df: DataFrame) -> DataFrame:
    """df as it would be, had it been made through frugal(); files are read by the session that df has."""
    own = frugal(df.sparkSession)
    return DataFrame(own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()), own)


def partitions_for(docs: DataFrame, each: int) -> int:
    """Partitions of about `each` bytes of the tables below docs, as the optimiser knows them; at least two a core.

    Of rows that do not come from files it knows no size; then the session's number of shuffle partitions counts.
    """
    spark, leaves = docs.sparkSession, docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions")) if len(sizes) > sum(s < 1 << 60 for s in sizes) else 0
    return max(2 * spark.sparkContext.defaultParallelism, wanted, min(known // each, 1_000_000))


def give_back() -> None:
    """Return this process's free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def driver_gives_back(spark: SparkSession) -> str | None:
    """Return the free native memory of the driver's JVM to the system; what the JVM says of it.

    Compilers and buffers free theirs, but glibc keeps it, the more the longer a session runs. A JVM that cannot
    do this (other libraries, releases before 17.0.9) keeps it, too.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName
    kinds = array(jvm.java.lang.Class, 4)  # the server's own class is closed to py4j, its interface is not
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = named(kind)
    given = array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        return named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return None


def tidy(batches):
    """The batches of a pass; behind the last one, a worker that may idle gives its free memory back."""
    try:
        yield from batches
    finally:
        give_back()


def tidily(run):
    """A function for mapInArrow that ends with tidy()."""
    return lambda batches: tidy(run(batches))


#: A key of more rows is told to all tasks instead of being dealt to one: n rows have n / HOT_ROWS such keys at most.
HOT_ROWS = 100_000


def join_by(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined to right, which has one row for each key, however many rows of left share one. left is read three times."""
    hot = F.broadcast(left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_ROWS).select(key))
    many = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key)
    return left.join(hot, key, "left_anti").join(right, key).unionByName(many)


def beside(docs: DataFrame, *results: str) -> DataFrame:
    """docs with `_given` added to the names that a result bears, in any case, so that no column is lost."""
    taken, names = {r.lower() for r in results}, []
    for name in docs.columns:
        while name.lower() in taken:
            name += "_given"
        taken.add(name.lower())
        names.append(name)
    return docs if names == docs.columns else docs.toDF(*names)


def columns_of(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs out of df, in which they stand first, by their own names."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[: len(docs.columns)]]).toDF(*docs.columns)


def held_out(doc_id="doc_id"):
    """Rows kept from learning: crc32 of the decimal id leaves 2 modulo 4 (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


# --- words as 64-bit hashes ------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True



def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _P)


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of many texts at once.

    A word is a maximal run of ASCII letters and digits and of any characters beyond ASCII. Returns
    the words' hashes, the texts' bounds in them (len(texts) + 1), and each word's first and last
    (exclusive) byte in the lower-cased UTF-8 of its text. Null counts as empty.
    """
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    buffer = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = _WORD_BYTE[buffer]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    first, last = edge[0::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64), first, last
    # sum of value[byte] * P^(distance to the word's end), by doubling over word lengths
    hashes = np.zeros(len(first), np.uint64)
    length = last - first
    order = np.argsort((255 - np.minimum(length, 255)).astype(np.uint8), kind="stable")
    longest = int(length.max())
    by_length = len(length) - np.cumsum(np.bincount(np.minimum(length, 65), minlength=66))[:64]
    f, h = first[order], hashes[order]
    for k in range(min(longest, 64)):
        n = by_length[k]  # words longer than k bytes
        h[:n] = h[:n] * _P + _BYTE_VALUE[buffer[f[:n] + k]]
    for i in np.flatnonzero(length[order] > 64):
        h[i] = _long(buffer[f[i] + 64 : last[order[i]]], h[i])
    hashes[order] = h
    owner = np.searchsorted(first, starts)
    shift = np.repeat(starts[:-1], np.diff(owner))
    return mix(hashes), owner, first - shift, last - shift


def _long(rest: np.ndarray, h: np.uint64) -> np.uint64:
    """Continue the polynomial over the bytes of a long word, in one vector operation."""
    n = len(rest)
    powers = np.cumprod(np.full(n, _P, np.uint64), dtype=np.uint64)
    ahead = np.concatenate((powers[-2::-1] if n > 1 else powers[:0], np.ones(1, np.uint64)))
    with np.errstate(over="ignore"):  # arithmetic is modulo 2^64
        return h * powers[-1] + (_BYTE_VALUE[rest] * ahead).sum(dtype=np.uint64)


#: The same words, for brute-force tests and for alignment.
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())
