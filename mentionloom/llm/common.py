"""What the operators of this subpackage share: the shared folder, written tables, words and hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters outside this set; ``bytes.split()`` splits at exactly these.
WORD_REGEX = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch where a query moves whole texts to Python.
ROWS_PER_BATCH = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run
    on this machine. On a cluster no folder of one machine will do."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="mentionloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows, so that a batch of whole texts stays small in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


#: Lets Spark delete a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _run(spark, lambda: df.write.parquet(path))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``written``, in buckets by ``key``: what is dealt out alike joins them without moving them once more."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    path, table = f"{shared_dir(spark)}/{name}-{mark}", f"{name}_{mark}".replace("-", "_")
    _run(spark, lambda: df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table))
    out = spark.table(table)
    # the files stay
    spark.sql(f"DROP TABLE {table}")
    return out


def _run(spark: SparkSession, write: Callable[[], None]) -> None:
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        write()
    finally:
        spark.conf.set(CLEANUP, before)
    # what other queries have left is only cleaned up once both sides have let go of it
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def freed() -> None:
    """Give memory that this process no longer uses back to the system; glibc and Arrow would keep it."""
    gc.collect()
    trimmed()


def trimmed() -> None:
    """Like ``freed`` where nothing is held by cycles; takes little time."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the bytes that ``df`` is read from; only sets how finely work is dealt out. Inputs
    whose size Spark doesn't know count as 8 MB a shuffle partition."""
    leaves, total = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        size = int(str(leaves.apply(i).stats().sizeInBytes()))
        total += size if size < 1 << 60 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) << 23
    return total


def buckets_for(df: DataFrame, mb: int = 8, least: int = 16) -> int:
    """Number of exchange buckets, in proportion to the input."""
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(max(least, wide, input_bytes(df) // (mb << 20)), 1 << 20))


def n_words(text: str | F.Column) -> F.Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit hashes (the splitmix64 constants)."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Vocabulary:
    """Numbers words in a worker and keeps their 64-bit hashes; starts anew when it holds too many."""

    def __init__(self, most: int = 300_000, most_bytes: int = 16_000_000):
        self.most, self.most_bytes = most, most_bytes
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(count().__next__)
        self.hashes, self.known, self.weighed, self.bytes = np.zeros(1024, np.uint64), 0, 0, 0

    def number(self, words: list[bytes]) -> np.ndarray:
        """Ids of the words, equal for equal words until the next ``trim``."""
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def hashed(self, words: list[bytes], ids: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the words; ``ids``: what ``number`` has just given for them."""
        ids = self.number(words) if ids is None else ids
        if (n := len(self.ids)) > self.known:
            if n > len(self.hashes):
                self.hashes = np.concatenate([self.hashes[: self.known], np.zeros(max(n, 2 * self.known) - self.known, np.uint64)])
            # dicts keep their insertion order, so new words are the last ones
            new = list(self.ids)[self.known :] if n - self.known > 4096 else _last(self.ids, n - self.known)
            self.hashes[self.known : n] = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
            self.known = n
        return self.hashes[ids]

    def trim(self) -> None:
        """Call between texts: starts anew if there are too many words, or too many bytes of long words."""
        for w in _last(self.ids, max(0, len(self.ids) - self.weighed)):
            self.bytes += len(w)
        self.weighed = len(self.ids)
        if len(self.ids) > self.most or self.bytes > self.most_bytes:
            self._clear()


def _last(ids: dict[bytes, int], n: int) -> list[bytes]:
    back = reversed(ids)
    return [next(back) for _ in range(n)][::-1]


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; a null text is empty."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""
