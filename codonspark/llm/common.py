"""Helpers shared by the training-data operators.

Only bounded things reach the driver. Intermediate tables go to the shared folder named by
``spark.checkpoint.dir``, so a lost executor costs a recomputation of tasks and never a wrong or failed
result.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in the contracts: space and TAB..CR.
WORD_SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``. Where that is unset a local session (tests) gets a
    temporary one; on a cluster each executor would write to its own disk there, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="codonspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/codonspark-{spark.sparkContext.applicationId}"


_cleaned: set[str] = set()


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    if folder in _cleaned:
        return
    _cleaned.add(folder)

    def remove() -> None:
        try:
            _delete(spark, folder)
        except Exception:  # the session has ended before the interpreter: nothing can be removed any more
            pass

    atexit.register(remove)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Shuffle files of a finished write go at once, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows and bytes that go to a Python worker at once, where the session has the defaults. Whole texts are long: ten thousand of
#: them take tens of MB in the executor's buffers, in each worker, and again for what is made of them.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has limits of its own."""
    for key, (default, limit) in _BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, limit)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it as a table: cuts lineage."""
    spark = df.sparkSession
    bound_batches(spark)
    folder = shared_dir(spark)
    _remove_at_exit(spark, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._codonspark_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` made, once nothing that is still to run reads them."""
    for table in tables:
        _delete(table.sparkSession, table._codonspark_path)


#: A key with more than this share of a table's rows is joined by broadcasting its other side.
HOT_SHARE = 1000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """Inner join where ``right`` has one row per key, with the number ``n`` of the left rows of that key.

    Keys with a thousandth of ``total`` (all rows that ``n`` counts) or more, so at most ``HOT_SHARE`` rows of
    ``right``, are broadcast and their left rows stay where they are; the others are shuffled. ``left`` and ``right``
    should be written tables: they are read more than once.
    """
    hot = (F.col(n) > 1) & (F.col(n) * HOT_SHARE >= total)
    few, rest = F.broadcast(right.where(hot).drop(n)), right.where(~hot).drop(n)
    return left.join(few, on).unionByName(left.join(few.select(*on), on, "left_anti").join(rest, on))


#: Bits of a filter of keys at most (16 MB). With more keys it lets more rows through, never fewer.
FILTER_BITS = 1 << 27


def maybe_among(keys: DataFrame, on: list[str]) -> Callable[..., Column]:
    """A condition on columns that holds for every row of ``keys`` (its columns ``on``) and for few others.

    It is a Bloom filter of two places a key: what it turns away need not be shuffled to be joined with ``keys``, what it lets
    through must be. ``keys`` should be a written table: it is read twice.
    """
    spark = keys.sparkSession
    bits = min(FILTER_BITS, 1 << max(16, (16 * keys.count()).bit_length()))
    one = keys.select(F.xxhash64(*on).alias("x"))
    at = one.select(F.explode(F.array("x", F.shiftrightunsigned("x", 32))).alias("at")).select(F.col("at").bitwiseAND(bits - 1).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("own")).toPandas()
    table = np.zeros(bits // 64, np.uint64)
    table[words["word"].to_numpy(np.int64)] = words["own"].to_numpy(np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def held(x: pa.Array) -> pa.Array:
        key, found = x.to_numpy(zero_copy_only=False).view(np.uint64), True
        for at in (key & np.uint64(bits - 1), (key >> np.uint64(32)) & np.uint64(bits - 1)):
            found &= (sent.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return pa.array(found)

    return lambda *columns: held(F.xxhash64(*columns))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def split_words(text: str | None) -> list[str]:
    """Maximal runs of anything but the six separators. ``str.split()`` would also split at NBSP and others."""
    if not text:
        return []
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


class Remembered(dict):
    """Values of a function of words, remembered for up to ``limit`` distinct words (then started anew).

    Words beyond ``LONG`` characters are worked out each time, so the memory is bounded in bytes.
    """

    LONG = 64

    def __init__(self, of, limit: int = 150_000) -> None:
        self._of, self._limit = of, limit

    def __missing__(self, word: str):
        value = self._of(word)
        if len(word) <= self.LONG:
            self[word] = value
        return value

    def all(self, words: list[str]) -> list:
        if len(self) > self._limit:
            self.clear()
        if len(words) <= self._limit:
            return [*map(self.__getitem__, words)]
        out = []
        for at in range(0, len(words), self._limit):
            out += self.all(words[at : at + self._limit])
        return out


class WordHashes:
    """64-bit XXH64 of words."""

    def __init__(self, seed: int = 0) -> None:
        import xxhash

        of = xxhash.xxh64_intdigest
        self._known = Remembered(lambda w: of(w.encode("utf-8", "surrogatepass"), seed))

    def __call__(self, words: list[str]) -> np.ndarray:
        return np.array(self._known.all(words), dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection on uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fresh_name(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it (column names don't tell case apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
