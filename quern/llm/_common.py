"""Helpers shared by the corpus operators: shared storage, ASCII lower-casing, word splitting, block exchange."""

from __future__ import annotations

import atexit
import gc
import sys
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of alphanumeric words once A-Z are lower-cased; everything above ASCII belongs to words.
WORD_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space, the separators of plain tokens.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shipped_by_value(module: str) -> None:
    """Python functions of the module travel to the workers with the plan, so workers need no copy of this library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, on a local master only, a temporary
    one."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="quern-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, most: str = "8m"):
    """Arrow batches of at most 8 MB while the block runs; both sides of the exchange with workers hold whole ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, old)


class Scratch:
    """Written tables in the shared folder; they cut lineage and survive lost executors. The folder goes when the
    driver ends: results read from it until then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
        if not SCRATCH:
            atexit.register(_remove_all)
        SCRATCH.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        del df
        self.collect_shuffles()
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm, where = self.spark._jvm, self.path(name) if name else self.root
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def collect_shuffles(self) -> None:
        """Lets the driver notice which exchanges nobody refers to any more, so their files go."""
        for _ in range(2):  # what the first round frees may hold more
            gc.collect()
            self.spark._jvm.System.gc()


def fresh(df: DataFrame, n: int) -> list[str]:
    """n column names that df hasn't got, whatever the case."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (f"__q{k}{'_' * j}" for j in range(len(taken) + 1)) if x not in taken) for k in range(n)]


#: Folders to be removed at the end.
SCRATCH: list[Scratch] = []


def _remove_all() -> None:
    for x in SCRATCH:
        try:
            x.drop()
        except Exception:  # noqa: BLE001  the session may have ended already
            return


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() would change other letters too; it is used where the text is all ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the lower-cased text; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_SEPARATORS), "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)).cast("int"), F.lit(-1))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; sizes exchanges so that tasks stay equally large at every input size."""
    return int(docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def lean(rows):
    """A function on Arrow batches that gives freed memory back when its task ends; idle workers would keep it."""

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run


def lean_group(rows):
    """The same for a function on a group's table."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return rows(table)
        finally:
            give_back()

    return run


def give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # other C libraries do it by themselves
        pass


def byte_blocks(column: pa.Array, most: int = 1 << 20, rows: int = 50_000):
    """(first row, texts as UTF-8 bytes) for runs of rows of about `most` bytes and no more than `rows`, so that arrays
    over them stay small; a null text is empty."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(column):
        j = min(i + rows, max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right"))))
        yield i, [x or b"" for x in column.slice(i, j - i).cast(pa.binary()).to_pylist()]
        i = j


# --- numpy hashing -------------------------------------------------------------------------------

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Token bytes -> 64-bit hash, remembered; forgets everything at 150,000 entries to stay small."""

    def __init__(self):
        from xxhash import xxh3_64_intdigest

        super().__init__()
        self.digest = xxh3_64_intdigest

    def __missing__(self, token: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        self[token] = h = self.digest(token)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def scatter(part: np.ndarray, parts: int, *columns: np.ndarray) -> list[tuple]:
    """(part, bytes of each column's values of that part) for the parts that have any; order within a part is kept."""
    order = np.argsort(part.astype(np.uint16 if parts <= 65536 else np.uint32), kind="stable")
    sorted_part, sorted_columns = part[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.r_[True, sorted_part[1:] != sorted_part[:-1], True]).tolist() if len(order) else [0]
    return [(int(sorted_part[a]), *(c[a:b].tobytes() for c in sorted_columns)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


shipped_by_value(__name__)
