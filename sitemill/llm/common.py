"""What the operators of this subpackage share: scratch tables, documents as Arrow batches, block joins, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

#: Rows and bytes that a Python worker unpacks at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: What separates words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="sitemill-")
    return f"file://{_own}"


_own: str | None = None


class Scratch:
    """Tables written in the shared folder to cut lineage; they go when they are spent, at the latest when the driver ends."""

    _made: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/sitemill-{name}-{uuid.uuid4().hex}"
        self.n, self.tables = 0, {}
        atexit.register(self.drop)
        for made in self._made:
            made.append(self)

    @classmethod
    @contextlib.contextmanager
    def made(cls) -> Iterator[list[Scratch]]:
        """Gathers the scratch tables that are made within, so that who has written the result can drop them."""
        found: list[Scratch] = []
        cls._made.append(found)
        try:
            yield found
        finally:
            cls._made.remove(found)

    def keep(self, df: DataFrame, *spent: DataFrame) -> DataFrame:
        """df as a table that was written and is read again; tables kept before that only df needed are deleted."""
        path = f"{self.path}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = out, path
        for old in spent:
            if id(old) in self.tables:
                self._delete(self.tables.pop(id(old))[1])
        return out

    def _delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self) -> None:
        atexit.unregister(self.drop)
        self.tables.clear()
        try:
            self._delete(self.path)
        except Exception:  # the session, and with it a local folder's owner, may be gone
            pass


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most BATCH_ROWS rows and, unless one row has more, about BATCH_BYTES bytes."""
    for b in batches:
        rows = max(1, min(BATCH_ROWS, b.num_rows * BATCH_BYTES // max(1, b.nbytes)))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def together(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches put together to about so many rows, or BATCH_BYTES bytes: for short rows, of which many are handled at once."""
    held, n, size = [], 0, 0
    for b in batches:
        held.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= rows or size >= BATCH_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, size = [], 0, 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over slices of bounded size, whatever batches the session sends.

    Where f gives back the columns that it gets (schema is then a type), their names may hold dots."""
    run = lambda batches: f(sliced(batches))
    if isinstance(schema, StructType) and any("." in n for n in df.columns):
        plain = [f"_{k}" if "." in n else n for k, n in enumerate(df.columns)]
        return df.toDF(*plain).mapInArrow(run, StructType([StructField(n, x.dataType, x.nullable) for n, x in zip(plain, schema)])).toDF(*df.columns)
    return df.mapInArrow(run, schema)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the named columns and the text, a null text being empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c) for c in more), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc_rest(n: int, key: str = "doc_id") -> F.Column:
    """crc32 of the id as text modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def words_of(text: str) -> list[bytes]:
    """Words of a text after A-Z are lower-cased, as UTF-8; bytes split at space and U+0009 to U+000D only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def forest(pairs_of: Iterable[tuple[int, np.ndarray]], n: int) -> np.ndarray:
    """Labels 0..n-1 of the components that (row, linked rows) join; memory is O(n)."""
    label = np.arange(n)
    for i, linked in pairs_of:
        at = np.unique(np.append(label[linked], label[i]))
        if len(at) > 1:
            label[np.isin(label, at)] = at[0]
    return label


def blocks(n: F.Column, size: int) -> F.Column:
    return F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("int")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node) of every node of edges (a, b), by contraction.

    Each round moves every node to a smallest neighbour and joins nodes that moved together. Rounds in
    turn take the smallest id, which ends stars at once, and the smallest hash, which halves the rest in
    expectation, so long chains need O(log n) rounds. Only minima are gathered for a node, so a hub of any
    size is no hot key; joins on a hub's key are plain ones that adaptive execution splits."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    e, labels, rounds = scratch.keep(e), None, 0
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if rounds % 2 == 0:
            to = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("at"), F.least("a", "to").alias("to"))
        else:
            to = _moved(both, rounds)
        to = scratch.keep(to)
        labels = to.select(F.col("at").alias("node"), F.col("to").alias("label")) if labels is None else labels.join(to, labels["label"] == to["at"], "left").select("node", F.coalesce("to", "label").alias("label"))
        x, y = to.select(F.col("at").alias("a"), F.col("to").alias("x")), to.select(F.col("at").alias("b"), F.col("to").alias("y"))
        e = scratch.keep(e.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), e)
        rounds += 1
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if rounds == 1:
        return labels.select("node", F.col("label").alias("component"))
    labels = scratch.keep(labels)
    least = scratch.keep(labels.groupBy("label").agg(F.min("node").alias("component")))
    return labels.join(least, "label").select("node", "component")


def _moved(both: DataFrame, seed: int) -> DataFrame:
    """at, to: each node and whichever of it and its neighbours has the smallest hash."""
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("id"))
    best = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
    return best.select(F.col("a").alias("at"), F.least(rank("a"), F.col("near"))["id"].alias("to"))


class Cached(dict):
    """What f gives for a token, kept; trim() between batches bounds it."""

    def __init__(self, f: Callable, most: int = 300_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        value = self[key] = self.f(key)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
