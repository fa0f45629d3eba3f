"""What several operators share: tables, tables written between steps, words."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch_path

#: Word of a text for sizes and shingles: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


class Temporary:
    """Folders that :func:`pinned` writes inside a ``with`` block; they go at its end, but for those kept."""

    open: list[Temporary] = []

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, []

    def __enter__(self) -> Temporary:
        Temporary.open.append(self)
        return self

    def add(self, path: str) -> None:
        self._paths.append(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """A table written inside the block that shall stay."""
        self._paths = [p for p in self._paths if p != df.scratch]
        return df

    def __exit__(self, *problem) -> None:
        Temporary.open.remove(self)
        jvm, conf = self._spark.sparkContext._jvm, self._spark.sparkContext._jsc.hadoopConfiguration()
        for path in self._paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def pinned(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    This cuts lineage and pins values that a recomputed task could give anew.
    Executors share the folder, so a lost executor takes nothing with it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if Temporary.open:
        Temporary.open[-1].add(path)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


@contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside pass at most ``rows`` rows at a time to Python workers.

    For tables whose row is a whole segment or chunk: with thousands of them in a batch
    its buffers would outgrow an executor.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fetched(df: DataFrame) -> pd.DataFrame:
    """A result of bounded size on the driver, in columns all the way."""
    return df.toArrow().to_pandas()


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(keys: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    x = keys.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit digests of words (bytes), remembered between texts.

    The memory is emptied when it holds ``most`` words, so it stays bounded; the
    digests do not depend on it.
    """

    def __init__(self, most: int = 300_000):
        from hashlib import blake2b

        self._digest = lambda w: int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
        self._known: dict[bytes, int] = {}
        self._most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self._known, self._digest
        if len(known) > self._most:
            known.clear()
        out = [known.get(w) for w in words]
        if None in out:
            for i, w in enumerate(words):
                if out[i] is None:
                    out[i] = known[w] = digest(w)
        return np.array(out, dtype=np.uint64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what a worker builds stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
