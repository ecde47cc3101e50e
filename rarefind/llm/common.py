"""What the text operators share: words, bounded memos, stored tables and worker set-up."""

from __future__ import annotations

import ctypes
import gc
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rarefind.sources.scratch import fresh_path

_PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])

#: Bytes after which a batch for a Python worker ends, and about those of a batch that it gives back. By rows alone,
#: 10,000 texts would go over at once.
BATCH_BYTES = 2 << 20
OUTPUT_BYTES = 1 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

# Code points that str.split() takes as white space and the word rule does not.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE_INSIDE_RUN = re.compile(r"\s (?:\s|\Z)")
_UPPER = re.compile("[A-Z]+")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows written once to the shared folder and read from there: cuts the lineage for good."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote. Nothing that is still to be computed may read them."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def workers_import_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it.

    On a cluster the package is installed or on a shared path; a local run may have it only on the
    driver's ``sys.path``.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _PACKAGE_ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([_PACKAGE_ROOT, *filter(None, known)])


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package importable on the workers.

    The collector for reference cycles is off meanwhile: the functions here make many small objects
    and no cycles. Batches are kept small for the whole session, as both sides hold a batch in full.
    """

    def run(batches):
        gc.disable()
        try:
            for batch in function(batches):
                yield from small_batches(batch)
        finally:
            gc.enable()
            give_memory_back()

    workers_import_package(df.sparkSession)
    _keep_batches_small(df.sparkSession)
    return df.mapInArrow(run, schema)


def _keep_batches_small(spark: SparkSession) -> None:
    """Lower the bytes of a batch to ``BATCH_BYTES``; a smaller setting stays."""
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_SETTING))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def small_batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``OUTPUT_BYTES``; a row that is larger comes alone."""
    parts = max(1, min(batch.num_rows, -(-batch.nbytes // OUTPUT_BYTES)))
    size = max(1, -(-batch.num_rows // parts))
    for at in range(0, max(1, batch.num_rows), size):
        yield batch.slice(at, size)


def give_memory_back() -> None:
    """Return what is free to the system. Idle workers are reused in turn, so what each has left adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def words(text: str) -> list[str]:
    r"""Matches of ``[^\x20\x09-\x0D]+``. ``str.split`` gives the same unless rarer spaces occur."""
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def lower_ascii(text: str) -> str:
    """A-Z in lower case, all else unchanged."""
    return _UPPER.sub(lambda m: m[0].lower(), text) if not text.isascii() else text.lower()


def spaced_parts(text: str) -> list[str]:
    """The text cut before its spaces, where no pre-token of byte-level BPE reaches across.

    Byte-level pre-tokens take a single space with the word after it. Only a space within a run of
    white space can belong to a longer pre-token; a text with such a run stays whole.
    """
    if _SPACE_INSIDE_RUN.search(text):
        return [text]
    first, *others = text.split(" ")
    return [first, *[" " + part for part in others]]


def in_chunks(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``chars`` characters; a longer text comes alone."""
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) > chars:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


class Memo(dict):
    """Results of a function by argument, cleared when full, so that a worker's memory is bounded."""

    def __init__(self, function: Callable, limit: int):
        super().__init__()
        self._function, self._limit = function, limit

    def __missing__(self, key):
        if len(self) >= self._limit:
            self.clear()
        value = self[key] = self._function(key)
        return value


class RecentMemo:
    """Results of a batch function by argument; the younger of two generations of ``limit`` entries.

    When the young generation is full it becomes the old one, and the old one goes. What is still in
    use moves on to the young generation.
    """

    def __init__(self, function: Callable[[list], list], limit: int):
        self._function, self._limit = function, limit
        self._young, self._old = {}, {}

    def lookup(self, keys: set) -> dict:
        """A result for each of the keys, all new ones computed in one call."""
        if len(self._young) > self._limit:
            self._young, self._old = {}, self._young
        young, old = self._young, self._old
        for key in old.keys() & keys:
            if key not in young:
                young[key] = old[key]
        new = list(keys.difference(young))
        young.update(zip(new, self._function(new)))
        return {key: young[key] for key in keys}
