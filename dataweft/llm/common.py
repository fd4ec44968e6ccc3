"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: What the operators that this worker has served remember: a call that forgets it.
_HELD: dict[str, Callable[[], object]] = {}


def trim() -> None:
    """Hand freed memory back to the system; the C library and Arrow keep it otherwise, and a worker serves one stage after another."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if give is not None:
        give(0)


@contextmanager
def remembering(operator: str, forget: Callable[[], object]) -> Iterator[None]:
    """Around a task's work: what other operators remember in this worker goes before it, else the memos of all stages add up."""
    others = [k for k in _HELD if k != operator]
    for other in others:
        _HELD.pop(other)()
    _HELD[operator] = forget
    if others:
        gc.collect()
        trim()
    try:
        yield
    finally:
        trim()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(doc_id: str = "doc_id") -> Column:
    """The id as text; rows without an id share the empty one."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def crc_mod(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(id_text(doc_id).cast("binary")) % F.lit(n)


def slices(lengths: list[int | None], most: int = 1 << 20):
    """Ranges of rows whose texts are about ``most`` long together, so that what a range makes stays small."""
    start = total = 0
    for i, n in enumerate(lengths):
        total += n or 0
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def lengths(column: pa.Array) -> list[int | None]:
    """Bytes of each text."""
    return pc.binary_length(column).to_pylist()


def schema(df: DataFrame, names: Iterable[str], made: str) -> StructType:
    """The named columns as they are in ``df``, then the columns of ``made`` (DDL)."""
    return StructType([df.schema[c] for c in names] + StructType.fromDDL(made).fields)
