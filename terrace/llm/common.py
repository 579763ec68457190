"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.sources.staging import shared_folder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
Batches = Iterator[pa.RecordBatch]


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package, where it is not installed on them."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    return spark


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def put(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it from there, in the same partitions."""
    path = folder(df.sparkSession, "llm")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the whole text; a NULL text is an empty one."""
    return df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def as_bytes(df: DataFrame) -> DataFrame:
    """The text as UTF-8 bytes: ASCII rules are then the rules of bytes."""
    return df.withColumn("text", F.col("text").cast("binary"))


def mapped(df: DataFrame, function: Callable[[Batches], Batches], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def batch(**columns) -> pa.RecordBatch:
    arrays = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}
    return pa.RecordBatch.from_pydict(arrays)


class Memo(dict):
    """Remembers ``compute(key)`` for the keys met of late: between ``limit`` and twice as many.

    Keys that keep coming back survive; memory does not depend on the input.
    """

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key, self)
        if value is self:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


_kept: dict = {}


def kept(key, make: Callable):
    """What a worker keeps between tasks, such as a loaded tokenizer; only the last thing asked for."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Give back what operators that ran earlier in this worker have kept: Spark uses its workers
    for all stages."""
    _kept.clear()
    pa.default_memory_pool().release_unused()


def slices(b: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ``most`` bytes in a column, or of one row."""
    sizes = pc.fill_null(pc.binary_length(b[column]), 0).to_numpy().astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < b.num_rows:
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield b.slice(start, end - start)
        start = end


def encode_texts(
    texts: pa.Array,
    spaced: Memo,
    first: Callable[[str], bytes],
    whole: Callable[[str], bytes],
    last: bytes = b"",
) -> pa.Array:
    """The ids of each text, as bytes laid end to end, ``last`` following each text.

    Texts are cut at spaces and each different piece is looked up once: ``spaced`` has the ids
    of a space and the piece, or None where cutting would change them; ``first`` gives those of
    the piece before the first space, ``whole`` those of a text that cannot be cut.
    """
    pieces = pc.split_pattern(texts, " ")
    starts = pieces.offsets.to_numpy().astype(np.int64)
    coded = pieces.flatten().dictionary_encode()
    values = [spaced[p] for p in coded.dictionary.to_pylist()]
    places = coded.indices.to_numpy().astype(np.int64)
    uncut = np.array([v is None for v in values], bool)[places]
    uncut[starts[:-1]] = False  # the first pieces are not after a space
    before = np.append(0, np.cumsum(uncut))
    spoilt = before[starts[1:]] > before[starts[:-1]]
    empty, end = len(values), len(values) + 1
    values = [v or b"" for v in values] + [b"", last]
    for i, text in enumerate(texts.to_pylist()):
        at, cut = int(starts[i]), text.find(" ")
        opening = text if cut < 0 else text[:cut]
        if spoilt[i] or (cut >= 0 and (not opening or opening[-1].isspace())):
            places[at : starts[i + 1]] = empty
            values.append(whole(text))
        else:
            values.append(first(opening))
        places[at] = end + 1 + i
    if last:
        places = np.insert(places, starts[1:], end)
        starts = starts + np.arange(len(starts))
    laid = pa.array(values, pa.large_binary()).take(pa.array(places))
    offsets = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset : laid.offset + len(laid) + 1]
    ends = pa.py_buffer(offsets[starts].tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, ends, laid.buffers()[2]])


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Left join of rows with what is known of their group; ``groups`` has its ``size``.

    Groups larger than an even share of all rows, of which there are fewer than partitions,
    are broadcast; only rows of others are dealt out by key.
    """
    even = total // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = F.broadcast(groups.filter(F.col("size") > even))
    small = groups.filter(F.col("size") <= even)
    columns = [*rows.columns, *[c for c in groups.columns if c not in keys]]
    in_large = rows.join(large, keys).select(*columns)
    others = rows.join(large.select(*keys), keys, "left_anti").join(small, keys, "left")
    return in_large.unionByName(others.select(*columns))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
