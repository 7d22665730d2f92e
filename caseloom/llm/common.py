"""What the corpus operators share: tables that cut lineage, Arrow columns, words as hashes."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.session import checkpoint_dir

#: A word is a run of ASCII letters and digits and of anything beyond ASCII; this is the rest of ASCII.
BETWEEN_WORDS = bytes(c for c in range(128) if not chr(c).isalnum())
#: Lower-cases A-Z and turns whatever separates words into a space, byte by byte (UTF-8 safe).
FOLD = bytes.maketrans(BETWEEN_WORDS + bytes(range(65, 91)), b" " * len(BETWEEN_WORDS) + bytes(range(97, 123)))
#: White space as the contracts write it: [\x20\x09-\x0D].
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of text worked on at once; the arrays that takes are some fifty times as large.
BLOCK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared checkpoint folder and reads it back.

    Lineage ends here: a lost executor costs at most the stage that is running, and later
    readers neither repeat the work nor see it change.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").option("compression", "zstd").parquet(path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    settled.settled_at = path
    return settled


def release(*tables: DataFrame) -> None:
    """Removes tables that ``settle`` wrote, once everything made from them has been written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops input columns that an operator's own columns would clash with, in any case of letters."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def arrow_column(fn: Callable[..., pa.Array], kind: str, *columns: Column) -> Column:
    """An Arrow-batched column, evaluated once per row: no filter is pushed below it."""
    @functools.wraps(fn)
    def tidied(*arrays: pa.Array) -> pa.Array:
        try:
            return fn(*arrays)
        finally:
            give_back()

    return F.arrow_udf(tidied, kind).asNondeterministic()(*columns)


def give_back() -> None:
    """Hands memory that is free inside this process back to the system. Python workers outlive their tasks, and what
    they hold while idle counts for their executor as much as what a running task needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` for ``mapInArrow``, which gives its memory back once its task has ended."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return run


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` mentions it."""
    return F.transform(F.array(value), then)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What ``combine`` makes of each array element and all before it: a running sum, a running maximum.

    The distance that is combined doubles each round, so n elements take log n rounds over the array. A fold that
    appended each result would copy all before it for each element.
    """
    def rounds(all_values: Column) -> Column:
        def one(done: Column, k: Column) -> Column:
            step = F.call_function("shiftleft", F.lit(1), k)
            return F.transform(done, lambda x, i: F.when(i >= step, combine(F.get(done, i - step), x)).otherwise(x))

        last = F.ceil(F.log2(F.greatest(F.size(all_values), F.lit(2)))).cast("int") - 1
        return F.aggregate(F.sequence(F.lit(0), last), all_values, one)

    return let(values, rounds)


def matches(text: Column, pattern: Column, group: int = 0) -> Column:
    """Place of each match in code points, as (start, end, size): from the lengths of matches and of what is between
    them; ``size`` is the length of the group. A text without a match is searched once."""
    def placed(m: Column) -> Column:
        lengths = F.zip_with(F.slice(m["between"], 1, F.size(m["whole"])), m["whole"], lambda b, w: b + w)
        sized = F.zip_with(m["whole"], m["part"] if group else m["whole"], lambda w, p: F.struct(w.alias("w"), p.alias("p")))
        return F.zip_with(running(lengths, lambda a, b: a + b), sized, lambda end, x: F.struct(
            (end - x["w"]).alias("start"), end.alias("end"), x["p"].alias("size")))

    def lengths_of(no: int) -> Column:
        return F.transform(F.regexp_extract_all(text, pattern, F.lit(no)), F.length)

    parts = F.struct(F.transform(F.split(text, pattern, -1), F.length).alias("between"), lengths_of(0).alias("whole"),
                     *([lengths_of(group).alias("part")] if group else []))
    none = F.array().cast("array<struct<start:int,end:int,size:int>>")
    return F.when(F.rlike(text, pattern), let(parts, placed)).otherwise(none)


def as_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of a text, empty for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def struct_of(**columns: tuple[object, pa.DataType]) -> pa.Array:
    return pa.StructArray.from_arrays([v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, t)
                                       for v, t in columns.values()], names=list(columns))


def blocks(texts: pa.Array | list[bytes], most: int = BLOCK, docs: int = 4096) -> Iterator[tuple[int, int, list[bytes]]]:
    """Texts in parts of at most ``docs`` texts of about ``most`` bytes together, with the numbers of
    the first and of the one after the last; a longer text stands alone. Only one part is held."""
    sizes = [len(t) for t in texts] if isinstance(texts, list) else pc.binary_length(texts).to_numpy(zero_copy_only=False).tolist()
    first, size = 0, 0
    for i, n in enumerate([*sizes, None]):
        if i > first and (n is None or size + n > most or i - first == docs):
            part = texts[first:i]
            yield first, i, part if isinstance(part, list) else part.to_pylist()
            first, size = i, 0
        size += (n or 0) + 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def _hashes_of(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of one blob in which only b' ' separates words."""
    a = np.frombuffer(blob, np.uint8)
    edge = np.diff(np.concatenate(([0], (a != 32).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _POWERS.to(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[:len(a)], out=sums[1:])
    return starts, mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes], fold: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of the texts in order, and the number of words of each text.

    ``fold`` translates bytes so that only b' ' separates words. Long texts are hashed piece by
    piece, cut between words, so that memory stays a small multiple of one text.
    """
    joined = b" ".join(texts).translate(fold)
    limits = np.cumsum([len(t) + 1 for t in texts])
    starts, hashes, at = [], [], 0
    while at < len(joined):
        end = at + BLOCK
        if end < len(joined):
            cut = joined.rfind(b" ", at, end)
            end = cut if cut > at else joined.find(b" ", end)
            end = len(joined) if end < 0 else end
        else:
            end = len(joined)
        s, h = _hashes_of(joined[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    start = np.concatenate(starts)
    before = np.searchsorted(start, limits)
    return np.concatenate(hashes), np.diff(before, prepend=0)


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``width`` words that lies inside one text, and its first word's index."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k:n - width + 1 + k]
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(doc[:n - width + 1] == doc[width - 1:])
    return mixed(total[inside]), inside
