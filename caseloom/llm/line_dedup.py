"""Lines that many documents share.

Hashes of lines are range-partitioned and sorted by hash, document and position. Each task
streams its sorted range, counts the documents of each run, and reports which lines go. The
range is cut by hash *and* document, so a line that a third of the corpus holds is spread over
as many tasks as its rows need; runs that touch an edge of a task leave a boundary record, and
the few rows such a run cannot decide alone wait for the sum of its records. What returns to
the documents is a compressed bitmap of kept lines, never text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import BLANKS, arrow_column, as_bytes, settle, struct_of, tidy, without

#: What names a document here: its id, whether that is null, and a hash of its text.
KEY = ("k_id", "k_null", "k_text")
LINES = "h1 bigint, h2 bigint, k_id bigint, k_null boolean, k_text bigint, pos int"
FOUND = "kind string, h1 bigint, h2 bigint, k_id bigint, k_null boolean, k_text bigint, pos int, n bigint"


def _key_columns(text: str = "text") -> list[Column]:
    shown = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).cast("bigint").alias("k_id"), F.col("doc_id").isNull().alias("k_null"),
            F.xxhash64(shown).alias("k_text")]


def line_key(line: bytes) -> bytes:
    """A line as it is compared: white space at both ends stripped, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def _lines_of(min_chars: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, h1, h2, row, pos = batch.column("text"), [], [], [], []
            for i, scalar in enumerate(texts):
                for p, line in enumerate(scalar.as_py().split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and (min_chars < 2 or len(key.decode()) >= min_chars):
                        digest = xxhash.xxh3_128_intdigest(key)
                        h1.append(digest >> 64)
                        h2.append(digest & 0xFFFFFFFFFFFFFFFF)
                        row.append(i)
                        pos.append(p)
                if len(h1) > 200_000:
                    yield _packed(batch, h1, h2, row, pos)
                    h1, h2, row, pos = [], [], [], []
            if h1:
                yield _packed(batch, h1, h2, row, pos)
    return emit


def _packed(batch: pa.RecordBatch, h1: list, h2: list, row: list, pos: list) -> pa.RecordBatch:
    at = pa.array(row, pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)),
         *[batch.column(k).take(at) for k in KEY], pa.array(pos, pa.int32())], names=["h1", "h2", *KEY, "pos"])


class _Run:
    """The run of one hash that a stream is in: documents seen and, until it is decided, its rows."""

    def __init__(self, key: tuple[int, int], first: bool) -> None:
        self.key, self.first, self.docs, self.held, self.last = key, first, 0, [], None


def _decide(min_docs: int):
    names = [c.split()[0] for c in FOUND.split(", ")]

    def rows(kind: str, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), *batch.columns, pa.nulls(n, pa.int64())], names=names)

    def record(run: _Run) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(["edge"]), pa.array([run.key[0]], pa.int64()), pa.array([run.key[1]], pa.int64()), pa.nulls(1, pa.int64()),
             pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([run.docs], pa.int64())], names=names)

    def close(run: _Run, last: bool) -> Iterator[pa.RecordBatch]:
        """A run inside the task is settled; one at an edge leaves its count and undecided rows."""
        if run.first or last:
            yield record(run)
            for part in run.held:
                yield rows("open", part)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: _Run | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, a, b, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("h1", "h2", *KEY))
            new_hash = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_hash | np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]
            starts = np.flatnonzero(new_hash)
            docs = np.add.reduceat(new_doc, starts, dtype=np.int64)
            ends = np.r_[starts[1:], len(h1)]
            drop = np.zeros(len(h1), bool)
            for s, e, n in zip(starts.tolist(), ends.tolist(), docs.tolist(), strict=True):
                key, head, tail = (int(h1[s]), int(h2[s])), s == 0, e == len(h1)
                if not (head or tail):  # the whole run lies in this batch
                    drop[s:e] = n >= min_docs
                    continue
                if run is None or run.key != key:
                    if run is not None:
                        yield from close(run, False)
                    run = _Run(key, run is None)
                elif run.last == (a[s], b[s], c[s]):
                    n -= 1  # the document the batch before ended with
                run.docs += n
                run.last = (a[e - 1], b[e - 1], c[e - 1])
                if run.docs >= min_docs:
                    for part in run.held:
                        yield rows("drop", part)
                    run.held = []
                    drop[s:e] = True
                else:
                    run.held.append(batch.slice(s, e - s))
            if drop.any():
                yield rows("drop", batch.filter(pa.array(drop)))
        if run is not None:
            yield from close(run, True)
    return stream


def shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, text: str = "text") -> DataFrame:
    """Lines to drop: one row (k_id, k_null, k_text, pos) per line of a key found in ``min_docs`` documents or more.

    With ``keep_first`` the first occurrence in order of document and position stays. Documents
    of one id and text are one document. Keys of under ``min_chars`` code points stay.
    """
    read = docs.select(*_key_columns(text), as_bytes(text).alias("text"))
    lines = settle(read.mapInArrow(tidy(_lines_of(min_chars)), LINES), "lines")
    ranged = lines.repartitionByRange("h1", "h2", *KEY).sortWithinPartitions("h1", "h2", *KEY, "pos")
    found = settle(ranged.mapInArrow(tidy(_decide(min_docs)), FOUND), "line-runs")
    sums = found.where("kind = 'edge'").groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    rest = found.where("kind = 'open'").join(sums.select("h1", "h2"), ["h1", "h2"], "left_semi")
    dropped = found.where("kind = 'drop'").unionByName(rest)
    if keep_first:
        order = F.struct(*KEY, "pos")
        first = dropped.groupBy("h1", "h2").agg(F.min(order).alias("f")).select("h1", "h2", "f.*")
        dropped = dropped.join(first, ["h1", "h2", *KEY, "pos"], "left_anti")
    return dropped.select(*KEY, "pos")


def _bitmap(positions: pa.Array) -> pa.Array:
    """Positions of dropped lines as a compressed bitmap: bit set = the line goes."""
    out = []
    for at in positions.to_pylist():
        bits = np.zeros(max(at) + 1, np.uint8)
        bits[at] = 1
        out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
    return pa.array(out, pa.binary())


def line_bitmaps(dropped: DataFrame) -> DataFrame:
    """One row per document that loses lines: its key and the compressed ``bitmap`` of lost lines."""
    gathered = dropped.groupBy(*KEY).agg(F.collect_set("pos").alias("at"))
    return gathered.select(*KEY, arrow_column(_bitmap, "binary", F.col("at")).alias("bitmap"))


def _apply(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
    n_lines, n_dropped, kept = [], [], []
    for text, packed in zip(texts.to_pylist(), bitmaps.to_pylist(), strict=True):
        lines = text.split(b"\n")
        n_lines.append(len(lines))
        if packed is None:
            n_dropped.append(0)
            kept.append(text)
            continue
        gone = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), bitorder="little", count=None)
        stay = [line for i, line in enumerate(lines) if i >= len(gone) or not gone[i]]
        n_dropped.append(len(lines) - len(stay))
        kept.append(b"\n".join(stay))
    return struct_of(n_lines=(n_lines, pa.int64()), n_dropped=(n_dropped, pa.int64()), kept_text=(kept, pa.binary()))


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, text: str = "text") -> DataFrame:
    """The documents with ``n_lines``, ``n_dropped`` and ``kept_text``, what is left of each text.

    Null and empty texts are one empty line. A text that loses all lines becomes empty; no row
    goes. Input columns named like the new ones are replaced; null ids and repeated rows are
    matched by id and text together.
    """
    docs = without(docs, "n_lines", "n_dropped", "kept_text", "bitmap", *KEY)
    maps = line_bitmaps(shared_lines(docs, min_docs, min_chars, keep_first, text))
    keyed = docs.select("*", *_key_columns(text)).join(maps, list(KEY), "left")
    judged = keyed.withColumn("_r", arrow_column(_apply, "struct<n_lines:bigint,n_dropped:bigint,kept_text:binary>", as_bytes(text), F.col("bitmap")))
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns], "_r.n_lines", "_r.n_dropped", F.col("_r.kept_text").cast("string").alias("kept_text"))
