"""Documents packed into training sequences: concatenate and cut.

First pass: each task tokenises its documents once and writes the ids with the running total
inside the task. The totals of the tasks, one row each, are summed in order, which gives every
document its place in one endless stream of tokens. Second pass: fixed windows cut the stream;
a document that crosses a boundary leaves one record per window. Only the last window of all
can be short.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import settle, without

VOCABULARY = "byte_bpe_50k"
SEPARATOR = 1
LENGTH = 2048
#: White space on which tiktoken's backtracking could run out of stack; it does somewhere beyond 700,000 characters.
LONG_BLANK = re.compile(r"\s{50000}")
TOKENS = "doc_id bigint, task int, start_in_task bigint, doc_tokens bigint, ids binary"


class _Encoder:
    """Byte-level BPE ids of whole texts: the vocabulary as ranks, and the tokenizer file itself
    for texts that spell one of its special tokens or have a very long run of white space."""

    def __init__(self, name: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.file = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.special = [t.content for t in self.file.get_added_tokens_decoder().values()]
        self.encode = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        by_file = any(s in text for s in self.special) or len(text) >= 50000 and LONG_BLANK.search(text)
        return np.array(self.file.encode(text, add_special_tokens=False).ids if by_file else self.encode(text), "<u4").tobytes()


@lru_cache(maxsize=1)
def _encoder(name: str) -> _Encoder:
    return _Encoder(name)


def _tokenise(name: str, separator: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(name), np.array([separator], "<u4").tobytes()
        task, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids, starts, counts, ids, size, first = batch.column(0), [], [], [], 0, 0
            for i, text in enumerate(batch.column(1)):
                got = encode(text.as_py() or "") + end
                starts.append(total)
                counts.append(len(got) // 4)
                total += counts[-1]
                ids.append(got)
                size += len(got)
                if size > 8 << 20 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.slice(first, len(ids)), pa.array([task] * len(ids), pa.int32()), pa.array(starts, pa.int64()),
                         pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "task", "start_in_task", "doc_tokens", "ids"])
                    starts, counts, ids, size, first = [], [], [], 0, i + 1
    return emit


def tokenise(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """Ids of each document, the separator last, with the place inside its task. Null is empty."""
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return settle(read.mapInArrow(_tokenise(vocabulary, separator), TOKENS), "tokens")


def pack_documents(docs: DataFrame, length: int = LENGTH, text: str = "text", vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    Each document, null and empty ones too, has at least its separator and so a piece. Repeated
    rows are packed each. An empty table gives no rows. ``ids`` are little-endian unsigned 32-bit.
    """
    tokens = tokenise(without(docs, "ids"), text, vocabulary, separator)
    # one row per task of the first pass: few enough to order in one place and to send everywhere
    totals = tokens.groupBy("task").agg(F.sum("doc_tokens").alias("n"))
    before = totals.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    placed = tokens.join(F.broadcast(before), "task").withColumn("at", F.col("before") + F.col("start_in_task"))

    def piece(sequence: F.Column) -> F.Column:
        begin = F.greatest(sequence * length, F.col("at"))
        end = F.least((sequence + 1) * length, F.col("at") + F.col("doc_tokens"))
        ids = F.substring(F.col("ids"), ((begin - F.col("at")) * 4 + 1).cast("int"), ((end - begin) * 4).cast("int"))
        return F.struct((begin - F.col("at")).alias("start"), (end - begin).alias("length"), ids.alias("ids"),
                        sequence.alias("sequence_id"), (begin - sequence * length).alias("offset"))

    windows = F.sequence(F.expr(f"at div {length}"), F.expr(f"(at + doc_tokens - 1) div {length}"))
    cut = placed.select("doc_id", "doc_tokens", F.explode(F.transform(windows, piece)).alias("p"))
    return cut.select("doc_id", "p.start", "p.length", "p.ids", F.crc32("p.ids").alias("ids_crc32"), "doc_tokens", "p.sequence_id", "p.offset")
