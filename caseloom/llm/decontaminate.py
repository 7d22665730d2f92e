"""Benchmark passages in training documents, found with a generalised suffix automaton.

The automaton holds every run of words of every test item in a number of states that is linear
in the words. A document streams through it once: at each word the walk knows the longest run
ending there that also stands in an item. Runs of a window's length or more are hits; items
shorter than a window count where they stand whole. Test sets larger than one automaton may
be are dealt into blocks, and the documents stream through one block after the other.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import FOLD, arrow_column, as_bytes, settle, struct_of, without
from caseloom.operators.spread import split_listed

WINDOW = 13
#: Words of test items in one automaton: some 250 bytes a word in each Python worker (50 when it is sent), 640 in the driver
#: while it is built, measured on items of random words, which have the most states.
BLOCK_WORDS = 200_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KEY = ["_doc", "_text"]
FOUND = "n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>"


class Automaton:
    """States of a generalised suffix automaton over words, with the items of each window.

    While it is built each state has a dictionary. Then nearly all states turn out to have one way on and one
    item, so the finished automaton is arrays: a word and a state for the only way, an item for the
    only item, and dictionaries for the few states that have more.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self._next: list[dict[int, int]] = [{}]
        self._link, self._len = [-1], [0]
        self.names: list[str | None] = []
        whole: dict[int, set[int]] = {}
        kept = []
        for name, words in items:
            if words:
                kept.append(array("i", [self.numbers.setdefault(w, len(self.numbers)) for w in words]))
                self.names.append(name)
        for no, words in enumerate(kept):
            last = 0
            for word in words:
                last = self._extend(last, word)
            if len(words) < window:
                whole.setdefault(last, set()).add(no)
        found: dict[int, int | set[int]] = {}
        for no, words in enumerate(kept):
            for state in self._windows(words):
                had = found.setdefault(state, no)
                if had != no:
                    found[state] = {had, no} if isinstance(had, int) else had | {no}
        self._finish(found, whole)

    def _finish(self, found: dict[int, int | set[int]], whole: dict[int, set[int]]) -> None:
        size = len(self._link)
        self.link, self.len = array("i", self._link), array("i", self._len)
        self.word, self.to, self.item = array("i", [-1]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        self.more: dict[int, dict[int, int]] = {}
        self.several: dict[int, set[int]] = {}
        for state, ways in enumerate(self._next):
            if len(ways) == 1:
                (self.word[state], self.to[state]), = ways.items()
            elif ways:
                self.more[state] = ways
        for state, of in found.items():
            if isinstance(of, int):
                self.item[state] = of
            else:
                self.several[state] = of
        for state, of in whole.items():
            self.several[state] = self.several.get(state, set()) | of
        # the nearest state, from each state along its links, that is an item shorter than a window
        self.short = array("i", [-1]) * size
        for state in sorted(range(1, size), key=self._len.__getitem__):
            self.short[state] = state if state in whole else self.short[self.link[state]]
        del self._next, self._link, self._len

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self._next.append(following)
        self._link.append(link)
        self._len.append(length)
        return len(self._link) - 1

    def _extend(self, last: int, word: int) -> int:
        if word in self._next[last]:  # a run that an earlier item has
            old = self._next[last][word]
            return old if self._len[old] == self._len[last] + 1 else self._split(last, word, old)
        state = self._new(self._len[last] + 1, 0, {})
        p = last
        while p != -1 and word not in self._next[p]:
            self._next[p][word] = state
            p = self._link[p]
        if p != -1:
            old = self._next[p][word]
            self._link[state] = old if self._len[old] == self._len[p] + 1 else self._split(p, word, old)
        return state

    def _split(self, p: int, word: int, old: int) -> int:
        copy = self._new(self._len[p] + 1, self._link[old], dict(self._next[old]))
        self._link[old] = copy
        while p != -1 and self._next[p].get(word) == old:
            self._next[p][word] = copy
            p = self._link[p]
        return copy

    def _windows(self, words: Iterable[int]) -> Iterable[int]:
        """The state of each window of an item."""
        state, matched = 0, 0
        for word in words:
            state, matched = self._next[state][word], matched + 1
            while self._len[self._link[state]] >= self.window:
                state = self._link[state]
            matched = min(matched, self._len[state])
            if matched >= self.window:
                yield state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words, end exclusive, and the items with a window in the text."""
        only, way, more, link, length, short, window = self.word, self.to, self.more, self.link, self.len, self.short, self.window
        state = matched = 0
        spans: list[tuple[int, int]] = []
        windows: set[int] = set()
        numbers, begins, nothing = self.numbers, self.more.get(0, {}) | ({self.word[0]: self.to[0]} if self.word[0] >= 0 else {}), {}
        for i, text in enumerate(words):
            word = numbers.get(text)
            if word is None:
                state = matched = 0
                continue
            to = begins[word] if not state else way[state] if only[state] == word else more.get(state, nothing).get(word)
            if to is None:
                while to is None:
                    state = link[state]
                    to = begins[word] if not state else way[state] if only[state] == word else more.get(state, nothing).get(word)
                matched = length[state]
            state = to
            matched += 1
            reach = 0
            if matched >= window:
                reach = matched
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                windows.add(at)
            brief = short[state]
            if brief >= 0:
                if brief == state and matched < length[state]:
                    brief = short[link[state]]
                at = brief
                while at >= 0:
                    windows.add(at)
                    reach = max(reach, length[at])
                    at = short[link[at]]
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        items = {self.item[at] for at in windows} | {no for at in windows for no in self.several.get(at, ())}
        return spans, {self.names[no] for no in items if no >= 0 and self.names[no] is not None}


def words_of(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return text.translate(FOLD).split()


def _blocks(benchmark: DataFrame, most: int) -> Iterable[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of about ``most`` words, read one partition at a time; ids as strings."""
    read = benchmark.select(F.col("item_id").cast("string"), as_bytes("text").alias("text"))
    block, size = [], 0
    for name, text in read.toLocalIterator():
        words = words_of(bytes(text))
        if size and size + len(words) > most:
            yield block
            block, size = [], 0
        block.append((name, words))
        size += len(words)
    if block:
        yield block


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _scanner(shared):
    def scan(texts: pa.Array, *before: pa.Array) -> pa.Array:
        automaton = shared.value
        n_words, n_hit, items, spans = [], [], [], []
        earlier = before[0].to_pylist() if before else [None] * len(texts)
        for text, old in zip(texts, earlier, strict=True):
            words = words_of(text.as_py())
            hit, names = automaton.scan(words)
            if old:
                names |= set(old["items"])
                hit = _merged([*hit, *[(s["start"], s["end"]) for s in old["spans"]]])
            n_words.append(len(words))
            n_hit.append(sum(e - s for s, e in hit))
            items.append(sorted(names))
            spans.append([{"start": s, "end": e} for s, e in hit])
        return struct_of(
            n_words=(n_words, pa.int64()), n_hit=(n_hit, pa.int64()), items=(items, pa.list_(pa.string())),
            spans=(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text: str = "text") -> DataFrame:
    """The documents with ``hits``: n_words, n_hit, items and spans (word numbers, end exclusive).

    An item of fewer words than a window counts as one window, items without words count nowhere,
    items without an id are hit but not listed, null texts have no words. An input column named ``hits`` is replaced.

    Test sets of up to ``block_words`` words are one pass, in which no row moves between tasks. Each further
    block of items is a pass of its own over the texts that writes the hits alone, under the document's id and a hash
    of its text; in the last pass only documents with such hits are shuffled to meet them.
    """
    docs = without(docs, "hits", *KEY, "_before")
    context, blocks = docs.sparkSession.sparkContext, iter(_blocks(benchmark, block_words))

    def scanned(items: list[tuple[str | None, list[bytes]]], *before: F.Column) -> F.Column:
        shared = context.broadcast(Automaton(items, window))  # bounded by block_words
        return arrow_column(_scanner(shared), f"struct<{FOUND}>", as_bytes(text), *before)

    own = [F.col("doc_id").cast("bigint").alias(KEY[0]), F.xxhash64(F.col(text).cast("string")).alias(KEY[1])] if "doc_id" in docs.columns else [
        F.lit(0).cast("bigint").alias(KEY[0]), F.xxhash64(F.col(text).cast("string")).alias(KEY[1])]
    first, earlier = next(blocks, []), []
    for block in blocks:
        hits = docs.select(*own, scanned(block).alias("hits")).where(F.size("hits.spans") > 0).dropDuplicates(KEY)
        earlier.append(settle(hits, "hits"))
    if not earlier:
        return docs.withColumn("hits", scanned(first))
    before = F.struct(F.flatten(F.collect_list("hits.items")).alias("items"), F.flatten(F.collect_list("hits.spans")).alias("spans"))
    known = settle(reduce(DataFrame.unionByName, earlier).groupBy(*KEY).agg(before.alias("_before")), "known-hits")
    clear, maybe = split_listed(docs.select("*", *own), KEY, known)
    # null ids are ids like any other here
    same = (F.col(f"m.{KEY[0]}").eqNullSafe(F.col(f"k.{KEY[0]}"))) & (F.col(f"m.{KEY[1]}") == F.col(f"k.{KEY[1]}"))
    met = maybe.alias("m").join(known.alias("k"), same, "left").select("m.*", "_before")
    both = clear.withColumn("_before", F.lit(None).cast(known.schema["_before"].dataType)).unionByName(met)
    return both.withColumn("hits", scanned(first, F.col("_before"))).drop("_before", *KEY)


def contaminated() -> F.Column:
    """A twentieth of the words or more lies in windows of the benchmark."""
    return (F.col("hits.n_hit") > 0) & (20 * F.col("hits.n_hit") >= F.col("hits.n_words"))


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, hit in zip(texts, spans.to_pylist(), strict=True):
        if not hit:
            out.append(text.as_py())
            continue
        raw = text.as_py()
        places = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
        at, kept = 0, []
        for s in hit:
            kept.append(raw[at:places[s["start"]][0]])
            at = places[s["end"] - 1][1]
        out.append(b"".join([*kept, raw[at:]]))
    return pa.array(out, pa.binary())


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """Drops documents beyond the coverage limit; cuts spans of the length limit out of the others.

    Columns stay as they came, but for the text.
    """
    found = find_contamination(docs, benchmark, window, text=text).where(~contaminated())
    clean = F.when(F.size("hits.spans") == 0, F.col(text)).otherwise(arrow_column(_cut, "binary", as_bytes(text), F.col("hits.spans")).cast("string"))
    return found.withColumn(text, clean).select(*[F.col(f"`{c}`") for c in without(docs, "hits").columns])
