"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Texts become weighted sets of five-word shingles: (1 + ln tf) * idf. Consistent weighted samples of
such sets agree with a probability equal to their weighted Jaccard similarity; samples are
cut into bands, and documents that agree on a whole band are candidates. Candidates are verified by
their exact weighted Jaccard similarity, and verified links join documents into classes.

Scale. Exact copies collapse first, so a group of copies costs one row per task. The idf needs
no table of all shingles: idf(s) = sqrt(ln(1 + N / max(df(s), L))) with L a share of all documents, so
only shingles in L documents or more have an entry. They are found by hashed counts, which
never undercount, and then counted exactly: their number is at most the mean number of shingles
of a document over that share. In a bucket every member is compared with a few leaders, not with
all others, first with the most central one; buckets whose members are then still in several classes
go on with many more leaders each time, until each pair of classes in them has been compared or
merged. How many rare shingles two texts have bounds what they can share, so pairs beyond that
bound are not made; pairs that have a rare shingle in common are found by it.

A large group of near copies makes its own shingles frequent, so weights alone would drop what
its members share below what they do not. A pair is therefore similar if its weighted or its
plain Jaccard similarity reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import FOLD, arrow_column, as_bytes, blocks, mixed, release, settle, shingles, struct_of, tidy, word_hashes
from caseloom.operators.spread import split_listed

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Share of documents, and their number, from which on a shingle's frequency matters.
RARE, LEAST_DOCS = 0.05, 20
#: Hashed document counts: 2**SKETCH_BITS of them.
SKETCH_BITS = 16
#: Entries of the tables the samples' random numbers come from.
TABLE_BITS = 14
#: Share of agreeing samples below which a candidate cannot be similar: fewer than 25 of 64 samples agree once in
#: 10**12 pairs at a weighted similarity of 0.8, once in 3 * 10**5 at 0.66, which is what a plain 0.8 may come to
#: where half of all texts are one group.
LEAST_AGREEING = 0.4
#: Shingles keep this many bits of their hash; the rest of 64 numbers the texts of a block.
KEY_BITS = 52
#: Leaders of a bucket in the turns after the first grow by this factor.
MORE_LEADERS = 64


def weighted_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order: text number, hash, how often; and words per text.

    A text of one to four words is one shingle of all its words; a text without words has none.
    """
    hashes, counts = word_hashes(texts, FOLD)
    keys, first = shingles(hashes, counts, WIDTH)
    doc = np.repeat(np.arange(len(counts)), counts)[first]
    ends = np.cumsum(counts)
    brief = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(brief):
        whole = [np.bitwise_xor.reduce(mixed(hashes[ends[i] - counts[i]:ends[i]] + np.arange(1, counts[i] + 1, dtype=np.uint64))) for i in brief]
        keys, doc = np.concatenate((keys, np.array(whole, np.uint64))), np.concatenate((doc, brief))
    # texts of a block are few, so text number and hash fit into one number, which sorts fast
    both = (doc.astype(np.uint64) << np.uint64(KEY_BITS)) | (keys >> np.uint64(64 - KEY_BITS))
    both.sort()
    at = np.flatnonzero(np.r_[True, both[1:] != both[:-1]][:len(both)])
    found = both[at]
    return (found >> np.uint64(KEY_BITS)).astype(np.int64), found & np.uint64((1 << KEY_BITS) - 1), np.diff(np.append(at, len(both))), counts


class Weights:
    """(1 + ln tf) * idf, with the entries of frequent shingles and the idf all others share."""

    def __init__(self, n_docs: int, hashes: np.ndarray, df: np.ndarray, rare: float) -> None:
        order = np.argsort(hashes)
        least = max(LEAST_DOCS, n_docs * rare)
        self.hashes, self.idf = hashes[order], np.sqrt(np.log1p(n_docs / np.maximum(df[order], least)))
        self.top = float(np.sqrt(np.log1p(max(n_docs, 1) / least)))

    def of(self, keys: np.ndarray, tf: np.ndarray) -> np.ndarray:
        weight = np.full(len(keys), self.top)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
            hit = self.hashes[at] == keys
            weight[hit] = self.idf[at[hit]]
        often = tf > 1
        weight[often] *= 1 + np.log(tf[often])
        return weight


def _hashed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per hashed shingle, summed over the task."""
    counts, n = np.zeros(1 << SKETCH_BITS, np.int64), 0
    for batch in batches:
        n += batch.num_rows
        for _, _, part in blocks(batch.column(0), docs=1 << 64 - KEY_BITS):
            _, keys, _, _ = weighted_shingles(part)
            counts += np.bincount((keys >> np.uint64(KEY_BITS - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], n))], names=["slot", "n"])


def _frequent(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value
        for batch in batches:
            got = []
            for _, _, part in blocks(batch.column(0), docs=1 << 64 - KEY_BITS):
                _, keys, _, _ = weighted_shingles(part)
                got.append(keys[heavy[(keys >> np.uint64(KEY_BITS - SKETCH_BITS)).astype(np.int64)]])
            keys, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])
    return count


def shingle_weights(docs: DataFrame, rare: float = RARE) -> Weights:
    """Frequent shingles with their exact document frequencies, over all documents.

    The driver receives 2**SKETCH_BITS flags and the frequent shingles: at most mean shingles per
    document / rare of them, whatever the number of documents.
    """
    read = docs.select(as_bytes("text").alias("text"))
    sketch = settle(read.mapInArrow(tidy(_hashed_counts), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")), "shingle-counts")
    n_docs = sketch.where("slot = -1").agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_DOCS, n_docs * rare)
    slots = np.array([r[0] for r in sketch.where((F.col("slot") >= 0) & (F.col("n") >= least)).select("slot").collect()], np.int64)
    heavy = np.zeros(1 << SKETCH_BITS, bool)
    heavy[slots] = True
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    counted = read.mapInArrow(tidy(_frequent(shared)), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = counted.toPandas()
    release(sketch)
    return Weights(n_docs, found["key"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64), rare)


class Sampler:
    """Consistent weighted samples of many sets at once.

    A sample of a set is the element that minimises c / (y e^r) with y = exp(r (t - b)) and
    t = floor(ln(weight) / r + b), together with its t. The random r, c, b of element and
    sample number are drawn from tables by a hash of both. Most elements share one
    weight, so what they contribute is a table too, and only the others are worked out.
    """

    def __init__(self, top: float, n: int = BANDS * ROWS, bits: int = TABLE_BITS, seed: int = 7) -> None:
        rng, size = np.random.default_rng(seed), 1 << bits
        self.r, self.ln_c, self.b = rng.gamma(2, 1, size), np.log(rng.gamma(2, 1, size)), rng.random(size)
        self.odd = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift, self.top = np.uint64(64 - bits), top
        self.common = self._rank(np.arange(size), np.full(size, np.log(top)))

    def _rank(self, at: np.ndarray, ln_weight: np.ndarray) -> np.ndarray:
        """ln of what is minimised, as an unsigned number in the same order, in the upper 32 bits."""
        r, b = self.r[at], self.b[at]
        value = (self.ln_c[at] - r * (np.floor(ln_weight / r + b) - b) - r).astype(np.float32).view(np.uint32)
        ordered = np.where(value >> 31, ~value, value | np.uint32(1 << 31))
        return ordered.astype(np.uint64) << np.uint64(32)

    def of(self, doc: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """A row of samples per set, as 32-bit numbers; sets without elements get zeros."""
        out = np.zeros((n, len(self.odd)), np.int32)
        if not len(keys):
            return out
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        own = np.flatnonzero(weights != self.top)
        ln_own, low, spread = np.log(weights[own]), keys & np.uint64(0xFFFFFFFF), mixed(keys)
        for k, odd in enumerate(self.odd):
            at = ((spread * odd) >> self.shift).astype(np.int64)
            rank = self.common[at]
            if len(own):
                rank[own] = self._rank(at[own], ln_own)
            least = np.minimum.reduceat(rank | low, starts)
            out[doc[starts], k] = (mixed(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return out


def _signer(shared):
    def sign(texts: pa.Array) -> pa.Array:
        weights, sampler = shared.value
        size = len(texts)
        samples, content, n_words = [], np.zeros((size, 2), np.uint64), np.zeros(size, np.int64)
        n, weight = np.zeros(size, np.int64), np.zeros(size)
        for i, j, part in blocks(texts, docs=1 << 64 - KEY_BITS):
            doc, keys, tf, counts = weighted_shingles(part)
            own = weights.of(keys, tf)
            n[i:j], weight[i:j] = np.bincount(doc, minlength=j - i), np.bincount(doc, weights=own, minlength=j - i)
            samples.append(sampler.of(doc, keys, own, j - i))
            hashes, _ = word_hashes(part, FOLD)
            ends = np.cumsum(counts)
            for half, base in enumerate((np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))):
                place = mixed((np.arange(len(hashes), dtype=np.uint64) - np.repeat(ends - counts, counts).astype(np.uint64)) * base + base)
                sums = np.r_[np.uint64(0), np.cumsum(mixed(hashes ^ place), dtype=np.uint64)]
                content[i:j, half] = sums[ends] - sums[ends - counts]
            n_words[i:j] = counts
        flat = np.concatenate(samples).reshape(-1) if samples else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(sampler.odd), dtype=np.int32)), pa.array(flat))
        return struct_of(w1=(content[:, 0].view(np.int64), pa.int64()), w2=(content[:, 1].view(np.int64), pa.int64()),
                         n_words=(n_words, pa.int64()), n=(n, pa.int64()), weight=(weight, pa.float64()), samples=(lists, lists.type))
    return sign


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, a hash of the text as it stands, a 128-bit hash of its words in order, the numbers of words and of
    shingles, their weight, and the samples."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, Sampler(weights.top)))
    signed = arrow_column(_signer(shared), "struct<w1:bigint,w2:bigint,n_words:bigint,n:bigint,weight:double,samples:array<int>>", as_bytes("text"))
    return docs.select(*_own(), signed.alias("s")).select("doc_id", "t", "s.*")


def _own() -> list[Column]:
    """What a row is known by: its id and a hash of its text, since an id may be repeated with different texts."""
    return [F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t")]


def _similar(shared, least: float):
    """Whether the exact weighted, or plain, Jaccard similarity of pairs of texts reaches ``least``."""
    def verify(left: pa.Array, right: pa.Array) -> pa.Array:
        weights, out, last = shared.value, [], (None, None)
        for a, b in zip(left, right, strict=True):
            a, b = a.as_py(), b.as_py()
            if last[0] != b:
                _, keys, tf, _ = weighted_shingles([b])
                last = (b, (keys, weights.of(keys, tf)))
            kb, wb = last[1]
            _, ka, tf, _ = weighted_shingles([a])
            wa = weights.of(ka, tf)
            _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            both, plain = np.minimum(wa[ia], wb[ib]).sum(), len(ia)
            out.append(bool(plain and (both >= least * (wa.sum() + wb.sum() - both) - 1e-9 or plain >= least * (len(ka) + len(kb) - plain) - 1e-9)))
        return pa.array(out, pa.bool_())
    return verify


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root): the least id each node reaches. Labels pass along links and then jump to the
    label of their label, so chains shorten by half each time."""
    both = settle(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "links")
    label = settle(nodes.select("id", F.col("id").alias("root")), "labels")
    known = label
    while True:
        near = both.join(label.withColumnsRenamed({"id": "v", "root": "r"}), "v").groupBy("u").agg(F.min("r").alias("near"))
        passed = label.join(near.withColumnRenamed("u", "id"), "id", "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("new"))
        jump = passed.select(F.col("id").alias("new"), F.col("new").alias("over"))
        after = settle(passed.join(jump, "new", "left").select("id", F.least("new", F.coalesce("over", "new")).alias("root"), F.col("root").alias("old")), "labels")
        changed = after.where("root <> old").limit(1).count()
        release(known)
        known, label = after, after.select("id", "root")
        if not changed:
            release(both)
            return label


def _exploded(shared):
    """(key, id, w): the shingles of candidates."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            ids = batch.column(0)
            for i, _, part in blocks(batch.column(1), docs=1 << 64 - KEY_BITS):
                doc, keys, tf, _ = weighted_shingles(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), ids.take(pa.array(doc + i)), pa.array(weights.of(keys, tf))], names=["key", "id", "w"])
    return explode


def _rare_shingles(texts: DataFrame, weights: Weights) -> DataFrame:
    """(key, n, w, ids): the candidates of each shingle that at most three candidates have."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    keyed = texts.select("id", "text").mapInArrow(tidy(_exploded(shared)), "key bigint, id bigint, w double")
    counted = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("w").alias("w"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor("id").alias("all"))
    middle = F.col("all").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high"))
    ids = F.when(F.col("n") == 1, F.array("low")).when(F.col("n") == 2, F.array("low", "high")).otherwise(F.array("low", middle, "high"))
    return counted.where("n <= 3").select("key", "n", "w", ids.alias("ids"))


def _rareness(rare: DataFrame) -> DataFrame:
    """(id, lone, lone_weight, few, few_weight): shingles no other candidate has, and those at most two others have.

    They bound similarities from above. A text of which over a fifth is lone has no partner at all. Two texts
    that have no rare shingle in common share at most what is not rare; those that have one are paired
    by it. And those with fewest rare shingles stand nearest to the middle of their group.
    """
    each = rare.select("n", "w", F.explode("ids").alias("id"))
    lone = F.col("n") == 1
    return each.groupBy("id").agg(
        F.count_if(lone).alias("lone"), F.sum(F.when(lone, F.col("w")).otherwise(0.0)).alias("lone_weight"), F.count("*").alias("few"), F.sum("w").alias("few_weight"))


def _rare_pairs(rare: DataFrame, possible: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) with a rare shingle in common: one or three for each such shingle."""
    ids = F.col("ids")
    pairs = F.when(F.col("n") == 2, F.array(F.struct(ids[1].alias("a"), ids[0].alias("b")))).otherwise(F.array(
        F.struct(F.greatest(ids[0], ids[1]).alias("a"), F.least(ids[0], ids[1]).alias("b")),
        F.struct(F.greatest(F.get(ids, F.lit(1)), F.get(ids, F.lit(2))).alias("a"), F.least(F.get(ids, F.lit(1)), F.get(ids, F.lit(2))).alias("b")),
        F.struct(F.greatest(ids[0], F.get(ids, F.lit(2))).alias("a"), F.least(ids[0], F.get(ids, F.lit(2))).alias("b"))))
    found = rare.where("n > 1").select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a <> b").distinct()
    one, other = (possible.select(F.col("id").alias(side), *[F.col(m).alias(f"{side}_{m}") for m in MEASURED]) for side in ("a", "b"))
    reach = _may_reach(similarity, {m: F.col(f"a_{m}") for m in MEASURED}, {m: F.col(f"b_{m}") for m in MEASURED}, "lone")
    return found.join(one, "a").join(other, "b").where(reach).select("a", "b")


def _keys(unique: DataFrame) -> DataFrame:
    """(id, band, bucket) of every band."""
    keys = F.array(*[F.xxhash64(F.lit(k), F.slice("samples", k * ROWS + 1, ROWS)) for k in range(BANDS)])
    return unique.select("id", F.posexplode(keys).alias("band", "bucket"))


def _members(each: DataFrame, known: DataFrame) -> DataFrame:
    """Members of the buckets that have several, with the number of members and the central one."""
    placed = each.join(known, "id")
    middle = F.struct((F.col("few") / F.col("n")).alias("share"), "id", *MEASURED)
    full = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min(middle).alias("middle")).where("size > 1")
    return placed.join(full, "bucket")


MEASURED = ("n", "weight", "lone", "lone_weight", "few", "few_weight")


def _may_reach(similarity: float, one: dict[str, Column], other: dict[str, Column], unshared: str = "few") -> Column:
    """Whether the shingles two texts may share suffice, counted or weighed."""
    def enough(all_of: str, apart: str) -> Column:
        most = F.least(one[all_of] - one[apart], other[all_of] - other[apart])
        return most >= similarity * (one[all_of] + other[all_of] - most) - 1e-6
    return enough("n", unshared) | enough("weight", f"{unshared}_weight")


def _asked(members: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of members of different classes, b a leader of their bucket in this turn.

    First the leader is the central member. Then leaders are those whose hash, as a share, falls
    into the turn's range, many times as many as before, until every member has been one. Pairs that
    cannot be similar are not made; those that share a rare shingle have been found by it before.
    """
    own = {m: F.col(m) for m in MEASURED}
    if turn == 0:
        reach = _may_reach(similarity, own, {m: F.col(f"middle.{m}") for m in MEASURED})
        pairs = members.where((F.col("id") != F.col("middle.id")) & reach).select(F.col("id").alias("x"), F.col("middle.id").alias("y"))
    else:
        share = F.pmod(F.xxhash64("id", "bucket"), F.lit(1 << 20)) / F.lit(1 << 20) * F.col("size")
        begin, end = (MORE_LEADERS**(turn - 1) if turn > 1 else 0), MORE_LEADERS**turn
        leaders = members.where((share >= begin) & (share < end)).select(
            F.col("bucket").alias("_b"), F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("samples").alias("_samples"),
            *[F.col(m).alias(f"_{m}") for m in MEASURED])
        # a pair meets in every band it agrees on, and is made in the first of them
        before = F.exists(F.array(*[F.lit(k) for k in range(BANDS)]), lambda k: (k < F.col("band")) & (
            F.slice("samples", k * ROWS + 1, F.lit(ROWS)) == F.slice("_samples", k * ROWS + 1, F.lit(ROWS))))
        reach = _may_reach(similarity, own, {m: F.col(f"_{m}") for m in MEASURED})
        pairs = members.join(leaders, (F.col("bucket") == F.col("_b")) & (F.col("root") != F.col("_root")) & reach & ~before).select(F.col("id").alias("x"), F.col("_id").alias("y"))
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """The pairs that are similar, by samples first, then exactly."""
    signs = texts.select("id", "samples")
    agreeing = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
    near = (pairs.join(signs.withColumnsRenamed({"id": "a", "samples": "sa"}), "a").join(signs.withColumnsRenamed({"id": "b", "samples": "sb"}), "b")
            .where(agreeing >= int(LEAST_AGREEING * BANDS * ROWS)).select("a", "b"))
    shared = pairs.sparkSession.sparkContext.broadcast(weights)
    with_a = near.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    alike = arrow_column(_similar(shared, similarity), "boolean", F.col("ta"), F.col("tb"))
    return both.select("a", "b", alike.alias("alike")).where("alike").select("a", "b")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, rare: float = RARE) -> DataFrame:
    """(doc_id, class_id) per row: the least doc_id of its class of copies and near copies.

    Texts with the same words in the same order are copies. Texts without words are alone. Rows that share a
    doc_id and differ in text are texts of their own, each with the class it belongs to; rows without a doc_id get
    a null class. Other columns stay behind.
    """
    signed, classes = _classified(docs.select("doc_id", "text"), similarity, rare)
    # a group of copies is as skewed a key as the data has: Spark splits it, the other side being one row per group
    joined = signed.select("doc_id", "n_words", "w1", "w2").join(classes.select("w1", "w2", F.col("first.doc_id").alias("class_id")), ["w1", "w2"], "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def _classified(docs: DataFrame, similarity: float, rare: float) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and (w1, w2, first) of every text with words: ``first`` is the least doc_id of its
    class, with the hash of that row's text."""
    weights = shingle_weights(docs, rare)
    signed = settle(signatures(docs, weights), "signatures")
    # a text is known by its words, and numbered once they have been written
    grouped = signed.where("n_words > 0 and doc_id is not null").groupBy("w1", "w2").agg(
        F.min(F.struct("doc_id", "t")).alias("own"), *[F.first(c).alias(c) for c in ("samples", "n", "weight")])
    unique = settle(grouped.withColumn("id", F.monotonically_increasing_id()), "unique")
    each = settle(_keys(unique), "bands")
    together = each.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    wanted = unique.join(each.join(together, "bucket", "left_semi").select("id").distinct(), "id", "left_semi")
    wanted = settle(wanted.select("own.*", "id", "samples", "n", "weight"), "wanted")
    # of all texts only those that may be wanted move; a repeated row counts once, or its shingles would not look rare
    _, maybe = split_listed(docs.select(*_own(), as_bytes("text").alias("text")), ["doc_id", "t"], wanted)
    # texts are few bytes beside the shingles made of them, so they are not gathered into as few tasks as their size allows
    dealt = maybe.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "t")
    texts = settle(dealt.join(wanted, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).drop("doc_id", "t"), "texts")
    rare_ones = settle(_rare_shingles(texts, weights), "rare")
    known = texts.select("id", "n", "weight").join(_rareness(rare_ones), "id", "left").fillna(0, ["lone", "lone_weight", "few", "few_weight"])
    possible = settle(known.where((F.col("n") - F.col("lone") >= similarity * F.col("n"))
                                  | (F.col("weight") - F.col("lone_weight") >= similarity * F.col("weight") - 1e-6)), "possible")
    members = settle(_members(each, possible), "members")
    release(each)
    root, known_roots = possible.select("id", F.col("id").alias("root")), None
    turn, tried, asked = 0, None, []
    while True:
        placed = members
        if turn:
            placed = members.join(root, "id").join(wanted.select("id", "samples"), "id")
            apart = placed.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("bucket")
            beyond = MORE_LEADERS**(turn - 1) if turn > 1 else 2
            placed = settle(placed.where(F.col("size") > beyond).join(apart, "bucket", "left_semi"), "open-buckets")
            if not placed.limit(1).count():
                release(placed)
                break
        pairs = _asked(placed, turn, similarity) if turn else _asked(placed, turn, similarity).union(_rare_pairs(rare_ones, possible, similarity)).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = settle(pairs, "pairs")
        release(placed if turn else rare_ones)
        links = settle(_verified(pairs, texts, weights, similarity), "similar")
        tried, asked = pairs if tried is None else tried.unionByName(pairs), [*asked, pairs]
        if links.limit(1).count():
            before = known_roots
            root = known_roots = settle(_joined_classes(root, links), "roots")
            if before is not None:
                release(before)
        release(links)
        turn += 1
    numbered = unique.select("w1", "w2", "own", "id").join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    firsts = numbered.groupBy("root").agg(F.min("own").alias("first"))
    classes = settle(numbered.join(firsts, "root").select("w1", "w2", "first"), "classes")
    release(texts, wanted, unique, members, possible, *asked, *([known_roots] if known_roots is not None else []))
    return signed, classes


def _joined_classes(root: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after new links: the links between roots are few, and only they are followed."""
    of_a = links.join(root.withColumnsRenamed({"id": "a", "root": "ra"}), "a")
    of_both = of_a.join(root.withColumnsRenamed({"id": "b", "root": "rb"}), "b").where("ra <> rb")
    between = settle(of_both.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "root-links")
    ends = between.select(F.col("a").alias("id")).union(between.select("b")).distinct()
    merged = components(ends, between).select(F.col("id").alias("root"), F.col("root").alias("new"))
    return root.join(merged, "root", "left").select("id", F.coalesce("new", "root").alias("root"))


def one_per_class(docs: DataFrame, similarity: float = SIMILARITY, rare: float = RARE) -> DataFrame:
    """One document of each class, the one of least id, and one row of it.

    Documents without words and rows without an id stay; texts that share an id stay or go each with their own class.
    Columns are those that came. Only rows that may have to go are shuffled.
    """
    signed, classes = _classified(docs.select("doc_id", "text"), similarity, rare)
    judged = signed.where("n_words > 0 and doc_id is not null").select("doc_id", "t", "w1", "w2").join(classes, ["w1", "w2"])
    rows = judged.groupBy("doc_id", "t").agg(F.max(F.struct("doc_id", "t") == F.col("first")).alias("_stays"), F.count("*").alias("_n"))
    listed = settle(rows.where("not _stays or _n > 1"), "listed")
    release(signed, classes)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *_own())
    clear, maybe = split_listed(own, ["doc_id", "t"], listed)
    looked = maybe.join(listed, ["doc_id", "t"], "left")
    single = looked.where("_n is null or (_stays and _n = 1)")
    nth = F.row_number().over(Window.partitionBy("doc_id", "t").orderBy("t"))
    repeated = looked.where("_stays and _n > 1").withColumn("_nth", nth).where("_nth = 1")
    return clear.select("_row.*").unionByName(single.select("_row.*")).unionByName(repeated.select("_row.*"))
