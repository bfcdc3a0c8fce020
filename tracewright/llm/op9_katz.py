"""Language-model scores by Katz backoff over word pairs.

Counts of each order are gathered over all training rows and stored in Parquet tables, partitioned by the hash of the n-gram. Good-Turing: log n_r is
fitted by a line a + b log r (Gale and Sampson) over the true counts of counts of all words and all pairs, so a count r is discounted by (1 + 1/r)**(b + 1),
below 1 for every r. Unigrams keep d(c) c / N; what is left is the probability of the one unknown type. A pair (h, w) counted at least `cut` times keeps
d(c) c / c(h); all others fall to alpha(h) P(w), with alpha(h) = (1 - sum of kept) / (1 - sum of P(w) over kept w), so that each history sums to 1 exactly.
A text starts after an end.

The cut is a parameter, the same at every size of input. The query's is CUT: pairs seen once, 80 % of the distinct pairs and 45 % of their occurrences in the
test tables, are counted, enter the Good-Turing line, and back off. With a cut of 1 every pair is kept, at about twice the cost.

The most frequent words, MOST_WORDS and the end at most, and the most frequent pairs, MOST_PAIRS at most, are broadcast. This decides only where a count is
looked up. All kept pairs stand in a table; those that are not broadcast, and rarer words, find their counts by joins. A bitmap of fixed size, in
which each pair of that table sets one bit, is broadcast too: a pair whose bit isn't set has no entry to find and isn't sent. With more pairs than bits it lets
all pass, and the joins decide alone.

Pairs are dealt into buckets by their hash, as many as the training tokens need (BUCKET), so a bucket's size doesn't follow the input. A task sends each bucket
one row for many pairs: keys in order, as differences, and what belongs to them, compressed. The bucket's task adds counts up, or finds the entries of pairs.

Null text: as an empty one (one end). Null doc_id: crc32 of empty text. Repeated rows: each its own row. Very long texts: whole. Ties: none matter. Extra
columns, whatever their names: not read. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import crc_mod, documents, drop_shuffles, materialise, release, small_batches

#: Words and pairs that are broadcast, at most.
MOST_WORDS, MOST_PAIRS = 1 << 19, 1 << 19
#: Leading bits of a pair's hash that are its place in the bitmap.
PLACE = 27
#: Least count of a pair that is kept, at every size.
CUT = 2
#: Entries at which a task passes on what it has counted.
FLUSH = 400_000
#: Training tokens for each bucket of pairs.
BUCKET = 1 << 21
#: Rows of a batch that a Python step gives.
GIVEN = 1 << 16
#: Bytes of text that a Python step takes at once, unless one text is longer.
PART = 1 << 21
#: Counts from 1 that the line is fitted to.
FITTED = 200
END = b""


def line(counts: dict[int, int]) -> float:
    """Slope b of log n_r over log r, n_r averaged over the gaps on both sides; -2 where there are too few points."""
    r = sorted(counts)
    if len(r) < 3:
        return -2.0
    z = []
    for i, x in enumerate(r):
        low = r[i - 1] if i else x - 1
        high = r[i + 1] if i + 1 < len(r) else 2 * x - low
        z.append(counts[x] / (0.5 * (high - low)))
    b = float(np.polyfit(np.log(r), np.log(z), 1)[0])
    return min(b, -1.05)


def least(of_counts: list[tuple[int, int]], most: int, low: int) -> int:
    """Least count, low or more, that no more than so many entries reach. of_counts: each count and how many entries have it."""
    total = 0
    for c, k in sorted(of_counts, reverse=True):
        total += k
        if total > most:
            return max(low, c + 1)
    return low


def kept_share(c, b: float):
    """Discount of a count."""
    return (1 + 1 / c) ** (b + 1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with PART bytes of text (the last column) at most, or one text."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, done + PART, "right")))
            yield batch.slice(at, end - at)
            at, done = end, int(upto[end - 1])


def sequence(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The tokens of all texts after an end, as places in a list of words; this list, lower-cased, its last one the end; tokens of each text, its end
    included. Words are [^\\x20\\x09-\\x0D]+, which is just how ascii_split_whitespace parts; it gives an empty word beside a blank at either end of a text."""
    parted = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = parted.flatten().dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary())
    owner = np.repeat(np.arange(len(parted)), pc.list_value_length(parted).to_numpy(zero_copy_only=False))
    blank = pc.index(words, pa.scalar(END, pa.binary())).as_py()
    if blank >= 0:
        full = code != blank
        code, owner = code[full], owner[full]
    out = np.full(len(code) + len(parted) + 1, len(words), np.int64)
    out[np.arange(len(code)) + owner + 1] = code
    return out, pa.concat_arrays([words, pa.array([END], pa.binary())]), np.bincount(owner, minlength=len(parted)) + 1


def word_counts(texts: DataFrame) -> DataFrame:
    """word (UTF-8, lower-cased; empty: the end), c."""

    def run(batches):
        waiting, n = [], 0

        def out():
            found = pa.Table.from_batches(waiting).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])
            waiting.clear()
            return found.to_batches(max_chunksize=GIVEN)

        for part in _parts(batches):
            seq, words, _ = sequence(part.column(0))
            c = np.bincount(seq[1:], minlength=len(words)).astype(np.int64)
            there = np.flatnonzero(c)
            waiting.append(pa.RecordBatch.from_arrays([words.take(pa.array(there)), pa.array(c[there])], ["word", "c"]))
            n += len(there)
            if n > 4 * FLUSH:
                yield from out()
                n = 0
        if n:
            yield from out()
        pa.default_memory_pool().release_unused()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Index:
    """Ids of words by the order of their hashes. Of words with the same hash one is found; the others count as outside the index, which only moves a lookup."""

    def __init__(self, words: pa.Array):
        self.words = words
        hashed = marks(words.to_pylist())
        self.order = np.argsort(hashed, kind="stable")
        self.hashed = hashed[self.order]

    def ids(self, words: pa.Array, hashed: np.ndarray, end: int) -> np.ndarray:
        """Ids of the words of a sequence; -1 for a word outside the index."""
        out = np.full(len(words), -1, np.int64)
        if len(self.order):
            at = self.order[np.minimum(np.searchsorted(self.hashed, hashed), len(self.order) - 1)]
            same = pc.equal(self.words.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
            out[same] = at[same]
        out[-1] = end
        return out


def pair_keys(x: np.ndarray, wide: int) -> np.ndarray:
    """(history + 1) * (wide + 1) + word + 1 of each pair; -1 stands for a word outside the index."""
    return (x[:-1] + 1) * (wide + 1) + x[1:] + 1


class Rare:
    """The pairs of a sequence with a word outside the index: at, where they stand; of, which of the different ones each is, in code, c times each."""

    def __init__(self, seq: np.ndarray, x: np.ndarray, words: pa.Array, hashed: np.ndarray):
        self.hashed = hashed
        self.at = np.flatnonzero((x[:-1] < 0) | (x[1:] < 0))
        self.words, wide = words, len(words)
        code, first, self.of, self.c = np.unique(seq[self.at] * wide + seq[self.at + 1], return_index=True, return_inverse=True, return_counts=True)
        where, end = self.at[first], wide - 1
        self.first = where
        self.h, self.w = np.where(x[where] < 0, code // wide, end), np.where(x[where + 1] < 0, code % wide, end)

    def names(self, which: np.ndarray) -> pa.Array:
        """Of different ones, their words outside the index (others and the end: empty) around a newline, which no word holds."""
        return pc.binary_join_element_wise(self.words.take(pa.array(self.h[which])), self.words.take(pa.array(self.w[which])), pa.scalar(b"\n", pa.binary()))

    def marks(self) -> np.ndarray:
        """See marks(); of the different ones."""
        return joined_marks(self.hashed[self.h], self.hashed[self.w])


_U = np.uint64


def marks(words: list[bytes]) -> np.ndarray:
    """A hash of each word; 0 for an empty one."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in words), _U, len(words))


def joined_marks(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return h ^ (w * _U(0x9E3779B97F4A7C15))


def mixed(keys: np.ndarray, rare: np.ndarray | None) -> np.ndarray:
    """A hash of each pair. rare: joined marks of the words outside the index."""
    x = keys.astype(np.int64).view(_U)
    if rare is not None:
        x = x ^ rare
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def places(keys: np.ndarray, rare: np.ndarray | None, bits: int) -> np.ndarray:
    """Place of each pair in a bitmap of 2**bits."""
    return mixed(keys, rare) >> _U(64 - bits)


def packed(x: np.ndarray) -> bytes:
    """Values of 8 bytes, compressed; their bytes of equal weight stand together."""
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T), asbytes=True)


def unpacked(data: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * n), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(kind).ravel()


DEALT = pa.schema([("bucket", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("held", pa.binary()), ("sizes", pa.binary()), ("rare", pa.binary())])
DEALT_DDL = "bucket int, first long, n long, keys binary, held binary, sizes binary, rare binary"


def dealt(buckets: int, keys: np.ndarray, held: np.ndarray, first: int = 0, rare: pa.Array | None = None, joined: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each bucket that has some of the pairs: how many, their keys, what they hold, and, for pairs with rare words, these names and their sizes."""
    bucket = (mixed(keys, joined) % _U(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(bucket[order], kind="stable")]
    which, starts = np.unique(bucket[order], return_index=True)
    columns: list = [[], [], [], [], []]
    for a, z in zip(starts, [*starts[1:], len(order)], strict=True):
        at = order[a:z]
        columns[0].append(len(at))
        columns[1].append(packed(np.diff(keys[at], prepend=0)))
        columns[2].append(packed(held[at]))
        names = None if rare is None else rare.take(pa.array(at))
        columns[3].append(None if names is None else packed(pc.binary_length(names).to_numpy().astype(np.int64)))
        columns[4].append(None if names is None else pa.Codec("zstd", compression_level=1).compress(b"".join(names.to_pylist()), asbytes=True))
    arrays = [which.astype(np.int32), np.full(len(which), first, np.int64), *columns]
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(arrays, DEALT, strict=True)], schema=DEALT)


def keys_of(row: dict) -> np.ndarray:
    return np.cumsum(unpacked(row["keys"], row["n"]))


def names_of(row: dict) -> pa.Array:
    sizes = unpacked(row["sizes"], row["n"])
    data = pa.Codec("zstd").decompress(row["rare"], int(sizes.sum()))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), data])


def rare_marks(names: pa.Array) -> np.ndarray:
    """Joined marks of names (see Rare.names); 0 for an empty one."""
    out = np.zeros(len(names), _U)
    there = np.flatnonzero(pc.binary_length(names).to_numpy() > 0)
    if len(there):
        parted = [r.split(b"\n") for r in names.take(pa.array(there)).to_pylist()]
        out[there] = joined_marks(marks([a for a, _ in parted]), marks([b for _, b in parted]))
    return out


def bitmap(pairs: DataFrame, place: int) -> np.ndarray:
    """2**place bits in bytes, set for the pairs (key, rare). Words of bits are joined in each task and then over tasks; 2**place / 64 rows at most reach the
    driver."""

    def run(batches):
        for batch in batches:
            at = np.unique(places(batch.column(0).to_numpy(), rare_marks(batch.column(1)), place))
            word, start = np.unique(at >> _U(6), return_index=True)
            bits = np.bitwise_or.reduceat(_U(1) << (at & _U(63)), start) if len(at) else np.empty(0, _U)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    found = pairs.select("key", "rare").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(max(1, (1 << place) // 64), np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def may_hold(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def pair_counts(texts: DataFrame, index, end: int, buckets: int, cut: int) -> DataFrame:
    """key and rare (see pair_keys and Rare.names; rare is empty where both words are indexed), c, of pairs counted cut times or more; and rows without a key:
    kinds, of how many pairs c is the count, in part. index: broadcast."""

    def run(batches):
        known = index.value
        wide = len(known.words)
        waiting, rares, n = [], [], 0

        def out():
            if any(map(len, waiting)):
                keys = np.concatenate(waiting)
                waiting.clear()
                keys.sort()
                starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                yield dealt(buckets, keys[starts], np.diff(starts, append=len(keys)))
                del keys, starts
            if rares:
                keys, names, c, joined = ([x[i] for x in rares] for i in range(4))
                rares.clear()
                yield dealt(buckets, np.concatenate(keys), np.concatenate(c), 0, pa.concat_arrays(names), np.concatenate(joined))

        for part in _parts(batches):
            seq, names, _ = sequence(part.column(0))
            hashed = marks(names.to_pylist())
            x = known.ids(names, hashed, end)[seq]
            keys = pair_keys(x, wide)
            waiting.append(keys[(x[:-1] >= 0) & (x[1:] >= 0)])
            rare = Rare(seq, x, names, hashed)
            if len(rare.at):
                rares.append((keys[rare.first], rare.names(np.arange(len(rare.first))), rare.c.astype(np.int64), rare.marks()))
            n += len(keys)
            if n > 8 * FLUSH:
                yield from out()
                n = 0
        if n:
            yield from out()
        pa.default_memory_pool().release_unused()

    def add(batches):
        near, far = [], []
        for batch in batches:
            for row in batch.to_pylist():
                keys, c = keys_of(row), unpacked(row["held"], row["n"])
                if row["rare"] is None:
                    near.append((keys, c))
                else:
                    far.append(pa.table({"key": keys, "rare": names_of(row), "c": c}))
        found = []
        if near:
            keys, c = (np.concatenate([x[i] for x in near]) for i in range(2))
            near.clear()
            order = np.argsort(keys)
            keys, c = keys[order], c[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            found.append((keys[starts], None, np.add.reduceat(c, starts)))
        if far:
            whole = pa.concat_tables(far)
            far.clear()
            whole = whole.group_by(["key", "rare"], use_threads=False).aggregate([("c", "sum")]).combine_chunks()
            found.append((whole["key"].to_numpy(), whole["rare"].combine_chunks(), whole["c_sum"].to_numpy()))
        for keys, names, c in found:
            count, kinds = np.unique(c, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(count), pa.int64()), pa.nulls(len(count), pa.binary()), pa.array(count), pa.array(kinds.astype(np.int64))], ["key", "rare", "c", "kinds"])
            kept = np.flatnonzero(c >= cut)
            for a in range(0, len(kept), GIVEN):
                at = kept[a : a + GIVEN]
                of = pa.array([b""] * len(at), pa.binary()) if names is None else names.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), of, pa.array(c[at]), pa.nulls(len(at), pa.int64())], ["key", "rare", "c", "kinds"])

    return texts.select("text").mapInArrow(run, DEALT_DDL).repartitionById(buckets, F.col("bucket")).mapInArrow(add, "key long, rare binary, c long, kinds long")


class Model:
    """Arrays for a worker: words in order of falling count, their log probabilities, alphas, and the broadcast pairs by key (history * wide + word)."""

    def __init__(self, words: pa.Array, counts: np.ndarray, n: int, kinds: int, slope: float, unknown: float):
        self.index, self.counts, self.wide, self.end = Index(words), counts, len(words), pc.index(words, pa.scalar(END, pa.binary())).as_py()
        self.buckets = max(1, -(-n // BUCKET))
        self.base = np.log10((counts + 0.1) / (n + 0.1 * (kinds + 1)))
        self.p = kept_share(counts, slope) * counts / n if n else np.zeros(0)
        self.uni = np.log10(self.p)
        self.n, self.kinds, self.slope, self.slope2, self.unknown = n, kinds, slope, -2.0, unknown
        self.alpha = np.zeros(len(words))
        self.keys, self.pair = np.empty(0, np.int64), np.empty(0)
        self.place = PLACE
        self.bits = np.zeros((1 << PLACE) // 8, np.uint8)

    @cached_property
    def words(self) -> list[bytes]:
        return self.index.words.to_pylist()

    def texts(self, texts: pa.Array) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
        """Of each text: tokens, indexed ones, sums of base and model over what is indexed, the other words, whose unigrams and alphas are still to be added,
        and the pairs of other words that are not broadcast. Then those of indexed words: the texts they stand in, and their keys."""
        seq, names, sizes = sequence(texts)
        hashed = marks(names.to_pylist())
        x = self.index.ids(names, hashed, self.end)[seq]
        h, w = x[:-1], x[1:]
        known, some = w >= 0, self.wide > 0
        owner, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        base, score = np.zeros(len(w)), np.zeros(len(w))
        pairs, near = np.empty(0, np.int64), np.empty(0, np.int64)
        if some:
            at = np.maximum(w, 0)
            base = np.where(known, self.base[at], 0.0)
            score = np.where(known, self.uni[at], 0.0) + np.where(h >= 0, self.alpha[np.maximum(h, 0)], 0.0)
            both = np.flatnonzero(known & (h >= 0))
            k, of = np.unique(h[both] * self.wide + w[both], return_inverse=True)
            hit = np.zeros(len(k), bool)
            if len(self.keys) and len(k):
                at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
                hit = self.keys[at] == k
                found = hit[of]
                score[both[found]] = self.pair[at[of[found]]]
            wide_keys = (k // self.wide + 1) * (self.wide + 1) + k % self.wide + 1
            hold = ~hit
            hold[hold] = may_hold(self.bits, places(wide_keys[hold], None, self.place))
            near = both[hold[of]]
            pairs = wide_keys[of[hold[of]]]
        rare = Rare(seq, x, names, hashed)
        far, far_names, far_keys = np.empty(0, np.int64), pa.array([], pa.binary()), np.empty(0, np.int64)
        if some and len(rare.at):
            hold = may_hold(self.bits, places(pair_keys(x, self.wide)[rare.first], rare.marks(), self.place))
            chosen = hold[rare.of]
            far = rare.at[chosen]
            far_names = rare.names(rare.of[chosen])
            far_keys = pair_keys(x, self.wide)[far]
        other, tf = np.unique(owner[~known] * len(names) + seq[1:][~known], return_counts=True)
        starts_of = lambda at: pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(sizes)))]).astype(np.int32))
        lists = [
            pa.ListArray.from_arrays(starts_of(other // len(names)), pa.StructArray.from_arrays([names.take(pa.array(other % len(names))), pa.array(tf.astype(np.int64))], ["word", "tf"])),
            pa.ListArray.from_arrays(starts_of(owner[far]), pa.StructArray.from_arrays([pa.array(far_keys), far_names], ["key", "rare"])),
        ]
        return [pa.array(sizes), *(pa.array(np.add.reduceat(v, starts)) for v in (known.astype(np.int64), base, score)), *lists], owner[near], pairs


def _found(df: DataFrame, word: str, table: DataFrame, value: str) -> DataFrame:
    """df with a value of the table for its words; null where df has no word or the table lacks it. Rows without a word are kept out of the join."""
    have = df.where(F.col(word).isNotNull()).join(table.select(F.col("word").alias(word), value), word, "left").select(*df.columns, value)
    return have.unionByName(df.where(F.col(word).isNull()).withColumn(value, F.lit(None).cast(table.schema[value].dataType)))


def annotated(bigrams: DataFrame, model: Model, unigrams: DataFrame) -> DataFrame:
    """key, rare, c, h (id, or -1), hs (a history outside the index), q (share kept), p (unigram probability of the word)."""
    sent = bigrams.sparkSession.sparkContext.broadcast((model.counts, model.p))

    def run(batches):
        counts, p = sent.value
        wide = len(counts) + 1
        for batch in batches:
            key = batch.column(0).to_numpy()
            h, w = key // wide - 1, key % wide - 1
            hs = ws = pa.nulls(batch.num_rows, pa.binary())
            if pc.max(pc.binary_length(batch.column(1))).as_py():
                names = [r.split(b"\n") if r else (None, None) for r in batch.column(1).to_pylist()]
                hs = pa.array([a or None for a, _ in names], pa.binary())
                ws = pa.array([b or None for _, b in names], pa.binary())
            hc = pa.array(counts[np.maximum(h, 0)], pa.float64(), mask=h < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h), hs, ws, hc, pa.array(p[np.maximum(w, 0)], pa.float64(), mask=w < 0)], ["key", "rare", "c", "h", "hs", "ws", "hc", "p"])

    rows = lambda some: bigrams.where(some).select("key", "rare", "c").mapInArrow(run, "key long, rare binary, c long, h long, hs binary, ws binary, hc double, p double")
    near = rows(F.length("rare") == 0).withColumns({x: F.lit(None).cast("long") for x in ("h_count", "w_count")})
    # A row without such a word gets one that no table has, its own for each key, so that these rows spread.
    stand_in = F.concat(F.lit("\n").cast("binary"), F.col("key").cast("string").cast("binary"))
    far = rows(F.length("rare") > 0).withColumns({"hs_key": F.coalesce("hs", stand_in), "ws_key": F.coalesce("ws", stand_in)})
    for x in "hw":
        far = far.join(unigrams.select(F.col("word").alias(f"{x}s_key"), F.col("c").alias(f"{x}_count")), f"{x}s_key", "left")
    rows = near.unionByName(far.select(near.columns))
    share = lambda c, slope: F.pow(1 + 1 / c, F.lit(slope + 1)) * c
    hc, p = F.coalesce("hc", F.col("h_count").cast("double")), F.coalesce("p", share(F.col("w_count").cast("double"), model.slope) / F.lit(float(model.n)))
    return rows.select("key", "rare", "c", "h", "hs", (share(F.col("c").cast("double"), model.slope2) / hc).alias("q"), p.alias("p"))


def gathered(docs: DataFrame, cut: int = CUT) -> tuple[Model, DataFrame, DataFrame | None, DataFrame | None]:
    """The model; the table of all unigram counts; log alphas of histories outside the index (word, la); the kept pairs (key, rare, q, p, h, hs) that are not
    broadcast. The last two are None without training rows."""
    spark = docs.sparkSession
    train = docs.where(crc_mod(F.col("doc_id"), 10) != 0)
    unigrams = materialise(word_counts(train), "katz-unigrams")
    n, kinds = unigrams.agg(F.sum("c"), F.count(F.lit(1))).first()
    n = n or 0
    by_count = [(r[0], r[1]) for r in unigrams.groupBy("c").count().collect()] if n else []  # distinct counts: below sqrt(2 N)
    slope = line({c: k for c, k in by_count if c <= FITTED})
    unknown = 1 - sum(float(kept_share(c, slope)) * c * k for c, k in by_count) / n if n else 1.0
    cut1 = least(by_count, MOST_WORDS, 2)
    top = unigrams.where((F.col("c") >= cut1) | (F.length("word") == 0)).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words, counts = pa.concat_arrays([pa.array([], pa.binary()), *top["word"].chunks]), top["c"].to_numpy().astype(np.float64)
    del top
    model = Model(words, counts, n, kinds, slope, unknown)
    if not len(words):
        return model, unigrams, None, None
    counted = materialise(pair_counts(train, spark.sparkContext.broadcast(model.index), model.end, model.buckets, cut), "katz-bigrams")
    drop_shuffles(spark)
    of_pairs = [(r[0], r[1]) for r in counted.where("key is null").groupBy("c").agg(F.sum("kinds")).collect()]  # distinct counts: below sqrt(2 N)
    cut2 = least([x for x in of_pairs if x[0] >= cut], MOST_PAIRS, cut)
    model.slope2 = line({c: k for c, k in of_pairs if c <= FITTED})
    pairs = materialise(annotated(counted.where("key is not null"), model, unigrams), "katz-pairs")
    release(counted)
    alpha = (1 - F.sum("q")) / (1 - F.sum("p"))
    by_id = pairs.where("h >= 0").groupBy("h").agg(F.log10(alpha).alias("la")).toArrow()  # as many rows as indexed words at most
    model.alpha[by_id["h"].to_numpy()] = by_id["la"].to_numpy()
    by_word = pairs.where("h < 0").groupBy(F.col("hs").alias("word")).agg(F.log10(alpha).alias("la"))
    near = (F.length("rare") == 0) & (F.col("c") >= cut2)
    kept = pairs.where(near).select("key", "q").toArrow()
    keys = kept["key"].to_numpy()
    keys = (keys // (model.wide + 1) - 1) * model.wide + keys % (model.wide + 1) - 1
    order = np.argsort(keys)
    model.keys, model.pair = keys[order], np.log10(kept["q"].to_numpy()[order])
    model.bits = bitmap(pairs.where(~near), model.place)
    alphas, others = materialise(by_word, "katz-alphas"), materialise(pairs.where(~near), "katz-others")
    release(pairs)
    return model, unigrams, alphas, others


def fit(docs: DataFrame, cut: int = CUT) -> tuple[Model, DataFrame]:
    """The model, and the table of all unigram counts."""
    return gathered(docs, cut)[:2]


def gains(pairs: DataFrame, alphas: DataFrame, model: Model) -> DataFrame:
    """key, rare, gain: log q - log p - log alpha(h) of pairs that are not broadcast."""
    sent = pairs.sparkSession.sparkContext.broadcast(model.alpha)

    def run(batches):
        alpha = sent.value
        for batch in batches:
            h = batch.column(2).to_numpy()
            la = np.where(h >= 0, alpha[np.maximum(h, 0)], batch.column(4).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(batch.column(3).to_numpy() - la, pa.float64())], ["key", "rare", "gain"])

    rows = _found(pairs.select("key", "rare", "h", "hs", (F.log10("q") - F.log10("p")).alias("lq")), "hs", alphas, "la")
    return rows.select("key", "rare", "h", "lq", F.coalesce("la", F.lit(0.0)).alias("la")).mapInArrow(run, "key long, rare binary, gain double")


def looked_up(rows: DataFrame, pairs: DataFrame, model: Model) -> DataFrame:
    """row, s: sums of gains of each text's pairs of indexed words that are not broadcast. rows: as dealt(), held by row less the first."""
    buckets, sent = model.buckets, pairs.sparkSession.sparkContext.broadcast(model.alpha)

    def entries(batches):  # gains; without gains(), as two Python steps in a row take twice the workers
        alpha, waiting, n = sent.value, [], 0

        def out():
            return dealt(buckets, *(np.concatenate([x[i] for x in waiting]) for i in range(2)), -1)

        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), (batch.column(2).to_numpy() - alpha[batch.column(1).to_numpy()]).view(np.int64)))
            n += batch.num_rows
            if n > 4 * FLUSH:
                yield out()
                waiting, n = [], 0
        if n:
            yield out()

    def find(batches):
        entries, asked = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["first"] < 0:
                    entries.append((keys_of(row), unpacked(row["held"], row["n"], np.float64)))
                else:
                    asked.append(row)
        if not entries:
            return
        keys, gain = (np.concatenate([x[i] for x in entries]) for i in range(2))
        order = np.argsort(keys)
        keys, gain = keys[order], gain[order]
        for row in asked:
            k = keys_of(row)
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == k)
            if len(hit):
                text, of = np.unique(unpacked(row["held"], row["n"])[hit], return_inverse=True)
                sums = np.bincount(of, gain[at[hit]])
                yield pa.RecordBatch.from_pylist([{"first": row["first"], "n": len(text), "keys": packed(np.diff(text, prepend=0)), "held": packed(sums)}], pa.schema([DEALT.field(x) for x in ("first", "n", "keys", "held")]))

    def add(batches):
        texts: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                texts.setdefault(row["first"], []).append((keys_of(row), unpacked(row["held"], row["n"], np.float64)))
        for first, parts in texts.items():
            text, of = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(first + text), pa.array(np.bincount(of, np.concatenate([x for _, x in parts])))], ["row", "s"])

    near = pairs.where(F.length("rare") == 0).select("key", "h", (F.log10("q") - F.log10("p")).alias("lq"))
    both = rows.unionByName(near.mapInArrow(entries, DEALT_DDL).drop("sizes", "rare"))
    return both.repartitionById(buckets, F.col("bucket")).mapInArrow(find, "first long, n long, keys binary, held binary").repartition("first").mapInArrow(add, "row long, s double")


def scored(docs: DataFrame, cut: int = CUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model, unigrams, alphas, pairs = gathered(docs, cut)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    of_texts = {"doc_id": "long", "held_out": "boolean", "n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double", "other": "array<struct<word:binary,tf:long>>", "rare": "array<struct<key:long,rare:binary>>", "row": "long"}
    of_pairs = {"bucket": "int", "first": "long", "n": "long", "keys": "binary", "held": "binary"}
    ddl = ", ".join(f"{k} {v}" for k, v in (of_texts | of_pairs).items())
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches):
        m = sent.value
        row = first = TaskContext.get().partitionId() << 33  # as monotonically_increasing_id()
        waiting, n = [], 0

        def out():
            found = dealt(m.buckets, *(np.concatenate([x[i] for x in waiting]) for i in range(2)), first)
            return pa.RecordBatch.from_arrays([found.column(x.name) if x.name in of_pairs else pa.nulls(found.num_rows, x.type) for x in schema], schema=schema)

        for part in _parts(batches):
            columns, text, keys = m.texts(part.column(2))
            waiting.append((keys, text + (row - first)))
            n += len(keys)
            made = dict(zip(of_texts, [part.column(0), part.column(1), *columns, pa.array(np.arange(row, row + part.num_rows))], strict=True))
            yield pa.RecordBatch.from_arrays([made[x.name].cast(x.type) if x.name in made else pa.nulls(part.num_rows, x.type) for x in schema], schema=schema)
            row += part.num_rows
            if n > 4 * FLUSH:
                yield out()
                waiting, n, first = [], 0, row
        if n:
            yield out()
        pa.default_memory_pool().release_unused()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), "text")
    whole = materialise(slim.mapInArrow(run, ddl), "katz-rows")
    rows = whole.where("row is not null").select(*of_texts)
    drop_shuffles(spark)
    words = rows.select("row", F.explode("other").alias("o")).select("row", "o.word", "o.tf").join(unigrams.join(alphas, "word", "left") if alphas is not None else unigrams.withColumn("la", F.lit(None).cast("double")), "word", "left")
    c = F.coalesce("c", F.lit(0)).cast("double")
    share = F.pow(1 + 1 / c, F.lit(model.slope + 1)) * c / F.lit(float(model.n or 1))
    base = F.log10((c + 0.1) / F.lit(model.n + 0.1 * (model.kinds + 1)))
    uni = F.when(c > 0, F.log10(F.when(c > 0, share))).otherwise(math.log10(model.unknown))
    sums = words.select("row", F.when(c > 0, F.col("tf")).otherwise(0).alias("k"), (F.col("tf") * base).alias("b"), (F.col("tf") * (uni + F.coalesce("la", F.lit(0.0)))).alias("s"))
    if pairs is not None:
        near = materialise(looked_up(whole.where("row is null").select(*of_pairs), pairs, model), "katz-near")
        gain = materialise(gains(pairs.where(F.length("rare") > 0), alphas, model), "katz-gains")
        release(pairs)
        far = rows.select("row", F.explode("rare").alias("o")).select("row", "o.key", "o.rare").join(gain, ["key", "rare"]).select("row", F.col("gain").alias("s"))
        for x in (near, far):
            sums = sums.unionByName(x.select("row", F.lit(0).alias("k"), F.lit(0.0).alias("b"), "s"))
    sums = sums.groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    out = rows.drop("other", "rare").join(sums, "row", "left")
    more = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", more("n_known", "k").cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), more("base_score", "b").alias("base_score"), more("score", "s").alias("score"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return scored(documents(spark, sf_dir))
