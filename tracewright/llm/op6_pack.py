"""Packing along a space-filling curve.

A document's token counts are hashed to a vector of few dimensions by random signs, each dimension is mapped to an even grid through the normal
distribution, and the cell's number on the Hilbert curve is the document's key. Documents in key order form one stream of ids, cut every 4,096: so like
documents share sequences, and only the last sequence is padded.

The order is (key, doc_id, count, ids). A cell is the leading bits of the key, and is dealt into parts at keys between which PART_ROWS documents or few more
stand, so that no task holds a whole cell; a key that many documents share is a part of its own, and only that is dealt on by hash. Offsets are sums over
parts and cells. Ids are tokenised once and travel as 16 bits.

pack_mixed keeps the order in which the rows stand in their files as well: windows of WINDOW rows follow one another, and the curve orders documents within
each. So the sequences carry the sources of a mix in its proportions, and documents of a window still stand beside those like them.

Null text: as an empty one, the end id alone. Null doc_id: sorts first among equal keys. Repeated rows: each packed. Very long texts: whole, over as many
sequences as they need. Ties: rows equal in key, doc_id, count and ids are alike. Extra columns, whatever their names: not read. Empty table: no rows.
"""

from __future__ import annotations

import functools
import math
import os
import re
import zlib

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_columns, materialise, small_batches, with_columns

LENGTH = 4096
END = 2
DIMS, BITS = 4, 8
#: Leading bits of the key that make a cell: 2**12 cells at most reach the driver.
CELL_BITS = 12
#: Documents of a part of a cell.
PART_ROWS = 1024
#: Rows of a window of pack_mixed.
WINDOW = 1024
#: Distinct chunks whose ids a worker remembers, in each of two generations.
CACHE = 200_000
#: Chunks that the tokenizer gets at once.
BATCH = 256

_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: Texts of these characters alone (ASCII without the apostrophe, and Latin letters) fall into runs of letters and of others, whatever stands beside them.
_SIMPLE = re.compile("[\x00-\x26\x28-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_RUNS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[^a-z\u00df-\u00f6\u00f8-\u00ff \t\n\r\x0b\x0c]+")
_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Texts on which a tokenizer must give the same by chunks.
_PROBES = ["The quick  brown\tfox's don't", "A-b c_d, e.f! 12 345 6e7", " Émile\u00a0\u3000naïve ſ ﬁ ½", "x\n\ny  ", "日本語 text 漢字", "a\u0301b \U0001f600 ok", "UPPER lower MiXeD", "end.</w> <|x|>"]


def chunks(text: str) -> list[str]:
    """Parts that the tokenizer treats on their own: lower-cased runs where the text is simple, else what stands between blanks."""
    simple = _SIMPLE.fullmatch(text) and "<|" not in text  # where the tokenizer's special tokens begin
    return _RUNS.findall(text.lower()) if simple else [x for x in _SPACE.split(text) if x]


def tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Memory(dict):
    """Ids of chunks. A chunk not yet met gets an empty buffer and waits in `new` until it is filled; the generation before is asked first."""

    def __init__(self, older: dict):
        self.older, self.new = older, []

    def __missing__(self, chunk: str):
        found = self.older.get(chunk)
        if found is None:
            found = bytearray()
            self.new.append(chunk)
        self[chunk] = found
        return found


class Encoder:
    """Ids of whole texts. The tokenizer drops white space and nothing in it reaches across, so each chunk is encoded on its own and remembered. New
    chunks that are words of Latin letters are encoded many in one text, and parted where a token ends a word."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(path))
        self.known = _Memory({})
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if self.size > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.parted = True
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        whole = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u2").tobytes() for x in _PROBES]
        self.parted = [x[:-2] for x in self.ids(_PROBES)] == whole

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for at in range(0, len(texts), BATCH) for e in self.tokenizer.encode_batch_fast(texts[at : at + BATCH], add_special_tokens=False)]

    def _fill(self, new: list[str]) -> None:
        words, others = [], []
        for x in new:
            (words if _WORD.fullmatch(x) else others).append(x)
        groups = [words[at : at + BATCH] for at in range(0, len(words), BATCH)]
        for group, ids in zip(groups, self._encoded([" ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(group):  # a tokenizer that marks no ends of words
                others += group
                continue
            data, at = ids.tobytes(), 0
            for x, end in zip(group, (2 * ends).tolist(), strict=True):
                self.known[x] += data[at:end]
                at = end
        for x, ids in zip(others, self._encoded(others), strict=True):
            self.known[x] += ids.tobytes()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 16-bit ids of each text, with the end id. A tokenizer that doesn't treat chunks on their own gets whole texts."""
        end = np.array([END], "<u2").tobytes()
        if not self.parted:
            return [x.tobytes() + end for x in self._encoded([t or "" for t in texts])]
        if len(self.known) > CACHE:
            self.known.older = {}
            self.known = _Memory(self.known)
        known = self.known
        found = [list(map(known.__getitem__, chunks(t or ""))) for t in texts]
        self._fill(known.new)
        out = [b"".join(f) + end for f in found]
        for x in known.new:
            known[x] = bytes(known[x])
        known.new = []
        return out


@functools.lru_cache(maxsize=2)
def encoder_of(path: str | None) -> Encoder:
    """One for each worker, so that later tasks find its chunks."""
    return Encoder(path)


def signs(size: int, dims: int = DIMS) -> np.ndarray:
    """A sign for each id and dimension, from a fixed integer mix."""
    x = np.arange(size, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(dims, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return ((x & np.uint64(1)).astype(np.float64) * 2 - 1).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Number on the Hilbert curve of each row of points (integers below 2**bits): the axes are transformed bit by bit, from the highest, by
    exchanges and inversions, then Gray-coded and interleaved."""
    x = points.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> np.uint64(b)) & one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(ids: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents: signed sums of id counts (dampened by a square root), scaled to unit length, through the normal distribution."""
    out = np.empty((len(ids), table.shape[1]))
    for i, x in enumerate(ids):
        kinds, counts = np.unique(x, return_counts=True)
        w = np.sqrt(counts)
        out[i] = (table[kinds] * w[:, None]).sum(0) / math.sqrt(float((w * w).sum()))
    even = np.vectorize(math.erf, otypes=[float])(out / math.sqrt(2)) / 2 + 0.5
    return hilbert(np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenised(docs: DataFrame, path: str | None = None, more: list[str] | None = None) -> DataFrame:
    """more columns of docs, doc_id, key, n, ids."""

    def make():
        encoder = encoder_of(path)
        table = signs(encoder.size)

        def step(c):
            ids = encoder.ids(c["text"])
            arrays = [np.frombuffer(x, "<u2") for x in ids]
            return {"key": curve_keys(arrays, table), "n": [len(x) for x in arrays], "ids": ids}

        return step

    slim = docs.select(*(more or []), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_columns(slim, ["text"], "key long, n long, ids binary", make).drop("text")


def pieces_of(start: int, n: int, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(first id, ids, sequence, offset there) of a document whose ids begin at a place in the stream."""
    out, at = [], 0
    while at < n:
        sequence, offset = divmod(start + at, length)
        take = min(n - at, length - offset)
        out.append((at, take, sequence, offset))
        at += take
    return out


def placed(rows: DataFrame, starts_of: dict[int, int]) -> DataFrame:
    """doc_id, n, ids and at, the document's place in the stream. rows: doc_id, key, n, ids, and cell, part, salt, in whose order parts follow one another.
    starts_of: where each cell begins."""
    spark = rows.sparkSession
    cells = spark.createDataFrame(list(starts_of.items()), "cell long, cell_start long")
    sums = rows.groupBy("cell", "part", "salt").agg(F.sum("n").alias("tokens"))
    before = Window.partitionBy("cell").orderBy("part", "salt").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = sums.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).join(F.broadcast(cells), "cell")
    starts = starts.select("cell", "part", "salt", (F.col("cell_start") + F.col("before")).alias("part_start"))
    within = Window.partitionBy("cell", "part", "salt").orderBy("key", "doc_id", "n", "ids").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.select("doc_id", "n", "ids", "cell", "part", "salt", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inner"))
    return inner.join(starts, ["cell", "part", "salt"]).select("doc_id", "n", "ids", (F.col("part_start") + F.col("inner")).alias("at"))


def pieces(rows: DataFrame, length: int) -> DataFrame:
    """A row for each piece of placed documents."""

    def make():
        def step(c):
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for doc, n, ids, first in zip(c["doc_id"], c["n"], c["ids"], c["at"], strict=True):
                wide = memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                for a, k, sequence, offset in pieces_of(first, n, length):
                    for name, x in zip(out, (doc, a, k, zlib.crc32(wide[4 * a : 4 * (a + k)]), n, sequence, offset), strict=True):
                        out[name].append(x)
            return out

        return step

    return map_columns(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", make)


def running(sums: list[tuple[int, int]]) -> dict[int, int]:
    """Where each cell begins, from the tokens of each."""
    out, at = {}, 0
    for cell, tokens in sorted(sums):
        out[cell] = at
        at += tokens
    return out


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cell = F.shiftright("key", DIMS * BITS - CELL_BITS)
    rows = materialise(tokenised(docs, path), "pack-ids").withColumn("cell", cell)
    keys = rows.groupBy("cell", "key").agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("cell").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))  # 2**20 keys of a cell at most
    hot = F.col("rows") >= PART_ROWS
    keys = keys.withColumn("part", (2 * F.floor(F.coalesce(upto, F.lit(0)) / PART_ROWS) + hot.cast("int")).cast("long"))
    parts = keys.groupBy("cell", "part").agg(F.min("key").alias("low"), F.sum("rows").alias("rows"))
    salts = F.when(F.col("part") % 2 == 1, F.floor(F.col("rows") / PART_ROWS)).otherwise(0) + 1  # an odd part is one key
    parts = parts.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("low", "part", salts.alias("salts")))).alias("parts"))
    dealt = rows.join(materialise(parts, "pack-parts"), "cell").withColumn("p", F.element_at(F.filter("parts", lambda x: x["low"] <= F.col("key")), -1))
    dealt = dealt.select("doc_id", "key", "n", "ids", "cell", F.col("p.part").alias("part"), F.pmod(F.xxhash64("doc_id", "n"), F.col("p.salts")).alias("salt"))
    sums = [(r[0], r[1]) for r in rows.groupBy("cell").agg(F.sum("n")).collect()]  # 2**CELL_BITS rows at most
    return pieces(placed(dealt, running(sums)), length)


def pack_mixed(docs: DataFrame, length: int = LENGTH, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """As pack, for docs that are read from files (others are written first): windows of their rows follow one another in the order of file names and of
    rows in a file."""
    try:
        docs.select("_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        docs = materialise(docs, "pack-docs")
    named = docs.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialise(tokenised(named, path, ["file", "row"]), "pack-ids")
    found = sorted((r[0], r[1]) for r in rows.groupBy("file").agg(F.sum("n")).collect())  # a row for each file
    files = rows.sparkSession.createDataFrame([(f, i) for i, (f, _) in enumerate(found)], "file string, cell long")
    dealt = rows.join(F.broadcast(files), "file").withColumns({"part": F.floor(F.col("row") / window), "salt": F.lit(0).cast("long")})
    return pieces(placed(dealt.drop("file", "row"), running([(i, n) for i, (_, n) in enumerate(found)])), length)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(documents(spark, sf_dir))
