"""Benchmark decontamination by winnowing.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Of every text the smallest hash of each run of
WINDOW consecutive k-grams (k = GRAM) is a fingerprint, so every shared span of GRAM + WINDOW - 1 = 10 words shares
one. Training and test fingerprints are joined and each hit is extended to both sides while the words agree; spans of
at least 10 words count. Items of fewer words are one window, looked up by the hash of the whole item.

Plan: the benchmark is dealt into blocks whose size is checked (BLOCK_WORDS words), each block's fingerprint index is
broadcast, and each block is one pass over the documents without a shuffle; with one block, as usual, nothing is
joined at all. For more blocks the documents are written once with a number for each row, hit ranges of all blocks are
merged by it, and the columns to keep are joined by it.

Cases: null texts have no words; items with a null item_id are ignored; every row is judged for itself, also those with
a null or repeated doc_id; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_TABLE, gram_hashes, materialize, release, slices, texts_as_bytes, word_hashes

GRAM, WINDOW = 6, 5
SPAN = GRAM + WINDOW - 1
BLOCK_WORDS = 4_000_000
ROW = "_decontam_row"


def words_of(text: bytes | None) -> np.ndarray:
    return word_hashes((text or b"").translate(ALNUM_TABLE).split())


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of all k-grams that are the smallest of some window of consecutive ones."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = grams[:n].copy()
    for i in range(1, window):
        np.minimum(low, grams[i : i + n], out=low)
    chosen = np.zeros(len(grams), bool)
    for i in range(window):
        chosen[i : i + n] |= grams[i : i + n] == low
    return np.flatnonzero(chosen)


class Index:
    """Fingerprints of a block of test items."""

    def __init__(self, items: list[tuple[object, bytes | None]]):
        self.items, self.words = [], []
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            words = words_of(text)
            if not len(words) or item is None:
                continue
            k = len(self.items)
            self.items.append(item)
            self.words.append(words)
            if len(words) < SPAN:
                self.short[len(words)][int(gram_hashes(words, len(words))[0])].append(k)
            else:
                grams = gram_hashes(words, GRAM)
                for p in winnow(grams).tolist():
                    self.places[int(grams[p])].append((k, p))
        self.places = dict(self.places)
        self.short = {n: dict(x) for n, x in self.short.items()}
        self.keys = np.array(sorted(self.places), np.uint64)
        self.short_keys = {n: np.array(sorted(x), np.uint64) for n, x in self.short.items()}

    @staticmethod
    def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(keys) or not len(values):
            return np.zeros(len(values), bool)
        return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values

    def hits(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Hit word ranges (start, end) of a document, and the items that have a window in it."""
        ranges: set[tuple[int, int]] = set()
        found: set = set()
        if len(words) >= SPAN and len(self.keys):
            grams = gram_hashes(words, GRAM)
            at = winnow(grams)
            at = at[self._among(grams[at], self.keys)]
            done: dict[tuple[int, int], int] = {}  # item and diagonal: the end of what has been extended
            for p in at.tolist():
                for k, q in self.places[int(grams[p])]:
                    if done.get((k, p - q), -1) >= p + GRAM:
                        continue
                    other = self.words[k]
                    back, ahead = min(p, q), min(len(words) - p, len(other) - q)
                    left = np.flatnonzero(words[p - back : p] != other[q - back : q])
                    right = np.flatnonzero(words[p : p + ahead] != other[q : q + ahead])
                    lo = p - back + (int(left[-1]) + 1 if len(left) else 0)
                    hi = p + (int(right[0]) if len(right) else ahead)
                    done[k, p - q] = hi
                    if hi - lo >= SPAN:
                        ranges.add((lo, hi))
                        found.add(self.items[k])
        for n, table in self.short.items():
            grams = gram_hashes(words, n)
            for p in np.flatnonzero(self._among(grams, self.short_keys[n])).tolist():
                ranges.add((p, p + n))
                found.update(self.items[k] for k in table[int(grams[p])])
        return sorted(ranges), found


def _covered(ranges: list[tuple[int, int]]) -> int:
    total = end = 0
    for lo, hi in sorted(ranges):
        total += max(0, hi - max(lo, end))
        end = max(end, hi)
    return total


def _row(n_words: int, ranges, items) -> tuple:
    names = sorted(str(i) for i in items)
    hit = _covered(ranges)
    return n_words, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0


_COLUMNS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
]


def _judge(index, names: list[str]):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches):
        release()
        own = index.value
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for text in texts_as_bytes(batch.column("text")):
                    words = words_of(text)
                    rows.append(_row(len(words), *own.hits(words)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))],
                    [*names, *(f.name for f in _COLUMNS)],
                )

    return run


def _collect_hits(index):
    def run(batches):
        release()
        own = index.value
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for row, text in zip(batch.column(ROW).to_pylist(), texts_as_bytes(batch.column("text")), strict=True):
                    words = words_of(text)
                    ranges, items = own.hits(words)
                    rows.append((row, len(words), [list(r) for r in ranges], sorted(str(i) for i in items)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())))],
                    [ROW, "n_words", "ranges", "items"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] = ["doc_id"], block_words: int = BLOCK_WORDS) -> DataFrame:  # noqa: B006
    """The columns `keep` of docs with n_words, n_hit, n_items, items_sha256 and contaminated."""
    spark = docs.sparkSession
    docs = docs.withColumn("text", F.col("text").cast("string"))
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("item_id is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // (2 * block_words)))  # a word and its separator take two characters at least
    if blocks == 1:
        index = spark.sparkContext.broadcast(Index([(r.item_id, (r.text or "").encode()) for r in items.collect()]))
        columns = list(dict.fromkeys([*keep, "text"]))
        schema = T.StructType([*(docs.schema[c] for c in keep), *_COLUMNS])
        return docs.select(*columns).mapInArrow(_judge(index, keep), schema)
    docs = materialize(docs.select(*dict.fromkeys([*keep, "text"])).withColumn(ROW, F.monotonically_increasing_id()), "decontam-rows")
    parts = None
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(Index([(r.item_id, (r.text or "").encode()) for r in mine.collect()]))
        part = docs.select(ROW, "text").mapInArrow(
            _collect_hits(index), f"{ROW} long, n_words long, ranges array<array<long>>, items array<string>"
        )
        parts = part if parts is None else parts.union(part)
    schema = T.StructType([T.StructField(ROW, T.LongType()), *_COLUMNS])

    def merge(batches):
        for batch in batches:
            rows = []
            for n, many, items in zip(*(batch.column(c).to_pylist() for c in ("n_words", "ranges", "items")), strict=True):
                rows.append(_row(n, [tuple(r) for x in many for r in x], {i for x in items for i in x}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())))],
                schema.names,
            )

    grouped = parts.groupBy(ROW).agg(F.max("n_words").alias("n_words"), F.collect_list("ranges").alias("ranges"), F.collect_list("items").alias("items"))
    judged = grouped.mapInArrow(merge, schema)
    return docs.select(ROW, *keep).join(judged, ROW).drop(ROW)
