"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenised, an end id is added, and only documents longer than a sequence are cut: into full pieces, of
which the first may be shorter. Full pieces are sequences by themselves; the others (at most one a document) are dealt
by hash into blocks of about BLOCK documents. Each block is evolved on ISLANDS islands, a Spark group each: the genes
are bins (groups of pieces), crossover injects whole well-filled bins of one parent into another, removes the bins that
repeat a piece, and places the displaced pieces, first for shorter ones where that fills a bin better, then by best
fit; mutation dissolves the emptiest bins. A block ends early at the least possible number of bins; after each epoch every island hands its elite to the next
one (one shuffle of small integer arrays), and at the end the best grouping of the block counts.

Cases: null texts are empty (the end id alone); repeated doc_ids are packed each for itself; empty tables give empty
results; extra columns are ignored. Everything is seeded by block and island, so a retried task gives the same rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release, slices
from .tokens import CACHE_PIECES, encoder

BLOCK, ISLANDS, EPOCHS, POPULATION, PATIENCE = 16384, 2, 2, 6, 12
REPLACED = 200  # displaced pieces, the longest, that may take the place of shorter ones in a child


def cut(length: int, capacity: int) -> list[int]:
    """Piece lengths: one, or full ones of which the first may be shorter."""
    if length <= capacity:
        return [length]
    full = -(-length // capacity) - 1
    return [length - full * capacity] + [capacity] * full


class Packing:
    """Bins of pieces with their fills."""

    def __init__(self, bins: list[list[int]], fills: list[int]):
        self.bins, self.fills = bins, fills
        self.rank = (-len(bins), sum(f * f for f in fills))  # fewer bins first; among equals, fuller bins


def best_fit(lengths: list[int], order: list[int], capacity: int, bins: list[list[int]] = (), fills: list[int] = ()) -> Packing:
    """Put pieces, in order, where the least room stays; open bins are found by their room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r is set if a bin has room r
    bins, fills = [list(b) for b in bins], list(fills)
    for k, fill in enumerate(fills):
        if fill < capacity:
            by_room[capacity - fill].append(k)
            mask |= 1 << (capacity - fill)
    for i in order:
        n = lengths[i]
        above = mask >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
            bins[k].append(i)
            fills[k] += n
        else:
            room, k = capacity, len(bins)
            bins.append([i])
            fills.append(n)
        if room > n:
            by_room[room - n].append(k)
            mask |= 1 << (room - n)
    return Packing(bins, fills)


def _replace(lengths: list[int], lost: list[int], capacity: int, bins: list[list[int]], fills: list[int]) -> list[int]:
    """Dominance: a displaced piece takes the place of a shorter one where the bin gets fuller; what remains displaced."""
    for at, d in enumerate(lost[:REPLACED]):
        n, best = lengths[d], None
        for k, fill in enumerate(fills):
            room = capacity - fill
            if room:
                for x in bins[k]:
                    gain = n - lengths[x]
                    if 0 < gain <= room and (best is None or room - gain < best[0]):
                        best = (room - gain, k, x)
                if best and best[0] == 0:
                    break
        if best:
            _, k, x = best
            bins[k] = [d if y == x else y for y in bins[k]]
            fills[k] += n - lengths[x]
            lost[at] = x
    return lost


def _rebuilt(lengths: list[int], capacity: int, kept: list[tuple[list[int], int]], lost: list[int]) -> Packing:
    bins, fills = [list(b) for b, _ in kept], [f for _, f in kept]
    down = sorted(lost, key=lambda i: -lengths[i])
    return best_fit(lengths, sorted(_replace(lengths, down, capacity, bins, fills), key=lambda i: -lengths[i]), capacity, bins, fills)


def _cross(one: Packing, two: Packing, lengths: list[int], capacity: int, rng) -> Packing:
    """Well-filled bins of `two` go into `one`, whose bins that repeat a piece go; displaced pieces find new places."""
    good = sorted(range(len(two.bins)), key=lambda k: -two.fills[k])[: max(1, len(two.bins) // 2)]
    chosen = [good[k] for k in rng.permutation(len(good))[: max(1, len(good) // 2)].tolist()]
    taken = {i for k in chosen for i in two.bins[k]}
    kept, lost = [(two.bins[k], two.fills[k]) for k in chosen], []
    for b, f in zip(one.bins, one.fills, strict=True):
        if taken.isdisjoint(b):
            kept.append((b, f))
        else:
            lost += [i for i in b if i not in taken]
    return _rebuilt(lengths, capacity, kept, lost)


def _mutate(one: Packing, lengths: list[int], capacity: int, rng) -> Packing:
    """The emptiest bins and a few by chance are dissolved."""
    order = sorted(range(len(one.bins)), key=lambda k: one.fills[k])
    gone = set(order[:2]) | set(rng.integers(0, len(order), min(64, max(2, len(order) // 12))).tolist())
    lost = [i for k in gone for i in one.bins[k]]
    return _rebuilt(lengths, capacity, [(b, f) for k, (b, f) in enumerate(zip(one.bins, one.fills, strict=True)) if k not in gone], lost)


def evolve(lengths: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray], population: int = POPULATION, patience: int = PATIENCE) -> np.ndarray:
    """A bin number for each piece; elites are such assignments from other islands.

    Exactly filled bins of the best-fit-decreasing seed stay as they are; the other pieces evolve until the number of
    bins is the least possible or no child has been better for `patience` generations.
    """
    rng, sizes = np.random.default_rng(seed), lengths.tolist()
    people = [best_fit(sizes, np.argsort(-lengths, kind="stable").tolist(), capacity)]
    for a in elites:
        bins: list[list[int]] = [[] for _ in range(int(a.max(initial=-1)) + 1)]
        for i, k in enumerate(a.tolist()):
            bins[k].append(i)
        people.append(Packing(bins, [sum(sizes[i] for i in b) for b in bins]))
    best = max(people, key=lambda x: x.rank)
    least = -(-int(lengths.sum()) // capacity)
    if len(best.bins) > least:
        full = [(b, f) for b, f in zip(best.bins, best.fills, strict=True) if f == capacity]
        rest = sorted(i for b, f in zip(best.bins, best.fills, strict=True) if f < capacity for i in b)
        own = [sizes[i] for i in rest]
        place = {i: k for k, i in enumerate(rest)}
        open_bins = [(b, f) for b, f in zip(best.bins, best.fills, strict=True) if f < capacity]
        crowd = [Packing([[place[i] for i in b] for b, _ in open_bins], [f for _, f in open_bins])]
        while len(crowd) < population:
            noisy = np.argsort(-(np.array(own) * rng.uniform(0.6, 1.0, len(own))), kind="stable").tolist()
            crowd.append(best_fit(own, noisy, capacity))
        crowd.sort(key=lambda x: x.rank, reverse=True)
        still = 0
        while still < patience and len(crowd[0].bins) + len(full) > least:
            a, b = rng.choice(len(crowd), 2, replace=False).tolist()
            child = _mutate(crowd[min(a, b)], own, capacity, rng) if rng.random() < 0.5 else _cross(crowd[a], crowd[b], own, capacity, rng)
            still = 0 if child.rank > crowd[0].rank else still + 1
            if all(child.rank != x.rank for x in crowd):
                crowd.append(child)
                crowd.sort(key=lambda x: x.rank, reverse=True)
                del crowd[population:]
        best = Packing([b for b, _ in full] + [[rest[i] for i in b] for b in crowd[0].bins], [f for _, f in full] + crowd[0].fills)
    out = np.empty(len(lengths), np.int32)
    for k, b in enumerate(best.bins):
        out[b] = k
    return out


def _tokenise(vocabulary: str, end_id: int, capacity: int, pieces: int):
    def run(batches):
        encode = encoder(vocabulary, pieces).encode
        for whole in batches:
            for batch in slices(whole, limit=4 << 20):
                columns: list[list] = [[], [], [], [], []]
                ids = encode([t or "" for t in batch.column("text").to_pylist()])
                for row, x in zip(batch.column("_row").to_pylist(), ids, strict=True):
                    raw, start = np.append(x, np.uint32(end_id)).astype("<u4"), 0
                    for k, n in enumerate(cut(len(raw), capacity)):
                        for c, v in zip(columns, (row, k, start, n, zlib.crc32(raw[start : start + n].tobytes())), strict=True):
                            c.append(v)
                        start += n
                docs = dict(zip(batch.column("_row").to_pylist(), batch.column("doc_id").to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([docs[r] for r in columns[0]], pa.int64()), *(pa.array(c, pa.int64()) for c in columns)],
                    ["doc_id", "_row", "piece", "start", "length", "ids_crc32"],
                )
        release(caches=False)

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, cache: int = CACHE_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    cache is the number of text pieces whose ids each worker keeps: memory against time, results don't depend on it.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("_row", F.monotonically_increasing_id())
    pieces = rows.mapInArrow(_tokenise(vocabulary, end_id, capacity, cache), "doc_id long, _row long, piece long, start long, length long, ids_crc32 long")
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.save(pieces, "pieces")
    small = pieces.filter(F.col("length") < capacity)
    blocks = max(1, -(-small.count() // block))
    small = small.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    groups = small.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("_row", F.col("length").cast("int").alias("length")))).alias("x"))
    groups = scratch.save(groups.select("_block", F.col("x._row").alias("ids"), F.col("x.length").alias("lengths")), "blocks")

    def evolved(epoch: int):
        def run(batches):
            release()
            for batch in batches:
                pdf = batch.to_pandas()
                got = [
                    evolve(np.asarray(n, np.int64), capacity, int(b) * 1009 + int(i) * 31 + epoch, [np.asarray(e, np.int64)] if e is not None else [])
                    for b, i, n, e in zip(pdf["_block"], pdf["island"], pdf["lengths"], pdf["elite"], strict=True)
                ]
                out = pd.DataFrame({"_block": pdf["_block"], "island": pdf["island"], "elite": [x.tolist() for x in got], "n_bins": [int(x.max()) + 1 if len(x) else 0 for x in got]})
                yield pa.RecordBatch.from_pandas(out, pa.schema([("_block", pa.int64()), ("island", pa.int64()), ("elite", pa.list_(pa.int32())), ("n_bins", pa.int64())]), preserve_index=False)

        return run

    spread = groups.withColumn("island", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(islands - 1).cast("long"))))
    elite = None
    for epoch in range(epochs):
        if elite is None:
            start = spread.withColumn("elite", F.lit(None).cast("array<int>"))
        else:  # migration: each island's best goes on to the next island
            moved = elite.select("_block", F.pmod(F.col("island") + 1, F.lit(islands).cast("long")).alias("island"), "elite")
            start = spread.join(moved, ["_block", "island"])
        dealt = start.select("_block", "island", "lengths", "elite").repartition(max(1, min(blocks * islands, 4096)), "_block", "island")
        last, elite = elite, scratch.save(dealt.mapInArrow(evolved(epoch), "_block long, island long, elite array<int>, n_bins long"), "elites")
        if last is not None:
            scratch.drop(last)
    best = elite.groupBy("_block").agg(F.min(F.struct("n_bins", "island")).alias("b")).select("_block", "b.island")
    chosen = elite.join(best, ["_block", "island"]).join(groups, "_block")

    def placed(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for b, ids, n, bins in zip(pdf["_block"], pdf["ids"], pdf["lengths"], pdf["elite"], strict=True):
                ids, n, bins = (np.asarray(x, np.int64) for x in (ids, n, bins))
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(n[order]) - n[order]
                first = np.r_[True, np.diff(bins[order]) > 0]
                offset = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (ids[order], bins[order] * blocks + int(b), offset)], ["_row", "bin", "offset"]
                )

    places = chosen.select("_block", "ids", "lengths", "elite").mapInArrow(placed, "_row long, bin long, offset long")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    partial = pieces.filter(F.col("length") < capacity).join(places, "_row").withColumn("sequence_id", F.col("bin") * 2)
    # a full piece has a number of its own: odd, from its row and place, which are unique
    full = pieces.filter(F.col("length") == capacity)
    full = full.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return partial.select(*out).union(full.select(*out))
