"""MinHash near-deduplication by SuperMinHash signatures, banding, verification and union-find grouping.

A document's set holds its distinct word shingles (lower-cased A-Z; with fewer words than a shingle has, the whole
sequence is the one shingle). Documents whose exact Jaccard similarity reaches the threshold are linked; a component
is named by its smallest doc_id.

Plan: one pass makes (set digest, signature, band keys) per row; equal sets fold into one node by a partially
aggregated minimum; buckets of band keys are never expanded into all pairs. A small bucket's pairs are all tested, a
larger one's members against its hub, the member with the most company. Buckets whose members then share one component
are done; where only a few are of others, these are tested with all. The rest become families of their hub: within a family every member lists its shingles with those first
that the hub and a few other references lack, and posts the first few of that list, as many as any partner of the size in question must meet (prefix
filter: two sets that reach the threshold share a posted shingle). Copies alike below the threshold differ
in shingles of their own, so postings are short; they are the next level's buckets. Only banding itself can lose a
pair (below 1e-6 a pair at the threshold) and the comparison of signature bytes, which asks for six standard
deviations less than the threshold.

Cases: null or empty texts and texts without words have no shingles and are linked with nothing. A null doc_id is
never linked and gets a null component (kept is true). Rows that repeat a doc_id are nodes of their own if their sets
differ, so each has its own links. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, Scratch, bounded_batches, gram_hashes, mix64, pack_columns, release, slices, texts_as_bytes, unpack_columns, word_hashes

#: Bands and rows by threshold: at the threshold a pair misses every band with a chance below 1e-6.
def banding(percent: int) -> tuple[int, int]:
    rows = 6 if percent >= 85 else 5 if percent >= 80 else 4
    return math.ceil(math.log(7e-7) / math.log(1 - (percent / 100) ** rows)), rows


MARKS = 128  # signature positions (a byte of each) that are compared before full sets are
BROADCAST_IDS = 2_000_000
SMALL = 4  # buckets up to this size are tested pair by pair; fourfold at each further level
BUCKETS = ["key", "id", "n", "component", "pos", "size"]
REFERENCES = 6  # members of a family, besides its hub, that tell common shingles from rare ones
GROWTH = 1.03  # of set sizes from class to class within a family
LOCAL_LINKS = 200_000
_BLOCK = 8192
_LOW = np.uint64(0xFFFFFFFF)
_SHIFT = np.uint64(32)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(width, len(words))))


def super_minhash(sets: list[np.ndarray], size: int = 128) -> np.ndarray:
    """SuperMinHash signatures, one row per set: rank in the high 32 bits, fraction in the low ones.

    Every element walks its own random permutation of the positions (Fisher-Yates); at rank j it offers j plus a
    fraction to the position it visits. All elements of a block take the same rank together, and a set stops at the
    highest rank that it holds anywhere: later ranks can't lower any position.
    """
    out = np.full((len(sets), size), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    parts: list[tuple[int, np.ndarray]] = []
    for k, s in enumerate(sets):
        parts += [(k, s[i : i + _BLOCK]) for i in range(0, len(s), _BLOCK)]
    at = 0
    while at < len(parts):
        end, total = at, 0
        while end < len(parts) and (end == at or total + len(parts[end][1]) <= _BLOCK):
            total += len(parts[end][1])
            end += 1
        elements = np.concatenate([p for _, p in parts[at:end]])
        owner = np.repeat([k for k, _ in parts[at:end]], [len(p) for _, p in parts[at:end]])
        at = end
        first, last = owner[0], owner[-1] + 1
        perm = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(elements), 1))
        rows = np.arange(len(elements))
        for j in range(size):
            z = mix64(elements + np.uint64((int(GOLDEN) * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
            k = ((z & _LOW) * np.uint64(size - j) >> _SHIFT).astype(np.int64) + j
            place = perm[rows, k]
            perm[rows, k] = perm[rows, j]
            np.minimum.at(flat, owner * size + place, np.uint64(j << 32) | z >> _SHIFT)
            alive = ((out[first:last].max(axis=1) >> _SHIFT) > j)[owner - first]
            if not alive.all():
                elements, owner, perm = elements[alive], owner[alive], perm[alive]
                rows = rows[: len(elements)]
                if not len(elements):
                    break
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    n = len(signatures)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (n, 1))
    cells = signatures[:, : bands * rows].reshape(n, bands, rows)
    for i in range(rows):
        key = mix64(key * GOLDEN + cells[:, :, i])
    return key.view(np.int64)


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two independent 64-bit sums over each set; with its size, equal sets have equal digests."""
    return [pa.array([int(mix64(s ^ x).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()) for x in (np.uint64(0), GOLDEN)]


def _fingerprint(width: int, bands: int, rows: int):
    def run(batches):
        release()
        for whole in batches:
            for batch in slices(whole, limit=1 << 20):
                sets = [shingle_set(t, width) for t in texts_as_bytes(batch.column("text"))]
                signs = super_minhash(sets, bands * rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("text_hash"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *_digests(sets),
                        pa.array([x.tobytes() for x in (signs[:, :MARKS] & np.uint64(0xFF)).astype(np.uint8)], pa.binary()),
                        pa.array(list(band_keys(signs, bands, rows)), pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_hash", "n", "d1", "d2", "sig", "keys"],
                )
        release()

    return run


def _full_sets(width: int):
    def run(batches):
        release()
        seen: set[tuple] = set()
        for whole in batches:
            for batch in slices(whole, limit=1 << 20):
                sets = [shingle_set(t, width) for t in texts_as_bytes(batch.column("text"))]
                d1, d2 = _digests(sets)
                names = list(zip(batch.column("doc_id").to_pylist(), d1.to_pylist(), d2.to_pylist(), strict=True))
                new = pa.array([x not in seen and not seen.add(x) for x in names], pa.bool_())
                out = [batch.column("doc_id"), d1, d2, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, ["rep", "d1", "d2", "shingles"]).filter(new)
        release()

    return run


def posted(shingles: np.ndarray, known: np.ndarray, times: np.ndarray, classes: list[int], percent: int) -> np.ndarray:
    """The shingles of which any partner must hold one that posts it too; classes are those of the family's set sizes.

    known, sorted, are the shingles of the family's references and times in how many of them each is: those in the
    fewest come first.
    """
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    order = shingles[np.lexsort((shingles, np.where(known[at] == shingles, times[at], 0)))]
    n, most = len(order), 0
    for c in classes:
        # a class's sizes, with room for rounding; longer lists than needed do no harm
        low, high = max(1, int(GROWTH**c) - 1), int(GROWTH ** (c + 1)) + 2
        low = max(low, -(-percent * n // 100))
        if low <= min(high, 100 * n // percent):
            most = max(most, n + 1 - -(-percent * (n + low) // (100 + percent)))
    return order[:most]


def _profile(batches):
    """The shingles of a family's references with the number of references that hold each."""
    for batch in batches:
        for family, sets in zip(batch.column("family").to_pylist(), batch.column("sets"), strict=True):
            every, times = np.unique(np.asarray(sets.values.flatten()).view(np.uint64), return_counts=True)
            row = [[family], [every.view(np.int64)], [times.astype(np.uint8).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["family", "known", "times"])
    release()


def _postings(percent: int):
    """(key, id, n, component, pos) of each posted shingle: the key is of family and shingle, pos the shingle's place in the
    member's list, so at most n - pos shingles are shared with whom it is the first one shared.
    """

    def run(batches):
        release()
        for batch in batches:
            keys, rows, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            columns = {c: batch.column(c) for c in ("x", "known", "classes", "times")}
            for i, family in enumerate(batch.column("family").to_pylist()):
                x, known, classes = (np.asarray(columns[c][i].values) for c in ("x", "known", "classes"))
                times = np.frombuffer(columns["times"][i].as_py(), np.uint8)
                s = posted(x.view(np.uint64), known.view(np.uint64), times, classes.tolist(), percent)
                keys.append(mix64(s * GOLDEN ^ mix64(np.array([family], np.int64).view(np.uint64))))
                rows.append(np.full(len(s), i))
                places.append(np.arange(len(s)))
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), *(batch.column(c).take(take) for c in ("id", "n", "component")), pa.array(np.concatenate(places))],
                ["key", "id", "n", "component", "pos"],
            )
        release()

    return run


def _likely(limit: float):
    """Keep pairs whose signatures agree in at least the share `limit` of positions."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            keep = (a == b).mean(axis=1) >= limit
            yield batch.select(["id", "p"]).filter(pa.array(keep))
        release()

    return run


def _forest(batches):
    """Union-find within a partition: its links shrink to one per node, towards the smallest id."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def flush():
        pairs = [(x, root(x)) for x in list(parent)]
        parent.clear()
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("u", "v")), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:  # bounded memory; what is flushed stays connected by the emitted links
            yield flush()
    yield flush()
    release()


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, component) for the nodes of links (u, v), roots perhaps without a row.

    Up to LOCAL_LINKS links one union-find does; beyond that union-find within partitions thins them out, and minimum
    labels with pointer jumping follow.
    """
    scratch = scratch or Scratch(links.sparkSession)
    if links.count() <= LOCAL_LINKS:  # a checked size: one task's union-find is then complete; roots have no row
        return scratch.save(links.coalesce(1).mapInArrow(_forest, "u long, v long").toDF("id", "component"), "labels")
    thin = scratch.save(links.mapInArrow(_forest, "u long, v long"), "forest")
    both = thin.union(thin.select("v", "u")).toDF("u", "v")
    labels = scratch.save(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["id"]).select(F.col("u").alias("id"), "component")
        low = near.union(labels.select("id", "component")).groupBy("id").agg(F.min("component").alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("over"))
        jumped = low.join(up, "component", "left").select("id", F.least("component", F.coalesce("over", "component")).alias("component"))
        following = scratch.save(jumped, "labels")
        changed = following.join(labels.withColumnRenamed("component", "was"), "id").filter("component <> was").limit(1).count()
        scratch.drop(labels)
        labels = following
        if not changed:
            scratch.drop(thin)
            return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs; see the module's docstring."""
    return _judged(docs, width, percent, bands, rows).drop("text_hash", "group")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: of those with its smallest doc_id the one whose text has the smallest hash,
    once. Rows without a doc_id or without words stay.
    """
    judged = _judged(docs, width, percent, None, None).filter("n_shingles > 0 and doc_id is not null")
    first = judged.filter("kept").groupBy("group").agg(F.min("component_id").alias("doc_id"), F.min("text_hash").alias("first"), F.count("*").alias("rows"))
    several = first.filter("rows > 1").select("group", "doc_id", "first")
    gone = judged.filter(~F.col("kept")).select("doc_id", "text_hash")
    gone = gone.union(judged.filter("kept").join(several.select("group", "first"), "group").filter("text_hash <> first").select("doc_id", "text_hash"))
    hashed = pack_columns(docs, "doc_id", "text").withColumn("_hash", F.xxhash64(F.col("text").cast("string")))
    same = (F.col("doc_id").cast("long") == F.col("_d")) & (F.col("_hash") == F.col("_h"))
    rest = hashed.join(gone.toDF("_d", "_h"), same, "left_anti")
    again = several.select(F.col("doc_id").alias("_d"), F.col("first").alias("_h"))
    if again.isEmpty():
        return unpack_columns(rest, docs.columns, "doc_id", "text")
    once = rest.join(again, same, "left_semi").dropDuplicates(["doc_id", "_hash"])
    return unpack_columns(rest.join(again, same, "left_anti").union(once), docs.columns, "doc_id", "text")


def _judged(docs: DataFrame, width: int, percent: int, bands: int | None, rows: int | None) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    if bands is None or rows is None:
        bands, rows = banding(percent)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    base = texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _fingerprint(width, bands, rows), "doc_id long, text_hash long, n long, d1 long, d2 long, sig binary, keys array<long>"
    )
    base = scratch.save(base.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    live = base.filter("n > 0 and doc_id is not null")
    sets = scratch.save(live.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.min("row").alias("id")), "sets")
    nodes = scratch.save(sets.join(base.select(F.col("row").alias("id"), "sig", "keys"), "id"), "nodes")
    labels = _labels(scratch, nodes, texts, width, percent, 6 * math.sqrt(percent / 100 * (1 - percent / 100) / min(MARKS, bands * rows)))
    scratch.drop(nodes)
    named = sets.withColumn("component_id", F.col("rep")).withColumn("group", F.col("id"))
    if labels is not None:
        inside = labels.union(labels.select("component", "component")).distinct().join(sets.select("id", "rep"), "id")
        lowest = inside.groupBy("component").agg(F.min("rep").alias("low"))
        found = inside.join(lowest, "component").select("id", "low", "component")
        named = sets.join(found, "id", "left").withColumn("component_id", F.coalesce("low", "rep")).withColumn("group", F.coalesce("component", "id"))
    out = base.select("doc_id", "n", "d1", "d2", "text_hash").join(named.select("d1", "d2", "n", "component_id", "group"), ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_hash", "group")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept", "text_hash", "group")


def _sized(buckets: DataFrame) -> DataFrame:
    """Buckets with members of several components, with their sizes."""
    mixed = buckets.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    return buckets.join(mixed.filter("lo < hi").select("key", "size"), "key")


def _labels(scratch: Scratch, nodes: DataFrame, texts: DataFrame, width: int, percent: int, slack: float) -> DataFrame | None:
    """(id, component) of the nodes that have links; None where there are none."""
    members = _sized(nodes.select("id", "n", F.col("id").alias("component"), F.lit(0).cast("long").alias("pos"), F.explode("keys").alias("key")))
    members = scratch.save(members.select(*BUCKETS), "buckets")
    full = links = labels = waiting = tried = None
    limit = SMALL
    # sizes, and by the place of the bucket's shingle what can still be shared, must allow the threshold
    alike = f"100 * least(n, pn) >= {percent} * greatest(n, pn) and {100 + percent} * least(n - pos, pn - ppos) >= {percent} * (n + pn) and component <> pc"
    other = lambda df, *more: df.select("key", *(F.col(c).alias(a) for c, a in (("id", "p"), ("n", "pn"), ("component", "pc"), ("pos", "ppos"))), *more)
    while True:
        large, small = members.filter(F.col("size") > limit), members.filter(F.col("size") <= limit)
        # the hub: of each large bucket the member with the most company (the text that the others are copies of)
        ranks = large.groupBy("id").agg((F.sum("size") * 1048576 + F.pmod(F.xxhash64("id"), F.lit(1048576))).alias("rank"))
        best = large.join(ranks, "id").groupBy("key").agg(*(F.max_by(c, "rank").alias(c) for c in ("id", "n", "component", "pos")), F.max("rank").alias("top"))
        hubs = scratch.save(other(best, "top"), "hubs")
        pairs = large.join(hubs, "key").filter(f"id <> p and {alike}").select("id", "p").union(small.join(other(small), "key").filter(f"id < p and {alike}").select("id", "p"))
        pairs = (pairs if waiting is None else pairs.union(waiting)).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["id", "p"], "left_anti")
        likely, new, full = _confirmed(scratch, pairs, nodes, texts, full, large.select("id"), width, percent, slack)
        tried = likely if tried is None else tried.union(likely)
        if waiting is not None:
            scratch.drop(waiting)
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            if labels is not None:
                scratch.drop(labels)
            labels = components(links, scratch)
        # a hub that meets a greater one in another bucket brings its buckets into that one's family
        met = large.join(hubs.select("key", F.col("p").alias("over"), "top"), "key").join(hubs.select(F.col("p").alias("id")).distinct(), "id", "left_semi")
        greatest = met.groupBy(F.col("id").alias("p")).agg(F.max_by("over", "top").alias("family"))
        heads = hubs.join(greatest, "p").select("key", "family", "p", "pc")
        if labels is not None:
            now = lambda df, x, c: df.drop(c).join(labels.toDF(x, c), x, "left").withColumn(c, F.coalesce(c, x))
            large, heads = now(large, "id", "component"), now(heads, "p", "pc")
        large = scratch.save(large.drop("size").join(heads.drop("p"), "key"), "buckets")
        # buckets in which all share the hub's component are done; where few do not, these are tested with all the others
        outside = large.filter("component <> pc").groupBy("key").agg(F.count("*").alias("size"))
        few = outside.filter(F.col("size") <= limit).select("key")
        outsiders = large.filter("component <> pc").drop("pc", "family").join(few, "key", "left_semi")
        waiting = scratch.save(outsiders.join(other(large.drop("pc")), "key").filter(f"id <> p and {alike}").select(F.col("p").alias("id"), F.col("id").alias("p")).distinct(), "pairs")
        families = large.join(outside.filter(F.col("size") > limit).select("key"), "key", "left_semi").select("family", "id", "n", "component").distinct()
        families = scratch.save(families.withColumn("class", F.floor(F.log(GROWTH, "n"))), "families")
        scratch.drop(members, hubs, large)
        if families.isEmpty():
            postings = families.select(F.col("family").alias("key"), "id", "n", "component", F.col("n").alias("pos"), F.col("n").alias("size"))
            members = scratch.save(postings, "buckets")
            if waiting.isEmpty():
                scratch.drop(families, members, waiting, full)
                return labels
        else:
            postings = _posted_by(scratch, families, full, percent)
            members = scratch.save(_sized(postings).select(*BUCKETS), "buckets")
            scratch.drop(postings)
        scratch.drop(families)
        limit *= 4


def _confirmed(scratch: Scratch, pairs: DataFrame, nodes: DataFrame, texts: DataFrame, full: DataFrame | None, more: DataFrame, width: int, percent: int, slack: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Likely ones of pairs (id, p), the links (u, v) among them by full sets, and the sets, once, of all that can be
    compared: pairs and `more`. p is the side with fewer nodes (hubs, outsiders); where its sets are small, Spark
    broadcasts them and the other side's sets travel once.
    """
    likely = pairs.join(nodes.select("id", F.col("sig").alias("sa")), "id").join(nodes.select(F.col("id").alias("p"), F.col("sig").alias("sb")), "p")
    likely = scratch.save(likely.select("id", "p", "sa", "sb").mapInArrow(_likely(percent / 100 - slack), "id long, p long"), "pairs")
    if full is None:
        wanted = likely.select("id").union(likely.select("p")).union(more).distinct()
        wanted = scratch.save(nodes.select("id", "rep", "d1", "d2").join(wanted, "id"), "wanted")
        fewer = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted  # beyond a checked size a shuffle join
        some = texts.withColumnRenamed("doc_id", "rep").join(fewer.select("rep").distinct(), "rep", "left_semi")
        some = some.withColumnRenamed("rep", "doc_id").mapInArrow(_full_sets(width), "rep long, d1 long, d2 long, shingles array<long>")
        full = scratch.save(some.join(fewer, ["rep", "d1", "d2"]).select("id", "shingles"), "shingles")
        if full.count() > wanted.count():  # rows that repeat both doc_id and text, met by several tasks
            twice, full = full, scratch.save(full.dropDuplicates(["id"]), "shingles")
            scratch.drop(twice)
        scratch.drop(wanted)
    common = F.size(F.array_intersect("xa", "xb")).cast("long")
    pivots = scratch.save(full.toDF("p", "xb").join(likely.select("p").distinct(), "p", "left_semi"), "pivots")
    tested = (
        likely.join(full.toDF("id", "xa"), "id")
        .join(pivots, "p")
        .select(F.least("id", "p").alias("v"), F.greatest("id", "p").alias("u"), common.alias("common"), (F.size("xa") + F.size("xb") - common).alias("union"))
        .filter(F.col("common") * 100 >= F.col("union") * percent)
    )
    new = scratch.save(tested.select("u", "v"), "links")
    scratch.drop(pivots)
    return likely, new, full


def _posted_by(scratch: Scratch, families: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(key, id, n, component, pos) of the shingles that the members of families post."""
    classes = families.groupBy("family").agg(F.collect_set("class").alias("classes"))
    # references: the hub and a few members by chance, so that what most members hold is known to be common
    some = [F.max_by("id", F.xxhash64("id", F.lit(j))).alias(f"r{j}") for j in range(REFERENCES)]
    every = F.array_distinct(F.array("family", *(f"r{j}" for j in range(REFERENCES))))
    chosen = families.groupBy("family").agg(*some).select("family", F.explode(every).alias("id"))
    profiles = chosen.join(full, "id").groupBy("family").agg(F.collect_list("shingles").alias("sets"))
    profiles = scratch.save(profiles.mapInArrow(_profile, "family long, known array<long>, times binary").join(classes, "family"), "profiles")
    held = families.join(profiles, "family").join(full.toDF("id", "x"), "id")
    held = held.select("family", "id", "n", "component", "classes", "x", "known", "times")
    postings = scratch.save(held.mapInArrow(_postings(percent), "key long, id long, n long, component long, pos long"), "postings")
    scratch.drop(profiles)
    return postings
