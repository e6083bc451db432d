"""Token-ID files with bit-plane shuffling.

Format of a shard `*.bpz`: the magic `BPZ1`, then per block of BLOCK ids the zstandard frames of its byte planes (plane
b holds byte b of each little-endian id; as many planes as the largest id needs), then a zstandard frame with the
document index (doc_id validity, doc_id and token count, as 64-bit integers), then the chunk index (JSON: per block
its number of ids and the offset and length of each plane; the document index; totals), its length as 8 bytes, and the
magic again. Shards hold ascending doc_ids (null first, ties by text) and follow each other in ascending order.

Plan: one range shuffle of the texts by (doc_id, text hash), encoding and writing in the same tasks, a shard a
partition; only (shard, name, counts) goes to the driver, which makes the prefix sums. A task writes under a name of
its own and renames when complete, and the manifest lists the winners' names, so retried tasks do no harm.

Cases: null texts are empty (the end id alone); repeated doc_ids stay rows of their own; an empty table gives no
shards and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, release, slices
from .tokens import encoder

BLOCK = 1 << 18
MAGIC = b"BPZ1"


def shuffle_planes(ids: np.ndarray, level: int = 1) -> list[bytes]:
    """Compressed byte planes of a block, the lowest byte first."""
    ids = np.ascontiguousarray(ids, "<u4")
    planes = ids.view(np.uint8).reshape(-1, 4).T
    top = int(ids.max()) if len(ids) else 0
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(np.ascontiguousarray(planes[b]).tobytes()) for b in range(max(1, (top.bit_length() + 7) // 8))]


def unshuffle_planes(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    unpack = zstandard.ZstdDecompressor()
    for b, frame in enumerate(planes):
        out[:, b] = np.frombuffer(unpack.decompress(frame, max_output_size=max(n, 1)), np.uint8)
    return out.reshape(-1).view("<u4")


class ShardWriter:
    def __init__(self, sink):
        self.sink, self.at = sink, len(MAGIC)
        self.blocks, self.buffer, self.held = [], [], 0
        self.docs: list[tuple[int | None, int]] = []
        sink.write(MAGIC)

    def _put(self, data: bytes) -> list[int]:
        self.sink.write(data)
        self.at += len(data)
        return [self.at - len(data), len(data)]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        every = np.concatenate(self.buffer) if self.buffer else np.empty(0, np.uint32)
        end = len(every) if rest else len(every) // BLOCK * BLOCK
        for i in range(0, end, BLOCK):
            part = every[i : min(end, i + BLOCK)]
            self.blocks.append({"n": len(part), "planes": [self._put(p) for p in shuffle_planes(part)]})
        self.buffer, self.held = [every[end:]], len(every) - end

    def close(self) -> tuple[int, int]:
        self._flush(True)
        table = np.array([(d is not None, d or 0, n) for d, n in self.docs], np.int64).reshape(-1, 3)
        documents = self._put(zstandard.compress(np.ascontiguousarray(table.T).tobytes(), 1))
        total = int(table[:, 2].sum())
        index = json.dumps({"blocks": self.blocks, "documents": documents, "n_docs": len(table), "n_ids": total}).encode()
        self.sink.write(index + len(index).to_bytes(8, "little") + MAGIC)
        return len(table), total


class ShardReader:
    def __init__(self, source):
        self.source, end = source, source.size()
        tail = self._get(end - 12, 12)
        if tail[8:] != MAGIC:
            raise ValueError("not a complete shard")
        n = int.from_bytes(tail[:8], "little")
        self.index = json.loads(self._get(end - 12 - n, n))

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        b = self.index["blocks"][k]
        return unshuffle_planes([self._get(*p) for p in b["planes"]], b["n"])

    def documents(self):
        """(doc_id, ids) in order, block by block."""
        table = np.frombuffer(zstandard.decompress(self._get(*self.index["documents"]), max_output_size=24 * self.index["n_docs"] + 1), np.int64).reshape(3, -1)
        held, following = np.empty(0, np.uint32), 0
        for known, doc, n in table.T.tolist():
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(following))
                have += len(parts[-1])
                following += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield (doc if known else None), held[:n]
            held = held[n:]


def _encode_to_files(folder: str, vocabulary: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(vocabulary).encode
        name = f"{part:06d}-{uuid.uuid4().hex}.bpz"
        fs, root = pafs.FileSystem.from_uri(folder)
        writer = None
        for whole in batches:
            for batch in slices(whole, limit=4 << 20):
                if writer is None:
                    sink = fs.open_output_stream(f"{root}/.{name}")
                    writer = ShardWriter(sink)
                ids = encode([t or "" for t in batch.column("text").to_pylist()])
                for doc, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                    writer.add(doc, np.append(x, np.uint32(end_id)))
        if writer is not None:
            n_docs, n_ids = writer.close()
            sink.close()
            fs.move(f"{root}/.{name}", f"{root}/{name}")
            release(caches=False)
            yield pa.RecordBatch.from_pydict({"shard": [part], "name": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    return run


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> tuple[str, list[tuple]]:
    """Encode docs into shards. Returns the folder and its manifest: (shard, name, n_docs, n_ids, start), in order."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n_rows = rows.select("doc_id").count()
    parts = max(1, min(n_rows, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // 100_000))))
    dealt = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "text").drop("_h")
    made = dealt.mapInArrow(_encode_to_files(folder, vocabulary, end_id), "shard long, name string, n_docs long, n_ids long").collect()
    manifest, start = [], 0
    for r in sorted(made, key=lambda r: r.shard):
        manifest.append((r.shard, r.name, r.n_docs, r.n_ids, start))
        start += r.n_ids
    return folder, manifest


def read_tokens(spark, folder: str, manifest: list[tuple], with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, decoded from the files."""

    def run(batches):
        release()
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as source:
                    rows = []
                    for doc, ids in ShardReader(source).documents():
                        raw = np.ascontiguousarray(ids, "<u4").tobytes()
                        rows.append((doc, start, len(ids), zlib.crc32(raw), ids.tolist() if with_ids else None))
                        start += len(ids)
                        if len(rows) == 2000:
                            yield _rows(rows, with_ids)
                            rows = []
                    yield _rows(rows, with_ids)

    shards = spark.createDataFrame(manifest, "shard long, name string, n_docs long, n_ids long, start long")
    shards = shards.repartition(max(1, len(manifest)), "shard")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
