"""Compression classifier: zstandard dictionaries of good and bad labelled text.

The dictionaries hold labelled texts of each class. A text is compressed whole with each of them and with none; the
normalised size difference, with the plain ratio and their products, becomes a score by logistic calibration on
labelled rows that are in neither dictionary.

Bounds: TRAIN_ROWS labelled rows of SAMPLE_BYTES in all at most (those with the smallest hash of doc_id; the share of
each class follows the data). The dictionaries take DICT_BYTES a class, an eighth of that from one text: a longer one
stands in it with slices spread over its whole length. Every text is scored whole.

Cases: null texts are empty and get a score too; without labels of both classes the score is the share of label 1 (0.5
without labels); several labels of a document count as its mean; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, release, slices, texts_as_bytes

TRAIN_ROWS, SAMPLE_BYTES, DICT_BYTES, LEVEL = 4000, 48 << 20, 112 << 10, 3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, rows: int, size: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """Up to `rows` labelled texts of `size` bytes in all, those with the smallest hash of doc_id; `keep` says which ids
    may be learnt from. Of several texts with a doc_id the smallest one counts.
    """
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep("doc_id")).groupBy("doc_id").agg(F.avg(label).alias("y"))
    order = (F.xxhash64(F.col("doc_id").cast("long")), F.col("doc_id"))
    ids = docs.select("doc_id").join(marked, "doc_id").distinct().orderBy(*order).limit(rows)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).orderBy(*order)
    got, used = [], 0
    for r in found.toLocalIterator():
        text = (r.text or "").encode()
        used += len(text)
        if got and used > size:
            break
        got.append((r.doc_id, text, int(r.y >= 0.5)))
    got.sort(key=lambda r: (r[0], r[1]))
    return [r[1:] for r in got]


def spread(text: bytes, size: int, parts: int = 8) -> bytes:
    """At most about `size` bytes of a text: all of it, or `parts` slices at equal distances from its start to its end."""
    if len(text) <= size:
        return text
    own = size // parts
    return b"\n".join(text[k * (len(text) - own) // (parts - 1) :][:own] for k in range(parts))


class CompressionClassifier:
    def __init__(self, rows: list[tuple[bytes, int]], dict_bytes: int = DICT_BYTES):
        self.prior = float(np.mean([y for _, y in rows])) if rows else 0.5
        self.weights = None
        classes = [[t for t, y in rows if y == c and t] for c in (0, 1)]
        if min(map(len, classes)) < 4:
            return
        self.dicts, rest = [], []
        for c in (1, 0):
            data, used = b"", 0
            while used < len(classes[c]) // 2 and len(data) < dict_bytes:
                data += spread(classes[c][used], dict_bytes // 8) + b"\n"
                used += 1
            self.dicts.append(data[:dict_bytes])
            rest += [(t, c) for t in classes[c][used:]]
        x = np.array([self.features(t) for t, _ in rest])
        y = np.array([c for _, c in rest], float)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        w = np.zeros(z.shape[1])
        w[0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        for _ in range(40):  # Newton steps of ridge logistic regression
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 0.3 * np.eye(len(w))
            w += np.linalg.solve(h, z.T @ (y - p) - 0.3 * np.r_[0, w[1:]])
        self.weights = w

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_packers"}

    def sizes(self, text: bytes) -> tuple[int, int, int]:
        if "_packers" not in self.__dict__:
            made = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in self.dicts]
            for d in made:
                d.precompute_compress(level=LEVEL)
            self._packers = [zstandard.ZstdCompressor(level=LEVEL), *(zstandard.ZstdCompressor(level=LEVEL, dict_data=d) for d in made)]
        return tuple(len(p.compress(text)) for p in self._packers)

    def features(self, text: bytes) -> list[float]:
        n = len(text) + 8
        plain, good, bad = self.sizes(text)
        d, r = (bad - good) / n, plain / n
        gain = (plain - good) / n
        return [d, r, gain, d * r, d * d, r * r, np.log(n), d * np.log(n), r * np.log(n)]

    def score(self, text: bytes) -> float:
        if self.weights is None:
            return self.prior
        z = (np.array(self.features(text)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30))))


def append_scores(docs: DataFrame, model, name: str = "_score") -> DataFrame:
    """docs with one more column: the model's score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        release()
        score = shared.value.score
        for whole in batches:
            for batch in slices(whole):
                got = [score(t or b"") for t in texts_as_bytes(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, name])
        getattr(shared.value, "forget", release)()  # the worker lives on, and what it has cached with it
        release()

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, keep, label: str = "quality", rows: int = TRAIN_ROWS) -> CompressionClassifier:
    return CompressionClassifier(labelled_sample(docs, labels, label, keep, rows))
