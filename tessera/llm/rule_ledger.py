"""Quality rules with a bitmask ledger.

Every rule is evaluated once for each text; the ledger stores the measurements and one failure bit a rule. Policies are
versioned sets of rules: a verdict is a bitwise test on the ledger, and ablations (what a policy would keep without one
of its rules) are counts over the failure bits, grouped by mask before anything is moved, so texts aren't read again.

Measurements of a whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.
Cases: null and empty texts have no words and fail the base rules; repeated doc_ids are judged each for itself; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, slices, texts_as_bytes, word_hashes

_SYMBOLS = b"#*$%&|<>"
#: Bit, name and SQL condition of failure over the measurements; bits never change their meaning.
RULES = [
    (0, "few_words", "n_words < 50"),
    (1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "n_symbols * 5 > n_words * 1 and n_symbols > 20"),
    (3, "long_words", "word_chars > 25 * n_words"),
    (4, "short_words", "word_chars < 2 * n_words"),
    (5, "dup_lines", "n_dup_lines > 10 and n_dup_lines * 20 > n_words"),
    (6, "many_words", "n_words > 5000000"),
]
BASE = 0b11
POLICIES = {"base-1": BASE, "strict-1": 0b0111111}


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    packed = text.translate(None, b" \t\n\x0b\x0c\r")
    word_chars = len(packed) if packed.isascii() else len(packed.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif not line or line.isspace():
            continue
        else:
            seen.add(line)
    repeat = 0
    if len(words) >= 4:
        _, back, count = np.unique(gram_hashes(word_hashes(words), 3), return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[back] > 1)
        if len(at):
            hit = np.zeros(len(words), bool)
            for i in range(3):
                hit[at + i] = True
            repeat = int(hit.sum())
    return len(words), word_chars, symbols, dup, repeat


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(batches):
    for whole in batches:
        for batch in slices(whole):
            got = np.array([measures(t or b"") for t in texts_as_bytes(batch.column("text"))], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(got[:, i]) for i in range(5))], ["doc_id", *_NAMES])


def failed_bits() -> Column:
    bits = F.lit(0).cast("long")
    for bit, _, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and the failure bits of all rules."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = rows.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{n} long" for n in _NAMES))
    return made.withColumn("failed", failed_bits())


def fails(mask: int) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask).cast("long")) != 0


def apply_policy(book: DataFrame, policy: str = "strict-1") -> DataFrame:
    """The ledger with base_failed and kept under a policy; the base rules are part of every policy."""
    return book.withColumn("base_failed", fails(BASE)).withColumn("kept", ~fails(POLICIES[policy] | BASE))


def ablation(book: DataFrame, policy: str = "strict-1") -> DataFrame:
    """(rule, n_failed, n_only): documents that fail a rule, and those that the policy would keep without it."""
    mask = POLICIES[policy]
    counts = book.groupBy("failed").count()
    rules = [(1 << bit, name) for bit, name, _ in RULES if mask >> bit & 1]
    rows = F.explode(F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(n).alias("rule")) for m, n in rules)))
    of = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    return (
        counts.withColumn("r", rows)
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.m")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(of == F.col("r.m"), F.col("count")).otherwise(0)).alias("n_only"),
        )
    )
