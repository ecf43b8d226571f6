"""Quality rules as a ledger of bits.

Each rule is evaluated once per document. The ledger keeps the measurements and one integer whose bit r says that rule
r failed. Policies are versioned bit masks: a document passes a policy if none of the mask's bits failed. What a policy
would keep without one of its rules follows from the bits alone, without another look at the texts.

Defined cases: a null or empty text has no words and all counts are 0; ratios are compared by cross-multiplication, so
nothing divides by 0. Lines are split at \\n alone; lines and words are compared byte by byte, never by hash. Extra
columns are dropped by `ledger`; ids may repeat or be null: a row of the ledger for each row. A text is measured whole,
in memory of about 45 times its bytes; smaller texts share blocks of 512 KB.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.tables import written
from lexquarry.llm.text import block_of, in_blocks, numbered, words_of
from lexquarry.ship import ship

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str
    """A SQL condition on the measurements."""


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "many_words", "n_words > 1000000"),
)
BASE = 0b11
POLICIES = {"v1": BASE, "v2": 0b1111, "v3": 0b1111111}
CURRENT = "v3"


def _repeats(number: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which first words of 3-word windows begin one found twice or more within its row. number: of each word."""
    first = np.flatnonzero(row[:-2] == row[2:])
    n = int(number.max()) + 1
    keys, fits = row[first], (int(row[-1]) + 1) * n**3 < 2**63
    for j in range(3):
        keys = keys * n + number[first + j]
        if not fits:  # row and words so far, numbered anew: equal numbers are equal words
            keys = np.unique(keys, return_inverse=True)[1]
    order = np.argsort(keys)
    same = np.r_[False, keys[order][1:] == keys[order][:-1], False]
    return first[np.sort(order[same[1:] | same[:-1]])]


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    start, end, first = words_of(buf, off)
    row = np.repeat(np.arange(n), np.diff(first))
    leading = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    raw = buf.tobytes()
    out = {"n_words": np.diff(first), "word_chars": np.bincount(row, leading[end] - leading[start], n).astype(np.int64)}
    out["n_symbols"] = np.diff(np.concatenate([[0], np.cumsum(symbol[buf])])[off])

    # lines with a word; a line is a repeat if the same bytes made an earlier line of the row
    breaks = np.flatnonzero(buf == 10)
    of = np.searchsorted(off, breaks, "right") - 1
    starts = np.concatenate([off[:-1], breaks + 1])
    ends = np.concatenate([breaks, off[1:]])
    lines = np.concatenate([np.arange(n), of])
    order = np.argsort(starts, kind="stable")  # an empty row's start comes before the next row's
    order = order[np.argsort(lines[order], kind="stable")]
    starts, lines = starts[order], lines[order]
    ends = ends[np.argsort(np.concatenate([of, np.arange(n)]), kind="stable")]
    filled = np.searchsorted(start, ends) > np.searchsorted(start, starts)
    per_row = np.bincount(lines[filled], minlength=n)
    out["n_lines"], out["n_dup_lines"] = per_row, np.zeros(n, np.int64)
    cuts, a, b = np.concatenate([[0], np.cumsum(per_row)]), starts[filled].tolist(), ends[filled].tolist()
    for r in np.flatnonzero(per_row > 1):
        own = range(cuts[r], cuts[r + 1])
        out["n_dup_lines"][r] = len(own) - len({raw[a[k] : b[k]] for k in own})

    # words in 3-word windows found twice or more in the row
    covered = np.zeros(len(start), bool)
    if len(start) >= 3:
        found = _repeats(numbered(buf, start, end), row)
        for j in range(3):
            covered[found + j] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    return {k: out[k].astype(np.int64) for k in MEASURES}


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements, and failed: the bits of the rules that failed. Map only; no shuffle."""

    ship(docs.sparkSession)

    def rows(batches):
        for batch in in_blocks(batches):
            found = measure(*block_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k]) for k in MEASURES)], ["doc_id", *MEASURES])

    kind = docs.schema[doc_id].dataType.simpleString()
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in MEASURES))
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return found.withColumn("failed", bits)


def stored(found: DataFrame) -> DataFrame:
    """The ledger as a table in the shared folder: policies and ablations read it, the texts are never looked at again."""
    return written(found, "ledger")


def passes(policy: str = CURRENT, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(found: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A row per rule of the policy: documents that fail it, that fail it alone, and what is kept with and without it."""
    mask = POLICIES[policy]
    of = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    own = [r for r in RULES if mask >> r.bit & 1]
    totals = found.agg(
        F.count_if(of == 0).alias("kept"),
        *(F.count_if(of.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias(f"fail_{r.bit}") for r in own),
        *(F.count_if(of == F.lit(1 << r.bit).cast("long")).alias(f"alone_{r.bit}") for r in own),
        F.bit_or(of).alias("seen"),
    )
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"fail_{r.bit}").alias("n_failed"), F.col(f"alone_{r.bit}").alias("n_alone"), F.col("kept").alias("n_kept"), (F.col("kept") + F.col(f"alone_{r.bit}")).alias("n_kept_without")) for r in own)))
    return totals.select(F.lit(policy).alias("policy"), each.alias("x")).select("policy", "x.*")
