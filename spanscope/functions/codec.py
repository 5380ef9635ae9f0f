"""Between base letters and numbers: A, C, G, T are 0, 1, 2, 3."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rng import below

LETTERS = "ACGT"

# Motif names and their sequences.
MOTIFS = {"CTCF": "CCGCGNGGNGGCAG", "GATA": "AGATAAGG", "SP1": "GGGCGG", "TATA": "TATAAAA", "CAAT": "CCAAT"}


def digits(s: Column) -> Column:
    """One digit per letter, case ignored; N and every other letter count as A."""
    return F.translate(F.regexp_replace(F.translate(s, "acgt", LETTERS), "[^ACGT]", "A"), LETTERS, "0123")


def encode(s: Column) -> Column:
    """DNA letters as an array of bytes."""
    return F.when(F.length(s) == 0, F.array().cast("array<tinyint>")).otherwise(F.transform(F.split(digits(s), ""), lambda c: c.cast("tinyint")))


def decode(seq: Column) -> Column:
    """The letters of an array of base numbers."""
    return F.array_join(F.transform(seq, lambda b: F.substr(F.lit(LETTERS), b.cast("int") + 1, F.lit(1))), "")


def encode_motif(motif: Column, seed: int = 42) -> Column:
    """Motif letters as base numbers; a letter other than ACGT becomes a base drawn by motif and place."""
    up = F.translate(motif, "acgt", LETTERS)
    return F.transform(F.split(up, ""), lambda c, i: F.when(F.instr(F.lit(LETTERS), c) > 0, F.instr(F.lit(LETTERS), c) - 1).otherwise(below(4, seed, "motif", motif, i)).cast("int"))


def complement(seq: Column) -> Column:
    """Antithetic kernel: every base replaced by its partner."""
    return F.transform(seq, lambda b: (3 - b).cast("tinyint"))


def token_to_base(token: Column, k: int | Column = 1) -> Column:
    """First base of a token in a model with k bases a token."""
    return token * F.lit(k)


def listed(x: np.ndarray) -> pa.Array:
    """Rows of equal length as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def packed(x: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Rows of single bytes of equal length as binary values, or as strings."""
    off = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(kind or pa.binary(), len(x), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(x))])


def bases(col: pa.Array) -> np.ndarray:
    """All bases of a column of lists or binary values, one after the other."""
    if pa.types.is_list(col.type):
        return np.asarray(col.flatten())
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.int8)[off[0] : off[-1]]
