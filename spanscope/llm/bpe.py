"""Byte-level BPE with tiktoken and a local rank file.

Texts are cut at places no match of the pre-splitting pattern can span: before
a white-space character that follows a character other than white space.  All
alternatives of the pattern take white space at their beginning only, and none
looks behind, so the matches of the pieces are the matches of the text.  Long
texts therefore reach the regex engine in short pieces.  A long run of white
space has no such place and would overflow the engine's stack; but it is one
match, up to its last character if another one follows, so it is encoded as
that without the engine.

Nulls are empty texts; an empty text has no ids.  Repeated rows are encoded
independently, other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._base import pick

_CUT = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")  # what the engine's \s means


@lru_cache(maxsize=16)
def _run(size: int):
    return regex.compile(rf"\p{{White_Space}}{{{max(2, size)},}}")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = 1 << 16):
    """Cut a text at safe boundaries into pieces of about ``size`` characters."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(text: str | None, enc, size: int = 1 << 16) -> list[int]:
    """The ids of a text; ``size`` is about what reaches the regex engine at once."""
    if not text:
        return []
    if len(text) <= size:
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    for run in _run(size).finditer(text):
        for piece in safe_pieces(text[at : run.start()], size):
            out += enc.encode_ordinary(piece)
        at = run.end() - (run.end() < len(text))
        out += enc._encode_single_piece(text[run.start() : at])
    for piece in safe_pieces(text[at:], size):
        out += enc.encode_ordinary(piece)
    return out


def decode(ids, enc) -> bytes:
    """The raw bytes of the ids; they need not be whole characters."""
    return enc.decode_bytes(ids)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, ids (if kept), ids_sha256, decoded_sha256.

    Digests are of the ids as little-endian unsigned 32-bit integers and of the
    decoded bytes.  The work is per row: no shuffle, bounded memory.
    """
    src = pick(docs, **{id_col: "bigint", text_col: "string"})
    ids_field = ", ids array<int>" if keep_ids else ""

    def run(batches):
        enc = encoding(rank_file, pattern)
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                n, ids_sha, dec_sha, kept = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = encode(text, enc)
                    packed = np.asarray(ids, dtype="<u4")
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(packed.tobytes()).hexdigest())
                    dec_sha.append(hashlib.sha256(decode(ids, enc)).hexdigest())
                    if keep_ids:
                        kept.append(packed.astype(np.int32))
                cols = {id_col: part.column(0), "n_tokens": pa.array(n, pa.int64())}
                if keep_ids:
                    cols["ids"] = pa.array(kept, pa.list_(pa.int32()))
                cols |= {"ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(dec_sha, pa.string())}
                yield pa.RecordBatch.from_pydict(cols)

    return src.mapInArrow(run, f"{id_col} bigint, n_tokens bigint{ids_field}, ids_sha256 string, decoded_sha256 string")
