"""Byte-level BPE encoding and decoding by a local rank file.

Every text is cut by the tokenizer's pattern and each match is merged
separately by the ``tiktoken`` library; no special tokens exist.  Long texts
are first cut at *safe boundaries*: before one space or line feed that stands
between two characters that are no white space.  No match of the pattern can
reach over such a place, so the ids are those of the whole text, while the
memory of a call stays bounded.

Defined cases: a null or empty text has no ids and decodes to no bytes; rows
that repeat are encoded each for itself.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import emit, pieces, table, texts

#: Code points after which the next safe boundary is taken.
SEGMENT = 1 << 15
RANKS = "byte_bpe_50k.tiktoken"
_SAFE = re.compile(r"(?<=\S)[ \n](?=\S)")
_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("token_bytes", pa.binary())])


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@lru_cache(maxsize=2)
def _codec(ranks: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(ranks), special_tokens={})


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """``text`` in parts of at least ``size`` code points, cut at safe boundaries only."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_text(codec, text: str, size: int = SEGMENT) -> list[int]:
    ids: list[int] = []
    for part in segments(text, size):
        ids += codec.encode_ordinary(part)
    return ids


def _defaults(ranks: str | None, pattern: str | None) -> tuple[str, str]:
    if ranks is None or pattern is None:
        import public_tokenizers

        return ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    return ranks, pattern


def encode_documents(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, token_bytes``: the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        import numpy as np

        codec = _codec(*_defaults(ranks, pattern))

        def rows():
            for batch in batches:
                for part in pieces(batch):
                    for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                        ids = encode_text(codec, text)
                        yield doc_id, len(ids), np.asarray(ids, dtype="<u4").tobytes()

        yield from emit(_ENCODED, rows(), lambda r: len(r[2]))

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, token_bytes binary")


def decode_tokens(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the raw bytes that its ids stand for (no UTF-8 check)."""
    schema = pa.schema([*_ENCODED, ("decoded", pa.binary())])

    def run(batches):
        import numpy as np

        codec = _codec(*_defaults(ranks, pattern))

        def rows():
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield *row, codec.decode_bytes(np.frombuffer(row[2], dtype="<u4").tolist())

        yield from emit(schema, rows(), lambda r: len(r[2]) + len(r[3]))

    return encoded.select("doc_id", "n_tokens", "token_bytes").mapInArrow(run, "doc_id long, n_tokens long, token_bytes binary, decoded binary")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode_tokens(encode_documents(table(spark, sf_dir, "documents")))
    return both.select("doc_id", "n_tokens", F.sha2("token_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
