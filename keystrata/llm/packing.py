"""Packing by power-of-two decomposition.

Each document's ids (with an end id) are cut into pieces whose lengths are powers of two: as many
full sequences as fit, then the binary digits of the rest from the largest. Every piece is a
sequence of its own, so no sequence crosses documents and none needs padding; equal lengths form
a bucket from which batches are drawn.

Work is per row: one scan, no shuffle, memory bounded by a slice of text plus the largest document.
"""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens, workers

SEQUENCE = 2048

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])
DDL = "doc_id long, start long, length long, ids binary, doc_tokens long"


def pieces(n: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; sequence must be a power of two."""
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError("sequence length must be a power of two")
    out = [(at, sequence) for at in range(0, n - sequence + 1, sequence)]
    at, rest = n // sequence * sequence, n % sequence
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append((at, size))
        at, rest = at + size, rest - size
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", cache_words: int = tokens.CACHE_WORDS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset.

    A null or empty text is the end id alone, one piece of length 1. Null ids are kept as null;
    repeated rows are packed each. Other columns are ignored. An empty table gives an empty table. cache_words: words
    whose ids a worker remembers (about 250 bytes each); results don't depend on it.
    """
    path = tokenizer or tokens.default_path("byte_bpe_50k.json")
    pieces(0, sequence)

    @workers.task("packing")
    def run(batches):
        encode = tokens.encoder(path, cache_words).encode
        end = tokens.END_ID.to_bytes(4, "little")
        for batch in common.slices(batches, ["text"]):
            out = []
            for doc, ids in zip(batch.column("id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                out += [(doc, at, size, ids[4 * at : 4 * (at + size)], n) for at, size in pieces(n, sequence)]
            columns = zip(*out, strict=True)
            yield common.arrow_batch(PIECES, **dict(zip(PIECES.names, map(list, columns), strict=True)))

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, DDL)
    return found.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write pieces as one Parquet folder for each length."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def with_digest(packed: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


__all__ = ["pack", "pieces", "with_digest", "write_buckets"]
