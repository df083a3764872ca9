"""Token ids in directly addressable codes.

An id is split into chunks of ``widths`` bits, lowest first. Level k holds the k-th chunk of those
ids that have one; a bitmap at each level says which ids go on to the next, and a rank directory
counts its ones before every 512 bits. So the id at any position is found with one rank per level
and without decoding a block.

A code file is a Parquet folder in ascending order of document ids, its part files being ranges of ids: one row per
document with its code as one binary value (written and read by Spark, so any file system that Spark knows will do).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens, workers

MAGIC = b"DAC1"
#: Bits of the chunk levels, 32 in all. Most ids of a 49k vocabulary need one or two levels.
WIDTHS = (8, 8, 16)
RANK_BITS = 512
_HEAD = struct.Struct("<4sIB3x")
_LEVEL = struct.Struct("<IBB2x")


def encode(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The code of an array of ids below 2**32."""
    if sum(widths) < 32 or any(w not in (8, 16, 32) for w in widths):
        raise ValueError("chunk widths are 8, 16 or 32 bits, 32 in all")
    rest, parts, levels = ids.astype(np.uint64), [], 0
    for width in widths:
        chunk = (rest & np.uint64((1 << width) - 1)).astype(f"<u{width // 8}")
        rest = rest >> np.uint64(width)
        more = rest > 0
        last = not more.any()
        bits = b"" if last else np.packbits(more, bitorder="little").tobytes()
        ranks = b"" if last else np.concatenate(([0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32))))[:-1].astype("<u4").tobytes()
        parts += [_LEVEL.pack(len(chunk), width, last), chunk.tobytes(), bits, ranks]
        levels += 1
        if last:
            break
        rest = rest[more]
    return b"".join([_HEAD.pack(MAGIC, len(ids), levels), *parts])


def encode_many(ids: list[np.ndarray]) -> list[bytes]:
    """encode() of many arrays with WIDTHS; ids of 16 bits are split all at once."""
    if not ids:
        return []
    whole = np.concatenate(ids)
    if len(whole) and whole.max() >= 1 << 16:
        return [encode(x) for x in ids]
    low, high = whole.astype(np.uint8), (whole >> 8).astype(np.uint8)
    more = high > 0
    next_, ones = high[more], np.concatenate(([0], np.cumsum(more)))
    ends = np.cumsum([len(x) for x in ids]).tolist()
    counts = ones[[0, *ends]].tolist()
    out, a = [], 0
    for k, b in enumerate(ends):
        first, last = counts[k], counts[k + 1]
        parts = [_HEAD.pack(MAGIC, b - a, 1 + (last > first)), _LEVEL.pack(b - a, 8, last == first), low[a:b].tobytes()]
        if last > first:
            parts += [np.packbits(more[a:b], bitorder="little").tobytes(), (ones[a:b:RANK_BITS] - first).astype("<u4").tobytes(), _LEVEL.pack(last - first, 8, True), next_[first:last].tobytes()]
        out.append(b"".join(parts))
        a = b
    return out


class Code:
    """Random access to the ids of one code."""

    def __init__(self, blob: bytes):
        magic, self.n, levels = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token code")
        at, self.levels = _HEAD.size, []
        for _ in range(levels):
            count, width, last = _LEVEL.unpack_from(blob, at)
            at += _LEVEL.size
            chunk = np.frombuffer(blob, f"<u{width // 8}", count, at)
            at += chunk.nbytes
            bits = ranks = None
            if not last:
                bits = np.frombuffer(blob, np.uint8, (count + 7) // 8, at)
                at += bits.nbytes
                ranks = np.frombuffer(blob, "<u4", -(-count // RANK_BITS), at)
                at += ranks.nbytes
            self.levels.append((width, chunk, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for width, chunk, bits, ranks in self.levels:
            value |= int(chunk[i]) << shift
            shift += width
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            first, whole = block * RANK_BITS // 8, i >> 3
            ones = int(np.bitwise_count(bits[first:whole]).sum()) + int(bits[whole] & ((1 << (i & 7)) - 1)).bit_count()
            i = int(ranks[block]) + ones
        raise ValueError("code ends early")

    def decode(self) -> np.ndarray:
        """All ids at once."""
        out = np.zeros(self.n, "<u4")
        where, shift = slice(None), 0
        for width, chunk, bits, _ in self.levels:
            out[where] |= chunk.astype("<u4") << np.uint32(shift)
            shift += width
            if bits is not None:
                on = np.flatnonzero(np.unpackbits(bits, count=len(chunk), bitorder="little"))
                where = on if isinstance(where, slice) else where[on]
        return out


CODES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("code", pa.binary())])


def encode_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (with the end id), ids_crc32, code. Null texts count as empty; a null id stays null."""
    path = tokenizer or tokens.default_path("word_bpe_49k.json")

    @workers.task("token codes")
    def run(batches):
        encode_texts = tokens.encoder(path).encode
        end = tokens.END_ID.to_bytes(4, "little")
        for batch in common.slices(batches, ["text"]):
            found = [x + end for x in encode_texts(batch.column("text").to_pylist())]
            codes = encode_many([np.frombuffer(x, "<u4") for x in found])
            yield common.arrow_batch(CODES, doc_id=batch.column("id").to_pylist(), n_tokens=[len(x) // 4 for x in found], ids_crc32=list(map(zlib.crc32, found)), code=codes)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, code binary")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode documents and write their codes in ascending order of ids, ties by length, then by checksum.

    Shards are ranges of ids and become part files in their order. Their bounds come from quantiles of the id column
    alone, so texts are read and encoded once; null ids come first. shards: by default the session's number of
    shuffle partitions.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    bounds = ids.agg(F.percentile_approx("id", [k / shards for k in range(1, shards)] or [0.5], 10 * shards)).head()[0]
    bounds = sorted(set(bounds or [0]))
    cuts = F.array(*(F.lit(b).cast("long") for b in bounds))
    codes = encode_documents(docs, tokenizer, id_col, text_col)
    codes = codes.withColumn("shard", F.coalesce(F.size(F.filter(cuts, lambda b: b < F.col("doc_id"))), F.lit(0)))
    codes.repartitionById(shards, F.col("shard")).sortWithinPartitions("doc_id", "n_tokens", "ids_crc32").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded from a code file."""
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    @workers.task("token codes")
    def run(batches):
        for batch in common.slices(batches, ["code"]):
            ids = [Code(x).decode().tobytes() for x in batch.column("code").to_pylist()]
            yield common.arrow_batch(schema, shard=batch.column("shard").to_pylist(), doc_id=batch.column("doc_id").to_pylist(), n_tokens=[len(x) // 4 for x in ids], ids=ids)

    return spark.read.parquet(path).select("shard", "doc_id", "code").mapInArrow(run, "shard int, doc_id long, n_tokens long, ids binary")


def token_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """The ids at (doc_id, position) rows of a code file; null beyond a document's end."""
    schema = pa.schema([("doc_id", pa.int64()), ("position", pa.int64()), ("token", pa.int64())])

    def run(batches):
        for batch in batches:
            docs, at, codes = (batch.column(c).to_pylist() for c in ("doc_id", "position", "code"))
            found = [(c := Code(blob))[p] if p is not None and 0 <= p < struct.unpack_from("<I", blob, 4)[0] else None for p, blob in zip(at, codes, strict=True)]
            yield common.arrow_batch(schema, doc_id=docs, position=at, token=found)

    rows = positions.select(F.col("doc_id").cast("long"), F.col("position").cast("long"))
    return rows.join(spark.read.parquet(path).select("doc_id", "code"), "doc_id").mapInArrow(run, "doc_id long, position long, token long")


def digests(ids: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 from rows of read()."""
    rows = common.materialize(ids.select("shard", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32")), "code-digests")
    # One row per shard: as many as there are files, never as many as documents.
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(bases, "shard")
    return out.select("doc_id", (F.col("base") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")
