"""Meeting of (fingerprint, document) pairs by fingerprint, and answers back by document.

A fingerprint has 64 bits, 16 more where it decides by itself, or 48 where it merely reveals what is looked at
again (``width``: bytes of a fingerprint as it is sent).

Pairs travel as packed binary columns, a few rows for each task and part instead of a row for each
pair. Parts are residues of the fingerprint, so they're even whatever the documents are; within a
task, equal pairs are sent once. A part is worked on as numpy arrays; it holds all pairs divided by the
number of parts. That is a multiple of the session's shuffle partitions, so that a partition's parts come one by one;
answers go back by document in as many parts as there are partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import workers

#: Pairs that a task holds before it sends them on.
FLUSH = 1_000_000
#: Parts for each shuffle partition.
PARTS = 2
PACKED = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("more", pa.binary())])
PACKED_DDL = "part int, keys binary, docs binary, more binary"
BY_DOC = pa.schema([("doc", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())])
BY_DOC_DDL = "doc long, keys binary, more binary"

#: Fingerprints, documents, and the fingerprints' 16 further bits (an empty array where they aren't used).
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]
NARROW = np.empty(0, np.uint16)


def parts_of(spark: SparkSession) -> int:
    return PARTS * max(24, int(spark.conf.get("spark.sql.shuffle.partitions")))


def key_bytes(keys: np.ndarray, width: int = 8) -> bytes:
    """The low bytes of fingerprints."""
    return keys.tobytes() if width == 8 else keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def keys_of(data: bytes, width: int = 8) -> np.ndarray:
    if width == 8:
        return np.frombuffer(data, np.uint64)
    whole = np.zeros((len(data) // width, 8), np.uint8)
    whole[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return whole.reshape(-1).view("<u8")


def pack(stream: Iterable[Pairs], parts: int, by_doc: bool = False, width: int = 8) -> Iterator[pa.RecordBatch]:
    """Packed rows of streams of pairs, dealt by fingerprint or by document."""
    held: list[Pairs] = []
    count = 0
    for keys, docs, more in stream:
        held.append((keys, docs, more))
        count += len(keys)
        if count >= FLUSH:
            yield from _flush(held, parts, by_doc, width)
            held, count = [], 0
    if count:
        yield from _flush(held, parts, by_doc, width)


def _flush(held: list[Pairs], parts: int, by_doc: bool, width: int) -> Iterator[pa.RecordBatch]:
    keys, docs, more = (np.concatenate(x) for x in zip(*held, strict=True))
    wide = len(more) > 0
    order = np.lexsort((more, keys, docs) if wide else (keys, docs))
    keys, docs, more = keys[order], docs[order], more[order] if wide else more
    keep = np.ones(len(keys), bool)
    keep[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    if wide:
        keep[1:] |= more[1:] != more[:-1]
    keys, docs, more = keys[keep], docs[keep], more[keep] if wide else more
    part = ((docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) if by_doc else keys >> np.uint64(17)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    part, keys, docs, more = part[order].astype(np.int32), keys[order], docs[order], more[order] if wide else more
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist()
    rows = [(int(part[a]), key_bytes(keys[a:b], width), docs[a:b].tobytes(), more[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(part)], strict=True)]
    for at in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[at : at + 64], strict=True), PACKED, strict=True)], schema=PACKED)


def unpack(table: pa.Table, width: int = 8) -> Pairs:
    """All pairs of some packed rows."""
    keys = keys_of(b"".join(table.column("keys").to_pylist()), width)
    docs = np.frombuffer(b"".join(table.column("docs").to_pylist()), np.int64)
    return keys, docs, np.frombuffer(b"".join(table.column("more").to_pylist()), np.uint16)


def sorted_groups(keys: np.ndarray, docs: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in order of fingerprint and document, and the group number of each."""
    wide = len(more) > 0
    order = np.lexsort((docs, more, keys) if wide else (docs, keys))
    keys, docs, more = keys[order], docs[order], more[order] if wide else more
    new = keys[1:] != keys[:-1]
    if wide:
        new |= more[1:] != more[:-1]
    return keys, docs, more, np.cumsum(np.concatenate(([0], new))) if len(keys) else np.empty(0, np.int64)


def meet(packed: DataFrame, select: Callable[[np.ndarray, np.ndarray, np.ndarray], Pairs], parts: int, owner: str, width: int = 8) -> DataFrame:
    """Packed rows, dealt by document, of the pairs that ``select`` keeps.

    select gets the distinct pairs of a part, all pairs of a fingerprint together, and returns pairs.
    """

    def run(table: pa.Table) -> pa.Table:
        found = list(pack([select(*unpack(table, width))], max(1, parts // PARTS), by_doc=True, width=width))
        return pa.Table.from_batches(found, schema=PACKED)

    return packed.groupBy("part").applyInArrow(workers.group(owner)(run), PACKED_DDL)


def gather(met: DataFrame, owner: str, width: int = 8) -> DataFrame:
    """(doc, keys, more): the fingerprints (ascending) of each document in rows dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        keys, docs, more = unpack(table, width)
        wide = len(more) > 0
        order = np.lexsort((more, keys, docs) if wide else (keys, docs))
        keys, docs, more = keys[order], docs[order], more[order] if wide else more
        cuts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))).tolist()
        ends = [*cuts[1:], len(docs)]
        return pa.table({"doc": pa.array(docs[cuts], pa.int64()), **{n: pa.array([f(x[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary()) for n, x, f in (("keys", keys, lambda k: key_bytes(k, width)), ("more", more, np.ndarray.tobytes))}}, schema=BY_DOC)

    return met.groupBy("part").applyInArrow(workers.group(owner)(run), BY_DOC_DDL)
