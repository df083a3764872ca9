"""Benchmark decontamination by spaced-seed hashing.

A window of 16 words is hashed under six fixed masks. Positions fall into four classes by their residue
modulo 4, and a mask ignores two of the classes, so whichever two words of a window are
substituted, some mask sees none of them: all overlaps with at most two substitutions are found.
Benchmark items of 8 to 15 words are found by windows of 8 words, exactly, and by windows of their own
length with at most one substitution, one of whose halves has none; items of 5 to 7 words by exact windows of their
own length. Runs of fewer than 16 words of longer items don't count, and items of fewer than 5 words are common phrases.

Training windows are first held against a bitmap of the benchmark's hashes. Its size is a constant,
so it may be broadcast whatever the benchmark; what passes (true hits and a few strays) is joined
with the benchmark by hash, and each hit is verified word by word.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words, workers

WINDOW, CLASSES, ERRORS = 16, 4, 2
SHORT_WINDOW, SHORT_ERRORS, LEAST_WORDS = 8, 1, 5
#: Bits of the benchmark's bitmap: 2 MB, always.
BITMAP_BITS = 24

_U = np.uint64
#: Fixed masks: positions that count.
MASKS = tuple(tuple(p for p in range(WINDOW) if p % CLASSES not in gone) for gone in itertools.combinations(range(CLASSES), 2))
#: Halves of an item of 8 to 15 words: whichever word is substituted, one half doesn't have it.
HALVES = tuple((size, half) for size in range(SHORT_WINDOW, WINDOW) for half in (tuple(range(size // 2)), tuple(range(size // 2, size))))
#: Words of a window, positions that are hashed, substitutions allowed: windows of long items, of short items without gaps, whole short items, whole shorter ones.
SEEDS = (*((WINDOW, mask, ERRORS) for mask in MASKS), (SHORT_WINDOW, tuple(range(SHORT_WINDOW)), 0), *((*x, SHORT_ERRORS) for x in HALVES), *((n, tuple(range(n)), 0) for n in range(LEAST_WORDS, SHORT_WINDOW)))
_STEP = np.random.default_rng(88).integers(1, 1 << 63, (len(SEEDS), WINDOW), dtype=np.uint64) * _U(2) + _U(1)

HITS = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("mask", pa.int32()), ("hash", pa.int64()), ("window", pa.binary())])
HITS_DDL = "id long, at long, mask int, hash long, window binary"


def _hashes(h: np.ndarray, at: np.ndarray, mask: int) -> np.ndarray:
    """Hashes of the windows that start at the given words."""
    out = np.zeros(len(at), np.uint64)
    for p in SEEDS[mask][1]:
        out += h[at + p] * _STEP[mask, p]
    return words.mix(out ^ _U(mask + 1))


def _windows(batches, bitmap: np.ndarray | None, masks: frozenset[int] = frozenset(range(len(SEEDS)))):
    """Rows of HITS: all windows of benchmark items (no bitmap), or those of documents that pass it.

    masks: the seeds that the benchmark has windows of; the others aren't looked up.
    """
    for batch in common.slices(batches, ["text"]):
        ids = np.asarray(batch.column("doc"))
        w = words.split_words(common.texts(batch, "text"), fold=True)
        doc = w.doc_of_word()
        count = np.diff(w.first)
        left = w.first[1:][doc] - np.arange(len(doc))
        for mask in sorted(masks):
            size = SEEDS[mask][0]
            places = np.flatnonzero(left >= size)
            if bitmap is None and mask >= len(MASKS):
                length = count[doc[places]]
                places = places[length < WINDOW if mask == len(MASKS) else length == size]
            hashes = _hashes(w.hashes, places, mask)
            if bitmap is not None:
                bit = hashes >> _U(64 - BITMAP_BITS)
                pick = (bitmap[bit >> _U(3)] >> (bit & _U(7)).astype(np.uint8)) & 1 == 1
                places, hashes = places[pick], hashes[pick]
            if len(places):
                local = places - w.first[doc[places]]
                yield common.arrow_batch(HITS, id=ids[doc[places]], at=local, mask=np.full(len(places), mask), hash=hashes.view(np.int64), window=[w.hashes[p : p + size].tobytes() for p in places])


def _bitmap(batches):
    """One bitmap for each task."""
    bits = np.zeros(1 << BITMAP_BITS, bool)
    for batch in batches:
        bits[np.asarray(batch.column("hash")).view(np.uint64) >> _U(64 - BITMAP_BITS)] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    size = 1 << 16
    yield pa.RecordBatch.from_arrays([pa.array(range(len(packed) // size), pa.int32()), pa.array([packed[a : a + size] for a in range(0, len(packed), size)], pa.binary())], names=["piece", "bits"])


def _merge(table: pa.Table) -> pa.Table:
    out = np.zeros(1 << 16, np.uint8)
    for data in table.column("bits").to_pylist():
        out |= np.frombuffer(data, np.uint8)
    return pa.table({"piece": table.column("piece")[:1], "bits": pa.array([out.tobytes()], pa.binary())})


@workers.task("decontamination")
def _verified(batches):
    """Hits whose windows differ in no more words than allowed."""
    for batch in batches:
        keep = []
        for mask, x, y in zip(*(batch.column(c).to_pylist() for c in ("mask", "window", "item_window")), strict=True):
            wrong = int((np.frombuffer(x, np.uint64) != np.frombuffer(y, np.uint64)).sum())
            keep.append(wrong <= SEEDS[mask][2])
        yield batch.filter(pa.array(keep, pa.bool_())).select(["doc_id", "at", "item_id"])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, at, item_id): document windows (first word) within the allowed substitutions of a window of an item.

    Words are runs without white space, with A-Z lower-cased. Null ids and texts give none. Items of
    fewer than 5 words can't be told from chance and give none.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("doc"), F.col(item_text_col).alias("text")).where("doc is not null and text is not null")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    known = common.materialize(items.mapInArrow(lambda b: _windows(b, None), HITS_DDL), "benchmark")
    pieces = known.select("hash").mapInArrow(_bitmap, "piece int, bits binary").groupBy("piece").applyInArrow(_merge, "piece int, bits binary").collect()
    whole = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in pieces:
        whole[r.piece << 16 : (r.piece + 1) << 16] = np.frombuffer(r.bits, np.uint8)
    masks = frozenset(r.mask for r in known.select("mask").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(whole)

    @workers.task("decontamination")
    def run(batches):
        return _windows(batches, shared.value, masks)

    hits = rows.mapInArrow(run, HITS_DDL).withColumnRenamed("id", "doc_id")
    # A window that occurs in many items is kept once for each of them.
    targets = known.select(F.col("id").alias("item_id"), "mask", "hash", F.col("window").alias("item_window")).distinct()
    joined = common.attach(hits, targets, ["mask", "hash"], targets.count(), how="inner")
    return joined.select("doc_id", "at", "mask", "window", "item_id", "item_window").mapInArrow(_verified, "doc_id long, at long, item_id long").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **names: str) -> DataFrame:
    """doc_id, n_windows (distinct overlapping windows), item_ids (ascending, comma-joined), contaminated, kept for each row.

    Rows that share an id share its verdict; a null id is kept. Empty tables give no hits.
    """
    found = overlaps(docs, benchmark, id_col, **names)
    by_doc = found.groupBy("doc_id").agg(F.countDistinct("at").alias("n_windows"), F.array_join(F.array_sort(F.collect_set("item_id")).cast("array<string>"), ",").alias("item_ids"))
    by_doc = common.materialize(by_doc, "contaminated")
    rows = common.attach(docs.select(F.col(id_col).cast("long").alias("doc_id")), by_doc, ["doc_id"], by_doc.count(), limit=common.BROADCAST_ROWS, sized=True)
    hit = F.col("n_windows").isNotNull()
    return rows.select("doc_id", F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.coalesce("item_ids", F.lit("")).alias("item_ids"), hit.alias("contaminated"), (~hit).alias("kept"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **names: str) -> DataFrame:
    """The rows of docs without overlaps, with all their columns."""
    ids = common.materialize(overlaps(docs, benchmark, id_col, **names).select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    return common.id_filter(docs, ids, id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
