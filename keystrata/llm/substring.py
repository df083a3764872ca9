"""Repeated substrings by recompression.

Round after round, neighbouring symbols of a text are named anew: a pair whose left symbol has one
colour and whose right symbol the other becomes one symbol, and a symbol that stays alone inside a
run of equals is named as a run. Colours and names are fingerprints of the symbols alone, so the
naming is the same on every machine without an exchange, and equal substrings get equal symbols in
their interior: only a symbol at either end can depend on what stands around.

Two rounds leave every window of 13 words at least one symbol that is certain. The longest (then
largest) of them stands for the window. Symbols that stand in two documents reveal where repeats
can be; only windows around them are compared, by a fingerprint of all their words in order. It has 80 bits from
two hashes of each word: among n windows about n*n / 2**81 pairs agree by chance, some 40 among 10**13 windows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, exchange, words, workers

WINDOW = 13
#: Bytes of a symbol that are sent: they only say which windows are looked at again.
REVEAL_BYTES = 6
#: Windows meet in as many passes, each with its share of the parts, so that a pass has few of them on disk twice.
PASSES = 2
_U = np.uint64
_REVEAL = _U((1 << 8 * REVEAL_BYTES) - 1)
_FURTHER = _U(0x2545F4914F6CDD1D)
_RUN, _LEFT, _RIGHT = _U(0x5851F42D4C957F2D), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def compress(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, round_no: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One round over the symbols of some documents: names, first and past-last word, document of each new symbol."""
    n = len(symbols)
    if n < 2:
        return symbols, starts, ends, doc
    right = words.mix(symbols ^ _U(round_no * 0x9E37 + 1)) >> _U(63) == 1
    together = doc[1:] == doc[:-1]
    first = np.concatenate((~right[:-1] & right[1:] & together, [False]))
    second = np.concatenate(([False], first[:-1]))
    equal = np.concatenate(([False], (symbols[1:] == symbols[:-1]) & together, [False]))
    run = equal[1:] | equal[:-1]
    names = np.where(run, words.mix(symbols ^ _RUN), symbols)
    at = np.flatnonzero(first)
    names[at] = words.mix(symbols[at] * _LEFT + words.mix(symbols[at + 1] ^ _RIGHT))
    ends = ends.copy()
    ends[at] = ends[at + 1]
    keep = ~second
    return names[keep], starts[keep], ends[keep], doc[keep]


def window_symbols(w: words.Words, n: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window of n words, and the symbol that stands for it."""
    total = len(w.hashes)
    doc = w.doc_of_word()
    at = np.arange(total)
    left = w.first[1:][doc] - at if total else at
    p = np.flatnonzero(left >= n)
    if not len(p):
        return p, np.empty(0, np.uint64)
    s1, b1, e1, d1 = compress(w.hashes, at, at + 1, doc, 1)
    s2, b2, e2, _ = compress(s1, b1, e1, d1, 2)
    # Certain symbols of round 1 lie inside the window without its end words; of these, the outer two are uncertain in round 2.
    low = b1[np.minimum(np.searchsorted(b1, p + 1) + 1, len(b1) - 1)]
    high = e1[np.maximum(np.searchsorted(e1, p + n - 1, side="right") - 2, 0)]
    j, last = np.searchsorted(b2, low), np.searchsorted(e2, high, side="right") - 1
    value = ((e2 - b2).astype(np.uint64) << _U(58)) | (s2 >> _U(6))
    best = value[np.minimum(j, len(value) - 1)]
    for k in range(1, int((last - j).max()) + 1):
        more = value[np.minimum(j + k, len(value) - 1)]
        best = np.where((j + k <= last) & (more > best), more, best)
    return p, words.mix(best)


def _shared(keys: np.ndarray, docs: np.ndarray, more: np.ndarray) -> exchange.Pairs:
    """Pairs whose fingerprint stands in two documents or more."""
    keys, docs, more, group = exchange.sorted_groups(keys, docs, more)
    if not len(keys):
        return keys, docs, more
    low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, group, docs)
    np.maximum.at(high, group, docs)
    keep = (low < high)[group]
    return keys[keep], docs[keep], more


def _later(keys: np.ndarray, docs: np.ndarray, more: np.ndarray) -> exchange.Pairs:
    """Pairs whose fingerprint also stands in a smaller document."""
    keys, docs, more, group = exchange.sorted_groups(keys, docs, more)
    if not len(keys):
        return keys, docs, more
    firsts = docs[np.searchsorted(group, np.arange(group[-1] + 1))]
    keep = docs > firsts[group]
    return keys[keep], docs[keep], more[keep]


def further_bits(w: words.Words, at: np.ndarray, n: int) -> np.ndarray:
    """16 bits of the windows of n words at the given places, from a second hash of each word."""
    second = words.mix(w.second ^ _FURTHER)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out + second[at + k]) * _LEFT
    return (words.mix(out) >> _U(48)).astype(np.uint16)


def _member(values: np.ndarray, w: words.Words, at: np.ndarray, sets: list[bytes | None], width: int = 8) -> np.ndarray:
    """Which windows' values are in their own document's set (ascending, of ``width`` bytes)."""
    out = np.zeros(len(values), bool)
    cuts = np.searchsorted(at, w.first)
    for k, data in enumerate(sets):
        a, b = cuts[k], cuts[k + 1]
        if data and b > a:
            have = exchange.keys_of(data, width)
            found = np.searchsorted(have, values[a:b])
            out[a:b] = have[np.minimum(found, len(have) - 1)] == values[a:b]
    return out


def _symbol_pairs(batches, n: int):
    for batch in common.slices(batches, ["text"]):
        ids = np.asarray(batch.column("doc"))
        w = words.split_words(common.texts(batch, "text"))
        at, symbols = window_symbols(w, n)
        yield symbols & _REVEAL, ids[w.doc_of_word()[at]], exchange.NARROW


def _window_pairs(batches, n: int):
    for batch in common.slices(batches, ["text"]):
        ids = np.asarray(batch.column("doc"))
        w = words.split_words(common.texts(batch, "text"), second=True)
        at, symbols = window_symbols(w, n)
        at = at[_member(symbols & _REVEAL, w, at, batch.column("keys").to_pylist(), REVEAL_BYTES)]
        yield words.window_hashes(w.hashes, n)[at] if len(at) else np.empty(0, np.uint64), ids[w.doc_of_word()[at]], further_bits(w, at, n)


def repeated_windows(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc, keys, more): fingerprints of each document's windows that also start in a smaller document.

    docs: columns doc (long, rows with null are left out) and text.
    """
    spark = docs.sparkSession
    parts = exchange.parts_of(spark)
    docs = docs.where("doc is not null and text is not null")
    packed = docs.mapInArrow(workers.task("substring")(lambda batches: exchange.pack(_symbol_pairs(batches, n), parts, width=REVEAL_BYTES)), exchange.PACKED_DDL)
    revealed = common.materialize(exchange.gather(exchange.meet(packed, _shared, parts, "substring", REVEAL_BYTES), "substring", REVEAL_BYTES), "symbols")
    del packed
    common.forget(spark)  # else both exchanges are on disk at once
    near = common.id_filter(docs, revealed, "doc", "left_semi").join(revealed.select("doc", "keys"), "doc")
    # Written before they meet: else the shuffled texts stay on disk until the last exchange ends.
    sent = common.materialize(near.mapInArrow(workers.task("substring")(lambda batches: exchange.pack(_window_pairs(batches, n), parts)), exchange.PACKED_DDL), "sent")
    common.drop(revealed)
    del near, revealed
    met = []
    for k in range(PASSES):
        common.forget(spark)
        met.append(common.materialize(exchange.meet(sent.where(F.col("part") % PASSES == k), _later, parts, "substring"), "met"))
    common.drop(sent)
    common.forget(spark)
    found = common.materialize(exchange.gather(functools.reduce(DataFrame.unionByName, met), "substring"), "windows")
    for table in met:
        common.drop(table)
    common.forget(spark)
    return found


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def _covered(w: words.Words, sets: list[bytes | None], more: list[bytes | None], n: int) -> np.ndarray:
    at, h = w.windows(n)
    near = _member(h, w, at, sets)
    at, h = at[near], h[near]
    # The fingerprints' other bits, of windows whose first 64 are among the document's: few beside all windows.
    further, hit, cuts = further_bits(w, at, n), np.zeros(len(at), bool), np.searchsorted(at, w.first)
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            have = np.stack([np.frombuffer(sets[k], np.uint64), np.frombuffer(more[k], np.uint16).astype(np.uint64)], axis=1)
            own = np.stack([h[a:b], further[a:b].astype(np.uint64)], axis=1)
            if len(np.unique(have[:, 0])) == len(have):
                hit[a:b] = have[np.searchsorted(have[:, 0], own[:, 0]), 1] == own[:, 1]
            else:  # two of a document's fingerprints agree in 64 bits
                known = set(map(tuple, have.tolist()))
                hit[a:b] = [tuple(x) in known for x in own.tolist()]
    hit = at[hit]
    change = np.zeros(len(w.hashes) + n + 1, np.int32)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + n, -1)
    return np.cumsum(change)[: len(w.hashes)] > 0


@workers.task("substring")
def _cut(batches, n: int, digest: bool):
    for batch in common.slices(batches, ["text"]):
        docs = common.texts(batch, "text")
        sets = batch.column("keys").to_pylist()
        w = words.split_words(docs, second=any(sets))
        gone = _covered(w, sets, batch.column("more").to_pylist(), n) if any(sets) else np.zeros(len(w.hashes), bool)
        kept = []
        for k, text in enumerate(docs):
            a, b = w.first[k], w.first[k + 1]
            out = gone[a:b]
            if out.any():
                base = w.offsets[k]
                text = b" ".join([text[s:e] for s, e in zip((w.starts[a:b][~out] - base).tolist(), (w.ends[a:b][~out] - base).tolist(), strict=True)])
            else:
                text = b" ".join(text.split())
            kept.append(hashlib.sha256(text).hexdigest().encode() if digest else text)
        sums = np.concatenate(([0], np.cumsum(gone)))
        yield common.arrow_batch(RESULT, doc_id=batch.column("doc").to_pylist(), n_words=np.diff(w.first), n_removed=np.diff(sums[w.first]), kept=kept)


def remove_repeats(docs: DataFrame, n: int = WINDOW, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space; digest: their SHA-256 instead).

    A word goes if a window of n words that covers it also starts in a document with a smaller id.
    Null texts have no words. Rows with one id don't count as repeats of each other; rows with a
    null id lose nothing and are no one's source. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    found = repeated_windows(rows, n)
    kind = "doc_id long, n_words long, n_removed long, kept binary"
    few = found.count() <= common.BROADCAST_ROWS
    if few:
        # Only texts that lose words are shuffled; the others are finished where they are read.
        ids = F.broadcast(found.select("doc"))
        hit = rows.join(ids, "doc", "left_semi").join(found, "doc")
        rest = rows.join(ids, "doc", "left_anti").withColumns({c: F.lit(None).cast("binary") for c in ("keys", "more")})
        return hit.mapInArrow(lambda b: _cut(b, n, digest), kind).unionByName(rest.mapInArrow(lambda b: _cut(b, n, digest), kind)).withColumn("kept", F.col("kept").cast("string"))
    return rows.join(found, "doc", "left").mapInArrow(lambda b: _cut(b, n, digest), kind).withColumn("kept", F.col("kept").cast("string"))
