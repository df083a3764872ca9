"""Near duplicates by a multi-index Hamming join of MinHash signatures.

A document's set of word shingles gives a signature of 64 symbols of 16 bits. Two sets of
similarity 0.85 differ in 9.6 symbols on average, in more than 23 with probability below 1e-5. A
signature is split into 12 chunks; by the pigeonhole principle two signatures that differ in at
most 23 symbols have a chunk with at most one difference, and so agree on that chunk without one
of its symbols: one key for each symbol left out, 64 keys in all, finds every such pair.

Documents with equal sets form one class, and only classes are joined. Classes with a common key
form a bucket; pairs of a bucket's smallest member with the others (as many as members, not their
square) tie buckets together into clusters, which hold every candidate pair. A cluster's full sets
meet once: an index of each set's rarest shingles (those that a set of similarity 0.85 can't miss
altogether) yields the pairs to confirm, and pairs that are in one component already are skipped.
Clusters of more than BLOCK members or BLOCK_SHINGLES shingles are compared block against block, in tasks of bounded size.
Components that span tasks are found by Spark rounds over the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, exchange, words, workers

SHINGLE, PERCENT = 5, 85
#: DISTANCE is what CHUNKS chunks with one difference each guarantee.
SYMBOLS, CHUNKS = 64, 12
DISTANCE = 2 * CHUNKS - 1
#: Members of a cluster in one block on average, and shingles; a task compares two blocks at most.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 19

_U = np.uint64
_random = np.random.default_rng(20240607)
_MULTIPLY = _random.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * _U(2) + _U(1)
_FLIP = _random.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
_CHUNK = [list(map(int, x)) for x in np.array_split(np.arange(SYMBOLS), CHUNKS)]

SIGNATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("signature", pa.binary())])
SIGNATURES_DDL = "doc_id long, n_shingles long, set_id binary, signature binary"


def shingle_sets(docs: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Documents and fingerprints of their distinct shingles; a short text is one shingle of all its words."""
    w = words.split_words(docs, fold=True)
    at, h = w.windows(size)
    doc = w.doc_of_word()[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.array([np.bitwise_xor.reduce(words.mix(w.hashes[a:b] + np.arange(b - a, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))) for a, b in zip(w.first[short], w.first[short + 1], strict=True)], np.uint64)
        doc, h = np.concatenate((doc, short)), np.concatenate((h, words.mix(whole + _U(size))))
    return words.unique_in_docs(doc, h)


def signatures_of(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents with shingles, their set sizes, set fingerprints (128 bits) and signatures."""
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(doc)])))
    sign = np.empty((len(starts), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        sign[:, k] = words.mix(np.minimum.reduceat((h ^ _FLIP[k]) * _MULTIPLY[k], starts)) >> _U(48)
    sets = np.stack([np.add.reduceat(words.mix(h ^ x), starts) for x in (_U(0x1234567), _U(0x89ABCDEF))], axis=1)
    return doc[starts], sizes, sets, sign


@workers.task("near duplicates")
def _signed(batches):
    for batch in common.slices(batches, ["text"]):
        n = batch.num_rows
        sizes, sets, signs = [0] * n, [None] * n, [None] * n
        doc, h = shingle_sets(common.texts(batch, "text"))
        if len(doc):
            for d, size, fp, sign in zip(*signatures_of(doc, h), strict=True):
                sizes[d], sets[d], signs[d] = int(size), fp.tobytes(), sign.tobytes()
        yield common.arrow_batch(SIGNATURES, doc_id=batch.column("doc").to_pylist(), n_shingles=sizes, set_id=sets, signature=signs)


def _keys(batches):
    """64 keys of each class: a chunk without one of its symbols."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.asarray(batch.column("id"))
        sign = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
        for chunk in _CHUNK:
            parts = [words.mix((sign[:, s] + _U(1)) * _MULTIPLY[s]) for s in chunk]
            whole = np.sum(parts, axis=0, dtype=np.uint64)
            for s, part in zip(chunk, parts, strict=True):
                yield words.mix((whole - part) ^ _FLIP[s]), ids, exchange.NARROW


STAR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@workers.group("near duplicates")
def _meet(table: pa.Table) -> pa.Table:
    """Pairs of each bucket's smallest member with its others."""
    keys, docs, _, group = exchange.sorted_groups(*exchange.unpack(table))
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(keys) else np.empty(0, np.int64)
    hub = np.repeat(docs[cuts], np.diff(np.concatenate((cuts, [len(keys)]))))
    pairs = np.unique(np.stack([hub, docs], axis=1)[hub < docs], axis=0) if len(keys) else np.empty((0, 2), np.int64)
    return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=STAR)


def forest(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(smallest id of its component, id) of every set that is linked with another, by all pairs of these sets.

    Sets are sorted by how rare their entries are here. If two sets are similar enough, each has one of the
    other's entries among its first size - ceil(0.85 * size) + 1.
    """
    order = np.lexsort((ids, [len(s) for s in sets]))
    sets, own = [sets[k] for k in order], ids[order]
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, counts))] = np.arange(len(values))
    entry = rank[inverse]
    entry = entry[np.lexsort((entry, owner))]
    first = np.concatenate(([0], np.cumsum(sizes)))
    # Where each entry occurs: set numbers, ascending.
    by_entry = np.lexsort((owner, entry))
    post, post_first = owner[by_entry], np.searchsorted(entry[by_entry], np.arange(len(values) + 1))
    prefix = sizes - -(-PERCENT * sizes // 100) + 1
    inside = np.arange(len(entry)) - first[owner] < prefix[owner]
    by_prefix = by_entry[inside[by_entry]]
    short, short_first = owner[by_prefix], np.searchsorted(entry[by_prefix], np.arange(len(values) + 1))
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in range(n):
        mine = entry[first[x] : first[x] + prefix[x]]
        lists = [short[short_first[e] : short_first[e + 1]] for e in mine if short_first[e + 1] - short_first[e] > 1]
        if not lists:
            continue
        found = np.unique(np.concatenate(lists))
        found = found[(found < x) & (100 * sizes[found] >= PERCENT * sizes[x])]
        if not len(found):
            continue
        roots = np.array([root(y) for y in found])
        found, roots = found[roots != root(x)], roots[roots != root(x)]
        if not len(found):
            continue
        whole = entry[first[x] : first[x + 1]]
        both = np.bincount(np.concatenate([post[post_first[e] : post_first[e + 1]] for e in whole]), minlength=n)[found]
        ok = 100 * both >= PERCENT * (sizes[found] + sizes[x] - both)
        for y in np.unique(roots[ok]):
            parent[root(int(y))] = root(x)
    roots = np.array([root(x) for x in range(n)])
    smallest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(smallest, roots, own)
    return [(int(a), int(b)) for a, b in zip(smallest[roots], own, strict=True) if a != b]


@workers.group("near duplicates")
def _compare(table: pa.Table) -> pa.Table:
    ids = np.asarray(table.column("id"))
    pairs = forest(ids, [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()])
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=STAR)


@workers.task("near duplicates")
def _sets(batches):
    for batch in common.slices(batches, ["text"]):
        ids = np.asarray(batch.column("doc"))
        doc, h = shingle_sets(common.texts(batch, "text"))
        cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.empty(0, np.int64)
        rows = [h[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)], strict=True)] if len(doc) else []
        yield pa.RecordBatch.from_arrays([pa.array(ids[doc[cuts]] if len(doc) else [], pa.int64()), pa.array(rows, pa.binary())], names=["id", "shingles"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ends of links (a, b): the smallest id that can be reached.

    Each round takes the smallest label among neighbours and then the label of the label, so labels
    travel twice as far in every round.
    """
    both = common.materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = common.materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        step = common.materialize(step, "labels")
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("next"))
        after = common.materialize(step.join(jump, "component", "left").select("id", "old", F.coalesce("next", "component").alias("component")), "labels")
        moved = after.where("old <> component").limit(1).count()
        common.drop(step)
        common.drop(labels)
        labels = after
        if not moved:
            common.drop(both)
            return labels.select("id", "component")


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows (doc, text), and one row (id, n, signature) for each distinct set."""
    signed = common.materialize(docs.mapInArrow(_signed, SIGNATURES_DDL), "signatures")
    classes = signed.where("set_id is not null and doc_id is not null").groupBy("set_id", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"))
    return signed, common.materialize(classes, "classes")


def links_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, component) of classes with links."""
    parts = exchange.parts_of(docs.sparkSession)
    packed = classes.select("id", "signature").mapInArrow(workers.task("near duplicates")(lambda b: exchange.pack(_keys(b), parts)), exchange.PACKED_DDL)
    star = packed.groupBy("part").applyInArrow(_meet, "a long, b long")
    # A class is in 64 buckets, so it has at most 64 hubs: it is tied to the smallest, and so are the others.
    tied = common.materialize(star.groupBy("b").agg(F.min("a").alias("a"), F.collect_set("a").alias("hubs")), "tied")
    hubs = tied.select("a", F.explode("hubs").alias("b")).where("a <> b").distinct()
    clusters = components(tied.select("a", "b").unionByName(hubs))
    common.drop(tied)
    sized = clusters.join(classes.select("id", "n_shingles"), "id").groupBy(F.col("component").alias("cluster"))
    sizes = sized.agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = common.materialize(clusters.withColumnRenamed("component", "cluster").join(sizes, "cluster"), "members")
    near = common.id_filter(docs, members.select(F.col("id").alias("doc")), "doc", "left_semi")
    sets = near.mapInArrow(_sets, "id long, shingles binary").join(members, "id")
    # Every two blocks of a cluster meet in one task; most clusters are a single block.
    block, other = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.select("id", "shingles", "cluster", "blocks", block.alias("own"), other.alias("other"))
    dealt = dealt.select("id", "shingles", "cluster", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    links = dealt.groupBy("cluster", "x", "y").applyInArrow(_compare, "a long, b long")
    out = components(links)
    common.drop(members)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Null and empty texts have no shingles and no links. Rows with a null id are linked with nothing
    and kept. Rows that share an id share its component. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    signed, classes = classes_of(rows)
    labels = links_of(rows.where("doc is not null and text is not null"), classes)
    named = common.materialize(classes.join(labels, "id", "left").select("set_id", F.coalesce("component", "id").alias("component_id")), "named")
    out = signed.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns."""
    gone = common.materialize(near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col)), "removed")
    return common.id_filter(docs, gone, id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
