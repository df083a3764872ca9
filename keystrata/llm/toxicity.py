"""Toxicity by weak supervision.

Voters look at a text through lexicons and patterns: lexicons of words and of word beginnings that mark
toxic training texts, in tiers by strength, each once for any hit and once for repeated hits; a
short fixed list; and patterns of writing. A generative label model learns by expectation
maximisation how often each voter votes in either class, estimates how voters still correlate given the
class, and discounts those that repeat each other. The given label of a training row is one voter more. A linear classifier is trained on the model's
posterior labels and scores every whole text.

Training rows fall into two halves by a hash of the id. A half's texts are read with the lexicons of the other half, so
that voters are judged on texts that they weren't made from; scoring uses the lexicons of both halves together.
Training takes a bounded sample: about TRAIN_TOXIC toxic and TRAIN_OTHER other labelled rows, chosen by a hash of the
id. Rows are weighted by their class's share of all labelled rows, so neither the label model's prior nor the scores depend
on the bounds. Lexicons hold every unit that is frequent enough in toxic rows of the sample, which bounds their number.
Language, source, id and labels are never inputs of a score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, workers

TRAIN_TOXIC, TRAIN_OTHER = 4000, 6000
LEAST_RATIO, TIERS = 10.0, (100.0, 30.0)
#: Shares of toxic and of other texts whose given label is toxic, as the label model takes it.
GIVEN = (0.95, 0.005)
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
CACHE_WORDS = 300_000
#: Common insults, a fixed list.
INSULTS = frozenset("idiot moron stupid scum trash garbage pathetic worthless disgusting loser clown filth vermin".split())

KINDS = ("w", *map(str, PREFIXES))
GROUPS = len(KINDS) * (len(TIERS) + 1) + 1
PATTERNS = 5
_STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„’‘…–—¡¿"


def units_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return ["w" + word, *(f"{k}{word[:k]}" for k in PREFIXES if len(word) >= k)]


def clean(token: str) -> str:
    return token.strip(_STRIP).lower()


@workers.task("toxicity")
def _unit_counts(batches):
    """Texts of each class that have a unit, by half of the sample."""
    for batch in common.slices(batches, ["text"], 1 << 22):
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update({u for w in {clean(t) for t in (text or "").split()} if w.isalpha() for u in units_of(w)})
        units = sorted(set(counts[0]) | set(counts[1]))
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), *(pa.array([counts[y][u] for u in units], pa.int64()) for y in (1, 0))], names=["unit", "toxic", "other"])


class Reader:
    """Hits of each lexicon group, and patterns, of a text."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.kinds: list[tuple[int, ...]] = [()]
        self.number: dict[tuple[int, ...], int] = {(): 0}
        self.cache: dict[str, int] = {}

    def _look(self, token: str) -> int:
        word = clean(token)
        groups = tuple(g for u in units_of(word) if (g := self.lexicon.get(u)) is not None) if word else ()
        if word in INSULTS:
            groups += (GROUPS - 1,)
        if groups not in self.number:
            self.number[groups] = len(self.kinds)
            self.kinds.append(groups)
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        if len(token) <= 64:
            self.cache[token] = self.number[groups]
        return self.number[groups]

    def read(self, text: str | None) -> list[int]:
        """Hits by group, then words, words in capitals, exclamation marks, signs, and words said twice running."""
        tokens = (text or "").split()
        hits = [0] * GROUPS
        found = list(map(self.cache.get, tokens))
        if None in found:
            found = [self._look(t) if f is None else f for t, f in zip(tokens, found, strict=True)]
        for kind, n in Counter(filter(None, found)).items():
            for g in self.kinds[kind]:
                hits[g] += n
        text = text or ""
        return [*hits, len(tokens), sum(map(str.isupper, tokens)), text.count("!"), sum(map(text.count, "#*$%&|")), sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))]


def features(counts: np.ndarray) -> np.ndarray:
    """Inputs of the classifier: logs of hits and of hits a hundred words, and shares of the patterns."""
    hits, words = counts[:, :GROUPS].astype(float), np.maximum(counts[:, GROUPS], 1).astype(float)[:, None]
    rest = counts[:, GROUPS + 1 :] / words
    return np.hstack([np.log1p(hits), np.log1p(100 * hits / words), np.log1p(rest)])


def votes(counts: np.ndarray) -> np.ndarray:
    """Voters of each text: 1 toxic, -1 not, 0 no opinion. A lexicon without a hit has none; one voter says no where no lexicon has one."""
    hits, words = counts[:, :GROUPS], np.maximum(counts[:, GROUPS], 1)[:, None]
    patterns = 10 * counts[:, GROUPS + 1 :] > words
    return np.hstack([hits > 0, hits > 2, 100 * hits > words, patterns, -1 * (hits.sum(axis=1, keepdims=True) == 0)]).astype(int)


def label_model(v: np.ndarray, given: np.ndarray, prior: float, weight: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of the toxic class of each row of votes; weight: what each row stands for.

    Voters' frequencies in either class and the correlations that the class leaves are estimated in
    turn, beginning with the classes given; a voter counts by 1 / (1 + the sum of its positive correlations with the
    others). given: a label of each row, a further voter whose accuracy is set (GIVEN), as the others' classes hang on it.
    """
    prior = min(max(prior, 1e-3), 0.5)
    voter = np.ones(v.shape[1])
    named = np.log(GIVEN[0] / GIVEN[1]) * given + np.log((1 - GIVEN[0]) / (1 - GIVEN[1])) * (1 - given)
    p = np.where(given == 1, 0.9, 0.1)
    for k in range(rounds):
        score = np.log(prior / (1 - prior)) + named
        frequency = []
        for value in (-1, 1):  # no opinion is no evidence
            is_value = v == value
            up, down = ((is_value * q[:, None]).sum(axis=0) + 0.1 for q in (weight * p, weight * (1 - p)))
            frequency.append((is_value, up / ((weight * p).sum() + 0.3), down / ((weight * (1 - p)).sum() + 0.3)))
        for is_value, up, down in frequency:
            score += is_value @ (voter * np.log(up / down))
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if k % 5 == 4:
            up, down = ((v * q[:, None]).sum(axis=0) / max(q.sum(), 1e-9) for q in (weight * p, weight * (1 - p)))
            rest = (v - (p[:, None] * up + (1 - p)[:, None] * down)) * np.sqrt(weight / weight.mean())[:, None]
            spread = np.sqrt((rest**2).mean(axis=0)) + 1e-6
            link = (rest.T @ rest) / len(v) / np.outer(spread, spread)
            voter = 1 / np.maximum(np.clip(link, 0, 1).sum(axis=0), 1)
    return p


class Linear:
    def __init__(self, x: np.ndarray, p: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 30):
        """Logistic regression on soft labels of weighted rows by Newton steps."""
        weight = weight / weight.mean()
        self.mean = (weight[:, None] * x).mean(axis=0)
        self.scale = np.sqrt((weight[:, None] * (x - self.mean) ** 2).mean(axis=0)) + 0.05
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        self.w = np.zeros(z.shape[1])
        ridge = penalty * len(x) * np.eye(len(self.w))
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (weight * q * (1 - q))[:, None]).T @ z + ridge, z.T @ (weight * (p - q)) - ridge @ self.w)
            self.w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-4:
                break

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.w[:-1] + self.w[-1], -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _read_counts(lexicons: list[dict[str, int]]):
    """Counts of each text by the lexicon of its half's place in the list."""

    @workers.task("toxicity")
    def run(batches):
        readers = [Reader(x) for x in lexicons]
        for batch in common.slices(batches, ["text"], 1 << 22):
            rows = [np.array(readers[h].read(t), np.int32).tobytes() for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.binary())], names=["toxic", "counts"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, int], Linear] | None:
    """Lexicon and classifier from labelled rows that aren't held out; None without both classes."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc"), F.col("toxic").cast("int").alias("toxic")).where("doc is not null and toxic in (0, 1)").where(~held_out(F.col("doc")))
    sizes = {r.toxic: r["count"] for r in own.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    step = F.when(F.col("toxic") == 1, F.lit(max(1, sizes[1] // TRAIN_TOXIC))).otherwise(F.lit(max(1, sizes[0] // TRAIN_OTHER)))
    chosen = own.where(F.pmod(F.xxhash64("doc"), step) == 0).dropDuplicates(["doc"])
    text = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    # At most about TRAIN_TOXIC + TRAIN_OTHER ids, by the choice above.
    sample = common.materialize(text.join(F.broadcast(chosen), "doc").withColumn("half", F.pmod(F.hash("doc"), F.lit(2))), "toxic-sample")
    totals = Counter({(r.half, r.toxic): r["count"] for r in sample.groupBy("half", "toxic").count().collect()})
    taken = [totals[0, y] + totals[1, y] for y in (0, 1)]
    if not all(taken):
        return None
    counted = [sample.where(f"half = {h}").select("text", "toxic").mapInArrow(_unit_counts, "unit string, toxic long, other long").select("unit", *(F.col(c).alias(f"{c}{h}") if k == h else F.lit(0).cast("long").alias(f"{c}{k}") for k in (0, 1) for c in ("toxic", "other"))) for h in (0, 1)]
    units = counted[0].unionByName(counted[1]).groupBy("unit").agg(*(F.sum(f"{c}{k}").alias(f"{c}{k}") for k in (0, 1) for c in ("toxic", "other")))
    ratios = []
    for part in ((0,), (1,), (0, 1)):  # half by half for the other's texts, and both for scoring
        toxic, other = (sum((F.col(f"{c}{h}") for h in part), F.lit(0)) for c in ("toxic", "other"))
        n = [sum(totals[h, y] for h in part) for y in (0, 1)]
        ratio = (toxic + 0.1) / (n[1] + 1) / ((other + 0.5) / (n[0] + 1))
        ratios.append(F.when((toxic >= max(3, n[1] // 250)) & (ratio >= LEAST_RATIO), ratio))
    top = units.select("unit", F.array(*ratios).alias("r")).where("exists(r, x -> x is not null)").collect()
    lexicons = [{x.unit: KINDS.index(x.unit[0]) * (len(TIERS) + 1) + sum(x.r[k] < t for t in TIERS) for x in top if x.r[k] is not None} for k in range(3)]
    rows = sample.select("text", "toxic", "half").mapInArrow(_read_counts([lexicons[1], lexicons[0]]), "toxic int, counts binary").collect()
    common.drop(sample)
    rows.sort(key=lambda r: (r.toxic, bytes(r.counts)))
    counts = np.stack([np.frombuffer(r.counts, np.int32) for r in rows])
    prior = sizes[1] / (sizes[0] + sizes[1])
    share = np.array([(1 - prior) * sum(taken) / taken[0], prior * sum(taken) / taken[1]])
    weight = share[[r.toxic for r in rows]]
    posterior = label_model(votes(counts), np.array([r.toxic for r in rows]), prior, weight)
    return lexicons[2], Linear(features(counts), posterior, weight)


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted (1 from 0.7 on) of every row.

    Null texts count as empty and get the score of a text without hits. Repeated rows are scored each;
    a null id isn't held out. Without labels of both classes every score is 0.
    """
    model = train(docs, labels, id_col, text_col)

    @workers.task("toxicity")
    def run(batches):
        reader = Reader(model[0] if model else {})
        for batch in common.slices(batches, ["text"], 1 << 22):
            counts = np.array([reader.read(t) for t in batch.column("text").to_pylist()], np.int64)
            scores = model[1](features(counts)) if model else np.zeros(batch.num_rows)
            yield common.arrow_batch(SCORES, doc_id=batch.column("doc_id").to_pylist(), score=scores)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
