"""Quality rules: robust multivariate outliers.

Each text becomes a vector of transformed statistics. For every language and source the minimum
covariance determinant (MCD) gives a centre and scatter that the worst quarter of its documents can't
move; documents far away by Mahalanobis distance are rejected.

The estimate is deterministic. It has three starts, all at the medians: median deviations alone, and correlations of
hyperbolic tangents and of spatial signs of the standardised statistics; each takes concentration steps, and the one
that ends with the least determinant is kept. One step is one aggregation for all groups and starts: rows are counted
with sums and products by group, start and distance bin, so a group leaves a few hundred rows however many documents it
has, and the bins up to three quarters of the count give the next centre and scatter. All rows take part in every step.

The same is estimated for every language and for all rows. A group's centre and scatter are drawn toward its
language's, and the language's toward all rows', as if SHRINK of their rows were the group's; so a small group has
nearly the parameters of its language, a large one its own, with no size at which that changes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, words, workers

#: Share of a group's rows that the estimate rests on, and concentration steps.
SUPPORT, STEPS = 0.75, 4
#: Rows of the wider group that count as a group's own.
SHRINK = 50
#: Spread below which a statistic's differences don't count, by statistic (see vector()).
FLOORS = (0.08, 0.10, 0.20, 0.20, 0.08, 0.08, 0.12)
#: Quantiles of chi-squared with 7 degrees of freedom at 0.999 and at 0.5 (fixed values).
CUTOFF, CHI2_MEDIAN = 24.322, 6.346
#: Repeated words come in windows of five that stand twice: so many words make one independent event.
BURST = 10
MIN_WORDS, REPEAT_PERCENT = 10, 20

_D = len(FLOORS)
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_other", "n_same")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_OTHER = np.zeros(256, bool)
_OTHER[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,#*$%&|<>"]] = True
_STARTS = (np.arange(256) & 0xC0) != 0x80


def count_texts(docs: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS of each text (UTF-8)."""
    w = words.split_words(docs)
    n = len(docs)

    def total(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(table[w.buf], dtype=np.int64)))
        return np.diff(sums[w.offsets])

    at, h = w.windows(5)
    doc = w.doc_of_word()
    covered = np.zeros(len(w.hashes) + 6, np.int32)
    if len(at):
        key = h ^ words.mix(doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 5, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(covered)[: len(w.hashes)] > 0)))
    same_word = np.concatenate(([False], (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1]))) if len(doc) else np.empty(0, bool)
    repeats = np.concatenate(([0], np.cumsum(same_word)))
    lines = [[x for x in d.split(b"\n") if x.strip()] for d in docs]
    return {
        "n_words": np.diff(w.first), "word_chars": total(_STARTS & ~words.IS_SPACE), "n_symbols": total(_SYMBOL),
        "n_dup_lines": np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, n), "n_repeat_words": np.diff(inside[w.first]),
        "n_lines": np.fromiter(map(len, lines), np.int64, n), "n_upper": total(_UPPER), "n_other": total(_OTHER), "n_same": np.diff(repeats[w.first]),
    }


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of all columns of docs, untouched) and COUNTS of each text; null counts as empty."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    @workers.task("quality")
    def run(batches):
        for batch in batches:
            text = pc.struct_field(batch.column("row"), text_col)
            batch = batch.append_column("_text", text)
            for part in common.slices([batch], ["_text"]):
                counts = count_texts(common.texts(part, "_text"))
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], names=["row", *COUNTS])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics: word length, symbols, repeated lines and words, capitals, other signs, words said twice running."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    rate = lambda c, by: F.sqrt(F.col(c) / by)
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), rate("n_symbols", n), rate("n_dup_lines", lines), rate("n_repeat_words", n), rate("n_upper", chars), rate("n_other", chars), rate("n_same", n)]


def sampling() -> list[Column]:
    """Variance that each statistic has from the text's length alone: a square root of a rate over an exposure of m has
    1 / 4m, whatever the rate, and so has the log of the mean length of m words, which vary by about half."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return [1 / (4 * m) for m in (n, n, lines, n / BURST, chars, chars, n)]


def _distance(deviations: list[Column], precision: str = "precision") -> Column:
    """Squared Mahalanobis distance; null without parameters."""
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + (1.0 if i == j else 2.0) * F.col(precision)[i * _D + j] * deviations[i] * deviations[j]
    return F.greatest(total, F.lit(0.0))


def with_vector(measured: DataFrame, lang: Column, source: Column) -> DataFrame:
    """Adds x0.. and the group's keys; null languages and sources are groups of their own."""
    none = F.lit("\x00null")
    return measured.withColumns({**{f"x{i}": x for i, x in enumerate(vector())}, "g_lang": F.coalesce(lang.cast("string"), none), "g_source": F.coalesce(source.cast("string"), none)})


_OWN = ["k_lang", "k_source"]
_ALL = "\x00all"
_STATE = "k_lang string, k_source string, start int, n long, log_det double, center array<double>, scatter array<double>, precision array<double>"


def estimate(vectors: DataFrame, steps: int = STEPS) -> tuple[DataFrame, int]:
    """Centre, precision and variances of every group, and the number of groups.

    vectors: rows of with_vector(), materialized, without those that fail the base rules.
    """
    every = F.lit(_ALL)
    levels = F.array(*(F.struct(a.alias("k_lang"), b.alias("k_source")) for a, b in ((every, every), (F.col("g_lang"), every), (F.col("g_lang"), F.col("g_source")))))
    rows = vectors.select(F.inline(levels), *(f"x{i}" for i in range(_D)))
    medians = common.materialize(rows.groupBy(_OWN).agg(F.count("*").alias("n"), F.array(*(F.percentile_approx(f"x{i}", 0.5, 1000) for i in range(_D))).alias("center")), "medians")
    groups = medians.count()
    off = [F.col(f"x{i}") - F.col("center")[i] for i in range(_D)]
    spread = common.attach(rows, medians.drop("n"), _OWN, groups).groupBy(_OWN).agg(*(F.percentile_approx(F.abs(d), 0.5, 1000).alias(f"s{i}") for i, d in enumerate(off)))
    unit = F.array(*(F.sqrt(F.pow(1.4826 * F.col(f"s{i}"), 2) + FLOORS[i] ** 2) for i in range(_D))).alias("unit")
    units = common.materialize(medians.join(spread.select(*_OWN, unit), _OWN), "spread")
    # Correlations of two transformations of the standardised statistics.
    z = common.attach(rows, units, _OWN, groups).select(*_OWN, "n", "center", "unit", *((d / F.col("unit")[i]).alias(f"z{i}") for i, d in enumerate(off)))
    z = z.withColumn("norm", F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(_D)), F.lit(1e-12))))
    tanh, sign = [F.tanh(f"z{i}") for i in range(_D)], [F.col(f"z{i}") / F.col("norm") for i in range(_D)]
    shapes = z.groupBy(_OWN).agg(F.first("n").alias("n"), F.first("center").alias("center"), F.first("unit").alias("unit"), *(F.array(*(F.avg(t[i] * t[j]) for i, j in _PAIRS)).alias(name) for name, t in (("tanh", tanh), ("sign", sign))))
    state = common.materialize(shapes.mapInPandas(_starts, _STATE), "mcd-0")
    for step in range(steps):
        near = common.attach(rows, state.select(*_OWN, "start", "center", "precision"), _OWN, 3 * groups)
        binned = near.withColumn("bin", F.floor(20 * F.log1p(_distance(off))).cast("int"))
        sums = binned.groupBy(*_OWN, "start", "bin").agg(F.count("*").alias("n"), F.array(*(F.sum(f"x{i}") for i in range(_D))).alias("s1"), F.array(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in _PAIRS)).alias("s2"))
        before, state = state, common.materialize(sums.groupBy(*_OWN, "start").applyInPandas(_concentrate, _STATE), f"mcd-{step + 1}")
        common.drop(before)
    best = state.groupBy(_OWN).agg(F.min(F.struct("log_det", "start", "n", "center", "scatter")).alias("b"))
    best = common.materialize(best.select(*_OWN, *(F.col(f"b.{c}").alias(c) for c in ("n", "center", "scatter"))), "mcd")
    level = lambda where, name: best.where(where).select(*(F.col(c).alias(f"{name}_{c}") for c in ("k_lang", "n", "center", "scatter")))
    whole, langs = level(F.col("k_lang") == _ALL, "all"), level((F.col("k_lang") != _ALL) & (F.col("k_source") == _ALL), "lang")
    own = best.where(F.col("k_source") != _ALL).select(F.col("k_lang").alias("g_lang"), F.col("k_source").alias("g_source"), "n", "center", "scatter")
    chain = own.join(langs, own.g_lang == langs.lang_k_lang).crossJoin(whole)  # whole: one row
    params = chain.mapInPandas(_shrink, "g_lang string, g_source string, center array<double>, precision array<double>, variance array<double>")
    return common.materialize(params, "mcd-params"), groups


def _matrix(values) -> np.ndarray:
    out = np.zeros((_D, _D))
    for value, (i, j) in zip(values, _PAIRS, strict=True):
        out[i, j] = out[j, i] = value
    return out


def _row(lang: str, source: str, start: int, n: int, center: np.ndarray, scatter: np.ndarray) -> tuple:
    """A state; its scatter can be inverted, as no statistic's spread is below its floor."""
    whole = scatter + np.diag(np.square(FLOORS))
    return lang, source, start, n, float(np.linalg.slogdet(whole)[1]), center.tolist(), scatter.ravel().tolist(), np.linalg.inv(whole).ravel().tolist()


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _starts(frames):
    """The three starts of each group."""
    import pandas as pd

    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            center, unit = np.array(r.center), np.array(r.unit)
            for start, moments in enumerate((None, r.tanh, r.sign)):
                shape = np.eye(_D)
                if moments is not None:
                    shape = _matrix(moments)
                    scale = np.sqrt(np.diag(shape)) + 1e-6
                    shape = shape / np.outer(scale, scale)
                out.append(_row(r.k_lang, r.k_source, start, int(r.n), center, shape * np.outer(unit, unit)))
        yield pd.DataFrame(out, columns=_columns(_STATE))


def _concentrate(bins):
    """The next state from the sums of one group and start by distance bin (some hundred rows at most)."""
    import pandas as pd

    bins = bins.sort_values("bin")
    upto = np.cumsum(bins["n"].to_numpy())
    last = int(np.searchsorted(upto, math.ceil(SUPPORT * upto[-1])))
    mean = np.sum(np.stack(bins["s1"].to_numpy())[: last + 1], axis=0) / upto[last]
    second = np.sum(np.stack(bins["s2"].to_numpy())[: last + 1], axis=0) / upto[last]
    scatter = _matrix(second) - np.outer(mean, mean)
    # Consistency: half of all distances should lie under the chi-squared median, and the support's spread is too small for that.
    middle = math.expm1((bins["bin"].iloc[int(np.searchsorted(upto, upto[-1] / 2))] + 0.5) / 20)
    first = bins.iloc[0]
    row = _row(first["k_lang"], first["k_source"], int(first["start"]), int(upto[-1]), mean, scatter * max(1.0, middle / CHI2_MEDIAN))
    return pd.DataFrame([row], columns=_columns(_STATE))


def _shrink(frames):
    """Parameters of each group with its language's and all rows' beside it."""
    import pandas as pd

    def drawn(n, center, scatter, wide_center, wide_scatter):
        share = n / (n + SHRINK)
        return share * center + (1 - share) * wide_center, share * scatter + (1 - share) * wide_scatter

    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            part = lambda name, r=r: (np.array(getattr(r, f"{name}center")), np.array(getattr(r, f"{name}scatter")).reshape(_D, _D))
            center, scatter = drawn(r.n, *part(""), *drawn(r.lang_n, *part("lang_"), *part("all_")))
            whole = scatter + np.diag(np.square(FLOORS))
            out.append((r.g_lang, r.g_source, center.tolist(), np.linalg.inv(whole).ravel().tolist(), np.diag(whole).tolist()))
        yield pd.DataFrame(out, columns=["g_lang", "g_source", "center", "precision", "variance"])


def judge(vectors: DataFrame, params: DataFrame, groups: int) -> DataFrame:
    """Adds base_failed, distance (squared) and kept. A deviation counts less by the part of its variance that a text of this length has anyway."""
    out = common.attach(vectors, params, ["g_lang", "g_source"], groups)
    deviations = [(F.col(f"x{i}") - F.col("center")[i]) * F.sqrt(F.col("variance")[i] / (F.col("variance")[i] + own)) for i, own in enumerate(sampling())]
    distance = F.coalesce(_distance(deviations), F.lit(0.0))
    return out.withColumn("base_failed", base_failed()).withColumn("distance", distance).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= CUTOFF))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, COUNTS, base_failed, distance, kept of each row.

    Null and empty texts have no words and fail. Repeated rows count each. An empty table gives an
    empty table. A group's few rows are judged by its language's parameters for the most part.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    measured = measure(slim).select(F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), *COUNTS)
    vectors = common.materialize(with_vector(measured, F.col("lang"), F.col("source")), "quality")
    params, groups = estimate(vectors.where(~base_failed()))
    return judge(vectors, params, groups).select("doc_id", *COUNTS, "base_failed", "distance", "kept")


def keep_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that pass, with all their columns. Texts are counted twice instead of shuffled."""
    slim = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    measured = measure(slim).select(F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), *COUNTS)
    vectors = common.materialize(with_vector(measured, F.col("lang"), F.col("source")).where(~base_failed()), "quality")
    params, groups = estimate(vectors)
    whole = with_vector(measure(docs, text_col), F.col("row")[lang_col], F.col("row")[source_col])
    return judge(whole, params, groups).where("kept").select("row.*")
