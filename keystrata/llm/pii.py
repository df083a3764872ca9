"""Personal data: base patterns, and candidates chosen by gradient boosted trees.

Everything on the main path is a DataFrame expression of one row: no shuffle, no Python on executors.
Matches of a pattern get their places from the lengths of the text between them. Base matches that pass
their test (numbers up to 255, Luhn, digit counts) always stay. High-recall generators then propose
spans on the text without the base spans; boosted trees score each by format and context, and those
above their kind's threshold are added, best first, where they overlap nothing that was taken.

The candidates of all documents are labelled: by whether they lie on a valid base span, or pass their
kind's test when written in the base form; base spans rewritten into loose forms are added. Equal feature
vectors are counted by Spark. A bounded number of vectors of each kind and label (TRAIN_VECTORS in all) reaches
the driver, where the trees are grown. Thresholds are calibrated on documents that the trees haven't seen: documents
fall into FOLDS by a hash of the row, every fold's candidates, all of them, are scored by trees grown on the other folds,
and a kind's threshold is the least margin at which PRECISION of them carry the label.

Every step's values are bound by a generator (bind()), so no expression is copied into another and plans grow with the
number of steps only.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")

#: Fixed patterns of the four kinds. Possessive repeats and the guard before a run give the same
#: leftmost matches without trying every start inside a long run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\x20\.\x20)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20.-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
}
#: What a text must contain before a kind's patterns are tried.
NEEDS = {"email": "@|[(\\[]at[)\\]]", "ip": r"[0-9](?:\.|\[\.\]|\x20\.\x20)[0-9]", "card": "[0-9]", "phone": "[0-9]"}

TRAIN_VECTORS, PRECISION, FOLDS = 50_000, 0.97, 3
#: Margins are counted in steps of 1 / BINS for the thresholds.
BINS = 1000
#: Places of features().
_LEFT, _RIGHT, _IS_LUHN, _IS_IP, _NAMED, _SPELLED = 3, 4, 6, 7, 8, 11
ROUNDS, DEPTH, RATE, LEAST_WEIGHT = 12, 2, 0.4, 2.0
#: Lengths that are summed together; characters of a text that are cut out together.
CHUNK, BLOCK = 64, 4096

_NONE = "cast(array() as array<struct<start:int,m:string,before:string,after:string>>)"
_DIGITS = "regexp_replace({m}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Whether a string of at most 19 digits passes Luhn's test."""
    one = f"int(substr({digits}, length({digits}) + 1 - i, 1))"
    doubled = f"if(i % 2 = 0, if(2 * {one} > 9, 2 * {one} - 9, 2 * {one}), {one})"
    return f"(length({digits}) between 1 and 19 and aggregate(transform(sequence(1, length({digits})), i -> {doubled}), 0, (a, b) -> a + b) % 10 = 0)"


def _octets(m: str) -> str:
    return f"forall(split({m}, '[^0-9]+'), p -> length(ltrim('0', p)) < 3 or length(ltrim('0', p)) = 3 and ltrim('0', p) <= '255')"


def _valid(kind: str, m: str) -> str:
    """SQL: whether a base match passes its kind's test."""
    digits = _DIGITS.format(m=m)
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return f"(length({digits}) between 16 and 19 and {_luhn(digits)})"
    if kind == "phone":
        return f"(length({digits}) between 8 and 15)"
    return "true"


def bind(df: DataFrame, **made: Column) -> DataFrame:
    """df with these columns, each computed once a row.

    They come out of a generator of one row: the optimiser copies no expression through it and pushes no filter on them below it.
    """
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in made), F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], out: str) -> DataFrame:
    """Adds ``out``_<kind>: (start in code points, m, 24 characters before, 8 after) of the leftmost matches.

    Starts are sums of the lengths before them, taken in chunks, so that a text with many matches
    costs little more than its length.
    """
    none = F.expr("cast(array() as array<string>)")
    df = bind(df, **{f"_m_{k}": F.when(F.col(text).rlike(NEEDS[k]), F.regexp_extract_all(F.col(text), F.lit(f"({p})"), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    df = bind(df, **{f"_s_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(F.col(text), p, -1)).otherwise(none) for k, p in patterns.items()})
    df = bind(df, **{f"_l_{k}": F.expr(f"zip_with(_s_{k}, _m_{k}, (a, b) -> length(a) + coalesce(length(b), 0))") for k in patterns})
    sums = f"transform(sequence(0, cast((size(_l) - 1) div {CHUNK} as int)), j -> aggregate(slice(_l, j * {CHUNK} + 1, {CHUNK}), 0, (a, b) -> a + b))"
    firsts = f"if(size(_m) > 0, aggregate({sums}, array(0), (acc, v) -> concat(acc, array(element_at(acc, -1) + v))), array(0))"
    own = lambda expr, k: re.sub(r"\b_([mslf])\b", rf"_\1_{k}", expr)
    df = bind(df, **{f"_f_{k}": F.expr(own(firsts, k)) for k in patterns})
    start = f"get(_f, cast(i div {CHUNK} as int)) + aggregate(slice(_l, cast(i div {CHUNK} as int) * {CHUNK} + 1, i % {CHUNK}), 0, (a, b) -> a + b) + length(get(_s, i))"
    each = f"transform(_m, (m, i) -> named_struct('start', {start}, 'm', m, 'before', right(get(_s, i), 24), 'after', left(get(_s, i + 1), 8)))"
    df = bind(df, **{f"{out}_{k}": F.expr(own(each, k)) for k in patterns})
    return df.drop(*(f"_{x}_{k}" for x in "mslf" for k in patterns))


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds base_<kind>: valid base matches; and ``_rest``: the text with them overwritten."""
    df = with_matches(df, text, BASE, "base")
    df = bind(df, **{f"base_{kind}": F.expr(f"filter(base_{kind}, x -> {_valid(kind, 'x.m')})") for kind in KINDS})
    df = df.withColumn("_rest", F.col(text))
    for kind in KINDS:  # on the rest, as an earlier kind's span may have been overwritten already
        some = F.size(f"base_{kind}") > 0
        df = bind(df, _m=F.when(some, F.regexp_extract_all(F.col("_rest"), F.lit(f"({BASE[kind]})"), F.lit(0))))
        df = bind(df, _s=F.when(F.size("_m") > 0, F.split(F.col("_rest"), BASE[kind], -1)))
        blank = f"zip_with(_s, _m, (a, b) -> concat(a, coalesce(if({_valid(kind, 'b')}, repeat('\\u0001', length(b)), b), '')))"
        df = bind(df, _rest=F.when(F.size("_m") > 0, F.array_join(F.expr(blank), "")).otherwise(F.col("_rest")))
    return df.drop("_m", "_s")


def features(c: str = "c") -> list[str]:
    """SQL of whole numbers that describe the format and the context of a candidate struct."""
    digits = _DIGITS.format(m=f"{c}.m")
    beside = lambda x, more: f"case when {x} = '' or {x} rlike '[\\\\s]' then 0 when {more} then 2 else 1 end"
    return [
        f"length({digits})", f"length({c}.m)", f"length(regexp_replace({c}.m, '[A-Za-z0-9]', ''))",
        beside(f"right({c}.before, 1)", f"{c}.before rlike '[A-Za-z0-9][-./_]?$'"), beside(f"left({c}.after, 1)", f"{c}.after rlike '^[-./_]?[A-Za-z0-9]'"), f"int(left({c}.m, 1) = '+')", f"int({_luhn(digits)})", f"int({_octets(f'{c}.m')})",
        f"int(lower({c}.before) rlike 'mail|phone|tel|call|fax|card|visa|pay|addr|host|contact|number')",
        f"size(array_distinct(transform(sequence(1, least(length({digits}), 19)), i -> substr({digits}, i, 1))))", f"length(regexp_extract({c}.m, '[.]([A-Za-z]+)$', 1))",
        f"case when {c}.m rlike '[(\\\\[](at|dot)[)\\\\]]' then 1 when {c}.m rlike ' [@.]|[@.] ' then 2 else 0 end",
    ]


def candidates(df: DataFrame, text: str) -> DataFrame:
    """Adds cand_<kind>: what the generators propose, spans of different kinds may overlap."""
    return with_matches(df, text, LOOSE, "cand")


class Trees:
    """Gradient boosted trees over counted feature vectors (logistic loss), written out as SQL."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        total, ones = weight.sum(), (weight * y).sum()
        rate = min(max(ones / total, 1e-4), 1 - 1e-4)
        self.first = math.log(rate / (1 - rate))
        self.trees: list = []
        margin = np.full(len(y), self.first)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, weight * (y - p), weight * p * (1 - p), weight, DEPTH)
            self.trees.append(tree)
            margin += self._value(tree, x)
        self.margin = margin

    def _grow(self, x, g, h, weight, depth):
        leaf = RATE * g.sum() / (h.sum() + 1.0)
        best = (1e-6, None, None)
        base = g.sum() ** 2 / (h.sum() + 1.0)
        for f in range(x.shape[1] if depth else 0):
            values, code = np.unique(x[:, f], return_inverse=True)
            lg, lh, lw = (np.cumsum(np.bincount(code, z))[:-1] for z in (g, h, weight))
            gain = lg**2 / (lh + 1.0) + (g.sum() - lg) ** 2 / (h.sum() - lh + 1.0) - base
            gain[np.minimum(lw, weight.sum() - lw) < LEAST_WEIGHT] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, int(values[gain.argmax()]))
        if best[1] is None:
            return float(leaf)
        left = x[:, best[1]] <= best[2]
        return (best[1], best[2], *(self._grow(x[s], g[s], h[s], weight[s], depth - 1) for s in (left, ~left)))

    def _value(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], self._value(tree[2], x), self._value(tree[3], x))

    def sql(self, v: str) -> str:
        def write(tree) -> str:
            return repr(tree) + "D" if isinstance(tree, float) else f"if(get({v}, {tree[0]}) <= {tree[1]}, {write(tree[2])}, {write(tree[3])})"

        return " + ".join([f"{self.first!r}D", *map(write, self.trees)])


def _label(c: str = "c") -> str:
    """SQL: 1 where a candidate off the valid base spans can be told to be of its kind, else 0.

    It has to pass its kind's test when it is written in the base form, and may not be a piece of a longer token. Forms
    that anything else may have as well are 0: an address with spaces around plain signs, and a bare run of digits
    as a phone without a word before it that says so.
    """
    digits, v = _DIGITS.format(m=f"{c}.m"), "v"
    passes = {
        "email": f"get({v}, {_SPELLED}) < 2",
        "ip": f"get({v}, {_IS_IP}) = 1",
        "card": f"length({digits}) between 13 and 19 and get({v}, {_IS_LUHN}) = 1",
        "phone": f"length({digits}) between 8 and 15 and ({c}.m rlike '[^0-9]' or get({v}, {_NAMED}) = 1)",
    }
    return f"int(get({v}, {_LEFT}) < 2 and get({v}, {_RIGHT}) < 2 and case kind {' '.join(f'when {chr(39)}{k}{chr(39)} then {x}' for k, x in passes.items())} end)"


def count_vectors(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, y, v, fold, n: feature vectors of the candidates of all documents by label and fold, with their weights.

    Candidates on a valid base span are of its kind, and so are valid base spans rewritten into a loose form at their
    place; others by _label(). One in ten runs of digits passes Luhn's test by chance. So for nine that don't, of 13 to 15
    digits (where base spans don't go by that test), one is counted that does and isn't a card.
    """
    fold = F.pmod(common.row_hash(docs), F.lit(FOLDS)).cast("int")  # copies under other ids are in all folds
    rows = candidates(with_base(docs.select(F.col(text_col).alias("text"), fold.alias("fold")).where("text is not null")), "text")
    on_base = lambda kind: f"exists(base_{kind}, b -> b.start < c.start + length(c.m) and c.start < b.start + length(b.m))"
    digits = _DIGITS.format(m="b.m")
    loose = {
        "email": "replace(replace(b.m, '@', ' (at) '), '.', ' (dot) ')",
        "ip": "replace(b.m, '.', '[.]')",
        "card": f"concat_ws('.', substr({digits}, 1, 4), substr({digits}, 5, 4), substr({digits}, 9, 4), substr({digits}, 13))",
        "phone": f"right({digits}, 10)",
    }
    named = [f"transform(cand_{kind}, c -> named_struct('kind', '{kind}', 'on', {on_base(kind)}, 'c', c))" for kind in KINDS]
    named += [f"transform(base_{kind}, b -> named_struct('kind', '{kind}', 'on', true, 'c', named_struct('start', b.start, 'm', {loose[kind]}, 'before', b.before, 'after', b.after)))" for kind in KINDS]
    each = rows.select("fold", F.explode(F.expr(f"concat({', '.join(named)})")).alias("x")).select("fold", "x.*")
    each = bind(bind(each, v=F.expr(f"array({', '.join(features())})")), y=F.expr(f"if(on, 1, {_label()})"))
    by_chance = f"kind = 'card' and not on and get(v, 0) between 13 and 15 and get(v, {_IS_LUHN}) = 0"
    twin = f"transform(v, (x, i) -> if(i = {_IS_LUHN}, 1, x))"
    each = each.withColumn("r", F.explode(F.expr(f"if({by_chance}, array(named_struct('v', v, 'w', 9L), named_struct('v', {twin}, 'w', 1L)), array(named_struct('v', v, 'w', 9L)))")))
    return each.groupBy("kind", "y", "fold", F.col("r.v").alias("v")).agg((F.sum("r.w") / 9).alias("n"))


def train(docs: DataFrame, text_col: str = "text") -> dict[str, tuple[Trees, float]]:
    """Trees and threshold (a margin) of each kind with candidates that carry the label, anywhere in the table.

    The counted vectors of all documents are written once. Trees are fitted to a bounded number of distinct vectors of each
    kind and label (all of them unless there are more). Thresholds come from the counts of all, each document scored by
    trees of the other folds; a kind without a margin of the wanted precision there gets none.
    """
    counted = common.materialize(count_vectors(docs, text_col).coalesce(16), "vectors")  # a small table, whatever the number of partitions
    most = TRAIN_VECTORS // (2 * len(KINDS))
    share = {(r.kind, r.y): min(1.0, most / r["count"]) for r in counted.groupBy("kind", "y").count().collect()}
    if not any(y for _, y in share):
        return {}
    part = " ".join(f"when kind = '{kind}' and y = {y} then {int(x * (1 << 30))}" for (kind, y), x in share.items())
    fitted = counted.where(F.expr(f"pmod(xxhash64(v, fold), {1 << 30}) < case {part} end")).collect()
    grown, margins = {}, []
    for kind in KINDS:
        own = sorted((r.v, r.y, r.n / share[kind, r.y], r.fold) for r in fitted if r.kind == kind)
        if not any(y for _, y, _, _ in own):
            continue
        x, y, weight, fold = (np.array(c, t) for c, t in zip(zip(*own, strict=True), (np.int64, float, float, int), strict=True))
        grown[kind] = Trees(x, y, weight)
        for k in range(FOLDS):
            rest = fold != k
            margins.append(f"when kind = '{kind}' and fold = {k} then {Trees(x[rest], y[rest], weight[rest]).sql('v') if rest.any() else f'{grown[kind].first!r}D'}")
    if not grown:
        return {}
    sums = counted.withColumn("bin", F.expr(f"floor((case {' '.join(margins)} end) * {BINS})")).where("bin is not null").groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("good")).collect()
    common.drop(counted)
    out = {}
    for kind, trees in grown.items():
        own = sorted(((r.bin, r.good, r.n) for r in sums if r.kind == kind), reverse=True)
        bins, good, all_ = (np.array(c, float) for c in zip(*own, strict=True))
        fit = np.flatnonzero((np.cumsum(good) >= PRECISION * np.cumsum(all_) - 1e-9) & (good > 0))
        if len(fit):
            out[kind] = (trees, float(bins[fit[-1]] / BINS))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (array of kind:start:end), spans (base and added ones, likewise).

    A null or empty text has no spans. Rows are independent, so repeated ids and rows don't matter. An
    empty table gives an empty table. Other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = _with_spans(slim, train(docs, text_col) if model is None else model)
    name = lambda which: F.flatten(F.array(*(F.expr(f"transform(array_sort({which.format(kind=k)}), x -> concat_ws(':', '{k}', x.s, x.e))") for k in KINDS)))
    return df.select("doc_id", *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS), name("_base_{kind}").alias("base"), name("concat(_base_{kind}, _added_{kind})").alias("spans"))


def _with_spans(df: DataFrame, model: dict) -> DataFrame:
    """Adds base_<kind>, _base_<kind> and _added_<kind> (arrays of s, e)."""
    df = with_base(df)
    df = candidates(df, "_rest") if model else df
    spans = "cast(array() as array<struct<score:double,kind:string,s:int,e:int>>)"
    if model:
        df = bind(df, **{f"_v_{kind}": F.expr(f"transform(cand_{kind}, c -> named_struct('s', c.start, 'e', c.start + length(c.m), 'v', array({', '.join(features())})))") for kind in model})
        scored = [f"filter(transform(_v_{kind}, r -> named_struct('score', -({trees.sql('r.v')}), 'kind', '{kind}', 's', r.s, 'e', r.e)), r -> r.score <= {-threshold!r}D and r.e > r.s)" for kind, (trees, threshold) in model.items()]
        df = bind(df, _all=F.expr(f"array_sort(concat({', '.join(scored)}))")).drop(*(f"_v_{kind}" for kind in model))
    else:
        df = df.withColumn("_all", F.expr(spans))
    df = bind(df, _all=F.expr(f"aggregate(_all, {spans}, (acc, c) -> if(exists(acc, a -> a.s < c.e and c.s < a.e), acc, concat(acc, array(c))))"))
    made = {f"_base_{kind}": F.expr(f"transform(base_{kind}, x -> named_struct('s', x.start, 'e', x.start + length(x.m)))") for kind in KINDS}
    made |= {f"_added_{kind}": F.expr(f"transform(filter(_all, x -> x.kind = '{kind}'), x -> named_struct('s', x.s, 'e', x.e))") for kind in KINDS}
    return bind(df, **made)


def with_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of its text replaced by [EMAIL], [IP], [CARD] or [PHONE]; all columns stay. Null texts stay null.

    Spans that overlap are replaced together, under the name of the first.
    """
    model = train(docs, text_col)
    own = [f"_r{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    rows = docs.select(*(F.col(f"`{c}`").alias(r) for c, r in zip(docs.columns, own, strict=True)), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    df = _with_spans(rows, model)
    every = ", ".join(f"transform(concat(_base_{k}, _added_{k}), x -> named_struct('s', x.s, 'e', x.e, 'k', '{k}'))" for k in KINDS)
    df = bind(df.select(*own, "text", *(f"_{x}_{k}" for x in ("base", "added") for k in KINDS)), _spans=F.expr(f"array_sort(concat({every}))")).select(*own, "text", "_spans")
    merged = "aggregate(_spans, cast(array() as array<struct<s:int,e:int,k:string>>), (acc, c) -> if(size(acc) > 0 and element_at(acc, -1).e > c.s, concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', greatest(element_at(acc, -1).e, c.e), 'k', element_at(acc, -1).k))), concat(acc, array(c))))"
    df = bind(df, _spans=F.expr(merged))
    # The text in blocks, as a cut costs the length before it.
    df = bind(df, _blocks=F.when(F.size("_spans") > 0, F.expr(f"transform(sequence(0, cast(length(text) div {BLOCK} as int)), i -> substring(text, i * {BLOCK} + 1, {BLOCK}))")))
    at = lambda x: f"cast({x} div {BLOCK} as int)"
    piece = lambda a, e: f"if({at(a)} = {at(e)}, substring(get(_blocks, {at(a)}), {a} % {BLOCK} + 1, {e} - {a}), concat(substring(get(_blocks, {at(a)}), {a} % {BLOCK} + 1), array_join(slice(_blocks, {at(a)} + 2, {at(e)} - {at(a)} - 1), ''), substring(get(_blocks, {at(e)}), 1, {e} % {BLOCK})))"
    before = piece("if(i = 0, 0, get(_spans, i - 1).e)", "x.s")
    parts = f"concat(transform(_spans, (x, i) -> concat({before}, '[', upper(x.k), ']')), array({piece('element_at(_spans, -1).e', 'length(text)')}))"
    df = bind(df, _new=F.when(F.size("_spans") > 0, F.array_join(F.expr(parts), "")).otherwise(F.col("text")))
    return df.select(*((F.when(F.col(r).isNotNull(), F.col("_new")) if c == text_col else F.col(r)).alias(c) for c, r in zip(docs.columns, own, strict=True)))
