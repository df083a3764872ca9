"""Exact length histogram: token counts of a corpus for every context limit.

Documents are counted by encoded length (partial counts leave each slice, so the shuffle holds
one row per length and task at most). Suffix sums over the histogram answer totals, quantiles and
truncated totals for each occurring length, and for any other limit by at_limits(). Prefixes run inside blocks of lengths, with block totals added,
so no single task has to hold the histogram.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens, workers

COUNTS = pa.schema([("n_tokens", pa.int64()), ("n_docs", pa.int64())])
BLOCK = 1024


def histogram(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text") -> DataFrame:
    """n_tokens (with the end id), n_docs. Null and empty texts have length 1; repeated rows count each."""
    path = tokenizer or tokens.default_path("byte_bpe_50k.json")

    @workers.task("lengths")
    def run(batches):
        encode = tokens.encoder(path).encode
        for batch in common.slices(batches, ["text"]):
            counts = Counter(len(ids) // 4 + 1 for ids in encode(batch.column("text").to_pylist()))
            yield common.arrow_batch(COUNTS, n_tokens=list(counts), n_docs=list(counts.values()))

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per occurring length, taken as a context limit.

    limit_tokens, n_docs (of this length), docs_longer, tokens_total (of the corpus), docs_total,
    tokens_up_to (in documents no longer), tokens_truncated (kept when each document is cut at the
    limit), tokens_lost, and share_of_docs (documents no longer, of all). An empty histogram gives
    an empty result.
    """
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("mass", F.col("n_docs") * F.col("n_tokens"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("mass").alias("t"))
    # One row per 1024 lengths: a few hundred rows, whatever the number of documents.
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "dt"), *(F.sum(c).over(everything).alias(f"{c}_all") for c in "dt"))
    upto = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.join(blocks, "block").withColumns({"docs": F.col("d_before") + F.sum("n_docs").over(upto), "up": F.col("t_before") + F.sum("mass").over(upto)})
    longer = F.col("d_all") - F.col("docs")
    kept = F.col("up") + longer * F.col("n_tokens")
    return rows.select(
        F.col("n_tokens").alias("limit_tokens"), "n_docs", longer.alias("docs_longer"), F.col("t_all").alias("tokens_total"), F.col("d_all").alias("docs_total"),
        F.col("up").alias("tokens_up_to"), kept.alias("tokens_truncated"), (F.col("t_all") - kept).alias("tokens_lost"), (F.col("docs") / F.col("d_all")).alias("share_of_docs"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit_tokens, docs_longer, tokens_total, docs_total, tokens_up_to, tokens_truncated, tokens_lost of each given limit, as in suffix_sums().

    Limits may lie between, below and beyond the occurring lengths; repeated ones give one row. An empty histogram gives
    an empty result.
    """
    each = suffix_sums(hist).withColumn("limit", F.explode(F.array_distinct(F.array(*(F.lit(x).cast("long") for x in limits)))))
    below = F.max(F.when(F.col("limit_tokens") <= F.col("limit"), F.struct("limit_tokens", "docs_longer", "tokens_up_to")))
    rows = each.groupBy("limit").agg(below.alias("b"), F.max("tokens_total").alias("tokens_total"), F.max("docs_total").alias("docs_total"))
    rows = rows.withColumns({"docs_longer": F.coalesce("b.docs_longer", "docs_total"), "tokens_up_to": F.coalesce("b.tokens_up_to", F.lit(0).cast("long"))})
    kept = F.col("tokens_up_to") + F.col("docs_longer") * F.col("limit")
    return rows.select(F.col("limit").alias("limit_tokens"), "docs_longer", "tokens_total", "docs_total", "tokens_up_to", kept.alias("tokens_truncated"), (F.col("tokens_total") - kept).alias("tokens_lost"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of all documents doesn't exceed."""
    sums = suffix_sums(hist).select("limit_tokens", "share_of_docs")
    return sums.select("limit_tokens", F.explode(F.array(*(F.when(F.col("share_of_docs") >= q, F.lit(q)) for q in shares))).alias("share")).where("share is not null").groupBy("share").agg(F.min("limit_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text") -> DataFrame:
    """The histogram is written once, so that texts are encoded once for all sums over it."""
    return suffix_sums(common.materialize(histogram(docs, tokenizer, text_col), "lengths"))
