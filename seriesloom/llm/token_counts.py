"""Token counts: exact histogram of encoded lengths.

Documents are encoded once; only their lengths are aggregated. The histogram has one row per distinct length, and
suffix sums over it answer, for every context limit, how many documents are at least that long, what they hold
together and what remains when each is truncated to the limit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written
from .textops import slices, small_batches

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-splitting pattern published with this vocabulary. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[str, object] = {}


def encoder(ranks: str):
    if ranks not in _encoders:
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[ranks] = tiktoken.Encoding("lengths", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _encoders[ranks]


def document_lengths(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """(id, n_tokens) per document; a null or empty text has 0 tokens, special-token strings are ordinary text."""
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            for b in slices(batch, "text"):
                n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(encode, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)


def length_histogram(lengths: DataFrame, *, length: str = "n_tokens", block: int = 256) -> DataFrame:
    """Per distinct length L: documents of that length, and for the limit L the suffix sums over the histogram.

    Columns: n_tokens, n_docs, docs_at_least, tokens_at_least, docs_at_most, tokens_at_most (documents of at most L and
    their tokens), truncated_total (sum of min(length, L)), rank_from and rank_to (1-based ranks that have this length:
    quantile q is the row with rank_from <= ceil(q * docs) <= rank_to). Null lengths are left out; an empty input gives
    no rows. The histogram is already tiny beside the documents; its suffix sums still run in blocks of lengths, so no
    task reads them all.
    """
    hist = lengths.where(F.col(length).isNotNull()).groupBy(F.col(length).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    hist = written(hist, "histogram")  # encoding is the costly part and runs once
    hist = hist.withColumn("b", F.floor(F.col("n_tokens") / block).cast("long")).withColumn("t", F.col("n_tokens") * F.col("n_docs"))
    per = hist.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt"))
    per = per.withColumn("s", F.floor(F.col("b") / block).cast("long"))
    top = per.groupBy("s").agg(F.sum("bd").alias("sd"), F.sum("bt").alias("st"))
    after = lambda part, order: Window.partitionBy(*part).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    top = top.select("s", run("sd", after([F.lit(0)], "s")).alias("sd"), run("st", after([F.lit(0)], "s")).alias("st"))
    per = per.join(F.broadcast(top), "s").select("b", (run("bd", after(["s"], "b")) + F.col("sd")).alias("bd"), (run("bt", after(["s"], "b")) + F.col("st")).alias("bt"))
    w = after(["b"], "n_tokens")
    out = hist.join(per, "b").select("n_tokens", "n_docs", "t", (run("n_docs", w) + F.col("bd")).alias("above"), (run("t", w) + F.col("bt")).alias("t_above"))
    whole = hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
    return out.crossJoin(F.broadcast(whole)).select(
        "n_tokens", "n_docs",
        (F.col("above") + F.col("n_docs")).alias("docs_at_least"), (F.col("t_above") + F.col("t")).alias("tokens_at_least"),
        (F.col("docs") - F.col("above")).alias("docs_at_most"), (F.col("tokens") - F.col("t_above")).alias("tokens_at_most"),
        (F.col("tokens") - F.col("t_above") + F.col("above") * F.col("n_tokens")).alias("truncated_total"),
        (F.col("docs") - F.col("above") - F.col("n_docs") + 1).alias("rank_from"), (F.col("docs") - F.col("above")).alias("rank_to"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents over it, and the tokens kept when every document is truncated to it.

    The suffix sums of the first length above a limit answer it, whether the limit is a length that occurs or not; one pass
    finds them for all limits. An empty histogram gives no rows.
    """
    first = [F.min(F.when(F.col("n_tokens") > c, F.struct("n_tokens", "docs_at_least", "tokens_at_least"))).alias(f"above{k}") for k, c in enumerate(limits)]
    found = histogram.agg(F.max("docs_at_least").alias("docs"), F.max("tokens_at_least").alias("tokens"), *first).where("docs is not null")
    each = F.explode(F.array(*[F.struct(F.lit(int(c)).cast("long").alias("context_limit"), F.col(f"above{k}").alias("above")) for k, c in enumerate(limits)]))
    over, longer = F.coalesce("at.above.docs_at_least", F.lit(0)), F.coalesce("at.above.tokens_at_least", F.lit(0))
    return found.select("docs", "tokens", each.alias("at")).select(
        "at.context_limit", F.col("docs").alias("n_docs"), over.cast("long").alias("n_over"),
        (F.col("tokens") - longer + over * F.col("at.context_limit")).cast("long").alias("kept_tokens"), F.col("tokens").alias("all_tokens"),
    )


def quantile(histogram: DataFrame, qs: list[float]) -> DataFrame:
    """Exact lower quantiles: the length of rank max(1, ceil(q * documents))."""
    n = histogram.agg(F.max("rank_to").alias("docs"))
    want = n.select("docs", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("docs"))))
    return histogram.join(F.broadcast(want), (F.col("rank_from") <= F.col("rank")) & (F.col("rank") <= F.col("rank_to"))).select("q", F.col("n_tokens").alias("length"))
