"""Mixing sources to target weights (problem 8).

Method: the tokens of each source are laid end to end, texts in pseudorandom order,
and cut into blocks of fixed length.  Each output shard draws its number of blocks
per source from the multinomial distribution, conditioned on the mix's totals so that
the targets are met exactly; a source's slots are mapped through a pseudorandom
permutation of its block indices, a new one each time the source is used up, and the
blocks are joined by index.  Positions come from two-level prefix sums over hashed
buckets, so a source with a third of all rows is never in one task.

A mix is as large as all its sources together, or as ``total_tokens`` asks; sources too
small for their share are repeated up to their caps and stop there, and the report shows
the shares reached.  ``total_tokens=EXACT_SHARES`` takes the largest total at which every
source that has tokens holds its share within its cap: exact shares, but no larger than
the scarcest source allows.  Copies of a text count as one text, that of the smallest
doc_id, so that no text comes more often than the cap of its source.

Defined results: shares are relative to the sources of the mix that have tokens; a
source without any, and null or non-positive shares or caps, draw nothing; null and
empty texts have no tokens; a null source is in no mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.storage import Scratch

BLOCK_TOKENS = 64
SHARDS = 16
#: Texts of a bucket of the two-level prefix sum, on average.
BUCKET_TEXTS = 20_000
_RANGE = 65_536
#: ``total_tokens`` of the largest mix with exact shares.
EXACT_SHARES = -1


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..size-1 for each key: a Feistel network with cycle walking."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, todo = index.astype(np.uint64), np.arange(len(index))
    key, size = key.astype(np.uint64), size.astype(np.uint64)
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = value[todo] >> half[todo], value[todo] & mask[todo]
            for turn in range(4):
                mixed = (right + np.uint64(turn + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ key[todo]
                mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(31))) & mask[todo])
            value[todo] = (left << half[todo]) | right
            todo = todo[value[todo] >= size[todo]]
    return value.astype(np.int64)


@F.pandas_udf(T.LongType())
def _permuted_udf(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy()))


def _laid_out(texts: DataFrame, seed: int, bucket_texts: int) -> DataFrame:
    """``texts`` (mix_name, source, doc_id, n_tokens) with the start of each text in its source's row of tokens."""
    n = max(1, -(-texts.count() // bucket_texts))
    mixed = F.xxhash64("doc_id", F.lit(seed))
    rows = texts.withColumn("rank", mixed).withColumn("bucket", F.pmod(F.xxhash64("rank"), F.lit(n)))
    sums = rows.groupBy("mix_name", "source", "bucket").agg(F.sum("n_tokens").alias("size"))
    before = Window.partitionBy("mix_name", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("mix_name", "source", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("mix_name", "source", "bucket").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("local", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(bases, ["mix_name", "source", "bucket"]).select("mix_name", "source", "doc_id", "n_tokens", (F.col("base") + F.col("local")).alias("start"))


def blocks(laid: DataFrame, block_tokens: int) -> DataFrame:
    """(mix_name, source, block_no, doc_id, start_token, n_tokens): the parts of texts in each block."""
    size = F.lit(block_tokens)
    cut = laid.where("n_tokens > 0").withColumn("block_no", F.explode(F.expr(f"sequence(start div {block_tokens}, (start + n_tokens - 1) div {block_tokens})")))
    first = F.greatest(F.col("block_no") * size, F.col("start"))
    past = F.least((F.col("block_no") + 1) * size, F.col("start") + F.col("n_tokens"))
    return cut.select("mix_name", "source", "block_no", "doc_id", (first - F.col("start")).alias("start_token"), (past - first).alias("n_tokens"))


def _plan(sources: pd.DataFrame, block_tokens: int, shards: int, seed: int, total_tokens: int | None) -> list[tuple]:
    """Slots per mix, shard and source; the input has one row per row of the target table."""
    rows = []
    for m, (mix, own) in enumerate(sorted(sources.groupby("mix_name"), key=lambda x: x[0])):
        own = own[(own["tokens"] > 0) & (own["target_share"] > 0) & (own["max_repeats"] > 0)].sort_values("source")
        if own.empty:
            continue
        share = (own["target_share"] / own["target_share"].sum()).to_numpy()
        most = (own["tokens"] * own["max_repeats"]).to_numpy()
        total = int((most / share).min()) if total_tokens == EXACT_SHARES else total_tokens or int(own["tokens"].sum())
        cap = (-(-own["tokens"] // block_tokens) * own["max_repeats"]).to_numpy().astype(np.int64)
        want = share * total / block_tokens
        slots = np.floor(want).astype(np.int64)
        for k in np.argsort(-(want - slots), kind="stable")[: max(0, round(total / block_tokens) - int(slots.sum()))]:
            slots[k] += 1
        left = np.minimum(slots, cap)
        n_blocks = (-(-own["tokens"] // block_tokens)).tolist()
        drawn, random = np.zeros_like(left), np.random.default_rng([seed, m])
        for shard in range(shards):
            # binomials of what is left make the counts of all shards multinomial, each source's total being met; their cost doesn't grow with the counts
            counts = random.binomial(left, 1 / (shards - shard))
            for source, n, first, size in zip(own["source"], counts.tolist(), drawn.tolist(), n_blocks, strict=True):
                if n:
                    rows.append((mix, shard, source, int(first), int(n), int(size)))
            drawn, left = drawn + counts, left - counts
    return rows


def mix(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS, seed: int = 7, total_tokens: int | None = None, bucket_texts: int = BUCKET_TEXTS) -> tuple[DataFrame, DataFrame]:
    """(draws, shares) for ``documents`` (doc_id, source, n_tokens, text_hash).

    draws: mix_name, shard, place, source, block_no, repeat, doc_id, start_token, n_tokens.
    shares: per row of the target table what was available, drawn and reached.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mix")
    targets = targets.where("mix_name IS NOT NULL AND source IS NOT NULL").groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    texts = documents.where("n_tokens > 0").join(targets.select("mix_name", "source"), "source")
    once = texts.groupBy("mix_name", "text_hash").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("t")).select("mix_name", "t.*")
    laid = scratch.save(_laid_out(scratch.save(once), seed, bucket_texts))
    # one number per row of the target table comes to the driver, which plans the draw
    amounts = laid.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"))
    listed = targets.join(amounts, ["mix_name", "source"], "left").fillna({"tokens": 0})
    plan = _plan(listed.toPandas(), block_tokens, shards, seed, total_tokens)
    planned = spark.createDataFrame(plan, "mix_name string, shard int, source string, first bigint, n bigint, n_blocks bigint")
    spans = planned.withColumn("span", F.explode(F.expr(f"sequence(0L, (n - 1) div {_RANGE})")))
    slots = spans.withColumn("slot", F.explode(F.expr(f"sequence(first + span * {_RANGE}, first + least(n, (span + 1) * {_RANGE}) - 1)")))
    slots = slots.withColumn("repeat", F.expr("slot div n_blocks"))
    key = F.xxhash64("mix_name", "source", "repeat", F.lit(seed))
    slots = slots.withColumn("block_no", _permuted_udf(F.expr("slot % n_blocks"), "n_blocks", key)).withColumn("place", F.xxhash64("mix_name", "source", "slot", F.lit(seed)))
    # slots come out of ranges the optimizer takes for single rows, so they must not be broadcast
    draws = slots.hint("merge").join(blocks(laid, block_tokens), ["mix_name", "source", "block_no"])
    draws = scratch.save(draws.select("mix_name", "shard", "place", "source", "block_no", "repeat", "doc_id", "start_token", "n_tokens"))
    drawn = draws.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.max("repeat").alias("last_repeat"))
    by_mix = Window.partitionBy("mix_name")
    report = listed.join(drawn, ["mix_name", "source"], "left").fillna({"drawn_tokens": 0})
    reachable = F.when((F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.col("target_share"))
    shares = report.select(
        "mix_name", "source", "target_share", (reachable / F.sum(reachable).over(by_mix)).alias("reachable_share"),
        (F.col("drawn_tokens") / F.sum("drawn_tokens").over(by_mix)).alias("reached_share"), F.col("tokens").alias("available_tokens"),
        "drawn_tokens", "max_repeats", (F.coalesce("last_repeat", F.lit(-1)) + 1).alias("repeats_used"),
    )
    return draws, shares
