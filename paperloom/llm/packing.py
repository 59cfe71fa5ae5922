"""Filling fixed-capacity containers with whole texts (problem 7).

Method: best-two-fit.  A container is filled greedily with the largest texts that
still fit; then its smallest text is replaced by two unpacked ones if they fill the
widened gap more tightly.  Sizes are counted once, hashed into shards of about
``SHARD_ITEMS`` texts, and each (capacity, shard) is packed on its own: the work of a
task is bounded, whatever the size or skew of the corpus, and a shard wastes at most
its last container.  Only (id, size) pairs are shuffled.

A text larger than the capacity is cut into full containers and a rest that is packed
like a text; no other text is split.  Defined results: null and empty texts have no
tokens and lie in the first container of their shard; equal sizes are taken in id
order; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of a shard, on average.
SHARD_ITEMS = 25_000
#: Capacities of one pass over the sizes; more take several passes.
PASS_CAPACITIES = 500


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item (sizes between 0 and ``capacity``)."""
    place = np.zeros(len(sizes), dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    stacks: dict[int, list[int]] = {}
    for i in order[::-1].tolist():  # the earliest item of a size lies on top
        if (s := int(sizes[i])) > 0:
            stacks.setdefault(s, []).append(i)
    count = np.zeros(capacity + 1, dtype=np.int64)
    available = 0  # bit s: an item of size s is unpacked
    for s, items in stacks.items():
        count[s] = len(items)
        available |= 1 << s

    def take(s: int) -> int:
        nonlocal available
        count[s] -= 1
        if not count[s]:
            available ^= 1 << s
        return stacks[s].pop()

    def give_back(s: int, item: int) -> None:
        nonlocal available
        stacks[s].append(item)
        count[s] += 1
        available |= 1 << s

    number = 0
    while available:
        gap, held = capacity, []
        while fits := available & ((1 << (gap + 1)) - 1):
            s = fits.bit_length() - 1
            held.append((s, take(s)))
            gap -= s
        if gap and len(held) > 1:
            low, item = held[-1]  # greedy takes sizes in falling order
            pair = _two_within(count, low + gap, low)
            if pair:
                held.pop()
                held += [(s, take(s)) for s in pair]
                give_back(low, item)
        for _, item in held:
            place[item] = number
        number += 1
    return place


def _two_within(count: np.ndarray, room: int, above: int) -> tuple[int, int] | None:
    """The two unpacked sizes with the largest sum in (above, room]."""
    sizes = np.flatnonzero(count[: room + 1])
    if not len(sizes):
        return None
    partner = np.searchsorted(sizes, room - sizes, side="right") - 1
    twin = (partner >= 0) & (sizes[partner] == sizes) & (count[sizes] < 2)
    partner = np.where(twin, partner - 1, partner)
    sums = np.where(partner >= 0, sizes + sizes[partner], 0)
    best = int(sums.argmax())
    return (int(sizes[best]), int(sizes[partner[best]])) if sums[best] > above else None


_PIECES = "bin_name string, container string, doc_id bigint, piece_no bigint, start_token bigint, n_tokens bigint"


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("doc_id", kind="stable").reset_index(drop=True)
    numbers = best_two_fit(rows["n_tokens"].to_numpy(), int(rows["capacity_tokens"].iloc[0]))
    rows["container"] = [f"s{key[1]}-{n}" for n in numbers.tolist()]
    return rows[["bin_name", "container", "doc_id", "piece_no", "start_token", "n_tokens"]]


def containers(sized: DataFrame, bins: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Pieces of ``sized`` (doc_id, n_tokens) in containers of each capacity of ``bins``.

    ``sized`` is counted once for the number of shards; pass a stored table.
    """
    shards = max(1, -(-sized.count() // shard_items))
    bins = bins.select("bin_name", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")).where("capacity_tokens > 0").distinct()
    # the list of capacities is the caller's configuration, as short as a person writes it
    sizes = bins.orderBy("bin_name", "capacity_tokens").collect()
    if len(sizes) > PASS_CAPACITIES:
        parts = [sized.sparkSession.createDataFrame(sizes[i : i + PASS_CAPACITIES], bins.schema) for i in range(0, len(sizes), PASS_CAPACITIES)]
        return reduce(DataFrame.unionByName, [containers(sized, part, shard_items) for part in parts])
    listed = F.array(*[F.struct(F.lit(r[0]).alias("bin_name"), F.lit(r[1]).cast("bigint").alias("capacity_tokens")) for r in sizes])
    if not sizes:
        return sized.sparkSession.createDataFrame([], _PIECES)
    items = sized.select("doc_id", "n_tokens", F.explode(listed).alias("b")).select("doc_id", "n_tokens", "b.*")
    items = items.withColumn("whole", F.expr("n_tokens div capacity_tokens"))
    full = items.where("whole > 0").select("bin_name", "doc_id", "capacity_tokens", F.explode(F.expr("sequence(0L, whole - 1)")).alias("piece_no"))
    full = full.select(
        "bin_name", F.format_string("d%d-%d", "doc_id", "piece_no").alias("container"), "doc_id", "piece_no",
        (F.col("piece_no") * F.col("capacity_tokens")).alias("start_token"), F.col("capacity_tokens").alias("n_tokens"),
    )
    rest = items.select(
        "bin_name", "capacity_tokens", "doc_id", F.col("whole").alias("piece_no"), F.expr("whole * capacity_tokens").alias("start_token"),
        F.expr("n_tokens - whole * capacity_tokens").alias("n_tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"),
    ).where("n_tokens > 0 OR piece_no = 0")
    return full.unionByName(rest.groupBy("bin_name", "shard").applyInPandas(_pack, _PIECES))


def fill_report(pieces: DataFrame, bins: DataFrame) -> DataFrame:
    """Per capacity: containers used, the least number possible and the share of space filled."""
    used = pieces.groupBy("bin_name", "container").agg(F.sum("n_tokens").alias("n")).groupBy("bin_name").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    room = F.col("capacity_tokens").cast("bigint")
    return used.join(bins.distinct(), "bin_name").select(
        "bin_name", "capacity_tokens", "containers", "tokens",
        F.expr("CAST(ceil(tokens / capacity_tokens) AS BIGINT)").alias("least_containers"), (F.col("tokens") / (F.col("containers") * room)).alias("filled_share"),
    )
