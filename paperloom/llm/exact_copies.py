"""Duplicates hidden by formatting differences (problem 6).

Records are reduced to a canonical key, range-partitioned on (key, id), sorted
within the partitions (Spark's sort spills to disk) and scanned: adjacent rows with
equal full keys form a run.  The range is over the pair, so a run of copies of any
length, even a third of all rows, spreads over many partitions; one border row per
partition (its first and last key) then tells which leading runs continue the run
of the partition before.  Only these border rows, one or two per partition and so
bounded by the number of partitions, pass through a single task.

Defined results: null and blank titles are one empty title; an absent or placeholder
identifier equals only an absent one; an empty table gives no rows; repeated ids are
kept as written; input columns other than the named ones are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.ids import work_ids
from paperloom.storage import Scratch

_SEPARATOR = "\u0001"


def _fold(text: str) -> str:
    """Compatibility form, case folded, without separators, punctuation and control characters."""
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in text if unicodedata.category(c)[0] not in "ZPC")


@F.pandas_udf(T.StringType())
def _fold_udf(titles: pd.Series) -> pd.Series:
    return titles.map(_fold, na_action="ignore")


def title_key(title: Column) -> Column:
    """Title without case, whitespace, invisible characters, punctuation and Unicode form.

    Plain ASCII, the great majority, stays in the JVM; only other titles visit Python.
    """
    ascii_only = ~title.rlike(r"[^\x00-\x7F]")
    plain = F.regexp_replace(F.lower(title), r"[\s\p{P}\p{Cc}]", "")
    return F.coalesce(F.when(ascii_only, plain), _fold_udf(F.when(~ascii_only, title)), F.lit(""))


def followup_keys(followups: DataFrame) -> DataFrame:
    """(id, key): the canonical record of title, DOI and arXiv id."""
    doi, arxiv = work_ids(F.col("doi"), F.col("arxivid"))
    key = F.concat_ws(_SEPARATOR, title_key(F.col("title")), F.coalesce(doi, F.lit("")), F.coalesce(arxiv, F.lit("")))
    return followups.select(F.col("followup_id").alias("id"), key.alias("key"))


_SCANNED = "id bigint, head bigint, head_key string, leading boolean, border int, border_key string, part int"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run heads of one sorted partition; constant memory, whatever the length of a run.

    ``border`` is 1 on the partition's first row and 2 on a closing row without an id,
    which carries the last key and the head of its run.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last_key, head, leading, first = None, None, True, True

    def batch(ids, heads, lead, border, keys):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(heads, pa.int64()), pa.nulls(n, pa.string()), pa.array(lead, pa.bool_()), pa.array(border, pa.int32()), pa.array(keys, pa.string()), pa.array([part] * n, pa.int32())],
            names=["id", "head", "head_key", "leading", "border", "border_key", "part"],
        )

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        starts = np.ones(n, dtype=bool)
        starts[0] = keys[0].as_py() != last_key
        starts[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        # the head of a row is the id at the last start before it, or that of the batch before
        at = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
        heads = np.where(at >= 0, ids[np.maximum(at, 0)], -1 if head is None else head)
        opened = np.cumsum(starts) - (1 if first else 0)
        lead = leading & (opened <= 0)
        head, leading = int(heads[-1]), bool(lead[-1])
        border, border_keys = [None] * n, [None] * n
        if first:
            border[0], border_keys[0], first = 1, keys[0].as_py(), False
        last_key = keys[n - 1].as_py()
        yield batch(ids, heads, lead, border, border_keys)
    if last_key is not None:
        yield batch([None], [head], [leading], [2], [last_key])


def copies(keyed: DataFrame, partitions: int | None = None) -> DataFrame:
    """(kept_id, id) for every row of ``keyed`` (id, key): kept_id is the smallest id of its key.

    ``partitions``: number of range partitions; default: the session's shuffle partitions.
    """
    spark = keyed.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = Scratch(spark, "copies")
    # stored first: the range's borders are sampled from the rows, which would compute all keys twice
    ordered = scratch.save(keyed).repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")
    scanned = scratch.save(ordered.mapInArrow(_scan, _SCANNED).drop("head_key"))

    # one row per non-empty partition, in key order; both sides are as many as partitions
    first = scanned.where("border = 1").select("part", F.col("border_key").alias("first_key"), F.col("id").alias("first_id"))
    last = scanned.where("border = 2").select("part", F.col("border_key").alias("last_key"), F.col("head").alias("last_head"), F.col("leading").alias("one_run"))
    borders = first.join(F.broadcast(last), "part")
    order = Window.orderBy("first_key", "first_id")
    linked = borders.withColumn("continues", F.coalesce(F.lag("last_key").over(order) == F.col("first_key"), F.lit(False)))
    # the run that reaches a partition's start began at the last partition whose closing run began inside it
    began = F.when(~(F.col("one_run") & F.col("continues")), F.col("last_head"))
    linked = linked.withColumn("carried", F.last(began, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    heads = linked.where("continues").select("part", F.lit(True).alias("leading"), F.col("carried"))
    rows = scanned.where("id IS NOT NULL").join(F.broadcast(heads), ["part", "leading"], "left")
    return rows.select(F.coalesce("carried", "head").alias("kept_id"), "id")


def representatives(keyed: DataFrame, partitions: int | None = None) -> DataFrame:
    """(kept_id, n_copies): one representative per distinct record and its exact number of rows."""
    return copies(keyed, partitions).groupBy("kept_id").agg(F.count("*").alias("n_copies"))
