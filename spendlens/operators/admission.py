"""Budget admission (W3, W3r): ads admitted only while their campaign's budget lasts.

Rule: requests are taken per campaign in order of ``seq``, then AdID, then
cost; one is admitted iff ``spent + cost <= budget``, and a rejected request
spends nothing, so a later, cheaper one may still get in. A running sum over
all requests is therefore wrong (it counts rejected cost); the exact answer is
a greedy fold. Money is integer cents. A campaign without a budget (NULL) may
spend nothing: its requests are rejected as such. NULL spend is 0.

Two ways give the same decisions for the same requests, and only sizes choose
between them:

1. *Level rounds* (parallel) decide campaigns of more than ``tail_group_limit``
   requests. Let the ``room`` (budget left) lie on level j, from 2^j up to 2^(j+1). Costs from 2^j up are
   *large*, the others *small*. While the room stays on the level every small cost fits, so the room in front of a
   request is the room less a prefix sum of small costs, and a large cost in front of it was rejected. The level ends with the
   first request that fits and takes the room below 2^j: a large one that fits, or the small one with which the prefix sum passes
   room - 2^j. That request is found by one prefix sum and one minimum; it is admitted, all before it is decided,
   and what is behind it goes on with the smaller room. Each round lowers the level of
   every campaign, so there are at most as many rounds as the largest room has
   bits, in any order of requests. The prefix sum is two-level over a range
   partitioning of (campaign, order) made once, so a hot campaign is spread over many tasks in every round.
2. *Tail* (exact). Smaller campaigns are hash partitioned by campaign, sorted and
   streamed through a small fold in ``mapInArrow`` with O(1) state: memory is one Arrow batch, not
   one group. Columns pass through as they are.

Requests that are invalid, unknown or dearer than the whole room are decided
before any of this and cross no exchange of it. A request without ``seq`` has no
place in the order: it is rejected, here and on a stream (T1), as W6 does.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.fold import fold_costs
from ..functions.money import spend_so_far, to_cents
from ..session import shared_dir, ship_package
from .checks import require_columns

OVER_BUDGET = "Campaign budget exceeded"
UNKNOWN_CAMPAIGN = "Unknown campaign"
NO_BUDGET = "Campaign has no budget"
INVALID_COST = "Missing or negative cost"
MISSING_SEQ = "Missing seq"

_KEY, _SEQ, _COST, _ROOM, _ORDER = "CampaignID", "seq", "_cents", "_room", "_order"
log = logging.getLogger(__name__)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder that the cluster names for checkpoints."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sliced(df: DataFrame, key: str, order: str, partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned on (key, order), so that a hot key is cut into
    contiguous slices over many tasks, with the ``_slice`` and a ``_tie`` that tells
    rows of equal order apart. Materialized: a range exchange evaluated twice may sample other bounds."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(n, key, order).withColumn("_slice", F.spark_partition_id())
                       .withColumn("_tie", F.monotonically_increasing_id()))


def running_sum(df: DataFrame, key: str, order: str, value: str, out: str, partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` per ``key`` in ``order``; rows that are equal in it are summed one after the other."""
    return _sum_over_slices(sliced(df, key, order, partitions), key, order, value, out).drop("_slice", "_tie")


def _sum_over_slices(ranged: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """The running sum over what is left of a ``sliced`` frame: each slice sums locally, and slice offsets come from a table
    with one row per (key, slice) — at most #keys + #partitions rows."""
    local_w = Window.partitionBy(key, "_slice").orderBy(order, "_tie") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_local", F.sum(value).over(local_w))
    totals = ranged.groupBy(key, "_slice").agg(F.sum(value).alias("_slice_total"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_slice", F.coalesce(F.sum("_slice_total").over(before), F.lit(0)).alias("_off"))
    return local.join(offsets, [key, "_slice"]) \
        .withColumn(out, F.col("_off") + F.col("_local")).drop("_local", "_off")


def _level_rounds(cand: DataFrame) -> list[DataFrame]:
    """Decide all of ``cand`` by level rounds; one frame for each round's decisions."""
    parts, left = [], sliced(cand, _KEY, _ORDER)
    rounds = 0
    while not left.isEmpty():
        rounds += 1
        # exact: the room's binary digits less one; a room of 0 has no level to leave
        level = F.when(F.col(_ROOM) > 0, F.expr(f"shiftleft(1L, length(bin({_ROOM})) - 1)"))
        small = F.col(_COST) < F.coalesce(level, F.lit(1))
        summed = left.withColumn("_level", level).withColumn("_small", F.when(small, F.col(_COST)).otherwise(F.lit(0)))
        summed = checkpointed(_sum_over_slices(summed, _KEY, _ORDER, "_small", "_cum"))
        room_before = F.col(_ROOM) - F.col("_cum") + F.col("_small")
        ends = F.when(small, F.col("_cum") > F.col(_ROOM) - F.col("_level")).otherwise(F.col(_COST) <= room_before)
        last = summed.where(ends).groupBy(_KEY).agg(F.min(F.struct(
            _ORDER, "_tie", (room_before - F.col(_COST)).alias("room"))).alias("_end"))
        marked = summed.join(last, _KEY, "left")
        at, end = F.struct(_ORDER, "_tie"), F.struct(F.col(f"_end.{_ORDER}").alias(_ORDER), F.col("_end._tie").alias("_tie"))
        ended = F.col("_end").isNotNull()
        behind = ended & (at > end)
        ok = small | (ended & (at == end))
        parts.append(marked.where(~behind).withColumn("admitted", ok)
                     .withColumn("Reason", F.when(~ok, F.lit(OVER_BUDGET))))
        rest = marked.where(behind).withColumn(_ROOM, F.col("_end.room"))
        parts.append(_decided(rest.where(F.col(_COST) > F.col(_ROOM)), False, OVER_BUDGET))
        left = rest.where(F.col(_COST) <= F.col(_ROOM)).drop("_level", "_small", "_cum", "_end")
    log.info("%d level rounds", rounds)
    return parts


def _decided(df: DataFrame, admitted: bool, reason: str | Column | None) -> DataFrame:
    reason = reason if isinstance(reason, Column) else F.lit(reason).cast("string")
    return df.withColumn("admitted", F.lit(admitted)).withColumn("Reason", reason)


def _fold_tail(columns: list[str]):
    """mapInArrow body: rows arrive sorted by (campaign, order); each campaign's
    run within a batch is folded by the numpy kernel, carrying the room
    across batches. The batch's own columns pass through untouched."""
    key_i, cost_i, room_i = columns.index(_KEY), columns.index(_COST), columns.index(_ROOM)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current_key, room = None, 0
        for batch in batches:
            keys, costs, rooms = (batch.column(i).to_numpy(zero_copy_only=False) for i in (key_i, cost_i, room_i))
            ok = np.zeros(batch.num_rows, dtype=bool)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if batch.num_rows else []
            for a, z in zip(starts, [*starts[1:], batch.num_rows]):
                if keys[a] != current_key:
                    current_key, room = keys[a], int(rooms[a])
                ok[a:z], room = fold_costs(costs[a:z], room)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok)], names=[*batch.schema.names, "admitted"])
    return fold


def request_order(columns: list[str]) -> Column:
    """The order of requests: ``seq``, then AdID (where they have one), then cost."""
    return F.struct(F.col(_SEQ), *[F.col(c) for c in ("AdID",) if c in columns], F.col(_COST))


def admission_decisions(requests: DataFrame, campaign: DataFrame, tail_group_limit: int = 1_000_000) -> DataFrame:
    """Decide every request. Output: request columns + ``admitted`` + ``Reason``.

    requests: ``seq`` (arrival order), ``CampaignID``, ``CostPerAd``, …
    campaign: ``CampaignID``, ``Budget``, ``CurrentBudget`` (spend so far).
    tail_group_limit: campaigns with more undecided requests than this are
    decided by parallel rounds, the others by the tail; no decision depends on it.
    """
    require_columns(requests, [_SEQ, _KEY, "CostPerAd"], "admission requests")
    require_columns(campaign, [_KEY, "Budget", "CurrentBudget"], "admission ledger")
    ship_package(requests.sparkSession)
    req_cols = requests.columns
    ledger = campaign.select(
        _KEY, (to_cents("Budget") - to_cents(spend_so_far())).alias(_ROOM), F.lit(True).alias("_known"))
    j = requests.withColumn(_COST, to_cents("CostPerAd")).join(ledger, _KEY, "left")
    # Costs must be present and non-negative: rooms only shrink. Such requests spend nothing, like any rejection.
    at_once = F.when(F.col(_SEQ).isNull(), F.lit(MISSING_SEQ)) \
        .when(F.col(_COST).isNull() | (F.col(_COST) < 0), F.lit(INVALID_COST)) \
        .when(F.col("_known").isNull(), F.lit(UNKNOWN_CAMPAIGN)) \
        .when(F.col(_ROOM).isNull(), F.lit(NO_BUDGET)) \
        .when(F.col(_COST) > F.col(_ROOM), F.lit(OVER_BUDGET))
    j = j.withColumn("_at_once", at_once).drop("_known")
    parts = [_decided(j.where("_at_once IS NOT NULL"), False, F.col("_at_once"))]
    cand = j.where("_at_once IS NULL").withColumn(_ORDER, request_order(req_cols))

    counts = cand.groupBy(_KEY).agg(F.count(F.lit(1)).alias("_n"))
    biggest = counts.agg(F.max("_n")).first()[0]
    if biggest and biggest > tail_group_limit:
        big = counts.where(F.col("_n") > tail_group_limit).select(_KEY)
        parts += _level_rounds(cand.join(big, _KEY, "left_semi"))
        cand = cand.join(big, _KEY, "left_anti")

    tail = cand.select(*req_cols, _COST, _ROOM, _ORDER).repartition(_KEY).sortWithinPartitions(_KEY, _ORDER).drop(_ORDER)
    schema = StructType(tail.schema.fields + [StructField("admitted", BooleanType(), False)])
    folded = tail.mapInArrow(_fold_tail(tail.columns), schema)
    parts.append(folded.withColumn("Reason", F.when(~F.col("admitted"), F.lit(OVER_BUDGET))))

    out = None
    for p in parts:
        p = p.select(*req_cols, "admitted", "Reason")
        out = p if out is None else out.unionByName(p)
    return out


def admit_ads(requests: DataFrame, campaign: DataFrame, materialize: bool = True,
              **kw) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected), with the requests' columns; ``writes.create_ads``
    makes ads of the admitted.

    ``materialize`` checkpoints the decisions once so that reading both
    outputs does not decide twice; a caller that reads one can skip it.
    """
    d = admission_decisions(requests, campaign, **kw)
    if materialize:
        d = checkpointed(d)
    return d.where("admitted").drop("admitted", "Reason"), d.where(~F.col("admitted")).drop("admitted")
