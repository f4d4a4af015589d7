"""Budget admission on a stream of ad requests.

State per campaign is what it has *spent*, in cents, first taken from the
ledger's CurrentBudget; it never expires. The budget itself is read from the
ledger with every run, so a changed budget counts for the requests that come
after it, and a campaign created meanwhile is known (W1 and W2 compose with
T1). Arrival order decides (within a micro-batch, ``seq`` then AdID, as in W3),
so late data needs no watermark. A campaign without a budget spends nothing.

A micro-batch holds ``max_bytes_per_trigger`` of files at most (one larger file
is taken whole), which bounds what the state function is handed of one
campaign. Of those requests it holds only what the order and the fold need,
three integers each (``Requests``), however many columns and chunks they come in, and hands decisions on in
chunks, so a campaign of millions of requests in one run costs tens of bytes a request.

Requests without ``seq`` are rejected, as in W3. NULLs travel as flags beside
integers: in a pandas frame a NULL would make doubles of them.

Two forms of the same join and fold: ``transformWithStateInPandas`` (RocksDB
state store) and ``applyInPandasWithState`` (any state store).
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    BooleanType, DecimalType, LongType, StringType, StructField, StructType,
)

from ..functions.fold import fold_costs
from ..functions.money import from_cents, spend_so_far, to_cents
from ..operators.admission import INVALID_COST, MISSING_SEQ, NO_BUDGET, OVER_BUDGET, UNKNOWN_CAMPAIGN
from ..session import ship_package

DECISION = StructType([
    StructField("seq", LongType()),
    StructField("AdID", LongType()),
    StructField("CampaignID", LongType()),
    StructField("CostPerAd", DecimalType(12, 2)),
    StructField("admitted", BooleanType()),
    StructField("Reason", StringType()),
])
STATE = StructType([StructField("spent", LongType())])
MAX_BYTES = 256 << 20
CHUNK = 100_000      # decisions handed on at once

#: What the state functions return; ``_restored`` makes DECISION of it.
_ANSWER = StructType([StructField(n, LongType()) for n in ("seq", "ad", "cid", "cost")]
                     + [StructField("known", LongType()), StructField("admitted", BooleanType())])
_SEQ, _AD, _CID, _COST, _CAMPAIGN, _BUDGET = (1 << k for k in range(6))    # bits of ``known``


class Requests:
    """One campaign's requests of a micro-batch, as integer columns."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.budget = self.spent = self.cid = 0

    def add(self, pdf: pd.DataFrame) -> None:
        self.parts.append(tuple(pdf[c].to_numpy(kind) for c, kind in
                                (("seq", np.int64), ("ad", np.int64), ("cost", np.int64), ("known", np.int8))))
        self.budget, self.spent, self.cid = (int(pdf[c].iloc[0]) for c in ("budget", "spent", "cid"))

    def decided(self, spent: int | None) -> tuple[Iterator[pd.DataFrame], int | None]:
        """(chunks of decisions in order, spend after them); ``spent`` is None before the campaign is known."""
        seq, ad, cost, known = (np.concatenate(c) for c in zip(*self.parts))
        self.parts = []
        order = np.lexsort((cost, ad, known & _AD, seq))
        ok = np.zeros(seq.size, bool)
        there = int(known[0])
        if there & _CAMPAIGN and spent is None:
            spent = self.spent
        if there & _CAMPAIGN and there & _BUDGET:
            good = order[(known[order] & _SEQ > 0) & (known[order] & _COST > 0) & (cost[order] >= 0)]
            # a budget cut below what is spent leaves no room, not even for a cost of 0
            ok[good], left = fold_costs(cost[good], self.budget - spent)
            spent = self.budget - left

        def chunks() -> Iterator[pd.DataFrame]:
            for k in range(0, order.size, CHUNK):
                at = order[k:k + CHUNK]
                yield pd.DataFrame({"seq": seq[at], "ad": ad[at], "cid": self.cid, "cost": cost[at],
                                    "known": known[at].astype(np.int64), "admitted": ok[at]})
        return chunks(), spent


def _with_ledger(stream: DataFrame, campaign: DataFrame) -> DataFrame:
    """Requests with their campaign's budget and spend, all integers, NULLs as 0 with a bit unset in ``known``."""
    ledger = campaign.select(
        "CampaignID", to_cents("Budget").alias("budget"),
        to_cents(spend_so_far()).alias("spent"), F.lit(True).alias("there"))
    j = stream.select("seq", "AdID", "CampaignID", to_cents("CostPerAd").alias("cost")).join(ledger, "CampaignID", "left")
    bits = [F.when(c.isNotNull(), F.lit(bit)).otherwise(F.lit(0)) for c, bit in (
        (F.col("seq"), _SEQ), (F.col("AdID"), _AD), (F.col("CampaignID"), _CID), (F.col("cost"), _COST),
        (F.col("there"), _CAMPAIGN), (F.col("budget"), _BUDGET))]
    known = bits[0]
    for b in bits[1:]:
        known = known + b
    zero = {c: F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(c) for c, s in (
        ("seq", "seq"), ("ad", "AdID"), ("cid", "CampaignID"), ("cost", "cost"), ("budget", "budget"), ("spent", "spent"))}
    return j.select("CampaignID", *zero.values(), known.cast("bigint").alias("known"))


def _restored(answers: DataFrame) -> DataFrame:
    def has(bit: int) -> F.Column:
        return F.col("known").bitwiseAND(F.lit(bit)) > 0
    reason = F.when(~has(_SEQ), F.lit(MISSING_SEQ)).when(~has(_COST) | (F.col("cost") < 0), F.lit(INVALID_COST)) \
        .when(~has(_CAMPAIGN), F.lit(UNKNOWN_CAMPAIGN)).when(~has(_BUDGET), F.lit(NO_BUDGET)).when(~F.col("admitted"), F.lit(OVER_BUDGET))
    return answers.select(
        F.when(has(_SEQ), F.col("seq")).alias("seq"), F.when(has(_AD), F.col("ad")).alias("AdID"),
        F.when(has(_CID), F.col("cid")).alias("CampaignID"), F.when(has(_COST), from_cents("cost")).alias("CostPerAd"),
        "admitted", reason.alias("Reason"))


def _decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    requests = Requests()
    for pdf in batches:
        if len(pdf):
            requests.add(pdf)
    chunks, spent = requests.decided(int(state.get[0]) if state.exists else None)
    if spent is not None:
        state.update((spent,))
    yield from chunks


def admission_stream(stream: DataFrame, campaign: DataFrame) -> DataFrame:
    """Streaming decisions for a stream of (seq, AdID, CampaignID, CostPerAd)."""
    return _restored(_with_ledger(stream, campaign).groupBy("CampaignID").applyInPandasWithState(
        _decide, _ANSWER, STATE, "append", GroupStateTimeout.NoTimeout))


class BudgetSpent(StatefulProcessor):
    """transformWithStateInPandas form: the spend per campaign is a value state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "spent long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        requests = Requests()
        for pdf in rows:
            if len(pdf):
                requests.add(pdf)
        chunks, spent = requests.decided(int(self.spent.get()[0]) if self.spent.exists() else None)
        if spent is not None:
            self.spent.update((spent,))
        yield from chunks

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb_state_store(spark: SparkSession):
    """Run stateful queries started inside on the RocksDB state store, then
    restore the session's setting."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, old)


def admission_stream_tws(stream: DataFrame, campaign: DataFrame) -> DataFrame:
    """Streaming decisions with ``transformWithStateInPandas`` (needs the
    RocksDB state store provider on the session)."""
    return _restored(_with_ledger(stream, campaign).groupBy("CampaignID").transformWithStateInPandas(
        BudgetSpent(), _ANSWER, "Append", "None"))


def run_admission(spark: SparkSession, source: str, schema: StructType, campaign: DataFrame,
                  sink: str, checkpoint: str, max_files_per_trigger: int | None = None,
                  api: str = "applyInPandasWithState", max_bytes_per_trigger: int = MAX_BYTES) -> DataFrame:
    """Process whatever arrived in ``source`` since the last run (availableNow)
    into a parquet sink — exactly-once through the checkpoint, which also
    carries the per-campaign state between runs — and read the sink back.
    ``campaign`` is the ledger as it stands at this run.

    ``max_bytes_per_trigger`` bounds a micro-batch (and so the rows of one
    campaign handed to the state function at once) on a large backlog, or
    ``max_files_per_trigger`` where that is given instead.
    ``api``: ``"applyInPandasWithState"`` (any state store) or
    ``"transformWithState"`` (RocksDB state store; the session must set
    ``spark.sql.streaming.stateStore.providerClass`` to ``ROCKSDB``).
    """
    ship_package(spark)
    limit = ("maxBytesPerTrigger", max_bytes_per_trigger) if max_files_per_trigger is None else ("maxFilesPerTrigger", max_files_per_trigger)
    stream = spark.readStream.schema(schema).option(*limit).parquet(source)
    decisions = (admission_stream_tws if api == "transformWithState" else admission_stream)(stream, campaign)
    q = (decisions.writeStream.format("parquet")
         .option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(DECISION).parquet(sink)
