"""Claims as keyed state of a streaming query.

Keys are dealt over `SLOTS` slots by their hash, and the state store holds one list of claims for each slot: key, status and owner. A
micro-batch moves only its own attempts; a slot that it touches is read as a whole, and what changes is added to the list, in which a key's
last entry counts. So a slot costs a handful of calls to the state store, however many of its keys come up. State may expire: a claim
that nobody finished within the time to live is free again.

The result equals `operators.claims.claim` on the claims that were held before the micro-batch. Sessions need the RocksDB
state store (`STATE_STORE`), which keeps state outside of the heap.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docledger.operators.claims import PROCESSED, RECLAIMABLE
from docledger.schemas import CLAIM_KEY
from docledger.streaming.jobs import changes_stream

STATE_STORE = {
    # With a time to live, a query would otherwise go on with empty micro-batches for ever.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
RESULT = "drive_file_id string, file_hash string, arrival bigint, claim_status string, owner_id string"
#: Rows of a frame that a slot hands out.
FRAME = 100_000
#: Part of the state's layout: a checkpoint is only good for the number it was made with. Ten million claims are 600 for each slot.
SLOTS = 16_384
STATE = "drive_file_id string, file_hash string, status string, owner_id string"


class ClaimState(StatefulProcessor):
    """The claims of a slot's keys.

    Rows without status are attempts; the smallest arrival of a micro-batch wins a free key. Rows with a status mark what
    became of a claim; of a micro-batch's marks that with the largest arrival counts, for the attempts after it as well as for those beside it.
    A slot's attempts of one micro-batch meet in one task, as numbers of key and arrival alone; `ingest_stream` bounds a micro-batch.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claims = handle.getListState("claims", STATE, self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.claims.appendList(list(initialState[[*CLAIM_KEY, "status", "owner_id"]].itertuples(index=False, name=None)))

    def held(self) -> tuple[dict, int]:
        """Status and owner by key, and the number of entries that they were read from."""
        claims, entries = {}, 0
        for *name, status, owner in self.claims.get():
            claims[tuple(name)] = (status, owner)
            entries += 1
        return claims, entries

    def keep(self, claims: dict, changed: set, entries: int) -> None:
        """Add the entries that changed; a list that is mostly outdated is put anew. With a time to live outdated entries go by themselves,
        and putting the others anew would let them live longer."""
        if self.ttl_ms is None and entries + len(changed) > 2 * len(claims):
            self.claims.put([(*name, *claim) for name, claim in claims.items()])
        elif changed:
            self.claims.appendList([(*name, *claims[name]) for name in changed])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        numbers, first, marks, asked = {}, [], {}, []
        for frame in rows:
            marked = frame["status"].notna()
            told = frame[marked]
            for *name, arrival, status in zip(*[told[column] for column in (*CLAIM_KEY, "arrival", "status")]):
                mark = (arrival, status)
                marks[tuple(name)] = max(marks.get(tuple(name), mark), mark)
            attempts = frame[~marked]
            places = np.empty(len(attempts), dtype=np.int64)
            arrivals = attempts["arrival"].to_numpy(dtype=np.int64)
            names = zip(*[attempts[column] for column in CLAIM_KEY])
            for row, (name, arrival, owner) in enumerate(zip(names, arrivals.tolist(), attempts["owner_id"])):
                place = places[row] = numbers.setdefault(name, len(numbers))
                if place == len(first):
                    first.append((arrival, owner))
                elif arrival < first[place][0]:
                    first[place] = (arrival, owner)
            asked.append((places, arrivals))
        claims, entries = self.held()
        changed = set()
        for name, (_, status) in marks.items():
            if name in claims:  # marks of keys that nobody holds are ignored
                claims[name] = (status, claims[name][1])
                changed.add(name)
        results = []
        for name, (arrival, owner) in zip(numbers, first):
            status, holder = claims.get(name, (None, None))
            free = status is None or status in RECLAIMABLE
            if free:
                claims[name] = ("CLAIMED", owner)
                changed.add(name)
            results.append((*name, "already_processed" if status in PROCESSED else "already_claimed", owner if free else holder, free, arrival))
        self.keep(claims, changed, entries)
        if not results:
            return
        files, hashes, otherwise, owners = (np.array(column, dtype=object) for column in list(zip(*results))[:4])
        free, winners = np.array([one[4] for one in results]), np.array([one[5] for one in results])
        for places, arrivals in asked:
            for start in range(0, len(places), FRAME):
                at, arrival = places[start : start + FRAME], arrivals[start : start + FRAME]
                won = free[at] & (arrival == winners[at])
                yield pd.DataFrame({
                    CLAIM_KEY[0]: files[at], CLAIM_KEY[1]: hashes[at], "arrival": arrival,
                    "claim_status": np.where(won, "claimed", otherwise[at]), "owner_id": owners[at],
                })

    def close(self) -> None:
        pass


def stateful_claims(stream: DataFrame, held: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The result of each attempt: key, arrival, claim_status and owner_id.

    ``stream``: key, owner_id, arrival (a unique whole number), and perhaps status, which makes a row a mark. Rows whose key has a null part
    take no part. ``held``: claims (key, status, owner_id, each key once) before the first micro-batch.
    """
    marked = stream if "status" in stream.columns else stream.withColumn("status", F.lit(None).cast("string"))
    keyed = marked.select(*CLAIM_KEY, "owner_id", F.col("arrival").cast("bigint").alias("arrival"), "status").dropna(subset=CLAIM_KEY)
    slot = F.pmod(F.hash(*CLAIM_KEY), F.lit(SLOTS))
    known = None if held is None else held.select(*CLAIM_KEY, "status", "owner_id").dropna(subset=CLAIM_KEY)
    first = None if known is None else known.withColumn("slot", slot).groupBy("slot")
    return keyed.withColumn("slot", slot).groupBy("slot").transformWithStateInPandas(
        ClaimState(ttl_ms), RESULT, "Update", "processingTime" if ttl_ms else "none", initialState=first
    )


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start within use the state store that keyed state needs; the session's settings come back afterwards."""
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def claim_results_stream(
    stream: DataFrame, path: str, checkpoint: str, held: DataFrame | None = None, ttl_ms: int | None = None
) -> StreamingQuery:
    """Write each micro-batch's results to a folder of its own; a repeated micro-batch overwrites its own."""
    with state_store(stream.sparkSession):
        return changes_stream(stateful_claims(stream, held, ttl_ms), path, checkpoint)
