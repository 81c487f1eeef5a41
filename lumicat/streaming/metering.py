"""H4-H14 on a stream: the account machine as a keyed stateful operator."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumicat.operators import account as machine
from lumicat.operators.metering import DECISION_DDL, EVENT_COLUMNS, FIGURE_DDL, prepare, to_event

c = F.col
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
CHUNK = 10_000  # rows of an account that are worked on at a time
SLICES = 1024  # entries that a collection of an account is dealt over
HELD = 500_000  # keys of a collection that are held in memory, about
FEW = ("account", "op", "kind", "terms", "plan")  # columns of few different texts
OUTPUT = f"{DECISION_DDL}, {FIGURE_DDL}"


class Slices:
    """A collection (key -> value) of an account in a keyed map state, dealt by hash over ``SLICES`` entries. A call of the state
    costs as much as many events, so a slice is read once and written once for many rows, whether keys repeat or not.
    ``stored`` has a bit for each slice that the state holds; the account keeps it."""

    def __init__(self, state):
        self._state = state
        self.open(0)

    def open(self, stored: int) -> None:
        self.stored = stored
        self._read, self._changed, self._held = {}, set(), 0

    def _slice(self, place: int) -> dict:
        known = self._read.get(place)
        if known is None:
            if self._held > HELD:
                self.flush()
            known = dict(json.loads(self._state.getValue((place,))[0])) if self.stored >> place & 1 else {}
            self._read[place] = known
            self._held += len(known)
        return known

    @staticmethod
    def _place(key: str | None) -> int:
        return crc32((key or "").encode()) % SLICES

    def get(self, key: str):
        return self._slice(self._place(key)).get(key)

    def put(self, key: str, value) -> None:
        place = self._place(key)
        known = self._slice(place)
        self._held += key not in known
        known[key] = value
        self._changed.add(place)

    def forget(self, before: int) -> None:
        """Drop the keys whose value is ``before`` at most."""
        for place in [p for p in range(SLICES) if self.stored >> p & 1 or p in self._changed]:
            known = self._slice(place)
            old = [key for key, value in known.items() if value <= before]
            for key in old:
                del known[key]
            if old:
                self._held -= len(old)
                self._changed.add(place)

    def clear(self) -> None:
        if self.stored:
            self._state.clear()
        self.open(0)

    def flush(self) -> None:
        """Write what has changed and hold nothing any more."""
        for place in sorted(self._changed):
            known, bit = self._read[place], 1 << place
            if known:
                self._state.updateValue((place,), (json.dumps(list(known.items())),))
                self.stored |= bit
            elif self.stored & bit:
                self._state.removeKey((place,))
                self.stored ^= bit
        self.open(self.stored)


class StateStore:
    """The collections of an account: seen keys, free resources of the day and used tokens."""

    def __init__(self, seen: Slices, free: Slices, tokens: Slices):
        self._seen, self._free, self._tokens = self._all = seen, free, tokens

    def open(self, stored: list[str]) -> None:
        for collection, bits in zip(self._all, stored):
            collection.open(int(bits, 16))

    def flush(self) -> list[str]:
        """Write the changes; which slices are stored, as hex numbers."""
        for collection in self._all:
            collection.flush()
        return [f"{collection.stored:x}" for collection in self._all]

    def last_seen(self, key: str):
        return self._seen.get(key)

    def record(self, key: str, now: int) -> None:
        self._seen.put(key, now)

    def forget(self, before: int) -> None:
        """Drop keys that cannot repeat any more; called once per account and day."""
        self._seen.forget(before)

    def has_free(self, kind: str, key: str) -> bool:
        return self._free.get(f"{kind} {key}") is not None

    def add_free(self, kind: str, key: str) -> None:
        self._free.put(f"{kind} {key}", True)

    def clear_free(self) -> None:
        self._free.clear()

    def has_token(self, token: str) -> bool:
        return self._tokens.get(token) is not None

    def add_token(self, token: str) -> None:
        self._tokens.put(token, True)


class MeterProcessor(StatefulProcessor):
    """Applies the events of a micro-batch in (ts, event_id) order. A row older than
    the account's newest processed second is answered ``late`` and changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        place = T.StructType([T.StructField("k", T.IntegerType())])
        text = T.StructType([T.StructField("json", T.StringType())])
        self.scalars = handle.getValueState("scalars", text)
        self.store = StateStore(*(Slices(handle.getMapState(name, place, text)) for name in ("seen", "free", "tokens")))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        account, stored = machine.Account(), ["0"] * 3
        if self.scalars.exists():
            known = json.loads(self.scalars.get()[0])
            account, stored = machine.Account(**known["account"]), known["stored"]
        self.store.open(stored)
        for events in _in_order(rows):
            out = []
            for row in events:
                ts = row["ts"]
                if ts < account.last_ts:
                    decision = machine.Decision(409, "late", balance=account.balance)
                else:
                    if ts // machine.DAY != account.last_ts // machine.DAY and account.last_ts >= 0:
                        self.store.forget(ts - machine.REPEAT)
                    account.last_ts = ts
                    decision = machine.step(account, self.store, to_event(*_plain(row)))
                out.append(vars(decision) | {k: row[k] for k in ("account", "event_id", "ts")})
            yield _frame(out)
        self.scalars.update((json.dumps({"account": account.dump(), "stored": self.store.flush()}),))

    def close(self) -> None:
        pass


def _table(frame: pd.DataFrame) -> pa.Table:
    """The rows without a Python object for each value; texts that repeat are held once."""
    columns = {}
    for name, values in frame.items():
        column = pa.array(values, from_pandas=True)
        if pa.types.is_floating(column.type):  # whole numbers, some of them null
            column = column.cast(pa.int64())
        if name in FEW:
            column = column.cast(pa.string()).dictionary_encode()
        columns[name] = column
    return pa.table(columns)


def _in_order(frames: Iterable[pd.DataFrame]) -> Iterator[list[dict]]:
    """The rows by (ts, event_id), ``CHUNK`` at a time; only these are Python objects."""
    table = pa.concat_tables([_table(f) for f in frames], promote_options="permissive").unify_dictionaries().combine_chunks()
    names, order = table.column_names, pc.sort_indices(table, [("ts", "ascending"), ("event_id", "ascending")])
    for at in range(0, len(order), CHUNK):
        some = table.take(order.slice(at, CHUNK))
        yield [dict(zip(names, row)) for row in zip(*map(_values, some.columns))]


def _values(column: pa.ChunkedArray) -> list:
    """Python values; those of a whole column at once are ten times as fast as one by one."""
    if pa.types.is_dictionary(column.type):
        column = column.cast(column.type.value_type)
    if column.null_count and not pa.types.is_string(column.type):
        return column.to_pylist()
    return column.to_numpy().tolist()


PLAIN = ("op", "ts", *EVENT_COLUMNS[EVENT_COLUMNS.index("op") + 1:])


def _plain(row: dict) -> list:
    """The fields of an event in order, as plain Python values."""
    asked = row["expected_price"]  # as text, since pandas has no whole numbers with nulls
    return [int(asked) if name == "expected_price" and asked is not None else row[name] for name in PLAIN]


def _frame(rows: list[dict]) -> pd.DataFrame:
    columns = [f.split()[0] for f in OUTPUT.split(", ")]
    kinds = [f.split()[1] for f in OUTPUT.split(", ")]
    dtype = {"bigint": "Int64", "int": "int32", "boolean": "bool", "string": object}
    return pd.DataFrame({
        name: pd.Series([r[name] for r in rows], dtype=dtype[kind]) for name, kind in zip(columns, kinds)
    })


def meter_stream(log: DataFrame, revisions: DataFrame) -> DataFrame:
    """H6 on a stream of log rows; ``revisions`` is a static table, read again per
    batch. Micro-batches bound what one account brings at a time, so size the
    source (``maxFilesPerTrigger``) for the busiest account."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    log.sparkSession.conf.set(CHANGELOG, "true")  # a commit writes what has changed, not each partition's files
    # pandas would make whole numbers with nulls to floats
    plain = {name: F.coalesce(name, F.lit(0)) for name in ("points", "days")} | {"expected_price": c("expected_price").cast("string")}
    return (
        prepare(log, revisions)
        .select(EVENT_COLUMNS)
        .withColumns(plain)
        .groupBy("account")
        .transformWithStateInPandas(
            statefulProcessor=MeterProcessor(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
        )
    )
