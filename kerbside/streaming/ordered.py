"""Order before the watermark: a stateful operator that sorts the rows of a key before it takes them up.

Rows wait in the key's list state until a row ``delay`` or more beyond them has come; then they are released in the order of ``order`` and the ties, whatever
micro-batch brought them. A row that comes after its place has been released is late: it is put out apart and changes nothing. So what is put out
does not depend on how the source was cut into micro-batches, as long as no row is more than ``delay`` behind. State is bound by the rows of ``delay``.

With ``silent_ms`` a key from which no micro-batch has had a row for that long, by the clock, has its waiting rows released, and time goes on by ``silent_step`` of the order (0 for
orders that are no time); the same again each ``silent_ms``, so that what depends on time passing is put out while nothing comes.

A row may carry a mark instead of data: ``clock`` only moves the time on, ``end`` releases all that waits (a source that closes says so). Neither is put out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

MARK = "mark"

#: Rows of a task that are packed together.
PACKED = 100_000


def packed(rows: DataFrame, by: str) -> DataFrame:
    """(by, data): the rows of a key as Arrow data, many in a row. Spark hands rows to a stateful processor in Python one by one, which costs more than what most do with them."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def data():
            table = pa.Table.from_batches(held)
            held.clear()
            keys, made = pc.unique(table[by]), []
            for key in keys:
                own = table.filter(pc.equal(table[by], key) if key.is_valid else pc.is_null(table[by])).drop_columns([by]).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as writer:
                    writer.write_table(own)
                made.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([keys, pa.array(made, pa.binary())], names=[by, "data"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED:
                yield data()
        if held:
            yield data()

    return rows.mapInArrow(run, f"{by} {rows.schema[by].dataType.simpleString()}, data binary")


def unpacked(rows: Iterator[pd.DataFrame]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for found in rows for x in found["data"]])


def in_order(rows: list[tuple]) -> list[tuple]:
    """rows by all their values, nulls first."""
    try:
        return sorted(rows)  # rows that differ before a null meets a value need no keys
    except TypeError:
        return sorted(rows, key=lambda row: [(x is not None, x) for x in row])


class Ordered(StatefulProcessor):
    """fields: DDL of a row's columns but the key, the first of which is the order; the rest break ties in their order. output: DDL of what is put out, the key first."""

    fields = output = ""

    def __init__(self, delay: int, silent_ms: int | None = None, silent_step: int = 0) -> None:
        self.silent_ms, self.silent_step = silent_ms, silent_step
        # parsed here, on the driver; tasks cannot
        self.delay, self.row, self.out = delay, StructType.fromDDL(self.fields), StructType.fromDDL(self.output)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.time = handle.getValueState("time", "newest long, released long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came, marks = [], []
        found = unpacked(rows).to_pandas()
        columns = [self._values(found[f.name], f.dataType.simpleString()) for f in self.row.fields]
        for *row, mark in zip(*columns, self._values(found[MARK], "string")):
            (marks if mark else came).append((tuple(row), mark))
        newest, released = self.time.get() if self.time.exists() else (None, None)
        late = [row for row, _ in came if released is not None and row[0] <= released]
        rest = [row for row, _ in came if released is None or row[0] > released]
        if self.waiting.exists():
            rest += [tuple(row) for row in self.waiting.get()]
        newest = max([x for x in (newest, *(row[0] for row, _ in came + marks)) if x is not None])
        ended = any(mark == "end" for _, mark in marks)
        out = self._advanced(rest, newest, newest if ended else newest - self.delay, released)
        out = [*out, *(self.ended() if ended else []), *(self.late(row) for row in late)]
        self._wait(timerValues)
        if out:
            yield self.frame(key[0], out)

    def _advanced(self, rows: list[tuple], newest: int, until: int, released: int | None) -> list[tuple]:
        """Releases what stands up to until; the rest waits."""
        until = until if released is None else max(until, released)
        rest = [row for row in rows if row[0] > until]
        if rest:
            self.waiting.put(rest)
        elif self.waiting.exists():
            self.waiting.clear()
        self.time.update((newest, until))
        return self.released(in_order([row for row in rows if row[0] <= until]))

    def _wait(self, timerValues) -> None:
        if self.silent_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, released = self.time.get()
        rows = [tuple(row) for row in self.waiting.get()] if self.waiting.exists() else []
        newest += self.silent_step
        out = self._advanced(rows, newest, newest, released)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        if out:
            yield self.frame(key[0], out)

    @staticmethod
    def _values(column: pd.Series, kind: str) -> list:
        """A column's plain values; pandas makes whole numbers with nulls among them floats."""
        of = {"int": int, "bigint": int, "double": float, "boolean": bool, "string": str}[kind]
        return [None if null else of(x) for x, null in zip(column.tolist(), column.isna().tolist())]

    def frame(self, key, out: list[tuple]) -> pd.DataFrame:
        """Rows of the output without the key, as the frame Spark takes."""
        schema = self.out
        types = {"int": "Int32", "bigint": "Int64", "double": "Float64", "string": object, "boolean": "boolean"}
        columns = {schema.names[0]: pd.array([key] * len(out), types[schema.fields[0].dataType.simpleString()])} if schema.fields[0].dataType.simpleString() != "string" else {schema.names[0]: [key] * len(out)}
        for k, field in enumerate(schema.fields[1:]):
            kind, values = types.get(field.dataType.simpleString(), object), [row[k] for row in out]
            columns[field.name] = pd.Series(values, dtype=object) if kind is object else pd.array(values, kind)
        return pd.DataFrame(columns)

    def released(self, rows: list[tuple]) -> list[tuple]:
        """What rows, in order, put out."""
        raise NotImplementedError

    def late(self, row: tuple) -> tuple:
        raise NotImplementedError

    def ended(self) -> list[tuple]:
        return []

    def close(self) -> None:
        pass


class OrderedColumns(Ordered):
    """The same over whole columns: a micro-batch's rows stay a frame from their coming to their release, so a row costs no Python objects. Numbers are Int64 or Float64, as they may be null."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = unpacked(rows).to_pandas(types_mapper={pa.int32(): pd.Int64Dtype(), pa.int64(): pd.Int64Dtype(), pa.float64(): pd.Float64Dtype(), pa.bool_(): pd.BooleanDtype()}.get)
        first, marks = found[self.row.names[0]].to_numpy(np.int64), found[MARK].to_numpy(object)
        marked = ~pd.isna(marks)
        came, order = self._typed(found[self.row.names] if not marked.any() else found.loc[~marked, self.row.names]), first[~marked]
        newest, released = self.time.get() if self.time.exists() else (None, None)
        behind = np.zeros(len(came), bool) if released is None else order <= released
        rest, late = (came[~behind], came[behind]) if behind.any() else (came, came[:0])
        if self.waiting.exists():
            rest = pd.concat([self._waiting(), rest], ignore_index=True)
        newest = int(first.max()) if newest is None else max(newest, int(first.max()))
        ended = bool((marks[marked] == "end").any())
        yield from self._let_go(key[0], rest, newest, newest if ended else newest - self.delay, released)
        out = [*(self.ended() if ended else []), *(self.late(self._row(row)) for row in late.itertuples(index=False))]
        self._wait(timerValues)
        if out:
            yield self.frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, released = self.time.get()
        rows = self._waiting() if self.waiting.exists() else self._typed(pd.DataFrame([], columns=self.row.names))
        newest += self.silent_step
        yield from self._let_go(key[0], rows, newest, newest, released)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)

    def _let_go(self, key, rows: pd.DataFrame, newest: int, until: int, released: int | None) -> Iterator[pd.DataFrame]:
        until = until if released is None else max(until, released)
        ready = rows[self.row.names[0]].to_numpy(np.int64) <= until
        if not ready.all():
            self.waiting.put([self._row(row) for row in rows[~ready].itertuples(index=False)])
        elif self.waiting.exists():
            self.waiting.clear()
        self.time.update((newest, until))
        going = rows[ready] if not ready.all() else rows
        for frame in self.released_columns(key, self._in_order(going)):
            yield from (frame[k : k + 100_000] for k in range(0, len(frame), 100_000))

    def _in_order(self, rows: pd.DataFrame) -> pd.DataFrame:
        """By all columns, nulls first."""
        first, *ties = self.row.names
        order = rows[first].to_numpy(np.int64)
        if (np.diff(order) > 0).all():
            return rows.reset_index(drop=True)
        if any(rows[c].dtype == object or rows[c].isna().any() for c in ties):
            return rows.sort_values(self.row.names, na_position="first", ignore_index=True)
        return rows.take(np.lexsort([*(rows[c].to_numpy() for c in reversed(ties)), order])).reset_index(drop=True)

    def _typed(self, rows: pd.DataFrame) -> pd.DataFrame:
        types = {"int": "Int64", "bigint": "Int64", "double": "Float64", "boolean": "boolean", "string": object}
        return rows.astype({f.name: types[f.dataType.simpleString()] for f in self.row.fields})

    def _waiting(self) -> pd.DataFrame:
        return self._typed(pd.DataFrame([tuple(row) for row in self.waiting.get()], columns=self.row.names))

    @staticmethod
    def _row(row: tuple) -> tuple:
        return tuple(None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in row)

    def table(self, key, n: int, **columns) -> pd.DataFrame:
        """n rows of the output with these columns; the others but the key are null."""
        types = {"int": "Int32", "bigint": "Int64", "double": "Float64", "boolean": "boolean"}
        made = {self.out.names[0]: np.full(n, key)}
        for field in self.out.fields[1:]:
            kind = types.get(field.dataType.simpleString(), object)
            value = columns.get(field.name)
            made[field.name] = pd.Series(np.full(n, value, object) if kind is object and (value is None or isinstance(value, str)) else pd.array([None] * n, kind) if value is None else value, dtype=kind)
        return pd.DataFrame(made)

    def released_columns(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """What rows, in order, put out."""
        raise NotImplementedError


def run(rows: DataFrame, by: str, processor: Ordered) -> DataFrame:
    """The stream that the processor makes of rows (by, its fields, mark). Needs the RocksDB state store."""
    return packed(rows.select(by, *processor.row.names, MARK), by).groupBy(by).transformWithStateInPandas(processor, processor.output, "Append", "None" if processor.silent_ms is None else "ProcessingTime")


def unmarked(rows: DataFrame) -> DataFrame:
    """rows with a null mark, if they have none yet."""
    return rows if MARK in rows.columns else rows.withColumn(MARK, F.lit(None).cast("string"))
