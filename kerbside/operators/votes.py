"""Votes of classifiers: softmax, colour majority with lock, class majority with hysteresis."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

#: Colour names by number (fixed values).
COLOURS = {1: "white", 2: "black", 3: "red", 4: "yellow", 5: "grey", 6: "blue", 7: "green", 8: "brown"}


def softmax_argmax(df: DataFrame, logits: str, base: int = 1) -> DataFrame:
    """Adds cls (the first of the largest logits, counted from base) and prob."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top.cast("double")))
    return df.withColumns({"cls": (F.array_position(logits, top) - 1 + base).cast("int"), "prob": 1 / total})


def color_candidates(objects: DataFrame, min_class: int = 2, min_area: int = 8000) -> DataFrame:
    """Vehicles large enough for the colour classifier, without those whose colour is locked."""
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    found = objects.filter((F.col("label") > min_class) & (area > min_area))
    return found.filter(~F.col("color_lock")) if "color_lock" in objects.columns else found


def _counted(votes: DataFrame, strong: float, lock_at: int, key: str) -> DataFrame:
    """The votes that count, with the hits of their colour so far and the vote that locks the track (lock_seq)."""
    weighted = votes.withColumn("weight", F.when(F.col("confidence") > strong, 3).otherwise(1))
    running = F.sum("weight").over(Window.partitionBy(key, "color").orderBy("vote_seq").rowsBetween(Window.unboundedPreceding, 0))
    summed = weighted.withColumn("hits", running)
    lock = F.min(F.when(F.col("hits") > lock_at, F.col("vote_seq"))).over(Window.partitionBy(key))
    return summed.withColumn("lock_seq", lock).filter(F.col("lock_seq").isNull() | (F.col("vote_seq") <= F.col("lock_seq")))


def color_so_far(votes: DataFrame, strong: float = 0.95, lock_at: int = 4, key: str = "track_id") -> DataFrame:
    """(key, vote_seq, color): the leading colour after each vote that counts."""
    leader = F.max(F.struct("hits", (-F.col("color")).alias("smaller"))).over(Window.partitionBy(key).orderBy("vote_seq").rowsBetween(Window.unboundedPreceding, 0))
    return _counted(votes, strong, lock_at, key).select(key, "vote_seq", (-leader["smaller"]).alias("color"))


def color_majority(votes: DataFrame, strong: float = 0.95, lock_at: int = 4, key: str = "track_id") -> DataFrame:
    """(key, color, hits, locked): sure votes weigh 3; a colour with more than lock_at hits locks the track, and later votes don't count.

    A running sum by track and colour finds the locking vote, so a track's votes are sorted, never gathered.
    """
    best = F.max(F.struct("hits", (-F.col("color")).alias("smaller"))).alias("best")
    return _counted(votes, strong, lock_at, key).groupBy(key).agg(best, F.max("lock_seq").alias("lock_seq")).select(key, (-F.col("best.smaller")).alias("color"), F.col("best.hits").alias("hits"), F.col("lock_seq").isNotNull().alias("locked"))


@dataclass(frozen=True)
class ClassRules:
    accept_over: float = 0.7
    young: int = 5
    few_hits: int = 3
    strong_over: float = 0.8
    lead: int = 2
    lock_over: int = 8
    classes: int = 10


@dataclass
class ClassState:
    """A track's class, the hits of each, and whether it is settled."""

    cls: int
    hits: dict[int, int] = field(default_factory=dict)
    locked: bool = False

    def vote(self, label: int, confidence: float, age: int, rules: ClassRules) -> None:
        if self.locked or not (confidence > rules.accept_over or age <= rules.young or self.hits.get(self.cls, 0) < rules.few_hits):
            return
        self.hits[label] = self.hits.get(label, 0) + (2 if confidence > rules.strong_over else 1)
        leads = min(self.hits, key=lambda k: (-self.hits[k], k))  # of equals the smallest class
        if self.hits[leads] >= self.hits.get(self.cls, 0) + rules.lead:
            self.cls = leads
        self.locked = self.hits[leads] > rules.lock_over


def class_majority(matches: DataFrame, rules: ClassRules = ClassRules(), key: str = "track_id", order: str = "frame_id") -> DataFrame:
    """(key, class_id, locked) after all votes in order; the first vote's label is where a track starts.

    Votes come sorted in Arrow batches and are folded with one track's state, a few numbers, carried from batch to batch; what comes after the lock is passed over. So a track may
    have any number of votes. Labels that are null or beyond ``classes`` count for none.
    """
    rows = matches.select(key, order, F.col("label").cast("int").alias("label"), F.col("confidence").cast("double").alias("confidence"), F.col("age").cast("long").alias("age"))
    out = StructType([StructField(key, rows.schema[key].dataType), StructField("class_id", IntegerType()), StructField("locked", BooleanType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        now, state, done = None, None, []

        def emitted():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
            done.clear()
            return batch

        for batch in batches:
            keys, *columns = (batch.column(k).to_pylist() for k in (0, 2, 3, 4))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)] if keys else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                name = keys[a]
                if state is None or name != now:
                    if state is not None:
                        done.append((now, state.cls, state.locked))
                    now, state = name, ClassState(columns[0][a])
                for k in range(a, b):
                    if state.locked:
                        break
                    if columns[0][k] is not None and 0 < columns[0][k] <= rules.classes:
                        state.vote(columns[0][k], columns[1][k] or 0.0, columns[2][k] or 0, rules)
            if len(done) > 5000:
                yield emitted()
        if state is not None:
            done.append((now, state.cls, state.locked))
        if done:
            yield emitted()

    return rows.repartition(key).sortWithinPartitions(key, order, "label", "confidence", "age").mapInArrow(run, out)
