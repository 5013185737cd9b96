"""Keyed state by shards: many keys share one state value, read and written as a whole.

A call into a stateful Python operator and each of its state requests cost some milliseconds,
however little they do. So operators are not called once a key but once a shard of keys, and a
shard's state is one value of columns. A micro-batch reads and writes the shards it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from pageflow import rules

TTL_MS = rules.STATE_TTL_DAYS * 86_400_000
# Shards of a query, fixed for its life: what a task holds at once is a shard's keys.
SHARDS = 1024
# Stands for null in a whole number, which pandas would turn into a fraction; it is the smallest, as null is.
NONE = -(2**63)


def whole(name: str) -> Column:
    """A whole number as it travels through Python."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NONE)).alias(name)


def restored(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(NONE)).alias(name)


def shard_of(*keys: str | Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")


class Held:
    """What a shard knows of each of its keys: ``keys`` and ``values`` as columns, and when a key was last written.

    With ``ttl_ms`` every key is forgotten that long after its own last write, as if it had a
    state value of its own. Without it, nothing is.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, keys: list[T.StructField], values: list[T.StructField],
                 ttl_ms: int | None = TTL_MS):
        fields = [*keys, *values, T.StructField("written_ms", T.LongType())]
        columns = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields])
        self.state = handle.getValueState(name, columns, ttl_ms)
        self.keys, self.ttl_ms = len(keys), ttl_ms

    def read(self, now_ms: int) -> dict[tuple, tuple]:
        """Values by key; the last value of a key is when it was written."""
        found = self.state.get()
        since = NONE if self.ttl_ms is None else now_ms - self.ttl_ms
        return {row[: self.keys]: row[self.keys :] for row in zip(*found) if row[-1] > since} if found else {}

    def write(self, held: dict[tuple, tuple]) -> None:
        rows = [key + value for key, value in held.items()]
        self.state.update(tuple([list(c) for c in zip(*rows)])) if rows else self.state.clear()
