"""Change feeds: a stream of inserts and deletes, applied to a session batch by batch.

A source has the columns op ('insert' or 'delete') and the relation's fields f0, f1, ...; within a batch the
change with the largest `order` value wins for each fact. A batch stays a DataFrame: it is compared with
the input by joins and never passes the driver. The batch's number is the admission key, so a batch that
the stream repeats after a failure is applied once. Numbers only rise; the last one is kept by the session under the
feed's name and goes with its checkpoints, so it holds after a restart too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weirlog.session import Applied, Session
from weirlog.types import RuleError


class Feed:
    """Applies change batches to one input relation of a session."""

    def __init__(self, session: Session, relation: str, order: str | None = None, listen: Callable[[int, Applied], None] | None = None, name: str | None = None) -> None:
        if relation not in session.schemas or not session.schemas[relation].input:
            raise RuleError(f"{relation} is not an input relation")
        self.session, self.relation, self.order, self.listen, self.name = session, relation, order, listen, name or relation

    def apply(self, batch: DataFrame, key: int) -> None:
        """One batch of changes; a key that was applied before is a lookup."""
        if key <= self.session.feeds.get(self.name, -1):
            return
        session, schema = self.session, self.session.schemas[self.relation]
        columns = schema.columns
        if self.order:
            last = Window.partitionBy(*columns).orderBy(F.col(self.order).desc(), F.col("op"))
            batch = batch.withColumn("_last", F.row_number().over(last)).where(F.col("_last") == 1)
        else:
            batch = batch.groupBy(*columns).agg(F.max("op").alias("op"))  # without an order an insert wins
        old = session.inputs[self.relation]
        part = lambda op: batch.where(F.col("op") == op).select(*(F.col(c).cast(f.dataType).alias(c) for c, f in zip(columns, schema.struct, strict=True)))
        come = part("insert").distinct().join(old, columns, "left_anti").select(*columns)
        gone = part("delete").distinct().join(old, columns, "left_semi").select(*columns)
        applied = session._advance({self.relation: (old, come, gone)}, self.listen is not None)
        self.session.feeds[self.name] = key
        if self.listen:
            self.listen(key, applied)

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Runs the feed over a streaming DataFrame; available_now ends after what is there."""
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
