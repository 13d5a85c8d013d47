"""Dashboard numbers kept up to date from a stream of finished inspections.

Counting a stream by status would count a re-submitted inspection twice.  Here every micro-batch is one commit of the version
log: it finds the last version of the ids it brings and keeps by how much the numbers of each day change. The numbers are
the sum of these changes; no month is read or written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.version_log import VersionLog


def start(stream: DataFrame, log: VersionLog, work_path: str, name: str = "live") -> StreamingQuery:
    """Run over everything available; `work_path` holds the checkpoint.

    A micro-batch that is repeated after a failure has the same number and is taken once. Re-deliveries of a version
    change nothing, late corrections count.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        log.upsert(batch, source=f"{name}-{batch_id}")

    return (
        stream.writeStream.foreachBatch(commit)
        .option("checkpointLocation", f"{work_path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_kpis(log: VersionLog) -> DataFrame:
    return log.measures(["day"])
