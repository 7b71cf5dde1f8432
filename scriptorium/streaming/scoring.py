"""The stateless scorers applied to a stream of model responses.

The reference has no streaming (no event time, watermark or keyed state);
its nearest relative is the flush-per-row gold log.  Because R3/R4 are
per-row column logic, the same functions accept a streaming DataFrame: the
gold selections are appended to a parquet sink as responses arrive, with a
checkpoint location so a restarted query resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.scoring import gold_selection_rows, selection_rewards


def gold_selection_stream(responses: DataFrame) -> DataFrame:
    """Streaming R3 R4 K4: scored responses -> right answers only."""
    # the log is ordered by the trigger that wrote a row
    return gold_selection_rows(selection_rewards(responses), seq=F.unix_micros(F.current_timestamp()))


def start_gold_log(responses: DataFrame, sink_path: str, checkpoint_path: str,
                   available_now: bool = True) -> StreamingQuery:
    """Append gold selections to ``sink_path`` as files arrive at the source."""
    w = (gold_selection_stream(responses).writeStream.format("parquet")
         .option("path", sink_path).option("checkpointLocation", checkpoint_path)
         .outputMode("append"))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
