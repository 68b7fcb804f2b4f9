"""Chat session history (H1/W1/X14) and clearing (H2).

History keeps the last ``n`` messages of each session; ``row_number() <= n`` is planned with a
partial ``WindowGroupLimit`` before the shuffle, so a very long session sends only ``n`` rows per
map task, and the collected list per session is bounded by ``n``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: messages kept per session.
HISTORY_LENGTH = 10
# Role labels in the rendered history.
USER_LABEL, OTHER_LABEL = "User", "Assistant"


def last_messages(messages: DataFrame, n: int = HISTORY_LENGTH) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    return messages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def session_history(messages: DataFrame, n: int = HISTORY_LENGTH) -> DataFrame:
    """``(session_id, history)``: "User: …" / "Assistant: …" lines, oldest first, joined by \\n."""
    last = last_messages(messages, n)
    line = F.concat(F.when(F.col("role") == "user", F.lit(USER_LABEL)).otherwise(F.lit(OTHER_LABEL)),
                    F.lit(": "), F.col("content"))
    agg = last.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("_l"))
    return agg.select("session_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("history"))


def clear_sessions(messages: DataFrame, cleared: DataFrame) -> DataFrame:
    """H2: drop every message of the listed sessions (left anti join on session_id)."""
    ids = cleared.select(F.col("session_id").alias("_sid")).distinct()
    return messages.join(ids, F.col("session_id") == F.col("_sid"), "left_anti")
