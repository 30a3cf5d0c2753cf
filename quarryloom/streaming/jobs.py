"""Three jobs as streams, each with a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_new_pages(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Fetched pages (source, content_hash, at) without repeats; state lasts as long as the watermark."""
    return stream.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["source", "content_hash"])


def new_pages(batch: DataFrame) -> DataFrame:
    """The batch twin: the first of equal (source, content_hash)."""
    return batch.groupBy("source", "content_hash").agg(F.min("at").alias("at"))


def rate_limit(requests: DataFrame, per_minute: int = 30) -> DataFrame:
    """Requests (caller, at) per caller and minute, flagged above the limit."""
    counted = requests.groupBy("caller", F.window("at", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return counted.select("caller", F.col("w.start").alias("minute"), "n", (F.col("n") > per_minute).alias("over"))


def stream_rate_limit(stream: DataFrame, per_minute: int = 30, watermark: str = "2 minutes") -> DataFrame:
    return rate_limit(stream.withWatermark("at", watermark), per_minute)


def stream_throttle(stream: DataFrame, interval: float) -> DataFrame:
    """Requests (origin, at double seconds, seq) with their grants: the state of an origin is its last grant.

    Requests of a micro-batch are granted in order of (at, seq); the state is one number per origin.
    """

    def grant(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        # the rows of one origin in one micro-batch, which the source's rate bounds
        frame = pd.concat(list(frames)).sort_values(["at", "seq"])
        granted = []
        for at in frame["at"]:
            last = at if last is None else max(at, last + interval)
            granted.append(last)
        state.update((last,))
        yield frame.assign(granted=granted, delay=[g - a for g, a in zip(granted, frame["at"], strict=True)])[["origin", "at", "seq", "granted", "delay"]]

    kinds = dict(stream.dtypes)
    schema = f"origin {kinds['origin']}, at double, seq {kinds['seq']}, granted double, delay double"
    return stream.select("origin", "at", "seq").groupBy("origin").applyInPandasWithState(grant, schema, "last double", "append", GroupStateTimeout.NoTimeout)
