"""The quota as a Structured Streaming operator with state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.quota import Bucket


def streaming_quota(requests: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """allowed and retry_after of requests (key string, request_id long, at timestamp with a watermark) as they come, by key.

    The state of a key is two numbers; it is dropped when the watermark passes the end of its window.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(*state.get) if state.exists else Bucket()
        rows = pd.concat(list(batches)).sort_values(["at", "request_id"])
        rows["at_ms"] = rows["at"].astype("datetime64[ms]").astype("int64")
        got = [bucket.request(int(now), limit, window_ms) for now in rows["at_ms"]]
        state.update((bucket.count, bucket.reset))
        state.setTimeoutTimestamp(max(bucket.reset, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "request_id": rows["request_id"].to_numpy(), "at_ms": rows["at_ms"].to_numpy(), "allowed": [a for a, _ in got], "retry_after": [r for _, r in got]})

    return requests.groupBy("key").applyInPandasWithState(step, "key string, request_id long, at_ms long, allowed boolean, retry_after int", "count int, reset long", "append", "EventTimeTimeout")
