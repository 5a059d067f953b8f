"""Fixed-window quota by key: a window opens at a key's first request and is not extended by others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bucket:
    """State of one key: requests let through and when the window ends (ms)."""

    __slots__ = ("count", "reset")

    def __init__(self, count: int = 0, reset: int = -1):
        self.count, self.reset = count, reset

    def request(self, now: int, limit: int, window: int) -> tuple[bool, int]:
        """Whether a request at now passes, and the seconds to wait if it does not."""
        if self.reset <= now:
            self.count, self.reset = 0, now + window
        if self.count >= limit:
            return False, max(1, -(-(self.reset - now) // 1000))
        self.count += 1
        return True, 0


def fixed_window(requests: DataFrame, key: str, at_ms: str, order: str, limit: int, window_ms: int) -> DataFrame:
    """Adds allowed and retry_after to each request, by key and time, ties by order.

    Rows are sorted within partitions, which may spill, and read as a stream: one key's requests are
    never held together. A null key is a key.
    """

    def run(batches):
        import pandas as pd

        current, bucket = object(), Bucket()
        for pdf in batches:
            allowed, retry = [], []
            for k, now in zip(pdf[key].tolist(), pdf[at_ms].tolist(), strict=True):
                if k != current and not (pd.isna(k) and current is None):
                    current, bucket = None if pd.isna(k) else k, Bucket()
                ok, wait = bucket.request(int(now), limit, window_ms)
                allowed.append(ok)
                retry.append(wait)
            yield pdf.assign(allowed=allowed, retry_after=retry)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.repartition(key).sortWithinPartitions(key, at_ms, order).mapInPandas(run, f"{schema}, allowed boolean, retry_after int")


def bounded_keys(requests: DataFrame, key: str, at_ms: str, order: str, limit: int, window_ms: int, most_keys: int) -> DataFrame:
    """fixed_window with a bound on live keys: a new key beyond it is refused for a whole window.

    The bound is over all keys at once, so this has to see requests in one order: it runs in one task
    and is meant for the stream of one gateway.
    """

    def run(batches):
        live: dict[object, Bucket] = {}
        for pdf in batches:
            allowed, retry = [], []
            for k, now in zip(pdf[key].tolist(), pdf[at_ms].tolist(), strict=True):
                if k not in live:
                    if len(live) >= most_keys:
                        live = {x: b for x, b in live.items() if b.reset > now}
                    if len(live) >= most_keys:
                        allowed.append(False)
                        retry.append(-(-window_ms // 1000))
                        continue
                    live[k] = Bucket()
                ok, wait = live[k].request(int(now), limit, window_ms)
                allowed.append(ok)
                retry.append(wait)
            yield pdf.assign(allowed=allowed, retry_after=retry)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.coalesce(1).sortWithinPartitions(at_ms, order).mapInPandas(run, f"{schema}, allowed boolean, retry_after int")


def with_millis(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.withColumn("at_ms", F.unix_millis(F.col(ts).cast("timestamp")))
