"""Change detection over a stream of scores, one state per entity: Page-Hinkley, and ADWIN (Bifet and Gavalda 2007)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRESH = (0, 0.0, 0.0, 0.0)
#: Buckets of one size before the two oldest become one, scores between two tests, least scores of a window that is tested and of either side of a cut.
BUCKETS, CLOCK, GRACE, LEAST_SIDE = 5, 32, 10, 5
STATE = "n long, mean double, total double, least double, seen long, sizes array<long>, sums array<double>, squares array<double>"


def step(state: tuple, x: float, least_rows: int, delta: float, limit: float) -> tuple[tuple, bool]:
    """State after one score, and whether it raises an alarm; an alarm starts afresh."""
    n, mean, total, least = state
    n += 1
    mean += (x - mean) / n
    total += x - mean - delta
    least = min(least, total)
    return (FRESH, True) if n >= least_rows and total - least > limit else ((n, mean, total, least), False)


class Adwin:
    """A window of scores that shrinks where its parts' means differ, as an exponential histogram.

    ``buckets`` go from the oldest to the newest, each of a power of two scores:
    their number, sum and squared deviations. A window of n scores has at most
    ``BUCKETS`` of each size, so the state grows with the logarithm of n.
    """

    def __init__(self, delta: float, seen: int = 0, buckets: list[tuple[int, float, float]] | None = None):
        self.delta, self.seen, self.buckets = delta, seen, buckets or []

    @staticmethod
    def _joined(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
        apart = a[1] / a[0] - b[1] / b[0]
        return a[0] + b[0], a[1] + b[1], a[2] + b[2] + apart * apart * a[0] * b[0] / (a[0] + b[0])

    def add(self, x: float) -> bool:
        """Whether the window has changed with this score; its older part is gone then."""
        self.seen += 1
        self.buckets.append((1, x, 0.0))
        size, end = 1, len(self.buckets)
        while True:  # buckets of a size stand together: too many of them push one into the next size
            start = end
            while start and self.buckets[start - 1][0] == size:
                start -= 1
            if end - start <= BUCKETS:
                break
            self.buckets[start : start + 2] = [self._joined(self.buckets[start], self.buckets[start + 1])]
            size, end = 2 * size, start + 1
        changed = False
        while self.seen % CLOCK == 0 and self._differs():
            changed = True
            del self.buckets[0]
        return changed

    def _differs(self) -> bool:
        whole = self.buckets[0]
        for b in self.buckets[1:]:
            whole = self._joined(whole, b)
        n, total, squares = whole
        if n <= GRACE:
            return False
        trust = math.log(2 * math.log(n) / self.delta)
        left, left_sum = 0, 0.0
        for size, own, _ in self.buckets[:-1]:
            left, left_sum = left + size, left_sum + own
            right = n - left
            if left < LEAST_SIDE or right < LEAST_SIDE:
                continue
            inverse = 1 / (left - LEAST_SIDE + 1) + 1 / (right - LEAST_SIDE + 1)
            bound = math.sqrt(2 * inverse * squares / n * trust) + 2 / 3 * trust * inverse
            if abs(left_sum / left - (total - left_sum) / right) > bound:
                return True
        return False


def monitor_scores(stream: DataFrame, entity: str, order: str, score: str, detectors: tuple[str, ...] = ("adwin", "page_hinkley"), least_rows: int = 30, delta: float = 0.005, limit: float = 50.0, confidence: float = 0.002) -> DataFrame:
    """(entity, at, detector) of each score that raises an alarm of a detector.

    Within a micro-batch an entity's rows are taken in order of ``order``; rows of later batches come
    after. Null scores are passed over. The state of Page-Hinkley is four numbers an entity, that of
    ADWIN three for each bucket. ``delta`` and ``limit`` are Page-Hinkley's, ``confidence`` is ADWIN's.
    """
    if unknown := set(detectors) - {"adwin", "page_hinkley"}:
        raise ValueError(f"unknown detectors: {sorted(unknown)}")

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).dropna(subset=["score"]).sort_values("at")
        *plain, seen, sizes, sums, squares = held.get if held.exists else (*FRESH, 0, [], [], [])
        state, window, alarms = tuple(plain), Adwin(confidence, seen, list(zip(sizes, sums, squares, strict=True))), []
        for at, x in zip(rows["at"].tolist(), rows["score"].tolist(), strict=True):
            if "adwin" in detectors and window.add(float(x)):
                alarms.append((key[0], at, "adwin"))
            if "page_hinkley" in detectors:
                state, alarm = step(state, float(x), least_rows, delta, limit)
                if alarm:
                    alarms.append((key[0], at, "page_hinkley"))
        held.update((*state, window.seen, *([b[k] for b in window.buckets] for k in range(3))))
        yield pd.DataFrame(alarms, columns=["entity", "at", "detector"])

    rows = stream.selectExpr(f"`{entity}` AS entity", f"CAST(`{order}` AS LONG) AS at", f"CAST(`{score}` AS DOUBLE) AS score")
    kind = rows.schema["entity"].dataType.simpleString()
    return rows.groupBy("entity").applyInPandasWithState(run, f"entity {kind}, at long, detector string", STATE, "append", GroupStateTimeout.NoTimeout)


def page_hinkley(stream: DataFrame, entity: str, order: str, score: str, least_rows: int = 30, delta: float = 0.005, limit: float = 50.0) -> DataFrame:
    """(entity, at) of each score that raises an alarm of Page-Hinkley."""
    return monitor_scores(stream, entity, order, score, ("page_hinkley",), least_rows, delta, limit).drop("detector")


def compared(alarms: DataFrame, change: int) -> DataFrame:
    """(entity, detector, n_alarms, first_alarm, delay, early): how soon after ``change`` each detector raised an alarm (null: never), and how many it raised before."""
    at, after = F.col("at"), F.col("at") >= change
    return alarms.groupBy("entity", "detector").agg(F.count("*").alias("n_alarms"), F.min("at").alias("first_alarm"), (F.min(F.when(after, at)) - change).alias("delay"), F.count_if(~after).alias("early"))
