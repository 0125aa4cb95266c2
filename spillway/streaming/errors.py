"""Detectors over a stream of right and wrong decisions: state by entity, updated row by row in order of a key.

DDM watches the error rate, EDDM the distance between errors; both follow their
papers (Gama et al. 2004, Baena-Garcia et al. 2006).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WARM_UP, WARN_AT, DRIFT_AT = 30, 2.0, 3.0
#: n, error rate, least rate, its deviation
FRESH_DDM = (0, 0.0, math.inf, math.inf)
#: n, errors, place of the last one, mean and squared deviations of distances, largest level
FRESH_EDDM = (0, 0, 0, 0.0, 0.0, 0.0)


def ddm(state: tuple, wrong: bool) -> tuple[tuple, str]:
    """The state after a decision, and "", "warning" or "drift"; after a drift the state is fresh."""
    n, rate, least, spread = state
    n += 1
    rate += (wrong - rate) / n
    own = math.sqrt(rate * (1 - rate) / n)
    if n < WARM_UP:
        return (n, rate, least, spread), ""
    if rate + own <= least + spread:
        least, spread = rate, own
    if rate + own > least + DRIFT_AT * spread:
        return FRESH_DDM, "drift"
    return (n, rate, least, spread), "warning" if rate + own > least + WARN_AT * spread else ""


def eddm(state: tuple, wrong: bool, warn: float = 0.95, drift: float = 0.9) -> tuple[tuple, str]:
    n, errors, last, mean, squares, top = state
    n += 1
    if not wrong:
        return (n, errors, last, mean, squares, top), ""
    errors, gap, last = errors + 1, n - last, n
    off = gap - mean
    mean += off / errors
    squares += off * (gap - mean)
    level = mean + 2 * math.sqrt(squares / errors)
    if level > top:
        return (n, errors, last, mean, squares, level), ""
    if errors < WARM_UP:
        return (n, errors, last, mean, squares, top), ""
    if level / top < drift:
        return FRESH_EDDM, "drift"
    return (n, errors, last, mean, squares, top), "warning" if level / top < warn else ""


def monitor(stream: DataFrame, entity: str, order: str, wrong: str, kind: str = "ddm") -> DataFrame:
    """(entity, at, said): warnings and drifts of a stream of decisions (``wrong``: boolean, null counts as right).

    A micro-batch's rows of an entity are put in order of ``order``; bound a batch
    by the source (maxFilesPerTrigger), as they are held together.
    """
    step, fresh = (ddm, FRESH_DDM) if kind == "ddm" else (eddm, FRESH_EDDM)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, said = tuple(state.get) if state.exists else fresh, []
        rows = pd.concat(frames).sort_values(order)
        for at, x in zip(rows[order].tolist(), rows[wrong].fillna(False).tolist(), strict=True):
            now, what = step(now, bool(x))
            if what:
                said.append((key[0], at, what))
        state.update(tuple(float(v) for v in now))
        yield pd.DataFrame(said, columns=["entity", "at", "said"])

    fields = ", ".join(f"s{k} double" for k in range(len(fresh)))
    types = dict(stream.dtypes)
    return stream.groupBy(entity).applyInPandasWithState(update, f"entity {types[entity]}, at {types[order]}, said string", fields, "append", GroupStateTimeout.NoTimeout)
