"""Two-way flows from a stream of packets, one state for each pair of endpoints.

Packets wait until the watermark has passed them, so that those of a pair are
taken in order of time whatever batch they came in. A flow is given out when a
packet comes that does not belong to it, or when the watermark has passed its
last packet by the idle limit: one that never ends is closed too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spillway.operators import flows

WAITING = "t long, row long, src string, sport int, dst string, dport int, proto string, size int, ttl int, window int, seq long, flags int"
_SIDE = ("n long", "bytes long", "ttl int", "window int", "seq long", "last long", "mean double", "squares double")
OPEN = "start long, end long, src string, sport int, dst string, dport int, proto string, flags int, syn long, synack long, ack long, " + ", ".join(f"{x.replace(' ', f'{d} ')}" for d in (0, 1) for x in _SIDE)
_OPEN_NAMES = [x.split()[0] for x in OPEN.split(", ")]
_WAITING_NAMES = [x.split()[0] for x in WAITING.split(", ")]


class OpenFlow:
    """What is known of a flow that may go on; -1 stands for a time not met."""

    def __init__(self, values: dict):
        self.v = values

    @classmethod
    def begun(cls, p: dict) -> OpenFlow:
        own = dict.fromkeys(_OPEN_NAMES, 0) | {c: p[c] for c in ("src", "sport", "dst", "dport", "proto")}
        return cls(own | {"start": p["t"], "end": p["t"], "syn": -1, "synack": -1, "ack": -1, "mean0": 0.0, "mean1": 0.0, "squares0": 0.0, "squares1": 0.0})

    def takes(self, p: dict, idle: int, active: int) -> bool:
        over = self.v["proto"] == "tcp" and self.v["flags"] & (flows.FIN | flows.RST)
        return not over and p["t"] - self.v["end"] <= idle and p["t"] - self.v["start"] <= active

    def add(self, p: dict) -> None:
        v, d = self.v, 0 if (p["src"], p["sport"]) == (self.v["src"], self.v["sport"]) else 1
        n = v[f"n{d}"]
        if not n:
            v |= {f"ttl{d}": p["ttl"], f"window{d}": p["window"], f"seq{d}": p["seq"]}
        else:
            gap = (p["t"] - v[f"last{d}"]) / 1000.0
            off = gap - v[f"mean{d}"]
            v[f"mean{d}"] += off / n
            v[f"squares{d}"] += off * (gap - v[f"mean{d}"])
        v |= {f"n{d}": n + 1, f"bytes{d}": v[f"bytes{d}"] + p["size"], f"last{d}": p["t"], "end": p["t"], "flags": p["flags"]}
        if p["proto"] == "tcp":
            syn, ack = p["flags"] & flows.SYN, p["flags"] & flows.ACK
            name = "syn" if syn and not ack else "synack" if syn and v["synack"] < 0 else "ack" if ack and v["synack"] >= 0 else None
            if name and v[name] < 0:
                v[name] = p["t"]


class Assembler(StatefulProcessor):
    def __init__(self, idle: float, active: float):
        self.idle, self.active = round(idle * 1e6), round(active * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.open = handle.getValueState("open", OPEN)

    def _advance(self, packets: list[dict], watermark: int) -> list[dict]:
        """Take the packets that the watermark (microseconds) has passed; gives the flows that have ended."""
        packets.sort(key=lambda p: (p["t"], p["row"]))
        flow = OpenFlow(dict(zip(_OPEN_NAMES, self.open.get(), strict=True))) if self.open.exists() else None
        done, left = [], []
        for p in packets:
            if p["t"] > watermark:
                left.append(p)
                continue
            if flow and not flow.takes(p, self.idle, self.active):
                done.append(flow.v)
                flow = None
            flow = flow or OpenFlow.begun(p)
            flow.add(p)
        if flow and watermark > flow.v["end"] + self.idle:
            done.append(flow.v)
            flow = None
        if left:
            self.waiting.put([tuple(p[c] for c in _WAITING_NAMES) for p in left])
        else:
            self.waiting.clear()
        if flow:
            self.open.update(tuple(flow.v[c] for c in _OPEN_NAMES))
        else:
            self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [p["t"] for p in left[:1]] + ([flow.v["end"] + self.idle] if flow else [])
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)
        return done

    def _held(self) -> list[dict]:
        return [dict(zip(_WAITING_NAMES, x, strict=True)) for x in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [r for frame in rows for r in frame[_WAITING_NAMES].to_dict("records")]
        yield self._given(self._advance(self._held() + new, timerValues.getCurrentWatermarkInMs() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._given(self._advance(self._held(), timerValues.getCurrentWatermarkInMs() * 1000))

    @staticmethod
    def _given(done: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(done, columns=_OPEN_NAMES)

    def close(self) -> None:
        pass


def assemble_stream(packets: DataFrame, delay: str = "10 seconds", idle: float = flows.IDLE, active: float = flows.ACTIVE) -> DataFrame:
    """The flows of a stream of packets, with the features of ``operators.flows.described``.

    A packet may come up to ``delay`` after ones with later times; what comes
    later still is dropped. Packets without a time, address, port or protocol
    are left out, other nulls count as 0. The session needs the state store that
    keeps its state in files (RocksDB).
    """
    numbers = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("size", "ttl", "window", "seq", "flags")}
    known = flows.endpoints(packets.withColumns(numbers).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)).withColumnRenamed("_t", "t")
    keyed = known.select("ts", *_WAITING_NAMES, F.col("_a.ip").alias("a"), F.col("_a.port").alias("ap"), F.col("_b.ip").alias("b"), F.col("_b.port").alias("bp"), F.col("proto").alias("p"))
    closed = keyed.groupBy("a", "ap", "b", "bp", "p").transformWithStateInPandas(Assembler(idle, active), OPEN, "Append", "EventTime")
    met = lambda c: F.when(F.col(c) >= 0, F.col(c))
    side = {}
    for d in (0, 1):
        head = F.when(F.col(f"n{d}") > 0, F.struct(F.col(f"ttl{d}").alias("ttl"), F.col(f"window{d}").alias("window"), F.col(f"seq{d}").alias("seq")))
        side |= {f"head{d}": head, f"gap{d}": F.col(f"mean{d}"), f"jitter{d}": F.when(F.col(f"n{d}") > 2, F.sqrt(F.col(f"squares{d}") / (F.col(f"n{d}") - 1))).otherwise(0.0)}
    first = F.struct("src", "sport", "dst", "dport", F.lit(0).alias("_d"), F.timestamp_micros("start").alias("ts"))
    counted = closed.withColumns(side | {"_first": first, "_start": F.col("start"), "_end": F.col("end"), "_flags": F.col("flags"), "_syn": met("syn"), "_synack_t": met("synack"), "_ack": met("ack"), "flow": F.lit(0)})
    return flows.described(counted).drop("_start", "flow")
