"""Packets to two-way flows, without a task that must see all packets of a pair of endpoints.

A flow ends before a packet that comes more than ``idle`` seconds after the one
before it, more than ``active`` seconds after the flow's first, or after a
packet with FIN or RST. Where the active limit cuts depends on where it cut
before: packets are taken by chunks of time, each of which tells how it goes on
from any cut that it may begin with.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spillway.operators.blocks import saved
from spillway.operators.ordered import running_sums

IDLE, ACTIVE, TRAILING = 120.0, 600.0, 100
#: So many active limits of a pair's packets are one chunk.
SPANS = 32
#: Bits of the flags.
FIN, SYN, RST, ACK = 1, 2, 4, 16
#: What needs the payload or whole sequence numbers and is 0 (``service``: a dash), not guessed.
ZERO = ("sloss", "dloss", "trans_depth", "response_body_len", "is_ftp_login", "ct_ftp_cmd", "ct_flw_http_mthd")
PAIR = ["_a", "_b", "proto"]
COUNTED = {"ct_srv_src": ["src", "proto"], "ct_srv_dst": ["dst", "proto"], "ct_dst_ltm": ["dst"], "ct_src_ltm": ["src"], "ct_src_dport_ltm": ["src", "dport"], "ct_dst_sport_ltm": ["dst", "sport"], "ct_dst_src_ltm": ["src", "dst"]}


def endpoints(packets: DataFrame) -> DataFrame:
    """``packets`` with the pair of endpoints in one order (``_a``, ``_b``), the direction ``_d`` (0: from ``_a``) and ``_t`` in microseconds."""
    own, other = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    known = packets.where("ts IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL AND proto IS NOT NULL AND sport IS NOT NULL AND dport IS NOT NULL")
    return known.withColumns({"_a": F.least(own, other), "_b": F.greatest(own, other), "_d": (own > other).cast("int"), "_t": F.unix_micros(F.col("ts").cast("timestamp"))})


def _starts(t: np.ndarray, cuts: np.ndarray, first: np.ndarray, active: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, last, n): the rows that begin flows if the rows ``first`` do, until the next of ``cuts`` (sorted), and for each of ``first`` the last of them and how many they are.

    ``t`` are the sorted times of a chunk's rows. All are followed at once, a flow in each step.
    """
    end = np.append(cuts, len(t))[np.searchsorted(cuts, first, "right")]
    last, n, here, found = first.copy(), np.ones(len(first), np.int64), np.arange(len(first)), [first]
    while len(here):
        then = np.searchsorted(t, t[last[here]] + active, "right")
        here, then = here[then < end[here]], then[then < end[here]]
        last[here] = then
        n[here] += 1
        found.append(then)
    return np.concatenate(found), last, n


def flow_numbers(packets: DataFrame, idle: float = IDLE, active: float = ACTIVE) -> DataFrame:
    """``endpoints(packets)`` with ``flow``: the number of the packet's flow among those of its pair.

    Packets are put in order of ``ts``, those of one time in that of ``row``
    (distinct). Packets without a time, address, port or protocol are left out.
    A pair's packets are taken by chunks of SPANS active limits. Of a chunk goes
    on how the flow that it begins in, whose first packet is not known yet, cuts
    it: one step for each first cut that makes a difference. A pair's chunks are
    gone through in order, and then each chunk's packets get their numbers.
    """
    us = lambda seconds: round(seconds * 1e6)
    idle, active = us(idle), us(active)
    width = SPANS * max(active, 1)
    flat = {f"{c}_{x}": F.col(c)[x] for c in ("_a", "_b") for x in ("ip", "port")}
    pair, key = [*flat, "proto"], [*flat, "proto", "_chunk"]
    ended = F.when(F.col("proto") == "tcp", F.col("flags").bitwiseAND(FIN | RST) > 0).otherwise(F.lit(False))
    rows = endpoints(packets).withColumns({"_ended": F.coalesce(ended, F.lit(False)), "_chunk": F.floor(F.col("_t") / width), **flat}).drop("_a", "_b")
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*pair).schema}
    of_key = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", _chunk long"

    def ordered(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """The chunk's rows in order, their times, and the rows after the first that the idle limit or an ending cuts."""
        group = group.take(pa.array(np.lexsort([group["row"].to_numpy(), group["_t"].to_numpy()])))
        t = group["_t"].to_numpy()
        return group, t, np.flatnonzero((np.diff(t) > idle) | group["_ended"].to_numpy()[:-1]) + 1

    def summed(group: pa.Table) -> pa.Table:
        group, t, cuts = ordered(group)
        head = t[: cuts[0] if len(cuts) else len(t)]
        first = np.flatnonzero(np.diff(head, prepend=head[0] - 1))  # of packets of one time the first
        first = first[: np.searchsorted(head[first], group["_chunk"][0].as_py() * width + active, "right") + 1]
        _, last, n = _starts(t, cuts, first, active)
        tail, tail_last, _ = _starts(t, cuts, cuts, active)
        same = np.flatnonzero(np.append((np.diff(last) != 0) | (np.diff(n) != 0), True))  # the last first cut of those that go on alike
        made = {"first": t[0], "last": t[-1], "ended": bool(group["_ended"][-1].as_py()), "n": len(tail), "start": t[tail_last[-1]] if len(cuts) else None}
        steps = {"step": t[first[same]], "step_start": t[last[same]], "step_n": n[same]}
        out = group.select(key).slice(0, 1)
        for c, x in (made | {c: x.tolist() for c, x in steps.items()}).items():
            out = out.append_column(c, pa.array([x], pa.list_(pa.int64()) if c in steps else pa.bool_() if c == "ended" else pa.int64()))
        return out

    def entered(group: pa.Table) -> pa.Table:
        group = group.sort_by("_chunk")
        flows, start, made = 0, None, []
        before = None
        for x in group.drop_columns(pair).to_pylist():
            new = before is None or before["ended"] or x["first"] - before["last"] > idle
            made.append((flows, start, new))
            at = 0 if new else bisect_right(x["step"], start + active)
            if at < len(x["step"]):
                start, flows = x["step_start"][at], flows + x["step_n"][at]
            start, flows, before = start if x["start"] is None else x["start"], flows + x["n"], x
        flows, starts, new = zip(*made, strict=True)
        return group.select(key).append_column("_flows", pa.array(flows, pa.int64())).append_column("_start", pa.array(starts, pa.int64())).append_column("_new", pa.array(new, pa.bool_()))

    def told(group: pa.Table) -> pa.Table:
        group, t, cuts = ordered(group)
        first = np.array([0]) if group["_new"][0].as_py() else np.searchsorted(t, [group["_start"][0].as_py() + active], "right")
        first = first[first < (cuts[0] if len(cuts) else len(t))]
        new = np.zeros(len(t), np.int64)
        new[_starts(t, cuts, np.concatenate([first, cuts]), active)[0]] = 1
        return group.drop_columns(["_ended", "_chunk", "_flows", "_start", "_new"]).append_column("flow", pa.array(np.cumsum(new) + group["_flows"][0].as_py(), pa.int64()))

    chunks = rows.select(*key, "_t", "row", "_ended").groupBy(*key).applyInArrow(summed, f"{of_key}, first long, last long, ended boolean, n long, start long, step array<long>, step_start array<long>, step_n array<long>")
    entries = saved(chunks.groupBy(*pair).applyInArrow(entered, f"{of_key}, _flows long, _start long, _new boolean"))
    plain = rows.drop("_ended", "_chunk")
    numbered = rows.join(entries, key).groupBy(*key).applyInArrow(told, StructType([*plain.schema.fields, StructField("flow", LongType())]))
    return numbered.withColumns({c: F.struct(*[F.col(f"{c}_{x}").alias(x) for x in ("ip", "port")]) for c in ("_a", "_b")}).drop(*flat)


def assemble(packets: DataFrame, idle: float = IDLE, active: float = ACTIVE, trailing: int = TRAILING) -> DataFrame:
    """A row for each flow of ``packets`` (the columns of ``sources.packets.SCHEMA``; ``row`` distinct): endpoints, ``start``, and features.

    The endpoint that sent the first packet is the source. Loads, rates, gaps and
    jitter are 0 where they are not defined. A packet that is null in size, ttl,
    window, seq or flags counts with 0. No packets make no flows.
    """
    of = {"_size": "size", "_ttl": "ttl", "_win": "window", "_seq": "seq", "_flags": "flags"}
    rows = flow_numbers(packets.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in of.values()}), idle, active)
    key = [*PAIR, "flow"]
    own = Window.partitionBy(*key, "_d").orderBy("_t", "row")
    rows = saved(rows.withColumn("_gap", (F.col("_t") - F.lag("_t").over(own)) / 1000.0))
    order = F.struct("_t", "row")
    flag = lambda bits: F.col("flags").bitwiseAND(bits) > 0
    first = lambda when, what: F.min_by(what, F.when(when, order))
    tcp = F.col("proto") == "tcp"
    made = {"_first": F.min_by(F.struct("src", "sport", "dst", "dport", "_d", "ts"), order), "_start": F.min("_t"), "_end": F.max("_t"), "_flags": F.max_by("flags", order)}
    made |= {"_syn": F.min(F.when(tcp & flag(SYN) & ~flag(ACK), F.col("_t"))), "_synack": F.min(F.when(tcp & flag(SYN) & flag(ACK), order))}
    for d in (0, 1):
        here = F.col("_d") == d
        made |= {f"n{d}": F.count_if(here), f"bytes{d}": F.coalesce(F.sum(F.when(here, F.col("size"))), F.lit(0)), f"head{d}": first(here, F.struct("ttl", "window", "seq"))}
        made |= {f"gap{d}": F.coalesce(F.avg(F.when(here, F.col("_gap"))), F.lit(0.0)), f"jitter{d}": F.when(F.count(F.when(here, F.col("_gap"))) > 1, F.stddev_pop(F.when(here, F.col("_gap")))).otherwise(0.0)}
    flows = saved(rows.groupBy(*key).agg(*[c.alias(k) for k, c in made.items()]))
    answered = flows.where("_synack IS NOT NULL").select(*key, "_synack")
    acks = rows.where(tcp & flag(ACK)).join(answered, key).where(order > F.col("_synack")).groupBy(*key).agg(F.min("_t").alias("_ack"))
    flows = flows.join(acks, key, "left")

    return _state_ttl(trailing_counts(described(flows.withColumn("_synack_t", F.col("_synack._t"))), trailing)).drop("_start", "flow")


def described(flows: DataFrame) -> DataFrame:
    """Endpoints and features of flows from what was counted of each side: side 0 sent the first packet where ``_first._d`` is 0."""
    tcp, forward = F.col("proto") == "tcp", F.col("_first._d") == 0
    side = lambda name: (F.when(forward, F.col(f"{name}0")).otherwise(F.col(f"{name}1")), F.when(forward, F.col(f"{name}1")).otherwise(F.col(f"{name}0")))
    (spkts, dpkts), (sbytes, dbytes), (shead, dhead), (sgap, dgap), (sjit, djit) = (side(x) for x in ("n", "bytes", "head", "gap", "jitter"))
    dur = (F.col("_end") - F.col("_start")) / 1e6
    per = lambda x: F.when(dur > 0, x / dur).otherwise(0.0)
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    state = F.when(tcp & (F.col("_flags").bitwiseAND(RST) > 0), "RST").when(tcp & (F.col("_flags").bitwiseAND(FIN) > 0), "FIN").when(both, "CON").otherwise("INT")
    half = lambda to, since: F.coalesce(F.greatest((to - since) / 1e6, F.lit(0.0)), F.lit(0.0))
    synack, ackdat = half(F.col("_synack_t"), F.col("_syn")), half(F.col("_ack"), F.col("_synack_t"))
    zero = lambda c, n: F.coalesce(c[n], F.lit(0))
    columns = {
        "start": F.col("_first.ts"), "dur": dur, "service": F.lit("-"), "state": state, "spkts": spkts, "dpkts": dpkts, "sbytes": sbytes, "dbytes": dbytes, "rate": per(spkts + dpkts),
        "sttl": zero(shead, "ttl"), "dttl": zero(dhead, "ttl"), "sload": per(sbytes * 8.0), "dload": per(dbytes * 8.0), "sinpkt": sgap, "dinpkt": dgap, "sjit": sjit, "djit": djit, "swin": zero(shead, "window"), "dwin": zero(dhead, "window"),
        "stcpb": zero(shead, "seq"), "dtcpb": zero(dhead, "seq"), "tcprtt": synack + ackdat, "synack": synack, "ackdat": ackdat, "smean": F.when(spkts > 0, sbytes / spkts).otherwise(0.0), "dmean": F.when(dpkts > 0, dbytes / dpkts).otherwise(0.0),
        "is_sm_ips_ports": ((F.col("_first.src") == F.col("_first.dst")) & (F.col("_first.sport") == F.col("_first.dport"))).cast("int"),
    }
    ends = [F.col(f"_first.{c}").alias(c) for c in ("src", "sport", "dst", "dport")]
    return flows.select(*ends, "proto", "_start", "flow", *[c.alias(k) for k, c in columns.items()], *[F.lit(0).alias(c) for c in ZERO])


def trailing_counts(flows: DataFrame, most: int = TRAILING) -> DataFrame:
    """Add ``COUNTED``: how many of the ``most`` flows before each, in order of start, have the same values in its columns."""
    place = F.struct("_start", "src", "sport", "dst", "dport", "proto", "flow")
    times = flows.groupBy("_start").agg(F.count("*").alias("_n"))
    base = running_sums(times, "_start", {"_upto": "_n"}).select("_start", (F.col("_upto") - F.col("_n")).alias("_base"))
    ties = F.row_number().over(Window.partitionBy("_start").orderBy(place))
    rows = saved(flows.join(base, "_start").withColumn("_pos", F.col("_base") + ties).drop("_base"))
    own = F.floor(F.col("_pos") / most)
    dealt = rows.withColumn("_own", own).withColumn("_block", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    for name, keys in COUNTED.items():
        w = Window.partitionBy(*keys, "_block").orderBy("_pos").rangeBetween(-most, -1)
        dealt = dealt.withColumn(name, F.count("*").over(w).cast("int"))
    return dealt.where("_block = _own").drop("_own", "_block", "_pos")


def _state_ttl(flows: DataFrame) -> DataFrame:
    """Add ``ct_state_ttl``: four times the place of the state among those that come, and a bucket of the source's TTL."""
    flows = saved(flows)
    states = sorted(r["state"] for r in flows.select("state").distinct().collect())  # four at most
    place = F.array_position(F.array(*map(F.lit, states)), F.col("state")) - 1 if states else F.lit(0)
    bucket = F.when(F.col("sttl") <= 31, 0).when(F.col("sttl") <= 63, 1).when(F.col("sttl") <= 127, 2).when(F.col("sttl") <= 255, 3).otherwise(0)
    return flows.withColumn("ct_state_ttl", (place * 4 + bucket).cast("int"))
