"""Capture files and flow assembly against plain loops over packets."""

import ipaddress
import math
import random
import statistics
import struct

import pytest

from spillway.operators import flows
from spillway.sources import packets

FIN, SYN, RST, ACK = 1, 2, 4, 16


def ip4(src, dst, number, body, ttl=64, fragment=0):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 7, fragment, ttl, number, 0, ipaddress.ip_address(src).packed, ipaddress.ip_address(dst).packed) + body


def ip6(src, dst, number, body, hops=33):
    return struct.pack(">IHBB16s16s", 6 << 28, len(body), number, hops, ipaddress.ip_address(src).packed, ipaddress.ip_address(dst).packed) + body


def tcp(sport, dport, seq=1000, flags=0, window=8192, more=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 0x50, flags, window, 0, 0) + more


def udp(sport, dport, more=b"x" * 16):
    return struct.pack(">HHHH", sport, dport, 8 + len(more), 0) + more


def frame(kind, body, vlan=0):
    return b"\xbb" * 6 + b"\xaa" * 6 + b"".join(struct.pack(">HH", 0x8100, 5) for _ in range(vlan)) + struct.pack(">H", kind) + body


def classic(path, records, order="<", nano=False, cut=0):
    out = struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for us, raw in records:
        out += struct.pack(order + "IIII", us // 1_000_000, us % 1_000_000 * (1000 if nano else 1), len(raw), len(raw)) + raw
    path.write_bytes(out[: len(out) - cut])
    return str(path)


def blocks(path, records):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535) + struct.pack("<HHB3xHH", 9, 1, 9, 0, 0))
    for us, raw in records:
        t = us * 1000
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(raw), len(raw)) + raw + b"\0" * (-len(raw) % 4)) + block(5, b"\0" * 12)
    path.write_bytes(out)
    return str(path)


def some_records(rng, n):
    out, want, t = [], [], 1_700_000_000_000_000
    for k in range(n):
        t += rng.randrange(3_000_000)
        a, b, sport, dport = f"10.0.0.{rng.randrange(9)}", f"10.0.1.{rng.randrange(9)}", rng.randrange(65536), rng.randrange(65536)
        seq, flags, window, ttl, more = rng.randrange(2**32), rng.randrange(64), rng.randrange(65536), rng.randrange(256), bytes(rng.randrange(256) for _ in range(rng.randrange(90)))
        kind = rng.randrange(9)
        if kind == 0:
            raw, row = frame(0x0800, ip4(a, b, 6, tcp(sport, dport, seq, flags, window, more), ttl), k % 3), (a, b, sport, dport, "tcp", ttl, window, seq, flags)
        elif kind == 1:
            raw, row = frame(0x0800, ip4(a, b, 17, udp(sport, dport, more), ttl)), (a, b, sport, dport, "udp", ttl, 0, 0, 0)
        elif kind == 2:
            raw, row = frame(0x86DD, ip6("fe80::1", "2001:db8::2", 6, tcp(sport, dport, seq, flags, window))), ("fe80::1", "2001:db8::2", sport, dport, "tcp", 33, window, seq, flags)
        elif kind == 3:
            raw, row = frame(0x86DD, ip6("::1", "::2", 0, bytes([58, 0]) + b"\0" * 6 + b"\x80\0\0\0" + more)), ("::1", "::2", 0, 0, "icmp", 33, 0, 0, 0)
        elif kind == 4:
            raw, row = frame(0x0800, ip4(a, b, 1, b"\x08\0\0\0" + more, ttl)), (a, b, 0, 0, "icmp", ttl, 0, 0, 0)
        elif kind == 5:
            raw, row = frame(0x0800, ip4(a, b, 6, tcp(sport, dport, seq, flags, window, more), ttl, fragment=33)), (a, b, 0, 0, "6", ttl, 0, 0, 0)
        elif kind == 6:
            raw, row = frame(0x0800, ip4(a, b, 6, b"\0" * 7, ttl)), (a, b, 0, 0, "6", ttl, 0, 0, 0)
        elif kind == 7:
            raw, row = frame(0x0806, more), None  # no IP packet
        else:
            raw, row = frame(0x0800, ip4(a, b, 6, b"")[: rng.randrange(20)]), None  # cut within its IP header
        out.append((t, raw))
        if row:
            want.append((t, *row[:5], len(raw), *row[5:]))
    return out, want


@pytest.mark.parametrize("layout", ["little", "big", "nano", "blocks", "cut"])
@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_read_packets(spark, tmp_path, layout, split):
    records, want = some_records(random.Random(split), 120)
    path = tmp_path / "a.pcap"
    if layout == "blocks":
        blocks(path, records)
    else:
        classic(path, records, ">" if layout == "big" else "<", layout == "nano", 5 if layout == "cut" else 0)
    if layout == "cut" and len(want) and want[-1][0] == records[-1][0]:
        want = want[:-1]
    got = packets.read_packets(spark, [str(path)], split).orderBy("row").selectExpr("unix_micros(ts)", "src", "dst", "sport", "dport", "proto", "size", "ttl", "window", "seq", "flags").collect()
    assert [tuple(r) for r in got] == want


def test_read_packets_of_several_and_empty_files(spark, tmp_path):
    records, want = some_records(random.Random(4), 30)
    paths = [classic(tmp_path / "a", records), classic(tmp_path / "b", []), blocks(tmp_path / "c", records[:10])]
    found = packets.read_packets(spark, paths, 333)
    assert {(r.file, r.n) for r in found.groupBy("file").count().withColumnRenamed("count", "n").collect()} == {(paths[0], len(want)), (paths[2], sum(w[0] <= records[9][0] for w in want))}
    (tmp_path / "d").write_bytes(b"no capture, but long enough for a head")
    with pytest.raises(ValueError, match="no capture"):
        packets.read_packets(spark, [str(tmp_path / "d")])
    assert packets.read_packets(spark, []).count() == 0


def test_a_payload_that_looks_like_records(spark, tmp_path):
    """Headers inside payloads mislead no range."""
    inner, _ = some_records(random.Random(6), 6)
    classic(tmp_path / "inner", inner)
    trap = (tmp_path / "inner").read_bytes()[24:]
    records = [(1_700_000_000_000_000 + k, frame(0x0800, ip4("10.0.0.1", "10.0.0.2", 17, udp(k, 9, trap)))) for k in range(40)]
    path = classic(tmp_path / "a", records)
    got = packets.read_packets(spark, [path], 211).orderBy("row").collect()
    assert [(r.sport, r.size) for r in got] == [(k, len(raw)) for k, (_, raw) in enumerate(records)]


COLUMNS = "row long, ts timestamp, src string, dst string, sport int, dport int, proto string, size int, ttl int, window int, seq long, flags int"


def loop(rows, idle=120.0, active=600.0):
    """Flows as lists of (row, forward), one packet after the other."""
    live, done = {}, []
    for r in sorted(rows, key=lambda r: (r["t"], r["row"])):
        own, back = (r["src"], r["sport"], r["dst"], r["dport"], r["proto"]), (r["dst"], r["dport"], r["src"], r["sport"], r["proto"])
        key = own if own in live else back if back in live else None
        if key is not None:
            f = live[key]
            last = f[-1][0]
            if r["t"] - last["t"] > round(idle * 1e6) or r["t"] - f[0][0]["t"] > round(active * 1e6) or last["proto"] == "tcp" and last["flags"] & (FIN | RST):
                done.append(live.pop(key))
                key = None
        if key is None:
            key = own
            live[key] = []
        live[key].append((r, key == own))
    return done + list(live.values())


def features(flow):
    first, last = flow[0][0], flow[-1][0]
    sides = [[r for r, forward in flow if forward == d] for d in (True, False)]
    gaps = [[(b["t"] - a["t"]) / 1000 for a, b in zip(s, s[1:], strict=False)] for s in sides]
    dur = (last["t"] - first["t"]) / 1e6
    syn = synack = ack = None
    for r, _ in flow:
        if r["proto"] == "tcp":
            s, a = r["flags"] & SYN, r["flags"] & ACK
            if s and not a and syn is None:
                syn = r["t"]
            elif s and a and synack is None:
                synack = r["t"]
            elif a and synack is not None and ack is None:
                ack = r["t"]
    one = max((synack - syn) / 1e6, 0) if syn is not None and synack is not None else 0.0
    two = max((ack - synack) / 1e6, 0) if ack is not None and synack is not None else 0.0
    state = "RST" if last["proto"] == "tcp" and last["flags"] & RST else "FIN" if last["proto"] == "tcp" and last["flags"] & FIN else "CON" if all(sides) else "INT"
    size = [sum(r["size"] for r in s) for s in sides]
    head = lambda s, c: s[0][c] if s else 0
    out = {"src": first["src"], "sport": first["sport"], "dst": first["dst"], "dport": first["dport"], "proto": first["proto"], "dur": dur, "state": state, "spkts": len(sides[0]), "dpkts": len(sides[1]), "sbytes": size[0], "dbytes": size[1]}
    out |= {"rate": len(flow) / dur if dur else 0.0, "sload": size[0] * 8 / dur if dur else 0.0, "dload": size[1] * 8 / dur if dur else 0.0, "synack": one, "ackdat": two, "tcprtt": one + two}
    for k, p in enumerate("sd"):
        out |= {f"{p}ttl": head(sides[k], "ttl"), f"{p}win": head(sides[k], "window"), f"{p}tcpb": head(sides[k], "seq"), f"{p}inpkt": statistics.fmean(gaps[k]) if gaps[k] else 0.0, f"{p}jit": statistics.pstdev(gaps[k]) if len(gaps[k]) > 1 else 0.0, f"{p}mean": size[k] / len(sides[k]) if sides[k] else 0.0}
    return out | {"is_sm_ips_ports": int(first["src"] == first["dst"] and first["sport"] == first["dport"]), "_t": first["t"]}


def packets_of(rng, n, hot=0.7):
    """Packets of a few pairs, one of them hot: bursts, long runs over the active limit, breaks over the idle one, equal times."""
    rows, t = [], {}
    for k in range(n):
        pair = 0 if rng.random() < hot else rng.randrange(1, 8)
        t[pair] = t.get(pair, 10**15) + rng.choice([0, 10, 10**6, 20 * 10**6, 20 * 10**6, 60 * 10**6, 120 * 10**6, 120 * 10**6 + 1]) * (rng.random() < 0.97) + 200 * 10**6 * (rng.random() < 0.02)
        a, b = ("10.0.0.9", 80), ("10.0.0.1", 1000 + pair)
        if pair == 7:
            a = b
        if rng.random() < 0.4:
            a, b = b, a
        proto = "udp" if pair == 3 else "icmp" if pair == 4 else "tcp"
        flags = rng.choice([ACK] * 60 + [SYN] * 3 + [SYN | ACK] * 3 + [FIN | ACK, RST, 0]) if proto == "tcp" else 0
        rows.append({"row": k, "t": t[pair], "src": a[0], "dst": b[0], "sport": a[1], "dport": b[1], "proto": proto, "size": rng.randrange(40, 1500), "ttl": rng.randrange(256), "window": rng.randrange(9999), "seq": rng.randrange(2**32), "flags": flags})
    return rows


def frame_of(spark, rows):
    df = spark.createDataFrame([tuple(r[c] for c in ("row", "t", "src", "dst", "sport", "dport", "proto", "size", "ttl", "window", "seq", "flags")) for r in rows], COLUMNS.replace("ts timestamp", "t long"))
    return df.withColumn("ts", df.t.cast("long")).selectExpr("* except (t, ts)", "timestamp_micros(ts) AS ts").repartition(5)


@pytest.mark.parametrize(("seed", "idle", "active"), [(1, 120.0, 600.0), (2, 120.0, 45.0), (3, 1000.0, 300.0)])
def test_assembly_equals_the_loop(spark, seed, idle, active):
    rows = packets_of(random.Random(seed), 1500)
    want = sorted((features(f) for f in loop(rows, idle, active)), key=repr)
    got = flows.assemble(frame_of(spark, rows), idle, active).withColumn("_t", flows.F.unix_micros("start"))
    mine = sorted(({c: r[c] for c in want[0]} for r in got.collect()), key=repr)
    assert len(mine) == len(want)
    by = lambda f: (f["_t"], f["src"], f["sport"], f["dst"], f["dport"], f["proto"], f["spkts"], f["dpkts"], f["sbytes"])
    for a, b in zip(sorted(mine, key=by), sorted(want, key=by), strict=True):
        assert all(math.isclose(a[c], b[c], rel_tol=1e-9, abs_tol=1e-9) if isinstance(b[c], float) else a[c] == b[c] for c in b), (a, b)
    if active >= 600:
        assert any(f["dur"] > 500 for f in want)


def test_long_runs_take_no_more_rounds(spark, monkeypatch):
    """A run that the active limit cuts a thousand times, over many chunks, is gone through in as many steps as a short one."""
    saves = []
    monkeypatch.setattr(flows, "saved", lambda df, saved=flows.saved: saves.append(1) or saved(df))
    rounds = []
    for n in (12, 3000):
        rows = [{"row": k, "t": 10**15 + (k * 7 // 5) * 10**6, "src": "10.0.0.1", "dst": "10.0.0.2", "sport": 1, "dport": 2, "proto": "udp", "size": 1, "ttl": 1, "window": 1, "seq": 1, "flags": 0} for k in range(n)]
        saves.clear()
        got = sorted((r["n"], r["first"]) for r in flows.flow_numbers(frame_of(spark, rows), 10.0, 2.5).groupBy("flow").agg(flows.F.count("*").alias("n"), flows.F.min("row").alias("first")).collect())
        assert got == sorted((len(f), f[0][0]["row"]) for f in loop(rows, 10.0, 2.5))
        rounds.append(len(saves))
    assert rounds[0] == rounds[1]


def test_trailing_counts_and_state(spark):
    rows = packets_of(random.Random(8), 900, 0.3)
    got = sorted((r.asDict() for r in flows.assemble(frame_of(spark, rows), trailing=10).collect()), key=lambda r: (r["start"], r["src"], r["sport"], r["dst"], r["dport"], r["proto"]))
    states = sorted({r["state"] for r in got})
    for k, r in enumerate(got):
        for name, keys in flows.COUNTED.items():
            assert r[name] == sum(all(x[c] == r[c] for c in keys) for x in got[max(0, k - 10) : k]), (k, name)
        assert r["ct_state_ttl"] == states.index(r["state"]) * 4 + (0 if r["sttl"] <= 31 else 1 if r["sttl"] <= 63 else 2 if r["sttl"] <= 127 else 3)
        assert all(r[c] == 0 for c in flows.ZERO) and r["service"] == "-"


def test_assembly_of_odd_packets(spark):
    rows = packets_of(random.Random(9), 60)
    df = frame_of(spark, rows)
    odd = df.limit(1).selectExpr("* except (ts, row)", "-1L AS row", "CAST(null AS timestamp) AS ts").unionByName(df.limit(1).selectExpr("* except (src, row)", "-2L AS row", "CAST(null AS string) AS src"))
    assert flows.assemble(df.unionByName(odd)).count() == len(loop(rows))
    assert flows.assemble(df.limit(0)).count() == 0


def test_stream_equals_the_loop(spark, tmp_path):
    """Packets out of order within and across batches, a flow that never ends, and pairs that go quiet."""
    from spillway.streaming import assembly

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(12)
    rows = packets_of(rng, 400, 0.4)
    rows.sort(key=lambda r: r["t"] + rng.randrange(8_000_000))
    late = max(r["t"] for r in rows) + 10**10
    last = rows[0] | {"src": "10.9.9.9", "dst": "10.9.9.8", "t": late, "row": 10**6}
    parts = [rows[k : k + 80] for k in range(0, 400, 80)] + [[last], [last | {"t": late + 1000, "row": 10**6 + 1}]]
    for k, part in enumerate(parts):
        frame_of(spark, part).coalesce(1).write.parquet(str(tmp_path / "made"), mode="overwrite")
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = assembly.assemble_stream(stream).writeStream.format("memory").queryName("assembled").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert not q.isActive and q.exception() is None
    want = [features(f) for f in loop(rows)]
    mine = [r.asDict() | {"_t": r.us} for r in spark.table("assembled").withColumn("us", flows.F.unix_micros("start")).collect()]
    by = lambda f: (f["_t"], f["src"], f["sport"], f["dst"], f["dport"], f["proto"], f["spkts"], f["dpkts"], f["sbytes"])
    assert len(mine) == len(want)
    for a, b in zip(sorted(mine, key=by), sorted(want, key=by), strict=True):
        assert all(math.isclose(a[c], b[c], rel_tol=1e-9, abs_tol=1e-9) if isinstance(b[c], float) else a[c] == b[c] for c in b), (a, b)
