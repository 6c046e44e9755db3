"""TCP sessions with retransmissions and reordering: what depends on the state of a connection.

Per flow, in order of arrival. Only flows of one connection meet in one task; nothing is shared across captures.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

FIN, SYN, RST, ACK = 1, 2, 4, 16
OUT = "capture string, flow string, sid int, pkt_idx long, ts double, direction int, state string, retransmissions int, out_of_order int, released boolean"


def _flow(pdf: pd.DataFrame, gap: float) -> list[tuple]:
    out: list[tuple] = []
    s = None
    sid = -1
    for r in pdf.sort_values("pkt_idx", kind="stable").itertuples(index=False):
        if s is None or s["closed"] or r.ts - s["last"] > gap:
            # What a timed-out or closed session still holds back is never released.
            sid += 1
            s = {"from": (r.src_ip, r.src_port), "state": "INIT", "closed": False, "next": {1: None, -1: None}, "held": {1: {}, -1: {}}, "re": 0, "ooo": 0, "fins": set()}
        s["last"] = r.ts
        d = 1 if (r.src_ip, r.src_port) == s["from"] else -1
        syn, ack = bool(r.tcp_flags & SYN), bool(r.tcp_flags & ACK)

        def give(row, way, s=s):
            out.append((row.capture, row.flow, sid, row.pkt_idx, row.ts, way, s["state"], s["re"], s["ooo"], True))

        if syn and not ack:
            if s["state"] != "INIT":
                s["re"] += 1
                continue
            s["state"], s["next"][d] = "SYN_SENT", r.tcp_seq + 1
            give(r, d)
        elif syn:
            if s["state"] != "SYN_SENT":
                s["re"] += 1
                continue
            s["state"], s["next"][d] = "SYN_RECEIVED", r.tcp_seq + 1
            give(r, d)
        elif r.tcp_flags & RST:
            s["state"], s["closed"] = "CLOSED", True
            give(r, d)
        else:
            if s["state"] == "SYN_RECEIVED" and ack:
                s["state"] = "ESTABLISHED"
            if s["state"] in ("ESTABLISHED", "FIN_WAIT") and r.payload_length > 0 and s["next"][d] is not None:
                due = s["next"][d]
                if r.tcp_seq < due:
                    s["re"] += 1
                    continue
                if r.tcp_seq > due:
                    s["ooo"] += 1
                    s["held"][d][r.tcp_seq] = r
                    continue
                give(r, d)
                s["next"][d] = due + r.payload_length
                while s["next"][d] in s["held"][d]:
                    late = s["held"][d].pop(s["next"][d])
                    give(late, d)
                    s["next"][d] += late.payload_length
            else:
                give(r, d)
            if r.tcp_flags & FIN:
                s["fins"].add(d)
                s["state"] = "FIN_WAIT"
                if len(s["fins"]) == 2:
                    s["state"], s["closed"] = "CLOSED", True
    if s is not None and not s["closed"]:  # the capture's end releases the rest, forward first
        for d in (1, -1):
            for seq in sorted(s["held"][d]):
                r = s["held"][d][seq]
                out.append((r.capture, r.flow, sid, r.pkt_idx, r.ts, d, s["state"], s["re"], s["ooo"], True))
    return out


def reassembled(packets: DataFrame, gap: float = 300.0) -> DataFrame:
    """Packets in order of release, with session, direction, state and the counts so far."""
    names = [x.split()[0] for x in OUT.split(", ")]
    cols = ["capture", "flow", "pkt_idx", "ts", "src_ip", "src_port", "tcp_flags", "tcp_seq", "payload_length"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_flow(pdf, gap), columns=names)

    return packets.select(*cols).groupBy("capture", "flow").applyInPandas(run, OUT)
