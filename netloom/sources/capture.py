"""Packet captures (pcap and pcapng) as a Spark data source, and link, network and transport headers.

    spark.dataSource.register(CaptureSource)
    spark.read.format("capture").option("max_packets", 1000).load("/captures/*.pcap")

One task reads one file as a stream, in bounded memory. A file that ends within a record ends there. Paths may be files,
folders (searched through: all *.pcap by name, then all *.pcapng) or hold wildcards in their last part; with a scheme they are
read from the store that it names.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The first four bytes of pcap files, with byte order and the fraction of a second that times count.
PCAP_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
PCAPNG = b"\x0a\x0d\x0d\x0a"
RAW_SCHEMA = "capture string, pkt_idx long, ts double, link_type int, data binary"
#: Link types whose headers are known.
ETHERNET, RAW_IP, LINUX_SLL = 1, 101, 113


def _exactly(f: BinaryIO, n: int) -> bytes | None:
    got = f.read(n)
    return got if len(got) == n else None


def _pcap(f: BinaryIO, order: str, unit: float) -> Iterator[tuple[float, int, bytes]]:
    head = _exactly(f, 20)
    if head is None:
        return
    link = struct.unpack(order + "I", head[16:])[0] & 0xFFFF
    while (h := _exactly(f, 16)) is not None:
        sec, frac, size, _ = struct.unpack(order + "IIII", h)
        data = _exactly(f, size)
        if data is None:
            return
        yield sec + frac / unit, link, data


def _resolution(options: bytes, order: str) -> float:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        if code == 9 and size >= 1:
            b = options[at + 4]
            return float(2 ** (b & 127) if b & 128 else 10**b)
        at += 4 + (size + 3) // 4 * 4
    return 1e6


def _pcapng(f: BinaryIO) -> Iterator[tuple[float, int, bytes]]:
    order, faces = "<", []
    kind = PCAPNG
    while True:
        size = _exactly(f, 4)
        if size is None:
            return
        if kind == PCAPNG:  # a new section: its own byte order and interfaces
            magic = _exactly(f, 4)
            if magic is None:
                return
            if magic not in (b"\x4d\x3c\x2b\x1a", b"\x1a\x2b\x3c\x4d"):
                raise ValueError("pcapng section without a byte order")
            order, faces = ("<" if magic[0] == 0x4D else ">"), []
            total = struct.unpack(order + "I", size)[0]
            body, code = _exactly(f, max(total - 16, 0)), 0x0A0D0D0A
        else:
            total, code = struct.unpack(order + "I", size)[0], struct.unpack(order + "I", kind)[0]
            body = _exactly(f, max(total - 12, 0))
        tail = _exactly(f, 4)
        if body is None or tail is None or struct.unpack(order + "I", tail)[0] != total:
            return
        if code == 1 and len(body) >= 8:
            faces.append((struct.unpack_from(order + "H", body)[0], _resolution(body[8:], order)))
        elif code == 6 and len(body) >= 20:
            face, hi, lo, held, _ = struct.unpack_from(order + "IIIII", body)
            link, unit = faces[face] if face < len(faces) else (ETHERNET, 1e6)
            yield ((hi << 32) | lo) / unit, link, body[20 : 20 + held]
        elif code == 3 and len(body) >= 4:  # simple packets have no time
            yield 0.0, faces[0][0] if faces else ETHERNET, body[4 : 4 + struct.unpack_from(order + "I", body)[0]]
        kind = _exactly(f, 4)
        if kind is None:
            return


def packets(f: BinaryIO, max_packets: int | None = None) -> Iterator[tuple[float, int, bytes]]:
    """Time, link type and bytes of each packet; at most max_packets are read."""
    if max_packets is not None and max_packets <= 0:
        raise ValueError("max_packets must be positive")
    magic = f.read(4)
    if len(magic) < 4:
        return
    if magic in PCAP_MAGIC:
        rows = _pcap(f, *PCAP_MAGIC[magic])
    elif magic == PCAPNG:
        rows = _pcapng(f)
    else:
        raise ValueError(f"neither pcap nor pcapng: {magic.hex()}")
    for i, x in enumerate(rows):
        if i == max_packets:
            return
        yield x


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def discover(paths: str) -> list[str]:
    """Files of paths, which are separated by commas."""
    from pyarrow import fs

    out = []
    for p in filter(None, paths.split(",")):
        store, inner = _store(p)
        prefix = p[: len(p) - len(inner)] if p.endswith(inner) else ""
        if any(c in inner for c in "*?["):
            base = posixpath.dirname(inner)
            found = [f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.path, inner)]
            out += sorted(prefix + f for f in found)
        elif (info := store.get_file_info(inner)).type == fs.FileType.Directory:
            found = [f.path for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File]
            out += [prefix + f for kind in (".pcap", ".pcapng") for f in sorted(found) if f.endswith(kind)]
        elif info.type == fs.FileType.File:
            out.append(p)
    if not out:
        raise FileNotFoundError(paths)
    return out


def kind_of(path: str) -> tuple[str, int]:
    """Format of a file by its first four bytes, the only ones that are read, and its size."""
    store, inner = _store(path)
    with store.open_input_stream(inner, compression=None) as f:
        magic = f.read(4)
    kind = "pcapng" if magic == PCAPNG else "unknown" if magic not in PCAP_MAGIC else "pcap" if PCAP_MAGIC[magic][1] == 1e6 else "pcap_ns"
    return kind, store.get_file_info(inner).size


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options.get("path", "")
        cap = options.get("max_packets")
        self.cap = int(cap) if cap is not None else None
        if self.cap is not None and self.cap <= 0:
            raise ValueError("max_packets must be positive")

    def partitions(self):
        return [_File(x) for x in discover(self.paths)]

    def read(self, partition):
        name = partition.path.rsplit("/", 1)[-1]
        store, inner = _store(partition.path)
        with store.open_input_stream(inner, compression=None, buffer_size=1 << 20) as f:
            for i, (ts, link, data) in enumerate(packets(f, self.cap)):
                yield name, i, ts, link, data


class CaptureSource(DataSource):
    """Format "capture"; path may be a folder, hold wildcards, and name several by commas."""

    @classmethod
    def name(cls):
        return "capture"

    def schema(self):
        return RAW_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


DECODED = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length int, payload_length int, tcp_flags int, tcp_seq long, tcp_ack long, tcp_window int, payload binary"


def decode(link: int, data: bytes) -> tuple | None:
    """The fields of DECODED; None if it isn't IP or is cut short. Bytes after the IP packet (padding) are no payload."""
    at = 0
    if link == ETHERNET:
        if len(data) < 14:
            return None
        kind, at = int.from_bytes(data[12:14], "big"), 14
        if kind == 0x8100 and len(data) >= 18:
            kind, at = int.from_bytes(data[16:18], "big"), 18
        if kind not in (0x0800, 0x86DD):
            return None
    elif link == LINUX_SLL:
        at = 16
    if len(data) < at + 20:
        return None
    version = data[at] >> 4
    if version == 4:
        head = (data[at] & 15) * 4
        length, protocol = int.from_bytes(data[at + 2 : at + 4], "big"), data[at + 9]
        src, dst = (".".join(map(str, data[at + k : at + k + 4])) for k in (12, 16))
    elif version == 6 and len(data) >= at + 40:
        head, protocol = 40, data[at + 6]
        length = int.from_bytes(data[at + 4 : at + 6], "big") + 40
        src, dst = (":".join(data[at + k + 2 * i : at + k + 2 * i + 2].hex() for i in range(8)) for k in (8, 24))
    else:
        return None
    body = data[at + head : at + length]
    if protocol == 6 and len(body) >= 20:
        sport, dport, seq, ack, off, flags, window = struct.unpack("!HHIIBBH", body[:16])
        payload = body[(off >> 4) * 4 :]
        return src, dst, sport, dport, 6, length, len(payload), flags, seq, ack, window, payload
    if protocol == 17 and len(body) >= 8:
        sport, dport, size = struct.unpack("!HHH", body[:6])
        payload = body[8 : max(size, 8)]
        return src, dst, sport, dport, 17, length, len(payload), 0, 0, 0, 0, payload
    return src, dst, 0, 0, protocol, length, len(body), 0, 0, 0, 0, body


def decoded(raw):
    """Raw packets with the fields of DECODED; packets that aren't IP are left out."""
    import pyarrow as pa

    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = ["capture", "pkt_idx", "ts", *[x.strip().split()[0] for x in DECODED.split(",")]]

    def run(batches):
        for b in batches:
            made = [decode(k, d) for k, d in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            keep = pa.array([i for i, x in enumerate(made) if x is not None], pa.int64())
            rest = list(zip(*[x for x in made if x is not None], strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(keep) for i in range(3)], *[pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]], names=names)

    return raw.select("capture", "pkt_idx", "ts", "link_type", "data").mapInArrow(run, f"capture string, pkt_idx long, ts double, {DECODED}")


def written(rows, folder: str):
    """Capture files, one for each value of `capture`, in the order of pkt_idx; rows: capture (a file name), pkt_idx, us (microseconds since 1970), data. Returns capture, packets, bytes.

    A capture is one file, so it is one task's work, which streams. A file has its name only when it is whole.
    """
    import pyarrow as pa

    def run(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        now, out, n, size = None, None, 0, 0
        done = []

        def end():
            out.close()
            store.move(f"{base}/_{now}", f"{base}/{now}")
            done.append((now, n, size))

        for b in batches:
            for capture, us, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if capture != now:
                    if out is not None:
                        end()
                    now, n, size, out = capture, 0, 24, store.open_output_stream(f"{base}/_{capture}", compression=None)
                    out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, ETHERNET))
                out.write(struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(data), len(data)) + data)
                n, size = n + 1, size + 16 + len(data)
        if out is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["capture", "packets", "bytes"])

    dealt = rows.select("capture", "pkt_idx", "us", "data").repartition("capture").sortWithinPartitions("capture", "pkt_idx")
    return dealt.mapInArrow(run, "capture string, packets long, bytes long")


def statistics(raw):
    """By capture: packets and bytes, how many are IP, TCP, UDP and other, with payload, first and last time."""
    from pyspark.sql import functions as F

    total = raw.groupBy("capture").agg(F.count("*").alias("packets"), F.sum(F.octet_length("data")).alias("bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    kinds = decoded(raw).groupBy("capture").agg(F.count("*").alias("ip"), F.count_if(F.col("protocol") == 6).alias("tcp"), F.count_if(F.col("protocol") == 17).alias("udp"), F.count_if(F.col("payload_length") > 0).alias("with_payload"), F.sum("payload_length").alias("payload_bytes"))
    out = total.join(kinds, "capture", "left").fillna(0)
    return out.withColumn("not_ip", F.col("packets") - F.col("ip")).withColumn("other_ip", F.col("ip") - F.col("tcp") - F.col("udp"))


def write_pcap(path: str, rows: list[tuple[float, bytes]], nano: bool = False, big: bool = False, link: int = ETHERNET) -> None:
    """A capture file, for tests and examples."""
    order, unit = (">" if big else "<"), (10**9 if nano else 10**6)
    with open(path, "wb") as f:
        f.write(struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, link))
        for ts, data in rows:
            f.write(struct.pack(order + "IIII", int(ts), round((ts - int(ts)) * unit), len(data), len(data)) + data)


def frame(src: str, sport: int, dst: str, dport: int, payload: bytes = b"", flags: int = 16, seq: int = 0, ack: int = 0, protocol: int = 6, pad: int = 0) -> bytes:
    """An Ethernet frame with an IPv4 packet, for tests and examples."""
    l4 = struct.pack("!HHIIBBHHH", sport, dport, seq, ack, 5 << 4, flags, 8192, 0, 0) if protocol == 6 else struct.pack("!HHHH", sport, dport, 8 + len(payload), 0)
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(l4) + len(payload), 0, 0, 64, protocol, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    return b"\x00" * 12 + b"\x08\x00" + ip + l4 + payload + b"\x00" * pad
