"""Binary formats read without generated code: protocol buffers, snappy blocks, XOR chunks, pprof and remote write."""

from __future__ import annotations

import gzip
import re
import struct
from collections import defaultdict
from collections.abc import Iterator


class WireError(ValueError):
    """Bytes that are no message of the format."""


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next position) of a base-128 number."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise WireError("a number is cut short")
        byte = data[at]
        value |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return value & (1 << 64) - 1, at
        shift += 7


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def zigzag(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a message's fields; fixed ones as bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise WireError("a field is cut short")
        else:
            raise WireError(f"wire type {kind}")
        if at > len(data):
            raise WireError("a field is cut short")
        yield key >> 3, kind, value


def message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = defaultdict(list)
    for number, _, value in fields(data):
        out[number].append(value)
    return out


def packed(values: list) -> list[int]:
    """Whole numbers of a repeated field, packed or not."""
    out = []
    for v in values:
        if isinstance(v, int):
            out.append(v)
            continue
        at = 0
        while at < len(v):
            n, at = varint(v, at)
            out.append(n)
    return out


def double(value: bytes) -> float:
    return struct.unpack("<d", value)[0]


def unsnappy(data: bytes) -> bytes:
    """A snappy block."""
    size, at = varint(data, 0)
    out = bytearray()
    while at < len(data):
        tag = data[at]
        at += 1
        if tag & 3 == 0:
            n = tag >> 2
            if n >= 60:
                extra = n - 59
                n = int.from_bytes(data[at : at + extra], "little")
                at += extra
            out += data[at : at + n + 1]
            at += n + 1
            continue
        if tag & 3 == 1:
            n, back = (tag >> 2 & 7) + 4, (tag >> 5) << 8 | data[at]
            at += 1
        else:
            wide = 2 if tag & 3 == 2 else 4
            n, back = (tag >> 2) + 1, int.from_bytes(data[at : at + wide], "little")
            at += wide
        if not 0 < back <= len(out):
            raise WireError("a copy from outside the block")
        while n > 0:  # a copy may overlap what it makes
            part = out[-back:][:n] if back > n else bytes(out[-back:])
            out += part[:n]
            n -= len(part)
    if len(out) != size:
        raise WireError(f"{len(out)} bytes instead of {size}")
    return bytes(out)


def labels_of_text(text: str) -> dict[str, str]:
    """{a="b", c="d"} as a dictionary."""
    found = re.fullmatch(r'\s*\{\s*((?:[A-Za-z_][\w.:]*\s*=\s*"(?:[^"\\]|\\.)*"\s*,?\s*)*)\}\s*', text, re.S)
    if not found:
        raise WireError(f"no labels: {text!r}")
    plain = lambda v: re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), v)
    return {k: plain(v) for k, v in re.findall(r'([A-Za-z_][\w.:]*)\s*=\s*"((?:[^"\\]|\\.)*)"', found[1], re.S)}


def pairs_of(raw: list[bytes]) -> dict[str, str]:
    """Messages (name, value) as a dictionary."""
    out = {}
    for p in map(message, raw):
        out[p[1][0].decode() if p[1] else ""] = p[2][0].decode() if p[2] else ""
    return out


def log_push(body: bytes) -> list[tuple[dict[str, str], int, str, dict[str, str]]]:
    """(labels, ts ns, line, metadata) of a snappy push request of log streams."""
    out = []
    for stream in map(message, message(unsnappy(body))[1]):
        labels = labels_of_text(stream[1][0].decode()) if stream[1] else {}
        for entry in map(message, stream[2]):
            at = message(entry[1][0]) if entry[1] else {}
            ns = sum(signed(at[k][0]) * scale for k, scale in ((1, 1_000_000_000), (2, 1)) if at and at[k])
            out.append((labels, ns, entry[2][0].decode("utf-8", "replace") if entry[2] else "", pairs_of(entry[3])))
    return out


def profile_push(body: bytes) -> list[tuple[dict[str, str], str, bytes]]:
    """(labels, id, pprof) of a push request of profile series."""
    out = []
    for series in map(message, message(gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body)[1]):
        labels = pairs_of(series[1])
        for sample in map(message, series[2]):
            out.append((labels, sample[2][0].decode() if sample[2] else "", sample[1][0] if sample[1] else b""))
    return out


# --- encoding
def put_varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def put(number: int, value: int | bytes | str | float) -> bytes:
    if isinstance(value, bool) or isinstance(value, int):
        return put_varint(number << 3) + put_varint(int(value))
    if isinstance(value, float):
        return put_varint(number << 3 | 1) + struct.pack("<d", value)
    raw = value.encode() if isinstance(value, str) else value
    return put_varint(number << 3 | 2) + put_varint(len(raw)) + raw


# --- remote write
def remote_write_v1(body: bytes) -> list[tuple[dict[str, str], int, float]]:
    """(labels with __name__, ts ms, value) of a snappy write request."""
    out = []
    for ts in message(unsnappy(body))[1]:
        m = message(ts)
        labels = {}
        for pair in m[1]:
            p = message(pair)
            labels[p[1][0].decode()] = p[2][0].decode() if p[2] else ""
        for sample in m[2]:
            s = message(sample)
            out.append((labels, signed(s[2][0]) if s[2] else 0, double(s[1][0]) if s[1] else 0.0))
    return out


def encode_remote_write(rows: list[tuple[dict[str, str], int, float]]) -> bytes:
    """A snappy write request of (labels with __name__, ts ms, value); samples of equal labels share a series, labels and times in order."""
    import pyarrow as pa

    series: dict[tuple, list[tuple[int, float]]] = defaultdict(list)
    for labels, ts, v in rows:
        series[tuple(sorted(labels.items()))].append((ts, v))
    body = b"".join(put(1, b"".join(put(1, put(1, k) + put(2, v)) for k, v in labels) + b"".join(put(2, put(1, float(v)) + put(2, ts)) for ts, v in sorted(points))) for labels, points in series.items())
    return pa.compress(body, codec="snappy", asbytes=True)


def remote_write_v2(body: bytes) -> list[tuple[dict[str, str], int, float]]:
    """The same of the second version, whose strings are in a table."""
    m = message(unsnappy(body))
    symbols = [s.decode() for s in m[4]]
    out = []
    for ts in m[5]:
        t = message(ts)
        refs = packed(t[1])
        if len(refs) % 2 or any(r >= len(symbols) for r in refs):
            raise WireError("labels are pairs of symbols")
        labels = {symbols[a]: symbols[b] for a, b in zip(refs[::2], refs[1::2], strict=True)}
        for sample in t[2]:
            s = message(sample)
            out.append((labels, signed(s[2][0]) if s[2] else 0, double(s[1][0]) if s[1] else 0.0))
    return out


# --- chunks
class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8

    def take(self, n: int) -> int:
        if n > self.left:
            raise WireError("the chunk is cut short")
        self.left -= n
        return self.value >> self.left & (1 << n) - 1


def xor_chunk(data: bytes) -> list[tuple[int, float]]:
    """(ts, value) of a Gorilla chunk: a 16-bit count; first sample whole, then deltas of deltas and XORs of values."""
    count = struct.unpack(">H", data[:2])[0]
    if not count:
        return []
    at = 2
    raw, at = varint(data, at)
    t, (v,) = zigzag(raw), struct.unpack(">Q", data[at : at + 8])
    at += 8
    out = [(t, v)]
    bits = None
    delta = lead = trail = 0
    for k in range(1, count):
        if k == 1:
            delta, at = varint(data, at)
            bits = _Bits(data[at:])
        else:
            ones = 0
            while ones < 4 and bits.take(1):
                ones += 1
            width = (0, 14, 17, 20, 64)[ones]
            if width:
                d = bits.take(width)
                delta += d - (1 << width) if d > 1 << (width - 1) or width == 64 and d >> 63 else d
        t += delta
        if bits.take(1):
            if bits.take(1):
                lead, size = bits.take(5), bits.take(6) or 64
                trail = 64 - lead - size
            v ^= bits.take(64 - lead - trail) << trail
        out.append((t, v))
    return [(t, struct.unpack(">d", struct.pack(">Q", v))[0]) for t, v in out]


# --- pprof
def decode_pprof(body: bytes) -> dict:
    """sample_types, period_type, time_nanos and samples (stack leaf to root, values, labels); the body may be gzipped."""
    m = message(gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body)
    strings = [s.decode("utf-8", "replace") for s in m[6]]
    text = lambda values: strings[values[0]] if values else ""
    names = {f[1][0]: text(f[2]) for f in map(message, m[5])}
    frames = {}
    for loc in map(message, m[4]):
        lines = [names.get(message(line)[1][0], "") for line in loc[4]]
        frames[loc[1][0]] = lines or [hex(loc[3][0]) if loc[3] else "unknown"]
    kind = lambda raw: (text(message(raw)[1]), text(message(raw)[2]))
    samples = []
    for s in map(message, m[2]):
        stack = [f for loc in packed(s[1]) for f in frames.get(loc, ["unknown"])]
        labels = {text(p[1]): text(p[2]) for p in map(message, s[3]) if p[2]}
        samples.append((stack, [signed(v) for v in packed(s[2])], labels))
    return {"sample_types": [kind(x) for x in m[1]], "period_type": kind(m[11][0]) if m[11] else ("", ""), "time_nanos": signed(m[9][0]) if m[9] else 0, "samples": samples}


def encode_pprof(stacks: list[tuple[list[str], int]], sample_type: tuple[str, str], time_nanos: int = 0) -> bytes:
    """A gzipped profile of (stack leaf to root, value) rows."""
    strings: dict[str, int] = {"": 0}
    index = lambda s: strings.setdefault(s, len(strings))
    functions: dict[str, int] = {}
    body = put(1, put(1, index(sample_type[0])) + put(2, index(sample_type[1])))
    for stack, value in stacks:
        ids = [functions.setdefault(f, len(functions) + 1) for f in stack]
        body += put(2, put(1, b"".join(map(put_varint, ids))) + put(2, put_varint(value)))
    for name, k in functions.items():
        body += put(4, put(1, k) + put(4, put(1, k))) + put(5, put(1, k) + put(2, index(name)))
    body += b"".join(put(6, s) for s in strings) + put(9, time_nanos)
    return gzip.compress(body, mtime=0)
