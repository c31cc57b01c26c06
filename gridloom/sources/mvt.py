"""Mapbox vector tiles: the protobuf wire format read by hand."""

from __future__ import annotations

import gzip
import math
import struct


def _varint(b: bytes, at: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        c = b[at]
        at += 1
        v |= (c & 127) << shift
        if c < 128:
            return v, at
        shift += 7


def _fields(b: bytes):
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        kind = key & 7
        if kind == 0:
            v, at = _varint(b, at)
        elif kind == 1:
            v, at = b[at : at + 8], at + 8
        elif kind == 2:
            n, at = _varint(b, at)
            v, at = b[at : at + n], at + n
        elif kind == 5:
            v, at = b[at : at + 4], at + 4
        else:
            raise ValueError("not a vector tile")
        yield key >> 3, v


def _packed(b: bytes) -> list[int]:
    out, at = [], 0
    while at < len(b):
        v, at = _varint(b, at)
        out.append(v)
    return out


def _signed(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def _value(b: bytes) -> str:
    for f, v in _fields(b):
        if f == 1:
            return v.decode()
        if f == 2:
            return repr(struct.unpack("<f", v)[0])
        if f == 3:
            return repr(struct.unpack("<d", v)[0])
        if f == 6:
            return str(_signed(v))
        if f == 7:
            return "true" if v else "false"
        return str(v - (1 << 64) if f == 4 and v >> 63 else v)
    return ""


def _geometry(kind: int, commands: list[int]):
    x = y = at = 0
    rings: list = []
    while at < len(commands):
        op, n = commands[at] & 7, commands[at] >> 3
        at += 1
        if op == 7:
            rings[-1].append(rings[-1][0])
            continue
        for _ in range(n):
            x, y = x + _signed(commands[at]), y + _signed(commands[at + 1])
            at += 2
            if op == 1:
                rings.append([])
            rings[-1].append((x, y))
    if kind == 1:
        return ("POINT", rings) if len(rings) == 1 else ("MULTIPOINT", [[r[0] for r in rings]])
    if kind == 2:
        return ("LINESTRING", rings) if len(rings) == 1 else ("MULTILINESTRING", rings)
    return "POLYGON", rings


def decode_tile(data: bytes, z: int, tx: int, ty: int):
    """(layer, (kind, rings), attributes) of a tile; coordinates in degrees, ty counted from the north."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    for f, layer in _fields(data):
        if f != 3:
            continue
        name, extent, keys, values, found = "", 4096, [], [], []
        for g, v in _fields(layer):
            if g == 1:
                name = v.decode()
            elif g == 2:
                found.append(v)
            elif g == 3:
                keys.append(v.decode())
            elif g == 4:
                values.append(_value(v))
            elif g == 5:
                extent = v
        side = 2**z

        def degrees(p):
            x, y = (tx + p[0] / extent) / side, (ty + p[1] / extent) / side
            return x * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y))))

        for feature in found:
            kind, tags, commands = 0, [], []
            for g, v in _fields(feature):
                if g == 2:
                    tags = _packed(v)
                elif g == 3:
                    kind = v
                elif g == 4:
                    commands = _packed(v)
            if kind in (1, 2, 3) and commands:
                k, rings = _geometry(kind, commands)
                yield name, (k, [[degrees(p) for p in r] for r in rings]), {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}
