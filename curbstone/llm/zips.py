"""Reading ZIP packages by their directories: central and ZIP64, without extraction."""

from __future__ import annotations

import struct
from collections.abc import Callable
from typing import NamedTuple

#: Fixed values of the format: signatures, and what stands in a field whose value is in the ZIP64 one.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 1
STORED = 0


class Member(NamedTuple):
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


ReadAt = Callable[[int, int], bytes]


def _end_record(read_at: ReadAt, size: int) -> tuple[int, int, int]:
    """(members, directory's size, its offset)."""
    tail_at = max(0, size - 22 - FULL16)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    members, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if members == FULL16 or FULL32 in (length, offset):
        locator = read_at(tail_at + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        record = read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end record")
        members, length, offset = struct.unpack_from("<QQQ", record, 32)
    return members, length, offset


def directory(read_at: ReadAt, size: int) -> list[Member]:
    """All members of a package of the given size."""
    members, length, offset = _end_record(read_at, size)
    data, at, found = read_at(offset, length), 0, []
    for _ in range(members):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("central directory is damaged")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, packed, unpacked, n_name, n_extra, n_note = struct.unpack_from("<IIIHHH", data, at + 16)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == EXTRA64:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                unpacked, packed, header = (next(values) if x == FULL32 else x for x in (unpacked, packed, header))
            extra = extra[4 + n :]
        found.append(Member(name, method, crc, packed, unpacked, header))
        at += 46 + n_name + n_extra + n_note
    return found


def data_offset(read_at: ReadAt, member: Member) -> int:
    """Where a stored member's bytes begin in the package."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed, so its records can't be read by range")
    head = read_at(member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra
