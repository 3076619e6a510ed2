"""A ZIP file's directory, read from its end by range: central records, with their ZIP64 forms, and members' places."""

from __future__ import annotations

import struct
from dataclasses import dataclass

# Fixed values of the ZIP format: signatures and the fixed parts of its records.
END, END64, LOCATOR64, CENTRAL, LOCAL = (b"PK" + bytes(x) for x in ((5, 6), (6, 6), (6, 7), (1, 2), (3, 4)))
END_SIZE, LOCATOR_SIZE, END64_SIZE, CENTRAL_SIZE, LOCAL_SIZE, LONGEST_COMMENT = 22, 20, 56, 46, 30, 65535
FULL16, FULL32, ZIP64_FIELD, STORED = 0xFFFF, 0xFFFFFFFF, 1, 0


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def read_range(source, start: int, size: int) -> bytes:
    """``size`` bytes from ``start`` of a seekable file; fewer are an error."""
    source.seek(start)
    data = source.read(size)
    if len(data) != size:
        raise ValueError(f"{size} bytes wanted at {start}, {len(data)} there")
    return bytes(data)


def _directory(source, length: int) -> tuple[int, int, int]:
    """Entries, size and offset of the central directory."""
    tail_at = max(0, length - END_SIZE - LONGEST_COMMENT)
    tail = read_range(source, tail_at, length - tail_at)
    last = len(tail) - END_SIZE + len(END)
    at = tail.rfind(END, 0, max(0, last))
    while at >= 0 and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at + len(END) - 1)
    if at < 0:
        raise ValueError("no end-of-directory record: not a ZIP file, or cut short")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if entries == FULL16 or size == FULL32 or offset == FULL32:
        signature, _, where, _ = struct.unpack("<4sIQI", read_range(source, tail_at + at - LOCATOR_SIZE, LOCATOR_SIZE))
        if signature != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        record = read_range(source, where, END64_SIZE)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end record")
        entries, size, offset = struct.unpack_from("<QQQ", record, 32)
    return entries, size, offset


def members(source, length: int) -> list[Member]:
    """The members in the central directory of a ZIP file of ``length`` bytes."""
    entries, size, offset = _directory(source, length)
    data, at, found = read_range(source, offset, size), 0, []
    for _ in range(entries):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIIHHH", data, at + 16)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + CENTRAL_SIZE : at + CENTRAL_SIZE + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + CENTRAL_SIZE + n_name :][:n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == ZIP64_FIELD:  # holds, in this order, those fields that are full above
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = next(wide) if full == FULL32 else full
                packed = next(wide) if packed == FULL32 else packed
                header = next(wide) if header == FULL32 else header
            extra = extra[4 + n :]
        found.append(Member(name, method, crc, packed, full, header))
        at += CENTRAL_SIZE + n_name + n_extra + n_note
    return found


def stored_at(source, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed in the archive; its parts can't be read by range")
    head = read_range(source, member.header, LOCAL_SIZE)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header for {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + LOCAL_SIZE + n_name + n_extra
