"""A ZIP archive as byte ranges: its directory is read, its members are not extracted.

``members`` reads the end of the file, follows it to the central directory (through
the ZIP64 records where they are needed) and returns where each member's bytes lie.
A stored member is then a byte range of the archive, and any part of it can be
read alone.  Bytes before the archive, as self-extracting files have them, shift
all places and are allowed for.
"""

from __future__ import annotations

import struct
from typing import NamedTuple, Protocol


class Ranges(Protocol):
    """What is read from: a file that gives any range of its bytes."""

    def size(self) -> int: ...

    def read_at(self, nbytes: int, offset: int) -> bytes: ...


class Member(NamedTuple):
    name: str
    header: int  # where the local header is
    packed: int  # bytes in the archive
    size: int  # bytes when unpacked
    stored: bool


END, END64, LOCATOR, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
#: The longest comment, and the two records that may stand before the last one.
COMMENT = 0xFFFF
U32 = 0xFFFFFFFF


def _end(f: Ranges) -> tuple[int, int, int]:
    """(entries, place of the central directory, what all places are shifted by)."""
    size = f.size()
    low = max(0, size - COMMENT - 22 - 20)
    tail = f.read_at(size - low, low)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(END, 0, at)  # a signature within a comment
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    disk, first, _, entries, length, place = struct.unpack_from("<HHHHII", tail, at + 4)
    end = low + at
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR:
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        record = f.read_at(56, where)
        if record[:4] != END64:  # shifted: it stands before the locator, without further data
            where = low + at - 20 - 56
            record = f.read_at(56, where)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of directory where its locator points")
        disk, first, _, entries, length, place = struct.unpack_from("<IIQQQQ", record, 16)
        end = where
    if disk != first:
        raise ValueError("a ZIP archive in several volumes")
    return entries, place, end - length - place


def members(f: Ranges) -> list[Member]:
    """All members, in the order of the central directory."""
    entries, place, shift = _end(f)
    at, out, data, base = place + shift, [], b"", 0

    def need(n: int) -> None:
        nonlocal data, base
        if at + n > base + len(data):
            data, base = f.read_at(max(n, min(1 << 20, f.size() - at)), at), at

    for _ in range(entries):
        need(46)
        if data[at - base : at - base + 4] != ENTRY:
            raise ValueError(f"no member of a ZIP directory at {at}")
        flags, method = struct.unpack_from("<HH", data, at - base + 8)
        packed, size, named, extra, comment, disk = struct.unpack_from("<IIHHHH", data, at - base + 20)
        header = struct.unpack_from("<I", data, at - base + 42)[0]
        need(46 + named + extra)
        raw = data[at - base + 46 : at - base + 46 + named]
        fields = data[at - base + 46 + named : at - base + 46 + named + extra]
        place = 0
        while place + 4 <= len(fields):
            kind, length = struct.unpack_from("<HH", fields, place)
            if kind == 1:  # 64-bit values of those fields that are full, in this order
                values = iter(struct.unpack_from(f"<{length // 8}Q", fields, place + 4))
                size = next(values) if size == U32 else size
                packed = next(values) if packed == U32 else packed
                header = next(values) if header == U32 else header
            place += 4 + length
        if flags & 1:
            raise ValueError("an encrypted member")
        out.append(Member(raw.decode("utf-8" if flags & 0x800 else "cp437"), header + shift, packed, size, method == 0))
        at += 46 + named + extra + comment
    return out


def start(f: Ranges, member: Member) -> int:
    """Where the bytes of a member begin: after its local header, whose extra fields may differ from the directory's."""
    header = f.read_at(30, member.header)
    if header[:4] != LOCAL:
        raise ValueError(f"no member at {member.header}")
    named, extra = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + named + extra
