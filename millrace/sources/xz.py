"""Blocks of xz files: where they lie, by the indexes at the ends of the file's streams, and what one of them holds.

A block is unpacked as a small file of its own, made of its stream's header, the
block, and an index and a footer of one record, so its integrity check is kept.
"""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterator
from typing import NamedTuple

#: Fixed values of the public format.
HEADER_MAGIC, FOOTER_MAGIC = b"\xfd7zXZ\x00", b"YZ"
ENDS = 12


class Block(NamedTuple):
    offset: int
    packed: int  # with padding
    padding: int
    size: int
    flags: int


def _read_number(raw: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, and the place behind it."""
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not b & 0x80:
            return value, at


def _number(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _crc(raw: bytes) -> bytes:
    return zlib.crc32(raw).to_bytes(4, "little")


def read_blocks(file, size: int) -> list[Block]:
    """The blocks of all streams of a seekable binary file, in order; ValueError if it isn't whole."""
    out: list[list[Block]] = []
    end = size
    while end > 0:
        file.seek(end - 4)
        if file.read(4) == b"\0\0\0\0":  # padding between streams
            end -= 4
            continue
        file.seek(end - ENDS)
        footer = file.read(ENDS)
        if footer[10:] != FOOTER_MAGIC or _crc(footer[4:10]) != footer[:4]:
            raise ValueError("no xz stream ends here")
        length = (int.from_bytes(footer[4:8], "little") + 1) * 4
        at = end - ENDS - length
        file.seek(at)
        index = file.read(length)
        if index[0] or _crc(index[:-4]) != index[-4:]:
            raise ValueError("the index of an xz stream is damaged")
        count, k = _read_number(index, 1)
        found, flags = [], int.from_bytes(footer[8:10], "big")
        for _ in range(count):
            unpadded, k = _read_number(index, k)
            plain, k = _read_number(index, k)
            found.append((unpadded, plain))
        start = at - sum(-(-u // 4) * 4 for u, _ in found)
        blocks, place = [], start
        for unpadded, plain in found:
            packed = -(-unpadded // 4) * 4
            blocks.append(Block(place, packed, packed - unpadded, plain, flags))
            place += packed
        out.append(blocks)
        end = start - ENDS
    if end:
        raise ValueError("an xz stream begins before the file")
    return [b for blocks in reversed(out) for b in blocks]


def unpack(file, block: Block) -> Iterator[bytes]:
    """What a block holds, some at a time; a caller may stop early."""
    flags = block.flags.to_bytes(2, "big")
    index = b"\0\1" + _number(block.packed - block.padding) + _number(block.size)
    index += b"\0" * (-len(index) % 4)
    index += _crc(index)
    behind = (len(index) // 4 - 1).to_bytes(4, "little") + flags
    unpacker = lzma.LZMADecompressor(lzma.FORMAT_XZ)
    todo = [HEADER_MAGIC + flags + _crc(flags)]
    at, end = block.offset, block.offset + block.packed
    while True:
        more = todo.pop() if todo else None
        if more is None:
            if at < end:
                file.seek(at)
                more = file.read(min(1 << 20, end - at))
                at += len(more)
            elif at == end:
                more, at = index + _crc(behind) + behind + FOOTER_MAGIC, at + 1
            else:
                return
        if plain := unpacker.decompress(more):
            yield plain
