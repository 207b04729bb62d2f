"""Parts of SQL that several operators' comparison queries use."""

from __future__ import annotations


def crc_table() -> str:
    """One row, crc_of: the 256 steps of CRC-32, by its polynomial."""
    return "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_of"


def crc32_of(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, in a query that crosses with crc_table()."""
    digit = lambda k: f"instr('123456789ABCDEF', hex(encode({text}))[2 * i + {k}])"
    octets = f"list_transform(range(strlen({text})), lambda i: ({digit(1)} * 16 + {digit(2)})::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, x: xor(c >> 8, crc_of[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295)"
