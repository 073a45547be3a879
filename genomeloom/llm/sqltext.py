"""Pieces of SQL that several oracles share."""

from __future__ import annotations


def _crc_table() -> list[int]:
    table = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    return table


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, for an engine without the function: a table look-up for each character."""
    table = f"[{', '.join(map(str, _crc_table()))}]"
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: xor(CAST({table}[(xor(a, b) & 255) + 1] AS BIGINT), a >> 8)), CAST(4294967295 AS BIGINT))"
