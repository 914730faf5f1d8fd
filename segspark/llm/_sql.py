"""Pieces of DuckDB SQL that several oracles share."""

#: One row, ``t``: the table of the reflected CRC-32, from its polynomial.
CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def crc32(octets: str) -> str:
    """SQL of the unsigned CRC-32 of a list of bytes (BIGINT), beside a table ``crc`` of :data:`CRC_TABLE`."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])))"


def ascii_bytes(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"


def utf8_bytes(text: str) -> str:
    return f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT))"
