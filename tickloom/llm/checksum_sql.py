"""CRC-32 of a text's UTF-8 bytes in SQL, for the queries' checks."""

# One entry a byte: eight shifts, with the polynomial where a set bit leaves.
TABLE_SQL = (
    "SELECT list(list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]), "
    "lambda c, _: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY k) AS steps "
    "FROM (SELECT unnest(range(256)) AS k)"
)


def crc32_sql(text: str, table: str = "steps") -> str:
    """The unsigned checksum of an expression, beside a column of ``TABLE_SQL``."""
    digit = "(strpos('0123456789ABCDEF', substr(hex(encode({0})), i, 1)) - 1)"
    low = digit.replace(", i, 1", ", i + 1, 1")
    octets = f"list_transform(range(1, 2 * strlen({text}) + 1, 2), lambda i: {digit.format(text)} * 16 + {low.format(text)})"
    return (
        f"xor(list_reduce(list_prepend(4294967295, {octets}), "
        f"lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"
    )
