"""Pieces of check SQL that several operators share, for an engine without crc32."""


def _bits(x: str) -> str:
    """Eight steps of the reflected CRC polynomial."""
    return f"list_reduce([{x}, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"


def crc32(text: str) -> str:
    """crc32 of the UTF-8 bytes of a text whose characters are all below U+0800."""
    codes = f"list_transform(string_split({text}, ''), lambda x: cast(unicode(x) as bigint))"
    data = f"flatten(list_transform({codes}, lambda x: case when x < 128 then [x] else [192 + (x >> 6), 128 + (x % 64)] end))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {data}), lambda a, b: {_bits('xor(a, b)')}), 4294967295)"
