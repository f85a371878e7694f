"""Hash identities. All seeds are explicit, so a row's fate depends on its key alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def joined(*parts) -> Column:
    return F.concat_ws(":", *[_col(p) for p in parts])


def _head64(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 16), 16, 10)


def hash_unit(*parts) -> Column:
    """SPL1: first eight bytes of the SHA-256 of colon-joined parts, scaled to [0, 1)."""
    return _head64(F.sha2(joined(*parts), 256)).cast("double") / F.lit(2.0**64)


def hash_rank(*parts) -> Column:
    """Hex SHA-256 of colon-joined parts; a stable sort key for sampling."""
    return F.sha2(joined(*parts), 256)


def hash_mod(n: Column, *parts) -> Column:
    """Unsigned 64-bit hash modulo ``n``."""
    head = _head64(F.sha2(joined(*parts), 256)).cast("decimal(20,0)")
    return (head % n.cast("decimal(20,0)")).cast("int")


def hash_is_even(*parts) -> Column:
    """Whether the first hash byte is even."""
    return F.conv(F.substring(F.sha2(joined(*parts), 256), 1, 2), 16, 10).cast("int") % 2 == 0


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def case_key(text: Column) -> Column:
    """IDN2: identity of a text up to white space."""
    return F.substring(F.sha2(collapse_space(text), 256), 1, 16)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with alphabetical keys and explicit nulls."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def content_id(fields: dict[str, Column]) -> Column:
    """IDN1: SHA-256 of the canonical JSON of the identity fields."""
    return F.sha2(canonical_json(fields), 256)
