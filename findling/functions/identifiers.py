"""Identifiers that a name determines: version 5 UUIDs by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace of web addresses (RFC 4122).
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The first 16 bytes of the SHA-1 of namespace and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda i, n: F.substring(h, i, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab" * 4)  # the two high bits become 10
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def program_id(product: str, name: Column, version: Column) -> Column:
    """The stable id of a matching program's version."""
    return uuid5(F.concat(F.lit(f"{product}:matching_program:"), name, F.lit(":"), version))
