"""Deciding what bytes are."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import BINARY, ENCRYPTED, TOO_LARGE, UNDECODABLE, UNREADABLE

# The size above which nothing is opened, how much of the head
# is inspected, and the openings that declare encryption.
MAX_BYTES = 1 << 20
HEAD_BYTES = 8192
ENCRYPTED_PREFIXES = (
    b"-----BEGIN PGP MESSAGE-----",
    b"-----BEGIN PGP PRIVATE KEY BLOCK-----",
    b"age-encryption.org/v1",
    b"\x85",
)


def unread_reason(size: Column, raw: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Why the bytes give no text, or NULL when they do.  Order matters."""
    head = F.substring(raw, 1, HEAD_BYTES)
    encrypted = F.lit(False)
    for prefix in ENCRYPTED_PREFIXES:
        encrypted = encrypted | F.startswith(head, F.lit(prefix))
    return (F.when(size > max_bytes, TOO_LARGE)
            .when(raw.isNull(), UNREADABLE)
            .when(encrypted, ENCRYPTED)
            .when(F.contains(head, F.lit(b"\0")), BINARY)
            .when(~F.is_valid_utf8(raw), UNDECODABLE))


def sha256_hex(raw: Column) -> Column:
    return F.sha2(raw, 256)
