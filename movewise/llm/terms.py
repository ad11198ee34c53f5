"""Terms of a text: maximal runs of digits, ASCII letters (lower-cased) and characters beyond ASCII."""

from __future__ import annotations

#: Bytes of terms stay, A-Z lower-cased; all other ASCII separates. UTF-8 writes what lies beyond ASCII in bytes from 0x80 on.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()
