"""Text folding shared by the operators."""

from __future__ import annotations

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def folded(text: str | None) -> bytes:
    """Letters and digits in lower case (A-Z), words parted by one space; null gives nothing."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())


def words(text: str | None) -> list[bytes]:
    """Runs of bytes that are not ASCII white space, A-Z in lower case; null gives none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()
