"""Byte decoding: UTF-8 where valid, else a statistical guess."""

from __future__ import annotations

BOM = b"\xef\xbb\xbf"


def without_bom(content: bytes) -> bytes:
    return content[3:] if content.startswith(BOM) else content


def spread(content: bytes, most: int = 1 << 20, pieces: int = 64) -> bytes:
    """``content``, or pieces of it from end to end, so that the guess sees every part of a long file."""
    if len(content) <= most:
        return content
    size, step = most // pieces, len(content) // pieces
    return b"".join(content[i * step : i * step + size] for i in range(pieces))


def decode(content: bytes) -> tuple[str, str]:
    """(text, encoding label)."""
    content = without_bom(content)
    try:
        return content.decode("utf-8"), "UTF-8"
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(spread(content)).best() if len(content) >= 256 else None
    except ImportError:
        best = None
    name = best.encoding if best is not None and not best.encoding.startswith("utf_7") else "cp1252"
    try:
        return content.decode(name), name.replace("cp125", "windows-125")
    except (UnicodeDecodeError, LookupError):
        return content.decode("cp1252", "replace"), "windows-1252"


def lossy(content: bytes) -> str:
    return without_bom(content).decode("utf-8", "replace")
