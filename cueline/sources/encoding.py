"""Text encodings of small files."""

from __future__ import annotations

#: Byte order marks.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def detect(content: bytes, fallback: str = "cp1252") -> tuple[str, int]:
    """(encoding, length of the mark): by byte order mark, else UTF-8 where it is valid, else ``fallback``."""
    for mark, name in MARKS:
        if content.startswith(mark):
            return name, len(mark)
    try:
        content.decode("utf-8")
        return "utf-8", 0
    except UnicodeDecodeError:
        return fallback, 0


def decode(content: bytes | str, fallback: str = "cp1252") -> str:
    if isinstance(content, str):
        return content
    name, skip = detect(bytes(content), fallback)
    return bytes(content)[skip:].decode(name, "replace")
