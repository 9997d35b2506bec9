"""Words of texts as bytes, for the operators that read texts in Python."""

from __future__ import annotations

#: Lower-cases A-Z; whatever parts words becomes a space.  Bytes of non-ASCII characters are word bytes.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def folded_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return text.translate(_FOLD).split()


def folded_starts(text: bytes) -> list[tuple[int, int]]:
    """Start and end, in bytes of the text, of each of its folded words."""
    folded, out, at = text.translate(_FOLD), [], 0
    for w in folded.split():
        at = folded.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def spaced(words: list[bytes]) -> bytes:
    """The words with a space before, between and after them: a phrase then is found as a substring."""
    return b" " + b" ".join(words) + b" " if words else b" "


def chars_at(text: bytes, places: list[int]) -> list[int]:
    """Ascending byte offsets as offsets in code points."""
    out, chars, done = [], 0, 0
    for p in places:
        chars += len(text[done:p].decode("utf-8", "replace"))
        done = p
        out.append(chars)
    return out
