"""Token ids of texts by a tokenizers file in which white space parts words and no token crosses it."""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from array import array

import numpy as np

#: Entries of a worker's caches of words and of words' parts (about 200 bytes each); beyond this a cache starts anew.
CACHE_WORDS = 300_000
CACHE_PARTS = 60_000
#: Longer words aren't cached, bytes.
CACHE_BYTES = 64

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
#: Words whose parts and lower case are beyond doubt: printable characters below U+0250 without apostrophes (contractions),
#: < (special tokens), fractions and raised digits.  Unicode's normal form C leaves them as they are.
_PLAIN = re.compile(f"[{_LETTERS}!-&(-;=-~¡-¬®-±´-¸»¿×÷]+")
_PARTS = re.compile(f"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")

_STOPS = b".,;:!?"

#: The make of file that the quick way is for.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def _quick(path: str):
    """A function from bytes of one lower-cased part of a word to its ids, or None if the file is of another make.

    The merges of a byte-level vocabulary whose ids are in the order of merging can be run by tiktoken: the lowest
    mergeable id first is the first merge first.  The end of a word is a byte that UTF-8 doesn't have.
    """
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, norm, split = made["model"], made["normalizer"] or {}, (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    kinds = [n["type"] for n in norm.get("normalizers", [])]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or kinds != ["NFC", "Replace", "Lowercase"] or split[0].get("pattern") != {"Regex": _SPLIT}:
        return None
    import tiktoken

    # the byte-level alphabet: printable bytes stand for themselves, the others for what follows U+00FF
    alphabet = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    alphabet |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in alphabet.values())}
    special = {t["content"] for t in made["added_tokens"]}
    ranks = {}
    for token, id in model["vocab"].items():
        if token not in special:
            end = token.endswith("</w>") and len(token) > 4
            ranks[bytes(alphabet[c] for c in (token[:-4] if end else token)) + b"\xff" * end] = id
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in merges]
    last_letters = [ranks.get(bytes([b, 255]), 1 << 30) for b in range(128)]
    if order != sorted(order) or (order and max(last_letters) > order[0]) or b"\xff" not in ranks:
        return None
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


class _Words(dict):
    """Ids of words by word; a word that isn't there yet is encoded.  Full, it starts anew."""

    def __init__(self, encode):
        super().__init__({b"": b""})
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        ids = self.encode(word)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
                self[b""] = b""
            self[word] = ids
        return ids


class Encoder:
    """ids(texts): each text's ids as little-endian unsigned 32-bit bytes, as the tokenizers library gives them.

    A text is cut at its spaces and line feeds; words are encoded once and remembered.  Most words
    take the quick way, which gives the same ids (tests compare); the library encodes the rest.
    plain: strings of special tokens in a text are ordinary text, so that no text holds a special id.
    """

    def __init__(self, path: str, plain: bool = False, quick: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.quick = _quick(path) if quick else None
        self.known = _Words(self._word)
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        if (ids := self.parts.get(part)) is None:
            ids = _bytes(self.quick(part.encode() + b"\xff"))
            if len(part) <= CACHE_BYTES:
                if len(self.parts) >= CACHE_PARTS:
                    self.parts = {}
                self.parts[part] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        if self.quick and len(word) <= 1024:
            if word.isalpha():  # of bytes: ASCII letters alone
                return _bytes(self.quick(word.lower() + b"\xff"))
            if word[-1] in _STOPS and word[:-1].isalpha():
                return _bytes(self.quick(word[:-1].lower() + b"\xff")) + self._part(chr(word[-1]))
        t = word.decode("utf-8", "replace")
        if self.quick and len(t) <= 1024 and _PLAIN.fullmatch(t):
            t = t.lower()
            return self._part(t) if t.isalpha() else b"".join(map(self._part, _PARTS.findall(t)))
        return _bytes(self.tokenizer.encode(t, add_special_tokens=False).ids)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        known = self.known.__getitem__
        return [b"".join(map(known, t.replace(b"\n", b" ").split(b" "))) for t in texts]


@functools.cache
def encoder(path: str, plain: bool = False) -> Encoder:
    """One for each worker and file, kept from task to task."""
    return Encoder(path, plain)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
