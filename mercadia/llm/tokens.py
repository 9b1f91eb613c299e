"""Token ids of whole texts with a public tokenizer file.

Byte-level pieces never cross the boundary between a visible character and a single blank that
another visible character follows, so the ids of such units can be kept and joined. Within a unit
the tokenizer's own model encodes each word of its pattern. Any other kind of tokenizer file
encodes whole texts. Ids are little-endian, two bytes wide where the vocabulary allows.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

#: Entries kept per worker process; beyond them the store starts anew.
KEPT = 800_000
#: Fixed value: the word pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ASCII marks that the pattern takes together when they close a unit.
CLOSING = ".,;:!?#$%&*|"
#: A blank next to other white space, where units can't be told apart by blanks alone.
ODD = re.compile(r" (?=\s|\Z)")
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[int, str]:
    """Fixed rule: printable bytes stand for themselves, the others for letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}


class Units(dict):
    """Ids of text units, made when first asked for."""

    def __init__(self, tokenizer: Tokenizer, code: str):
        super().__init__()
        self.tokenize, self.code = tokenizer.model.tokenize, code
        self.words = regex.compile(PATTERN).findall
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})

    def __missing__(self, unit: str) -> bytes:
        core = unit.rstrip(CLOSING)
        # A mark or digit before letters may be a word of its own, or open a contraction.
        if unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()):
            value = self.of_word(unit)
        elif core != unit and core[1:].isalpha():
            value = self[core] + self[unit[len(core) :]]
        else:
            words = self.words(unit)
            value = self.of_word(unit) if len(words) == 1 else b"".join([self[word] for word in words])
        self[unit] = value
        return value

    def of_word(self, word: str) -> bytes:
        """Ids of one match of the pattern."""
        shown = word if word.isascii() else word.encode().decode("latin-1")
        return array(self.code, [p.id for p in self.tokenize(shown.translate(self.letters))]).tobytes()


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        cut = made["pre_tokenizer"] or {}
        model = made["model"]
        self.by_unit = (
            cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space")
            and made["normalizer"] is None
            and made["truncation"] is None
            and made["padding"] is None
            and model.get("type") == "BPE"
            and not model.get("dropout")
        )
        self.marks = [token["content"] for token in made["added_tokens"]]
        self.units = Units(self.tokenizer, "H" if self.width == "<u2" else "I")

    def encode(self, text: str) -> bytes:
        """Ids of a text, without special tokens around it, as bytes of the encoder's width."""
        if not text:
            return b""
        if not self.by_unit or "\0" in text or any(mark in text for mark in self.marks):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, self.width).tobytes()
        if len(self.units) > KEPT:
            self.units.clear()
        split = CUT.sub("\0 ", text) if ODD.search(text) else text.replace(" ", "\0 ")
        return b"".join(map(self.units.__getitem__, split.split("\0")))


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a file; later tasks in the process use it again."""
    kept = sys.__dict__.setdefault("_token_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def crc_of_ids(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
