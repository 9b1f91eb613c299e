"""Token ids of whole texts with a tokenizer file that lower-cases and drops white space.

Such a tokenizer composes and lower-cases characters one by one and then takes words that never
hold white space, so the ids of the units between blanks can be kept and joined. Any other kind of
tokenizer file encodes whole texts. Ids are little-endian, two bytes wide where the vocabulary
allows.
"""

from __future__ import annotations

import json
import sys
from array import array

import numpy as np
from tokenizers import Tokenizer

from mercadia.llm.tokens import CLOSING, byte_letters

#: Entries kept per worker process; beyond them the store starts anew. Longer units are not kept.
KEPT, KEPT_LENGTH = 800_000, 64
#: Fixed value: the word pattern of this kind of tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: From here on characters go through the tokenizer's own tables.
BEYOND_LATIN = "ƀ"


class WordUnits(dict):
    """Ids of units without blanks, made when first asked for."""

    def __init__(self, tokenizer: Tokenizer, code: str):
        super().__init__()
        self.tokenizer, self.code = tokenizer, code
        self.tokenize = tokenizer.model.tokenize
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self[""] = b""

    def __missing__(self, unit: str) -> bytes:
        value = self.made(unit)
        if len(unit) <= KEPT_LENGTH:
            self[unit] = value
        return value

    def made(self, unit: str) -> bytes:
        if max(unit) < BEYOND_LATIN:
            if unit.isalpha():
                low = "".join(map(str.lower, unit))
                # A capital that becomes two characters, the second no letter, is cut by the pattern.
                if len(low) == len(unit):
                    shown = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
                    return array(self.code, [p.id for p in self.tokenize(shown)]).tobytes()
            else:
                core = unit.rstrip(CLOSING)
                if core != unit and core.isalpha() and core[-1].isascii():
                    return self[core] + self[unit[len(core) :]]
        return array(self.code, self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()


def cuts_at_blanks(made: dict) -> bool:
    """Whether a tokenizer's description is of the kind that the module is about."""
    normal = (made["normalizer"] or {}).get("normalizers", [])
    cut = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        [step["type"] for step in normal] == ["NFC", "Replace", "Lowercase"]
        and normal[1]["pattern"] == {"Regex": "\\s+"}
        and normal[1]["content"] == " "
        and [step["type"] for step in cut] == ["Split", "ByteLevel"]
        and cut[0]["pattern"] == {"Regex": PATTERN}
        and cut[0]["behavior"] == "Removed"
        and cut[0]["invert"]
        and not cut[1]["add_prefix_space"]
        and not cut[1]["use_regex"]
        and made["truncation"] is None
        and made["padding"] is None
        and made["model"]["type"] == "BPE"
        and not made["model"]["dropout"]
        and not any(" " in token["content"] or token["lstrip"] or token["rstrip"] or token["single_word"] for token in made["added_tokens"])
    )


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.by_unit = cuts_at_blanks(json.loads(self.tokenizer.to_str()))
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.units = WordUnits(self.tokenizer, "H" if self.width == "<u2" else "I")

    def encode(self, text: str) -> bytes:
        """Ids of a text, without special tokens around it, as bytes of the encoder's width."""
        if not self.by_unit:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes()
        if len(self.units) > KEPT:
            self.units.clear()
            self.units[""] = b""
        return b"".join(map(self.units.__getitem__, text.replace("\n", " ").split(" ")))


def word_encoder(path: str) -> WordEncoder:
    """The worker process's encoder for a file; later tasks in the process use it again."""
    kept = sys.__dict__.setdefault("_word_encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]
