"""Token ids of whole texts by a public tokenizer file, with the ids of frequent words remembered.

Where the tokenizer drops white space, lower-cases and splits by a pattern before its byte-level merges (its
file says so), no merge crosses a piece between ASCII white space, nor a part of a piece that the pattern
finds. A text's ids are then those of its pieces one after another: the library's merge model runs once per
distinct part, and two bounded memories, of pieces and of parts, give the rest. Pieces with characters whose
case or composition could differ between the library and Python go through the library whole, and so do the
texts of any other kind of tokenizer.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from functools import lru_cache

import regex

UNSURE = re.compile("[\x1c-\x1f]")  # separators for one of str and the library only
PLAIN = re.compile("[\n\x21-ɏ]+")  # case and composition known to agree


class Memory(dict):
    """A bounded dictionary: once full it takes no more, until as many entries were refused; then it begins anew."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.refused = most, 0

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.refused += 1
            if self.refused <= self.most:
                return
            self.clear()
            self.refused = 0
        self[key] = value


def byte_letters() -> dict[int, str]:
    """The characters that byte-level tokenizers write bytes as: printable ones as they are, the rest in order
    from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) if b in keep else chr(256 + rest.index(b)) for b in range(256)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids (bytes), within a bounded memory: an entry of either
    dictionary takes some 250 bytes, as pieces and parts of more than ``LONG`` bytes are not remembered."""

    LONG = 64

    def __init__(self, path: str, pieces: int = 600_000, parts: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces, self.parts = Memory(pieces), Memory(parts)
        self.letters = "".join(byte_letters()[b] for b in range(256))
        self.pattern = self._pattern(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model

    def _pattern(self, said: dict):
        """The splitting pattern, if the tokenizer is of the kind whose pieces are independent."""
        normal = [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])]
        steps = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
        if normal != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            return None
        split, level = steps
        if not split["invert"] or split["behavior"] != "Removed" or level["use_regex"] or level["add_prefix_space"]:
            return None
        self.specials = [t["content"] for t in said["added_tokens"]]
        pattern = regex.compile(split["pattern"]["Regex"])
        # a run of letters is one part, and needs no search, if the pattern says so for letters of either kind
        self.letters_whole = all(pattern.findall(x) == [x] for x in ("s", "re", "abcdefghijklmnopqrstuvwxyz", "àéîõüßñçøæ"))
        return pattern

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            got = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(part) <= self.LONG:
                self.parts.put(part, got)
        return got

    def _new(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces that are not remembered."""
        joined = b"\n".join(pieces).decode("utf-8", "surrogatepass")
        low = joined.lower()
        if not PLAIN.fullmatch(joined) or not PLAIN.fullmatch(low) or any(s in joined for s in self.specials):
            return [self._new([p])[0] for p in pieces] if len(pieces) > 1 else [self._whole(joined)]
        # characters below U+0300 are composed already
        part, find = self._part, self.pattern.findall
        return [part(t) if self.letters_whole and t.isalpha() else b"".join(map(part, find(t))) for t in low.split("\n")]

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.pattern is None or UNSURE.search(text):
            return self._whole(text)
        pieces = text.encode().split()
        out = list(map(self.pieces.get, pieces))
        if None in out:
            missing = [i for i, x in enumerate(out) if x is None]
            new = dict.fromkeys(pieces[i] for i in missing)
            for p, ids in zip(new, self._new(list(new)), strict=True):
                new[p] = ids
                if len(p) <= self.LONG:
                    self.pieces.put(p, ids)
            for i in missing:
                out[i] = new[pieces[i]]
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str, pieces: int = 600_000, parts: int = 300_000) -> Encoder:
    """One encoder per Python worker and size of memory, whose memories outlive its tasks."""
    return Encoder(path, pieces, parts)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
