"""Token ids of texts, by a tokenizer file of the tokenizers library.

A chunk between blanks is encoded once per worker and remembered. This is exact for tokenizers
that cut at white space, drop it and normalise without looking over a blank; the file is checked
for that, and any other file gets whole texts. Chunks of common letters are cut into pieces here and
go straight to the tokenizer's model.
"""

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np

#: Chunks and their pieces that a worker remembers, and as many from before that; bytes of text handled at a time.
CHUNKS, STEP_BYTES = 250_000, 1 << 20

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANKS = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
#: The same rule for lower-case chunks of the characters in _PLAIN.
_PLAIN_SPLIT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte, where it isn't the byte's own."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


class _Memo(dict):
    """What make gives for the keys met last: at most most of them, and those met before these."""

    def __init__(self, make, most: int):
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Texts to ids as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        cuts = form.get("pre_tokenizer") or {}
        cuts = cuts.get("pretokenizers", [cuts])
        by_words = cuts[0].get("pattern", {}).get("Regex") == _SPLIT and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert")
        byte_level = len(cuts) == 2 and cuts[1].get("type") == "ByteLevel" and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex")
        normal = (form.get("normalizer") or {}).get("normalizers", []) == [{"type": "NFC"}, _BLANKS, {"type": "Lowercase"}]
        added = form.get("added_tokens", [])
        apart = all(not x["content"].split()[1:] and not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in added)
        self.by_chunk = bool(sys.byteorder == "little" and by_words and byte_level and normal and apart and not form.get("post_processor"))
        self.specials = re.compile("|".join(re.escape(x["content"]) for x in added) or r"(?!)")
        self.letters = _byte_letters()
        self.letters_only = not any(x["content"].isalpha() for x in added)
        self.tokenize = self.tokenizer.model.tokenize
        self.chunks = _Memo(self._chunk, CHUNKS)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [x.id for x in self.tokenize(spelt)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        letters = chunk.isascii() and chunk.isalpha() and self.letters_only
        if not letters and (not _PLAIN.fullmatch(chunk) or self.specials.search(chunk)):
            return self._whole(chunk)
        low = chunk.lower()
        if low != chunk and not self.specials.search(low):
            return self.chunks[low]
        pieces = [low] if letters else _PLAIN_SPLIT.findall(low)  # each is a chunk as well
        return self._piece(low) if len(pieces) == 1 else b"".join(map(self.chunks.__getitem__, pieces))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return list(map(self._whole, texts))
        get = self.chunks.__getitem__
        return [b"".join(map(get, x.replace("\n", " ").split(" "))) for x in texts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def stream(self, texts: list[str]) -> Iterator[bytes]:
        """The texts' ids in order, some at a time."""
        first = size = 0
        for k, x in enumerate(texts):
            size += len(x)
            if size >= STEP_BYTES or k + 1 == len(texts):
                yield from self.encode_all(texts[first : k + 1])
                first, size = k + 1, 0


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, kept for the tasks that follow."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
