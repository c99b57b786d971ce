"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

Where the vocabulary file states exactly the normaliser and split that ``KNOWN`` has, a pretoken never
spans white space, and the normaliser looks no further than the white space around a character. So the
ids of a text are those of its chunks between white space, one after another. Runs of chunks of plain
characters are split into pretokens at once; any other chunk goes to the library by itself. Each Python
worker keeps the pretokens and odd chunks it has met in two bounded generations; only new ones go to the
library. With any other vocabulary file every text goes to the library whole.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: What a vocabulary file must state for its texts to be encoded chunk by chunk.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "added_tokens": ["<|startoftext|>", "<|endoftext|>"],
}
#: Chunks of only these characters, and without "<|", are lower-cased and split here as the vocabulary file does; any other goes to the library whole.
_PLAIN = re.compile(r"[\s!-~À-įı-ž]*").fullmatch
#: Chunks that aren't plain are at the odd places of a text split by this. It starts at chunks only, so a long chunk takes time in proportion.
_OTHER = re.compile(r"((?<!\S)[!-~À-įı-ž]*(?:[^\s!-~À-įı-ž]|<\|)\S*)").split
#: The pretokens of plain text in lower case: the split of ``KNOWN`` with its classes written out, which takes half the time.
_PRETOKENS = re.compile(r"[a-zß-öø-įı-ž]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\[-`{-~×÷]+").findall
#: str.split() takes these as white space, the vocabulary file's pattern doesn't (or differs by version).
_ODD = re.compile("[\x1c-\x1f᠎]").search


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """Two generations of at most ``most`` entries; what is used lives on."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, as bytes."""

    def __init__(self, path: str, most: int = 160_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        parts = {"normalizer": self.whole.normalizer, "pre_tokenizer": self.whole.pre_tokenizer}
        stated = {k: x and json.loads(x.__getstate__()) for k, x in parts.items()}
        stated["added_tokens"] = [x.content for _, x in sorted(self.whole.get_added_tokens_decoder().items())]
        self.known = stated == KNOWN and self.whole.truncation is None and self.whole.padding is None
        self.model, self.letters = self.whole.model, _byte_letters()
        self.pretokens, self.chunks = _Cache(self._pretoken, most), _Cache(self._full, most // 10)

    def _pretoken(self, text: str) -> bytes:
        mapped = text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode()))
        return b"".join([x.id.to_bytes(4, "little") for x in self.model.tokenize(mapped)])

    def _full(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known or _ODD(text):
            return self._full(text)
        if _PLAIN(text) and "<|" not in text:
            return b"".join(map(self.pretokens.__getitem__, _PRETOKENS(text.lower())))
        out = []
        for i, part in enumerate(_OTHER(text)):
            if i % 2:
                out.append(self.chunks[part])
            else:
                out.extend(map(self.pretokens.__getitem__, _PRETOKENS(part.lower())))
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
