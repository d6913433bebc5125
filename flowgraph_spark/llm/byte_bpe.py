"""Byte-level BPE ids of whole texts, with a memo of words.

The pre-tokenizer of the model cuts a text before each space that stands
between two other characters, whatever surrounds them; so the parts between
such spaces can be encoded apart, and each distinct part once per worker.
"""

import re
import struct

import numpy as np
from tokenizers import Tokenizer

#: Distinct parts a worker keeps, and distinct pre-tokens; later ones are encoded again each time.
MEMO_PARTS = 700_000
MEMO_TOKENS = 500_000

#: Letters and then marks: two pre-tokens, whose bytes need no pattern to be told apart.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?%$&*#]*)")
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")

_ENCODERS = {}


class WordEncoder:
    def __init__(self, model):
        self.tokenizer = Tokenizer.from_str(model)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.pre_tokenize = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.merge = self.tokenizer.model.tokenize
        self.memo, self.tokens = {}, {}
        # The character that stands for each byte in pre-tokens.
        self.shown = {}
        for char in [" ", *(chr(code) for code in range(0xC0, 0x250))]:
            for code, shown in zip(char.encode("utf-8"), self.pre_tokenize(char)[0][0]):
                self.shown[code] = shown

    def _token(self, token):
        """Ids of a pre-token."""
        ids = self.tokens.get(token)
        if ids is None:
            numbers = [one.id for one in self.merge(token)]
            ids = struct.pack(f"<{len(numbers)}I", *numbers)
            if len(self.tokens) < MEMO_TOKENS:
                self.tokens[token] = ids
        return ids

    def _part(self, part):
        """Ids of a part as little-endian unsigned 32-bit integers."""
        return b"".join([self._token(token) for token, _ in self.pre_tokenize(part)])

    def _spaced(self, part):
        """Ids of a part with the space before it."""
        plain = _PLAIN.fullmatch(part)
        if plain is None:
            return self._part(f" {part}")
        letters, marks = plain.groups()
        if not letters.isascii():
            letters = letters.encode("utf-8").decode("latin-1").translate(self.shown)
        ids = self._token(self.shown[32] + letters)
        return ids + self._token(marks) if marks else ids

    def encode(self, text):
        """All ids of a text as bytes, as the tokenizer gives them without special tokens."""
        if any(token in text for token in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        parts = text.split(" ")
        # A part that is empty or has white space at an end stands beside a longer run of it.
        if "" in parts or list(map(str.strip, parts)) != parts:
            parts = _INNER_SPACE.split(text)
        # The first part has no space before it, so it is not shared with the others.
        parts[0], first = None, parts[0]
        found = list(map(self.memo.get, parts))
        found[0] = self._part(first)
        if None in found:
            for place in [k for k, ids in enumerate(found) if ids is None]:
                part = parts[place]
                found[place] = ids = self._spaced(part)
                if len(self.memo) < MEMO_PARTS:
                    self.memo[part] = ids
        return b"".join(found)


def encoder(model):
    """The worker's encoder for a model given as JSON text."""
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(model)
    return _ENCODERS[key]
