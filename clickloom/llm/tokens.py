"""Token ids of whole texts with the tokenizers library.

A text is cut at places where the tokenizer always cuts, the cut pieces are encoded and remembered, and the ids of a text
are put together from those of its pieces. The result equals one call on the whole text.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

# No token has white space after other characters, so a cut before a space that follows another kind of character is
# safe. Where no two white-space characters meet, so are cuts on both sides of a line break.
_TWO_SPACES = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?= )")
_BEYOND_LATIN = re.compile("[^\x00-\xff]")
# Byte-level models write a byte that prints as itself, and the others in order from U+0100.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_SIGNS = {b: chr(0x100 + k) for k, b in enumerate(sorted({*range(256)}.difference(_PRINTED)))}
# Pieces remembered per worker process; beyond it the memory starts anew.
MEMORY = 500_000


class Vocabulary(NamedTuple):
    """A tokenizer file and the id put after each document."""

    path: str
    end_id: int
    # Whether a leading space belongs to the following token (byte-level BPE) or means nothing.
    spaces_count: bool


def public_vocabulary(name: str, end_id: int, spaces_count: bool) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name), end_id, spaces_count)


def _worker_state(vocabulary: Vocabulary) -> dict:
    """The tokenizer and the piece memories of this worker process.

    Functions travel to the workers by value and lose their globals after each task, so what should last is kept in a
    module of its own.
    """
    store = sys.modules.setdefault("_clickloom_tokens", types.ModuleType("_clickloom_tokens")).__dict__
    if vocabulary not in store:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary.path)
        store[vocabulary] = {
            "tokenizer": tokenizer,
            "bare": PieceMemory(tokenizer, "", vocabulary.spaces_count),
            "spaced": PieceMemory(tokenizer, " ", vocabulary.spaces_count)}
    return store[vocabulary]


def id_bytes(vocabulary: Vocabulary) -> int:
    """Bytes that hold any id of the vocabulary: 2 or 4."""
    size = _worker_state(vocabulary)["tokenizer"].get_vocab_size(with_added_tokens=True)
    return 2 if max(size, vocabulary.end_id + 1) <= 1 << 16 else 4


class PieceMemory(dict):
    """Ids of pieces after a prefix, as bytes.

    A new piece gets an empty place, and ``fill`` completes all new ones at once.
    """

    def __init__(self, tokenizer, prefix: str, byte_level: bool):
        """Of a byte-level model, a piece of letters is one pre-token and goes straight to the model."""
        super().__init__()
        self.letters = _BYTE_SIGNS if byte_level else None
        self.sign, self.model = prefix.translate(_BYTE_SIGNS), tokenizer.model
        self.tokenizer, self.prefix, self.new = tokenizer, prefix, []
        added = [(t.content, n) for n, t in tokenizer.get_added_tokens_decoder().items()
                 if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark = max(added, default=None)

    def __missing__(self, piece: str) -> bytearray:
        self.new.append(piece)
        place = self[piece] = bytearray()
        return place

    def _encode(self, pieces: list[str], together: int) -> None:
        """Pieces are encoded some at a time with an added token between them, which takes texts apart as calls do."""
        groups = [pieces[k:k + together] for k in range(0, len(pieces), together)]
        between = self.mark[0] if self.mark else ""
        for start in range(0, len(groups), 64):
            some = groups[start:start + 64]
            texts = [between.join([self.prefix + piece for piece in group]) for group in some]
            for group, found in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(found.ids, dtype="<u4")
                cuts = np.flatnonzero(ids == self.mark[1]).tolist() if len(group) > 1 else []
                data, at = ids.tobytes(), 0
                for piece, end in zip(group, [*cuts, len(ids)], strict=True):
                    self[piece].extend(data[4 * at:4 * end])
                    at = end + 1

    def fill(self, signs: PieceMemory) -> None:
        """A sign after a letter is a token of its own: "word," needs "word" and, from ``signs``, the bare ","."""
        whole, ending = [], []
        for piece in self.new:
            if len(piece) > 2 and piece[-1] in ".," and piece[-2].isalpha() and piece[-2].isascii():
                ending.append(piece)
            else:
                whole.append(piece)
        self.new = whole
        for piece in ending:  # their parts may be new as well
            self[piece[:-1]], signs[piece[-1]]
        rest = whole
        if self.letters:
            rest = []
            for piece in whole:
                if piece.isalpha() and not _BEYOND_LATIN.search(piece):
                    text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                    self[piece].extend(array("I", [t.id for t in self.model.tokenize(self.sign + text)]).tobytes())
                else:
                    rest.append(piece)
        self._encode([piece for piece in rest if self.mark and self.mark[0] not in piece], 128)
        self._encode([piece for piece in rest if not self.mark or self.mark[0] in piece], 1)
        self.new = []
        if signs is not self:
            signs.fill(signs)
        for piece in ending:
            self[piece].extend(self[piece[:-1]] + signs[piece[-1]])


def encoder(vocabulary: Vocabulary) -> Callable[[list[str]], list[np.ndarray]]:
    """A function from texts to their ids (unsigned 32-bit), each with the end id."""
    state = _worker_state(vocabulary)
    bare, spaced = state["bare"], state["spaced"]
    after_space = spaced.__getitem__
    end = array("I", [vocabulary.end_id]).tobytes()

    def counting(text: str) -> list:
        """Ids of the pieces where spaces matter."""
        if _TWO_SPACES.search(text):
            first, *rest = _CUT.split(text)
            return [bare[first], *[spaced[piece[1:]] for piece in rest]]
        found = []
        for k, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            if k:
                found.append(bare["\n"])
            found.append(bare[first])
            found.extend(map(after_space, rest))
        return found

    def dropping(text: str) -> list:
        """Ids of the pieces where white space only separates and letters are lower-cased."""
        if not _BEYOND_LATIN.search(text):  # as the tokenizer would; here it makes more pieces equal
            text = text.lower()
        return list(map(bare.__getitem__, text.replace("\n", " ").split(" ")))

    pieces = counting if vocabulary.spaces_count else dropping

    def encode(texts: list[str]) -> list[np.ndarray]:
        for memory in (bare, spaced):
            if len(memory) > MEMORY:
                memory.clear()
        found = [pieces(text) for text in texts]
        spaced.fill(bare)
        bare.fill(bare)
        return [np.frombuffer(b"".join(ids) + end, dtype="<u4") for ids in found]

    return encode
