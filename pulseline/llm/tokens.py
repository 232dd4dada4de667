"""Whole-text encoding with a public tokenizer, word by word.

No pre-token of ``word_bpe_49k.json`` spans an ASCII blank, so a text's ids are those of its
blank-separated chunks in order. Each worker keeps the ids of the parts it has met, up to a
fixed number, and has the library encode the new ones of a batch together.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np

#: Chunks whose ids a worker keeps; beyond it the memory is emptied and filled anew.
MEMO_CHUNKS = 600_000
#: Parts that the library encodes in one call.
CALL_PARTS = 500

# ASCII and Latin-1 letters, digits and ASCII signs: lower case and NFC are character by
# character there, so such a text can be split here and its parts go straight to the model.
_PLAIN = re.compile(r"[\x20-\x7e\x09-\x0dÀ-ÖØ-öø-ÿ]*")
_PARTS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ\x20\x09-\x0d]+"
)


#: Digest of the tokenizer file whose texts are encoded chunk by chunk (word_bpe_49k.json).
CHUNKED = "53fa9d558ea625daafcd57cd61e7be7b3c7043ea584b22d09575cf5ea9131b0a"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def file_digest(path: str) -> str:
    """sha256 of a tokenizer file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def chunks(text: str) -> list[str]:
    """The text between ASCII blanks; blanks in a row leave empty chunks."""
    for blank in "\t\n\x0b\x0c\r":
        text = text.replace(blank, " ")
    return text.split(" ")


class ChunkEncoder:
    """Ids of texts as little-endian 32-bit bytes, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        # The short cut repeats what the normaliser and splitter of one file do; any other
        # tokenizer file takes the whole way for every text.
        self._by_chunk = file_digest(path) == CHUNKED
        self._letters = _byte_letters()
        self._memo: dict[str, bytes] = {}
        if self._by_chunk:
            self._bare = Tokenizer.from_file(path)
            self._bare.normalizer = None
            self._bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocab = self._whole.get_vocab()
            self._ends = np.zeros(max(vocab.values()) + 1, bool)
            self._ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True

    def _library(self, text: str) -> bytes:
        ids = self._whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _split(self, text: str) -> list[str]:
        """Parts of a plain text, or the chunks of any other; an upper-case start tells them
        apart from parts and is of no account otherwise."""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return _PARTS.findall(text.lower())
        return ["A" + c for c in chunks(text)]

    def _learn(self, new: set[str]) -> None:
        """Put the ids of new parts and chunks into the memory."""
        memo = self._memo
        parts = []
        for key in new:
            if key[0] == "A":
                memo[key] = self._library(key[1:])
            else:
                parts.append(key)
        for i in range(0, len(parts), CALL_PARTS):
            call = parts[i : i + CALL_PARTS]
            line = " ".join(call)
            if not line.isascii():
                line = " ".join(
                    p if p.isascii() else "".join(map(self._letters.__getitem__, p.encode()))
                    for p in call
                )
            ids = np.array(self._bare.encode(line, add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(call):
                raise ValueError("the tokenizer does not mark word ends")
            data, ends = ids.tobytes(), [0, *(4 * ends).tolist()]
            memo.update(zip(call, map(data.__getitem__, map(slice, ends, ends[1:]))))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """All ids of each text, four bytes each."""
        if not self._by_chunk:
            return [self._library(t) for t in texts]
        memo = self._memo
        if len(memo) > MEMO_CHUNKS:
            memo.clear()
        lists = [self._split(t) for t in texts]
        self._learn(set().union(*lists).difference(memo))
        return [b"".join(map(memo.__getitem__, x)) for x in lists]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
