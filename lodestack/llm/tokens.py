"""Token ids of whole texts with the tokenizers library, fast enough for a corpus.

The byte-level BPE works on pre-tokens, each on its own, so ids of a pre-token are looked up in
a bounded per-worker memory and the library's model is asked only for pre-tokens not met before.
Texts with characters beyond Latin-1, for which the fast splitting is not written, go to the
library whole, as do texts that hold the string of an added token (the library gives such a string
its own id) and all texts where the vocabulary file asks for anything but plain byte-level BPE.
Ids are 16-bit numbers, 32-bit ones where a vocabulary has more than 65,536.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np

from lodestack.llm.common import KEPT

VOCABULARY = "byte_bpe_50k.json"
END = 0
_MEMORY = 320_000  # pre-tokens remembered by a worker, some 50 MB, in two halves: the newer one, and the one before it


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> re.Pattern:
    """The pre-token pattern of byte-level BPE for Latin-1 text."""
    letters, numbers = ("".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
    space = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """encode() gives the ids of texts as bytes, little-endian numbers of type `kind`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        before, model = made["pre_tokenizer"] or {}, made["model"]
        plain_model = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        plain_split = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.fast = plain_model and plain_split and not made["normalizer"] and not made["truncation"] and not made["padding"]
        self.added = re.compile("|".join(re.escape(t["content"]) for t in made["added_tokens"]) or r"(?!)")
        self.find = _pattern().findall
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.memory = _MEMORY

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, tokens: set[str]) -> None:
        letter, tokenize = self.letters.__getitem__, self.model.tokenize
        for token in tokens:
            ids = [x.id for x in tokenize("".join(map(letter, token.encode())))]
            self.known[token] = np.asarray(ids, self.kind).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.fast or self.added.search(text):
            return self._whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._whole(text)
        tokens = self.find(text)
        if len(self.known) > self.memory // 2:
            self.before, self.known = self.known, {}
        try:
            return b"".join(map(self.known.__getitem__, tokens))
        except KeyError:
            missing = set(tokens).difference(self.known)
            again = {t: self.before[t] for t in missing if t in self.before}
            self.known |= again  # what is still in use moves to the newer half
            self._learn(missing.difference(again))
            return b"".join(map(self.known.__getitem__, tokens))


_encoders: dict[str, Encoder] = {}
KEPT["encoders"] = _encoders.clear


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ids_of(texts, path: str, memory: int = _MEMORY) -> Iterator[np.ndarray]:
    """For each text (null: empty) its ids and the end id. `memory` pre-tokens are remembered."""
    code = encoder(path)
    code.memory = memory
    end = np.array([END], code.kind).tobytes()
    for text in texts:
        yield np.frombuffer(code.encode(text.as_py() if hasattr(text, "as_py") else text) + end, code.kind)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _crc_shifts() -> np.ndarray:
    """shifts[k]: the 32 columns of the linear map that 2**k zero bytes apply to a CRC-32."""
    column = np.zeros(32, np.uint64)
    column[0] = 0xEDB88320  # one zero bit
    column[1:] = 1 << np.arange(31, dtype=np.uint64)

    def times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for b in range(32):
            out ^= np.where((v >> np.uint64(b)) & np.uint64(1), m[b], np.uint64(0))
        return out

    for _ in range(3):
        column = times(column, column)  # 2, 4, 8 zero bits
    shifts = [column]
    for _ in range(47):
        shifts.append(times(shifts[-1], shifts[-1]))
    return np.array(shifts)


def crc32_join(crcs: np.ndarray, bytes_after: np.ndarray) -> np.ndarray:
    """What each part's CRC adds (by xor) to the CRC of the whole, given the bytes after the part."""
    shifts, out, rest = _crc_shifts(), crcs.astype(np.uint64), bytes_after.astype(np.uint64)
    k = 0
    while rest.any():
        rows = np.flatnonzero(rest & np.uint64(1))
        v, moved = out[rows], np.zeros(len(rows), np.uint64)
        for b in range(32):
            moved ^= np.where((v >> np.uint64(b)) & np.uint64(1), shifts[k][b], np.uint64(0))
        out[rows] = moved
        rest >>= np.uint64(1)
        k += 1
    return out
