"""Whole-text token ids, fast.

Files of the tokenizers library are read once per worker. Where a file's
splitting rule is one of the two known below, its merges run in tiktoken on
the same vocabulary, several times as fast and with equal ids; every other
file, every text that may hold a special token, and every text outside the plain
alphabet where that matters, is encoded by the tokenizers library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: The two splitting rules of the public vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_ENDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_END = "\x00"
#: Printable ASCII, new lines and precomposed Latin letters: nothing here is changed by NFC, and white space is only " " and "\n".
_ODD = re.compile("[^ -~\n¡-¬®-ɏ]")
#: What is not letters, cut as WORD_ENDS cuts it within that alphabet.
_CUT = re.compile("('(?:s|t|re|ve|m|ll|d)|[!-/:-@\\[-`{-~¡-©«¬®-±´¶-¸»¿×÷]+|[0-9²³¹¼-¾])")


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """``ids(text)`` gives a text's ids as an array of unsigned 32-bit integers; null is empty."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        text = json.dumps(spec["pre_tokenizer"])
        self.fast, self.mode = None, "library"
        if spec["model"].get("type") != "BPE":
            return
        suffix = spec["model"].get("end_of_word_suffix") or ""
        special = {x["content"] for x in spec["added_tokens"]}
        # A text that may hold one of them is left to the library, whatever the letters' case.
        self.added = re.compile("|".join(map(re.escape, sorted(special))), re.IGNORECASE) if special else None
        chars, n = _byte_chars(), len(suffix)
        if spec["normalizer"] is None and not suffix and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            self.mode, pattern = "byte", BYTE_LEVEL
        elif suffix and json.dumps(WORD_ENDS) in text:
            self.mode, pattern = "word", f"[^{_END}]+{_END}"
        else:
            return
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                word = bool(n) and token.endswith(suffix)
                ranks[bytes(chars[c] for c in (token[:-n] if word else token)) + (_END.encode() if word else b"")] = i
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        if self.mode != "library" and self.added and self.added.search(text):
            return self._slow(text)
        if self.mode == "byte":
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        if self.mode == "word" and not _ODD.search(text):
            plain = _END.join(_CUT.split(text.lower().replace("\n", " "))).replace(" ", _END)
            return np.array(self.fast.encode_ordinary(plain + _END), dtype="<u4")
        return self._slow(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of the file at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
