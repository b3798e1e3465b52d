"""Exact encoding by pieces: what a tokenizer's own rules never join is encoded once per distinct piece.

Texts are cut at white space into words, the words' ids are looked up, and a word not met before is given to the
`tokenizers` library: to its BPE model where the word has only common Latin characters, so that lower case and the
tokenizer's pattern are all that goes before the model, and else to the whole tokenizer.  Tokenizers of another
make, and texts with special strings or odd separators, are encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

#: A space in front of a word belongs to it; other white space stands alone (the boundaries of byte-level BPE).
_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python takes these for white space, the tokenizers don't.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Words of these characters are the same after normalisation to NFC, and in lower case in all libraries.
_LATIN = re.compile("[ !-~\xa1-į]+")
#: A task forgets its words beyond this many (memory, not results).
MOST_WORDS = 1_000_000
#: Words are looked up for about so many characters of text at once.
_TOGETHER = 1 << 20


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return {b: chr(b if b in printable else next(other)) for b in range(256)}


class PieceEncoder:
    """The ids of each distinct word, as little-endian unsigned 32-bit numbers, or their number; remembered by this task."""

    def __init__(self, path: str, count: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = spec["added_tokens"]
        self.count, self.letters, self.special = count, byte_letters(), [t["content"] for t in added]
        self.known: dict = {}
        self.parts: dict = {}
        self.pattern, self.lower, self.cut = None, False, None
        model = spec["model"]
        plain = model["type"] == "BPE" and not model["dropout"] and not model["ignore_merges"] and not spec["post_processor"]
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            return
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]:
            self.pattern, self.cut = regex.compile(public_tokenizers.PATTERN), _SPACED.findall
        elif pre.get("type") == "Sequence" and _drops_spaces(spec):
            pattern = pre["pretokenizers"][0]["pattern"]["Regex"]
            self.pattern, self.lower, self.cut = regex.compile(pattern), True, lambda text: text.encode().split()

    def pieces(self, texts: Iterable[str]) -> Iterator[list]:
        """For each text the values of its words, in order."""
        waiting: list[list] = []
        size = 0
        for text in texts:
            waiting.append(self._cut(text))
            size += len(text)
            if size >= _TOGETHER:
                yield from self._values(waiting)
                waiting, size = [], 0
        yield from self._values(waiting)

    def _cut(self, text: str) -> list:
        if self.cut is None or any(s in text for s in self.special) or any(s in text for s in _SEPARATORS):
            return [text]
        return self.cut(text)

    def _values(self, cut: list[list]) -> Iterator[list]:
        known = self.known
        if len(known) > MOST_WORDS:
            known.clear()
            self.parts.clear()
        joined = sum if self.count else b"".join
        parts, findall, latin = self.parts, self.pattern and self.pattern.findall, _LATIN.fullmatch
        for word in set().union(*cut).difference(known):
            text = word.decode() if isinstance(word, bytes) else word
            if findall is None or not latin(text) or any(s in text for s in self.special):
                known[word] = self._value(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
                continue
            found = findall(text.lower() if self.lower else text)
            try:
                known[word] = joined([parts[part] for part in found])
            except KeyError:
                for part in found:
                    if part not in parts:
                        mapped = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(self.letters)
                        parts[part] = self._value([token.id for token in self.tokenizer.model.tokenize(mapped)])
                known[word] = joined([parts[part] for part in found])
        for words in cut:
            yield list(map(known.__getitem__, words))

    def _value(self, ids: list[int]):
        return len(ids) if self.count else np.array(ids, dtype="<u4").tobytes()


def _drops_spaces(spec: dict) -> bool:
    """Whether white space is only what separates words, and lower case and NFC are all else that is normalised."""
    steps = (spec["normalizer"] or {}).get("normalizers", [])
    pre = spec["pre_tokenizer"]["pretokenizers"]
    first = pre[0]
    return (
        {s["type"] for s in steps} == {"NFC", "Replace", "Lowercase"}
        and all(s["pattern"] == {"Regex": r"\s+"} for s in steps if s["type"] == "Replace")
        and first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"]
        and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "")
        and [(p["type"], p["use_regex"], p["add_prefix_space"]) for p in pre[1:]] == [("ByteLevel", False, False)]
    )


_here: dict[tuple, PieceEncoder] = {}


def encoder(path: str, kind: str) -> PieceEncoder:
    """This worker's encoder; kind: "count" for numbers of ids, "bytes" for the ids themselves."""
    if (path, kind) not in _here:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _here[path, kind] = PieceEncoder(path, kind == "count")
    return _here[path, kind]
