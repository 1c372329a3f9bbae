"""Ids of whole texts under a lower-case word vocabulary, equal to those of the tokenizers library.

The library spends most of its time on normalising and on objects for each word. Here plain texts
are lower-cased and cut into words by Arrow, over many texts at once, and merged by byte ranks. A
text is plain if all its characters are known to be normalised, to have the same class in all
versions of Unicode since 5, and to become one character in lower case; the library encodes the
others. An end byte, which no plain text holds, stands for the vocabulary's end-of-word suffix.

Ranks of bytes give the merges of the list: before the merge that makes a token, its bytes always
are the pair that the list names, as every token of the vocabulary is the encoding of its own bytes
(a test checks this for each)."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import byte_letters

END = b"\x00"
#: The published split rule of the vocabulary, as in its file and as RE2 spells it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x{85}\p{Z}\p{L}\p{N}]+"
#: Plain characters: white space and ASCII; Latin, Greek, Cyrillic, Hebrew, Arabic; marks; kana, ideographs, Hangul; wide forms.
PLAIN = (
    r"\t\n\r -~\x{a0}-\x{ac}\x{ae}-\x{12f}\x{131}-\x{148}\x{14a}-\x{24f}\x{386}\x{388}-\x{38a}\x{38c}\x{38e}-\x{3a1}\x{3a3}-\x{3ce}\x{400}-\x{481}\x{48a}-\x{513}"
    r"\x{5d0}-\x{5ea}\x{621}-\x{63a}\x{641}-\x{64a}\x{1e00}-\x{1e95}\x{1ea0}-\x{1ef9}\x{2010}-\x{2027}\x{2030}-\x{2053}\x{20a0}-\x{20b5}\x{2190}-\x{21ff}\x{2500}-\x{266f}"
    r"\x{3001}-\x{3020}\x{3041}-\x{3096}\x{30a1}-\x{30fe}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}\x{ff01}-\x{ff5e}"
)
ODD = rf"[^{PLAIN}]|<\|"
WORD = re.compile(r"[^ \t\n\r]+")


@lru_cache(2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class WordBpe:
    """Encoder of whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.library = library(path)
        self.plain = self._ranks(file) if self._known(file) else None

    @staticmethod
    def _known(file: dict) -> bool:
        """Whether the file is of the form that the plain way is made for; else the library does all."""
        steps = (file.get("normalizer") or {}).get("normalizers", [])
        first = ((file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        marks = all(t["content"].startswith("<|") for t in file["added_tokens"])
        return [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": SPLIT} and file["model"].get("end_of_word_suffix") == "</w>" and marks

    def _ranks(self, file: dict):
        import tiktoken

        vocab, letters = file["model"]["vocab"], byte_letters()
        byte = {x: b for b, x in enumerate(letters)}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in file["model"]["merges"]]
        tokens = [*letters, *(x + "</w>" for x in letters), *(a + b for a, b in pairs)]
        raw = lambda t: bytes(byte[c] for c in t.removesuffix("</w>")) + END * t.endswith("</w>")
        self.ids = np.array([vocab[t] for t in tokens], np.uint32)
        return tiktoken.Encoding("words", pat_str=r"[^\s\x00]+\x00", mergeable_ranks={raw(t): k for k, t in enumerate(tokens)}, special_tokens={})

    def encode(self, texts: pa.Array, odd=None) -> list[np.ndarray]:
        """The ids of each text (null: empty). ``odd`` encodes a text that isn't plain."""
        texts = pc.fill_null(texts, "")
        if self.plain is None:
            return [self._by_library(x) for x in texts.to_pylist()]
        is_odd = pc.match_substring_regex(texts, ODD).to_pylist()
        cut = pc.replace_substring_regex(pc.utf8_lower(texts), CUT, "\\0\x00").to_pylist()
        plain, odd = self.plain.encode_ordinary, odd or self._by_words
        return [odd(texts[k].as_py()) if o else self.ids[plain(x)] for k, (o, x) in enumerate(zip(is_odd, cut, strict=True))]

    def _by_words(self, text: str) -> np.ndarray:
        """An odd text: nothing reaches across a blank, so its plain words are encoded as such."""
        words = WORD.findall(text)
        return np.concatenate([np.zeros(0, np.uint32), *self.encode(pa.array(words, pa.string()), self._by_library)])

    def _by_library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)
