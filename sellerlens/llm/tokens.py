"""Token ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import cache

import numpy as np

VOCABULARY = "word_bpe_49k.json"
END = 2            # id put behind each document
REMEMBERED = 1_000_000  # words whose ids a worker keeps


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Only letters below U+0180, digits and ASCII signs: lower case, composition and word borders are
# plain there, so that a text's words can be looked up one by one. "<|" may start a special token.
_ODD = re.compile(r"[^\x09-\x0d\x20-\x7f¡-įı-ž]")
_SPLIT = re.compile(r"([a-zß-öø-ž]+)([!-&(-/:-@\[-`{-~]+)\Z")  # letters, then signs but no apostrophe
_LETTERS = re.compile(r"[a-zß-öø-ž]+\Z")

# The word pattern of the vocabularies whose words can be looked up one by one.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _by_words(settings: dict) -> bool:
    """Whether a vocabulary's settings are those that ``WordEncoder`` follows: lower case, tokens that end with a word."""
    steps = lambda part, kind: [s for s in (settings[part] or {}).get(kind, [])]
    normal, cut = steps("normalizer", "normalizers"), steps("pre_tokenizer", "pretokenizers")
    if [s["type"] for s in normal] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in cut] != ["Split", "ByteLevel"]:
        return False
    return (
        normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
        and cut[0]["pattern"] == {"Regex": _WORDS} and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
        and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
        and settings["model"]["type"] == "BPE" and not settings["model"]["dropout"] and settings["truncation"] is None
        and all(t["content"].startswith("<|") for t in settings["added_tokens"])
    )


class WordEncoder:
    """Encodes texts as the library does, word by word with a memory of ``REMEMBERED`` words.

    White space ends a token in such a vocabulary, so that a text's ids are those of its words one after
    the other. Texts with characters outside the plain range are encoded in one piece, and so are all texts if the
    vocabulary's settings are others.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_words = _by_words(json.load(f))
        self.known: dict[str, bytes] = {}
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in kept)}
        self.shown = {b: chr(moved.get(b, b)) for b in range(256)}  # the byte-level alphabet

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            shown = word
        elif _LETTERS.match(word):
            shown = word.encode().decode("latin-1").translate(self.shown)
        else:
            parts = _SPLIT.match(word)
            return self._kept(parts[1]) + self._kept(parts[2]) if parts else self._whole(word)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _kept(self, part: str) -> bytes:
        if part not in self.known:
            self.known[part] = self._word(part)
        return self.known[part]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text as uint32, the end id last; null is taken as empty."""
        text = text or ""
        if not self.by_words or "<|" in text or _ODD.search(text):
            return np.append(np.frombuffer(self._whole(text), np.uint32), np.uint32(END))
        words = text.lower().split()
        known = self.known
        try:
            ids = b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
            ids = b"".join([known[w] for w in words])
        return np.append(np.frombuffer(ids, np.uint32), np.uint32(END))


@cache
def encoder(path: str) -> WordEncoder:
    """One per Python worker; its memory of words lasts as long as the worker."""
    return WordEncoder(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
