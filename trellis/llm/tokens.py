"""Counts and ids of public tokenizers, exact by construction and mostly without running the tokenizer.

For word counts, texts are cut into pre-tokens by Python's `re`, and each distinct one that is not proved whole is merged
once by the tokenizer and remembered, up to a fixed number of entries. Words with an unusual character, where libraries
may differ on Unicode, or with a special string go to the tokenizer as they are, from white space to white space. For ids,
texts without these are merged by rank, after a proof that this gives the tokenizer's ids; others go to it as a whole. The
tests hold both against it for all characters below U+0250, and counts for any text.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np

#: remembered pre-tokens in a worker; all are forgotten beyond
MEMO = 400_000
#: characters that are worked on at once
PART = 1 << 20


def _class(start: str) -> str:
    return "".join(f"\\u{c:04x}" if c > 127 else re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == start)


#: letters of Cyrillic, kana, Han and Hangul, and general punctuation: old, and the same in all normal forms that compose
FAR_LETTERS, MARKS = "\u0400-\u045f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3", "\u2010-\u2027\u2030-\u205e\u20ac"
L, N, S = _class("L") + FAR_LETTERS, _class("N"), r"\t\n\x0b\x0c\r \x85\xa0"
UNUSUAL = re.compile("[^\x00-ɏ]")
#: lower case leads out of the range from U+0180 on, and for U+0130
UNUSUAL_LOWER = re.compile(f"[^\x00-įı-ſ{FAR_LETTERS}{MARKS}]")
#: how byte-level vocabularies cut texts, for the library that merges by rank
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+")
_BLANKS = "\t\n\x0b\x0c\r"
_INNER_SPACE = re.compile(rf"(?<=[^{S}]) (?=[^{S}])")


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts that end before a single space between other characters, where both cuts begin a pre-token."""
    at = 0
    while len(text) - at > size:
        cut = _INNER_SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def read(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


def _tokenizer(spec: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def whole_words(spec: str) -> list[str]:
    """Pre-tokens that are proved to be one token: each vocabulary string that ends a word is encoded alone.

    A string qualifies if it is one pre-token as it stands, unchanged by normalisation, and the merges rebuild it.
    """
    from tokenizers.decoders import ByteLevel

    tok, bytes_of, out = _tokenizer(spec), ByteLevel(), []
    end = tok.model.end_of_word_suffix or ""
    candidates = [(s, bytes_of.decode([s.removesuffix(end)])) for s in tok.get_vocab(with_added_tokens=False) if s.endswith(end)]
    usual = [(s, w) for s, w in candidates if w and not UNUSUAL_LOWER.search(w) and _WORDS.fullmatch(w)]
    for (s, w), e in zip(usual, tok.encode_batch([w for _, w in usual], add_special_tokens=False), strict=True):
        if e.tokens == [s]:
            out.append(w)
    return sorted(out)


class WordCounter:
    """Token counts under a lower-casing BPE with word ends."""

    def __init__(self, spec: str, whole: list[str]) -> None:
        self.tok, self.whole = _tokenizer(spec), dict.fromkeys(map(sys.intern, whole), 1)
        #: tokens of pre-tokens: one for those proved whole, and what merging the others gave
        self.known, self.odd = dict(self.whole), {}
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added)) if added else None

    def _encoded(self, texts: list[str]) -> Iterator[tuple[str, int]]:
        for a in range(0, len(texts), 10_000):
            some = texts[a : a + 10_000]
            yield from zip(some, (len(e.ids) for e in self.tok.encode_batch(some, add_special_tokens=False)), strict=True)

    def _usual(self, text: str) -> int:
        n = 0
        for part in parts(text):
            found = _WORDS.findall(part.lower())
            fresh = {*found}.difference(self.known)
            if fresh:
                if len(self.known) + len(fresh) > MEMO:
                    self.known = dict(self.whole)
                    fresh = {*found}.difference(self.known)
                self.known.update(self._encoded([*fresh]))
            n += sum(map(self.known.__getitem__, found))
        return n

    def _odd(self, chunks: list[str]) -> int:
        n = 0
        for c in chunks:
            if len(c) > 64:
                n += len(self.tok.encode(c, add_special_tokens=False).ids)
        short = [c for c in chunks if len(c) <= 64]
        fresh = {*short}.difference(self.odd)
        if len(self.odd) + len(fresh) > MEMO:
            self.odd, fresh = {}, {*short}
        self.odd.update(self._encoded([*fresh]))
        return n + sum(map(self.odd.__getitem__, short))

    def count(self, text: str) -> int:
        """Runs of other characters than ASCII's white space, which the library drops, are apart from each other: those
        with anything unusual are counted by the library as they are, the rest together."""
        if UNUSUAL_LOWER.search(text) is None and not (self.special and self.special.search(text)):
            return self._usual(text)
        for c in _BLANKS:
            text = text.replace(c, " ")
        at, odd, usual = 0, [], []
        for mark in sorted(m.start() for by in (UNUSUAL_LOWER, self.special) if by for m in by.finditer(text)):
            if mark < at:
                continue
            begin, end = max(at, text.rfind(" ", at, mark) + 1), text.find(" ", mark)
            end = len(text) if end < 0 else end
            usual.append(text[at:begin])
            odd.append(text[begin:end])
            at = end
        usual.append(text[at:])
        return self._odd(odd) + self._usual(" ".join(usual))


def ranks(spec: str) -> dict[bytes, int] | None:
    """The vocabulary as bytes by id, if merging by rank is proved to give the library's ids; else None.

    Merging by rank joins the pair whose joint string has the least id, the library the pair of the first merge. Ids
    must follow merges, and every vocabulary string encoded alone must come out as itself. Then both agree: before
    either could join other halves of a string t than t's own, all joins of lesser rank inside t are done, as they are
    when t stands alone, and there t's own halves are what is left.
    """
    tok, model = _tokenizer(spec), json.loads(spec)["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    vocab = model["vocab"]
    of = {c: b for b, c in _byte_letters().items()}
    out = {bytes(of[c] for c in s): i for s, i in vocab.items() if all(c in of for c in s)}
    in_order = all(vocab.get(a + b) == i for i, (a, b) in enumerate(merges, len(vocab) - len(merges)))
    whole = len(out) == len(vocab) and all(len(found := tok.model.tokenize(s)) == 1 and found[0].id == i for s, i in vocab.items())
    return out if in_order and whole and all(bytes([b]) in out for b in range(256)) else None


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ByteIds:
    """Ids under a byte-level BPE without normalisation, as little-endian unsigned 32-bit numbers."""

    def __init__(self, spec: str, ranked: dict[bytes, int] | None) -> None:
        self.tok = _tokenizer(spec)
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added)) if added else None
        self.by_rank = None
        if ranked:
            import tiktoken

            self.by_rank = tiktoken.Encoding("ranks", pat_str=_PIECES, mergeable_ranks=ranked, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.by_rank is None or UNUSUAL.search(text) or self.special and self.special.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(np.array(self.by_rank.encode_ordinary(part), "<u4").tobytes() for part in parts(text))


_held: dict[tuple, object] = {}


def held(kind: type, *args) -> object:
    """One instance in each worker process for what a broadcast carries."""
    key = (kind.__name__, hash(args[0]), len(args[0]))
    if key not in _held:
        _held[key] = kind(*args)
    return _held[key]
