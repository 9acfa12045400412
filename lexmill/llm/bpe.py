"""Exact byte-pair encoding by cached pre-tokens.

A pre-token's ids depend on the pre-token alone, so each worker asks the tokenizers library once per distinct
pre-token and keeps the answer (the cache is emptied at ``CACHE_ITEMS``). Text made of Latin letters and common
punctuation is cut into pre-tokens by an equivalent compiled pattern; any other text is cut by the library itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

CACHE_ITEMS = 50_000

# The pre-token patterns of the two public tokenizer files, with their character classes written out
# for the code points below U+0250 and common punctuation.
_LETTER = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
_KNOWN = "\\x00-\\x1b -\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20ac\u2122"
_BYTE_LEVEL = f" ?[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_WORD_LEVEL = f"[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+"


class Bpe:
    """One vocabulary file; ``packed`` equals the library's encoding with add_special_tokens=False."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = spec["model"].get("end_of_word_suffix") == "</w>"
        added = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")")
        self.unknown = re.compile(f"[^{_KNOWN}]")
        self.double = re.compile(f"[{_SPACE}][{_SPACE}]")
        self.find = re.compile(_WORD_LEVEL if self.words else _BYTE_LEVEL).findall
        # the character of the byte-level alphabet that stands for each byte
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        merged, ids = _ranks(self.library, spec["model"], shown, self.words)
        bytewise = tiktoken.Encoding("pre-token", pat_str=".", mergeable_ranks=merged, special_tokens={})
        one, end = bytewise._encode_single_piece, b"\xff" if self.words else b""

        packed = [int(i).to_bytes(4, "little") for i in ids]

        def miss(pretoken: str) -> bytes:
            if pretoken[:2] == "<|" and self.special.fullmatch(pretoken):
                return np.array([self.library.token_to_id(pretoken)], "<u4").tobytes()
            return b"".join([packed[rank] for rank in one(pretoken.encode() + end)])

        self.bytes_ids = lambda raw: ids[one(raw)]  # of bytes inside one pre-token
        self.cache = _Cache(miss)
        lead = "" if self.words else " "
        # letters alone are one pre-token
        self.chunks = _Cache(lambda chunk: self.cache[lead + chunk] if chunk.isalpha() else b"".join(map(self.cache.__getitem__, self.find(lead + chunk))))
        byte = {c: b for b, c in shown.items()}
        self.pieces: list[bytes] = [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab().items():
            self.pieces[i] = token.encode() if token in added else bytes(byte.get(c, 63) for c in token)

    def pretokens(self, text: str) -> list[str]:
        """The text's pre-tokens in order; for the byte-level file they join to the text."""
        if "<|" not in text:
            return self._cut(text)
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if self.special.fullmatch(part) else self._cut(part)
        return out

    def _cut(self, text: str) -> list[str]:
        if not self.unknown.search(text):
            return self.find(text.lower() if self.words else text)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def join(self, pretokens: list[str]) -> bytes:
        """Their ids as little-endian unsigned 32-bit numbers."""
        self.cache.trim()
        return b"".join(map(self.cache.__getitem__, pretokens))

    def forget(self) -> None:
        """Empties the caches, so that an idle worker holds the vocabulary alone."""
        for cache in (self.cache, self.chunks):
            cache.clear()
            cache.old = {}

    def packed(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers.

        No pre-token of the word file spans white space, and none of the byte-level file does where single
        spaces part the text; such text is looked up by whole chunks between spaces.
        """
        if "<|" in text or self.unknown.search(text) or not self.words and (text[:1].isspace() or text[-1:].isspace() or self.double.search(text)):
            return self.join(self.pretokens(text))
        self.cache.trim()
        self.chunks.trim()
        if self.words:
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        first, *rest = text.split(" ")
        return b"".join([*map(self.cache.__getitem__, self.find(first)), *map(self.chunks.__getitem__, rest)])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

    def decode(self, ids: list[int]) -> str:
        """As the byte-level decoder: the pieces' bytes, ill-formed UTF-8 replaced."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def _ranks(library, model: dict, shown: dict[int, str], words: bool) -> tuple[dict[bytes, int], np.ndarray]:
    """The merges as ranks of byte strings, and the id of each rank.

    Merging the adjacent pair whose joined bytes rank lowest does what the list of pairs does if every ranked
    token encodes to itself alone: inside a token's span the same merges happen with or without its neighbours.
    So tokens that don't (none can ever come out) get no rank. The byte 0xFF, which UTF-8 never holds, stands
    for the end of a word; its merges come first.
    """
    byte = {c: b for b, c in shown.items()}
    end = "</w>" if words else ""
    vocab, merged, ids = model["vocab"], {}, []

    def rank(raw: bytes, token: str) -> None:
        if raw not in merged:
            merged[raw] = len(ids)
            ids.append(vocab.get(token, 0))

    for b, c in shown.items():
        rank(bytes([b]), c)
    if words:
        for b, c in shown.items():
            rank(bytes([b, 255]), c + end)
    for pair in model["merges"]:
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        token = left + right
        last = words and token.endswith(end)
        text = token.removesuffix(end) if last else token
        if words and not last:
            rank(bytes(byte[c] for c in token), token)  # only inside a word: it can't be asked for alone
        elif [t.id for t in library.model.tokenize(text)] == [vocab[token]]:
            rank(bytes(byte[c] for c in text) + (b"\xff" if last else b""), token)
    return merged, np.array(ids, "<u4")


class _Cache(dict):
    """Two generations: what was not asked for since the last turn is forgotten at the next."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 256:  # long ones are rare and would fill the memory
                return value
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > CACHE_ITEMS:
            self.old = dict(self)
            self.clear()


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One encoder per worker process and file."""
    return Bpe(path)


def public_path(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
