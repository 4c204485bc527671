"""Pieces of text that byte-level BPE merges never cross, and a per-worker cache of their ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The usual byte-level pre-token pattern; fixed values of that tokenizer family.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than space and newline, and runs of white space, take the slow way.
_ODD_SPACE = ["  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f"]
_WIDE_SPACE = ["\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　"]

_STATE: dict = {}


def tokenizer_at(path: str):
    """The tokenizer of a file, loaded once a worker."""
    if path not in _STATE:
        from tokenizers import Tokenizer

        _STATE[path] = Tokenizer.from_file(path)
    return _STATE[path]


def in_pieces(path: str) -> bool:
    """Whether the tokenizer parts texts by PRE_TOKEN and changes nothing before: byte-level, without a normalizer or a space put first."""
    import json

    spec = json.loads(tokenizer_at(path).to_str())
    before = spec["pre_tokenizer"] or {}
    return before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec["normalizer"]


def vocabulary_pieces(path: str) -> dict[str, int]:
    """Tier one: pre-tokens that are entries of the vocabulary, with their token counts; none of a tokenizer that has other pieces.

    Byte-pair vocabularies list the frequent pre-tokens of their training text;
    the table is no larger than the vocabulary, whatever the corpus.
    """
    import regex

    if not in_pieces(path):
        return {}
    tok, pattern = tokenizer_at(path), regex.compile(PRE_TOKEN)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    texts = tok.decode_batch([[i] for i in range(tok.get_vocab_size())], skip_special_tokens=False)
    texts = [t for t in dict.fromkeys(texts) if t and t not in special and "�" not in t and pattern.fullmatch(t)]
    return {t: len(e.ids) for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True)}


def plain(text: str) -> bool:
    """Whether words are parted by single spaces or newlines only, so that those two part pieces."""
    if any(s in text for s in _ODD_SPACE) or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"):
        return False
    return text.isascii() or not any(s in text for s in _WIDE_SPACE)


def _byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def fast_coder(path: str):
    """A function from text without special strings to ids that skips the tokenizer's bookkeeping.

    A byte-level BPE whose merges make entries of rising ids is given by these
    ids as ranks alone; any other tokenizer is called itself.
    """
    import json

    tok = tokenizer_at(path)
    plain_way = lambda piece: tok.encode(piece, add_special_tokens=False).ids
    spec = json.loads(tok.to_str())
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    flags = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec["normalizer"] or any(flags):
        return plain_way
    vocab, letters = model["vocab"], _byte_letters()
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if made != sorted(set(made)) or not all(c in vocab for c in letters):
        return plain_way
    import tiktoken

    ranks = {bytes(letters[c] for c in entry): i for entry, i in vocab.items()}
    return tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Pieces(dict):
    """Values of pieces, with `before` put before each: misses are encoded; holds at most `limit` of them."""

    def __init__(self, coder, value, first: dict | None = None, before: str = "", limit: int = 700_000):
        super().__init__()
        self.coder, self.value, self.first, self.before, self.limit = coder, value, first or {}, before, limit

    def __missing__(self, piece: str):
        whole = self.before + piece
        got = self.first.get(whole)
        if got is None:
            got = self.value(self.coder(whole))
        if len(self) >= self.limit:
            self.clear()
        self[piece] = got
        return got


class Encoder:
    """Applies one value per piece to whole texts; as the tokenizer's own encode() does. A tokenizer with other pieces gets texts whole."""

    def __init__(self, path: str, value, first: dict | None = None):
        import regex

        self.value, self.whole = value, None if in_pieces(path) else tokenizer_at(path)
        coder = fast_coder(path)
        self.pieces, self.spaced = Pieces(coder, value, first), Pieces(coder, value, first, " ")
        self.pattern = regex.compile(PRE_TOKEN)
        added = tokenizer_at(path).get_added_tokens_decoder()
        self.marks = {t.content: value([i]) for i, t in added.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.marks)) + ")")

    def parts(self, text: str) -> Iterator:
        """The values of a text's pieces, in order."""
        if self.whole:
            yield self.value(self.whole.encode(text, add_special_tokens=False).ids)
        elif any(m in text for m in self.marks):
            for k, part in enumerate(self.special.split(text)):
                if k % 2:
                    yield self.marks[part]
                elif part:
                    yield from map(self.pieces.__getitem__, self.pattern.findall(part))
        elif plain(text):
            for k, line in enumerate(text.split("\n")):
                if k:
                    yield self.pieces["\n"]
                first, *rest = line.split(" ")
                yield self.pieces[first]
                yield from map(self.spaced.__getitem__, rest)
        else:
            yield from map(self.pieces.__getitem__, self.pattern.findall(text))


def encoder(path: str, kind: str, first: dict | None = None) -> Encoder:
    """The worker's encoder: kind "count" gives numbers of tokens, "ids" little-endian 32-bit ids."""
    if (path, kind) not in _STATE:
        value = len if kind == "count" else (lambda ids: np.asarray(ids, "<u4").tobytes())
        _STATE[path, kind] = Encoder(path, value, first)
    return _STATE[path, kind]
