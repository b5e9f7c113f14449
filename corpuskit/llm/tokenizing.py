"""Exact whole-text encoding with a public ``tokenizers`` file, at word speed.

Both vocabularies used here cut a text into pre-tokens by a pattern before any
merge, so a text can be encoded piece by piece, with the same ids as in one
go, if every cut lies on a border that the pattern makes in any context.
Pieces repeat far more often than texts: each worker keeps the ids of the
first ``CACHE_PIECES`` distinct pieces that it meets, and the library encodes
the others once per block of texts.  A text that holds ``<|`` may contain a
special string, which the library takes out before the pattern, so it is
encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

#: Pieces whose ids a Python worker keeps (about 180 bytes each).
CACHE_PIECES = 700_000
#: Texts are encoded in blocks of about this many characters.
BLOCK_CHARS = 1 << 21

#: Pieces that start and end at certain pre-token borders: Latin words, digits
#: and runs of ASCII punctuation whose next character is surely of another
#: class, single line ends, and else everything up to the next such blank.
#: Apostrophes start contractions and are left to the last form.
_PIECES = re.compile(
    r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?![^\x00-\x7f]|[A-Za-z'])"
    r"| ?[!-&(-/:-@\[-`{-~]+(?=[ \nA-Za-z0-9]|\Z)"
    r"| ?[0-9]+(?=[ \nA-Za-z!-&(-/:-@\[-`{-~]|\Z)"
    r"|\n(?=\S)"
    r"|(?s:.)(?:(?! \S)(?s:.))*")
_BEYOND_LATIN1 = re.compile(r"[^\x00-\xff]")
_CODERS: dict = {}


class PieceCoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``spaced``: the vocabulary keeps a word's leading blank (byte-level BPE);
    otherwise blanks are dropped before the merges."""

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.spaced = spaced
        self.kept: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[str]:
        if not self.spaced and not _BEYOND_LATIN1.search(text):
            text = text.lower()  # as the vocabulary's normaliser does; one spelling to keep
        return _PIECES.findall(text)

    def block(self, texts: list[str]) -> list[bytes]:
        cut = [None if "<|" in t else self._pieces(t) for t in texts]
        kept = self.kept
        missing = list({k for keys in cut if keys for k in keys if k not in kept})
        ids = kept
        if missing:
            new = dict(zip(missing, self.whole(missing)))
            room = CACHE_PIECES - len(kept)
            if len(new) <= room:
                kept.update(new)
            else:
                for k in missing[:max(room, 0)]:
                    kept[k] = new[k]
                ids = _Both(kept, new)
        get = ids.__getitem__
        return [b"".join(map(get, keys)) if keys is not None else self.whole([t])[0]
                for t, keys in zip(texts, cut)]

    def encode(self, texts: list) -> Iterator[bytes]:
        """Ids of each text in order; null counts as empty."""
        block, size = [], 0
        for t in texts:
            t = t or ""
            block.append(t)
            size += len(t)
            if size >= BLOCK_CHARS:
                yield from self.block(block)
                block, size = [], 0
        if block:
            yield from self.block(block)


class _Both:
    """Looks a piece up among the kept ones, then among this block's."""

    def __init__(self, kept: dict, new: dict):
        self.kept, self.new = kept, new

    def __getitem__(self, key: str) -> bytes:
        got = self.kept.get(key)
        return self.new[key] if got is None else got


def coder(path: str) -> PieceCoder:
    """The worker's coder of a ``tokenizers`` file (one per Python process)."""
    if path not in _CODERS:
        import json
        with open(path, encoding="utf-8") as f:
            pre = json.load(f).get("pre_tokenizer") or {}
        spaced = pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space")
        parts = pre.get("pretokenizers") or []
        dropped = bool(parts) and parts[0].get("behavior") == "Removed" and bool(parts[0].get("invert"))
        if not (spaced or dropped):
            raise ValueError(f"{path}: piecewise encoding is not proved for this pre-tokenizer")
        _CODERS[path] = PieceCoder(path, spaced)
    return _CODERS[path]
