"""Encoding whole texts with a public tokenizer, one distinct word at a time.

``word_bpe_49k`` drops white space and neither its normaliser nor its pattern reaches
across ASCII white space, so a text's ids are the ids of its white-space separated words
in order.  Every distinct word of a slice of texts goes through the library once (frequent ones
are kept between slices); the texts' ids are then gathered as arrays.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from .common import BoundedCache, as_text, kept, word_slices

END_ID = 2
CACHE_WORDS = 250_000
TEXT_BYTES = 1 << 20  # text that is encoded together
LONG_WORD = 256  # bytes; longer words are encoded without being kept

_encoders: dict[str, "WordEncoder"] = kept.setdefault("tokens", {})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """bytes of a text -> bytes of its ids, little-endian unsigned 32-bit, end id last.

    A word of lower-case letters below U+0250, with or without closing points and commas, is
    one letter run and one mark run for the tokenizer's pattern, and its normaliser leaves
    it alone: such runs go straight to the model.  All other words take the whole tokenizer.
    """

    SIMPLE = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]*)([.,!?;:#$%&*|()]*)")

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end_id.to_bytes(4, "little")
        self.letters = _byte_letters()
        kinds = json.loads(self.tokenizer.to_str())
        # The short cut is for this file's normaliser and pattern only.
        self.direct = kinds.get("post_processor") is None and [n.get("type") for n in (kinds.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and kinds["model"].get("end_of_word_suffix") == "</w>"
        self.kept = BoundedCache(self.word, CACHE_WORDS)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def word(self, data: bytes) -> bytes:
        text = data.decode("utf-8", "replace")
        if self.direct and len(data) <= LONG_WORD and (m := self.SIMPLE.fullmatch(text)):
            run = self.tokenizer.model.tokenize
            ids = [t.id for part in m.groups() if part for t in run("".join(map(self.letters.__getitem__, part.encode())))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def slices(self, texts):
        """(rows, ids, offsets) for slices of an Arrow array of bytes: row k of the range ``rows`` has
        ``ids[offsets[k]:offsets[k + 1]]``, unsigned 32-bit, the end id last."""
        import numpy as np
        import pyarrow.compute as pc

        # Lower-casing ASCII first spares variants; a special token's string must stay as it is.
        spared = (lambda part: pc.if_else(pc.match_substring(part, "<|"), part, pc.ascii_lower(part))) if self.direct else None
        for rows, words, index, bounds in word_slices(as_text(texts), lower=False, most=TEXT_BYTES, prepare=spared):
            found = [self.kept[w] if len(w) <= LONG_WORD else self.word(w) for w in words] + [self.end]
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            start = np.cumsum(size) - size
            flat = np.frombuffer(b"".join(found), "<u4")
            # The end stands behind each text as a word of its own.
            index = np.insert(index, bounds[1:], len(words))
            count = size[index]
            ends = np.concatenate([[0], np.cumsum(count)])
            take = np.repeat(start[index] - ends[:-1], count)
            take += np.arange(len(take))
            yield rows, flat[take], ends[bounds + np.arange(len(bounds))]

    def encode(self, data: bytes) -> bytes:
        import pyarrow as pa

        return b"".join(ids.tobytes() for _, ids, _ in self.slices(pa.array([data], pa.binary())))


def encoder(path: str, end_id: int = END_ID) -> WordEncoder:
    """The worker process's encoder; kept between tasks."""
    if (key := f"{path}|{end_id}") not in _encoders:
        _encoders[key] = WordEncoder(path, end_id)
    return _encoders[key]


__all__ = ["BoundedCache", "END_ID", "WordEncoder", "default_path", "encoder"]
