"""Token ids of whole texts by a public tokenizer, at the cost of its new words.

``TokenEncoder.encode`` gives what the tokenizer gives for the whole text, as
little-endian 32-bit ids. The tokenizer drops white space and never joins over
it, so the pieces between white space are encoded once per worker and looked up
from then on. Three forms keep that exact:

- plain texts (no character above U+00FF, no special token) are lowered first
  and a full stop or comma after a word stands alone, which is what the
  tokenizer does with them anyway; this makes most pieces repeat;
- other texts are looked up as they are;
- texts with U+001C..U+001F, white space to Python but not to the tokenizer,
  are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections import deque

import numpy as np

from gleaner.llm.common import worker_cache

CACHED_WORDS = 400_000
WORDS_PER_CALL = 1_000
MARK = "\x01"
ODD_SPACES = "\x1c\x1d\x1e\x1f"

_RUN_BEFORE_STOP = re.compile(r"[.,](?<=(?:[^\w\s]|_)[.,])[ \n]")


def _latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Words(dict):
    """Ids by piece; a piece that isn't known yet is noted and has none."""

    def __init__(self):
        super().__init__()
        self.new: set[str] = set()

    def __missing__(self, word: str) -> bytes:
        self.new.add(word)
        return b""


class TokenEncoder:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        kept = worker_cache(f"tokens:{name}")
        if not kept:
            kept["tokenizer"] = Tokenizer.from_file(public_tokenizers.path(name))
            kept["words"] = _Words()
        self.tokenizer, self.words = kept["tokenizer"], kept["words"]
        self.mark = self._ids([MARK])[0]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in encoded]

    def _learn(self, new: list[str], split: list[list[str] | None]) -> None:
        """Encode new pieces, many in one call, kept apart by a mark."""
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
            new = list({w for words in split if words for w in words})
        self.words.new.clear()
        alone = [w for w in new if MARK in w]
        new = [w for w in new if MARK not in w]
        blocks = [new[i : i + WORDS_PER_CALL] for i in range(0, len(new), WORDS_PER_CALL)]
        for block, ids in zip(blocks, self._ids([f" {MARK} ".join(b) for b in blocks]), strict=True):
            at = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else np.empty(0, int)
            if len(at) != len(block) - 1:
                alone += block
                continue
            data, bounds = ids.tobytes(), [-1, *at.tolist(), len(ids)]
            for word, a, b in zip(block, bounds, bounds[1:], strict=False):
                self.words[word] = data[4 * a + 4 : 4 * b]
        for word, ids in zip(alone, self._ids(alone), strict=True):
            self.words[word] = ids.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        lookup = self.words.__getitem__
        for text in texts:
            if any(c in text for c in ODD_SPACES):
                split.append(None)
                continue
            if "<|" not in text and _latin1(text):
                text = text.lower()
                if not _RUN_BEFORE_STOP.search(text):
                    for stop in (". ", ", ", ".\n", ",\n"):
                        text = text.replace(stop, " " + stop)
            split.append(text.split())
            deque(map(lookup, split[-1]), maxlen=0)
        if self.words.new:
            self._learn(list(self.words.new), split)
        return [
            self._ids([text])[0].tobytes() if words is None else b"".join(map(lookup, words))
            for text, words in zip(texts, split, strict=True)
        ]
