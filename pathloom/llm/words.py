"""Words of whole texts as 64-bit hashes, batch by batch, for Python stages."""

from __future__ import annotations

import re
from itertools import chain

import pyarrow as pa

_WORD = re.compile(r"[^\W_]+")
_CACHED, _LONG = 1 << 17, 48
#: Bytes of text whose words are held at once.
WORD_BATCH = 2 << 20


class Words:
    """Lower-cased runs of letters and digits; a bounded cache keeps the hashes of the tokens met before."""

    def __init__(self) -> None:
        self.cache: dict[str, tuple[int, ...]] = {}

    def _hashes(self, token: str) -> tuple[int, ...]:
        import xxhash

        low = token.lower()
        # most tokens are one word, or one word and a mark after it
        if low.isalnum():
            found = (xxhash.xxh3_64_intdigest(low),)
        elif low[:-1].isalnum():
            found = (xxhash.xxh3_64_intdigest(low[:-1]),)
        else:
            found = tuple(xxhash.xxh3_64_intdigest(w) for w in _WORD.findall(low))
        if len(token) <= _LONG:
            if len(self.cache) >= _CACHED:
                self.cache.clear()
            self.cache[token] = found
        return found

    def of(self, texts: pa.Array):
        """``hashes, offsets``: all words of all texts, and where each text's words begin (one more at the end)."""
        few, at, offsets = self.coded(texts)
        return few[at], offsets

    def coded(self, texts: pa.Array):
        """``few, at, offsets``: the hashes of all words are ``few[at]``, so what is looked up by hash needs to be looked up for the ``few`` only."""
        import numpy as np
        import pyarrow.compute as pc

        lists = pc.utf8_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        encoded = lists.flatten().dictionary_encode()
        index = encoded.indices.to_numpy()
        known, fresh = self.cache.get, self._hashes
        per = [known(t) or fresh(t) for t in encoded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        counts = np.fromiter(map(len, per), dtype=np.int64, count=len(per))
        flat = np.fromiter(chain.from_iterable(per), dtype=np.uint64, count=int(counts.sum()))
        first = np.concatenate(([0], np.cumsum(counts)))
        n = counts[index]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(first[index] - ends[:-1], n) + np.arange(ends[-1])
        return flat, at, ends[offsets - offsets[0]]
