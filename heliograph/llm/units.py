"""Encoding with a cache of short text units.

Byte-level BPE splits text into pre-tokens and encodes each alone. In a text
without adjacent white space, a space always begins a pre-token, so cutting
before every space never cuts one: each such unit is encoded once and its ids
are reused. Texts with adjacent white space are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

#: Two adjacent characters that any of the libraries may hold for white space.
ADJACENT = re.compile(r"[\s\x1c-\x1f\x85\u180e\u200b\ufeff]{2}")
#: Units kept per Python worker; a full cache is emptied, which costs time only.
CACHE_UNITS = 300_000


class UnitCache:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``encode`` takes a list of texts and returns the bytes of each one's ids.
    """

    def __init__(self, encode: Callable[[Sequence[str]], list[bytes]]) -> None:
        self.encode = encode
        self.ids: dict[str, bytes] = {}

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of every text, in order."""
        split = [None if ADJACENT.search(x) else x.replace(" ", "\x00 ").split("\x00") if "\x00" not in x else None for x in texts]
        if len(self.ids) > CACHE_UNITS:
            self.ids.clear()
        known = self.ids
        missing = list({u for units in split if units for u in units if u not in known})
        for at in range(0, len(missing), 10_000):
            part = missing[at : at + 10_000]
            known.update(zip(part, self.encode(part), strict=True))
        rest = [x for x, units in zip(texts, split, strict=True) if units is None]
        alone = iter(self.encode(rest) if rest else [])
        get = known.__getitem__
        return [b"".join(map(get, units)) if units is not None else next(alone) for units in split]
