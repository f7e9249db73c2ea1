"""Words as 64-bit hashes and rolling hashes over them, a batch at a time."""

from __future__ import annotations

from .common import tidy


class WordHashes(dict):
    """64-bit hash of a word (bytes); emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit

    def forget(self) -> None:
        """For the end of a task: idle workers hold no words."""
        self.clear()
        tidy()

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: exactly what bytes.split() cuts at."""
    raw = (text or "").encode()
    return (raw.translate(LOWER) if lower else raw).split()


def hash_words(lists: list[list[bytes]], table: WordHashes):
    """All words' hashes in one array, and the place where each list begins (one more at the end)."""
    import numpy as np

    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    get = table.__getitem__
    flat = np.fromiter((h for x in lists for h in map(get, x)), np.uint64, int(starts[-1]))
    return flat, starts


def mix(x):
    """A 64-bit finaliser: every input bit reaches every output bit."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers of the two rolling hashes.
ROLL = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def windows(flat, width: int, which: int = 0):
    """Hash of each run of ``width`` values (runs over list ends are hashed too; the caller leaves them out)."""
    import numpy as np

    n = len(flat) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = np.uint64(ROLL[which])
    x = mix(flat + np.uint64(which * 0x632BE59BD9B4E019))
    h = x[:n].copy()
    for j in range(1, width):
        h *= c
        h += x[j : j + n]
    return mix(h)


def windows_at(flat, places, width: int, which: int = 0):
    """The hashes of ``windows`` at some places only."""
    import numpy as np

    c = np.uint64(ROLL[which])
    x = mix(flat + np.uint64(which * 0x632BE59BD9B4E019))
    h = x[places]
    for j in range(1, width):
        h *= c
        h += x[places + j]
    return mix(h)
