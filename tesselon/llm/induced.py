"""External suffix sorting by recursive induced sorting with disk-backed monotone priority queues.

A suffix is L if it is larger than the one after it and S otherwise; a leftmost S suffix
(LMS) follows an L suffix.  The order of the LMS suffixes gives all others: taking sorted
suffixes by ascending first symbol, each puts the suffix one place to its left, if that is
L, at the end of the queue of that one's first symbol; then likewise for S by descending
symbol.  The LMS suffixes themselves are sorted by the same induction over LMS substrings,
whose ranks form a text of at most half the length, sorted recursively until all ranks
differ.

``Queues`` is the monotone priority queue.  Its keys are ranges of symbols with about
``BATCH`` suffixes each (a frequent symbol has a range of its own), its entries come in the
order of the suffixes that induced them, and a range is taken out as a whole: entries that
induce others of the same range are followed to their end, and the whole range is sorted by
(symbol, place of the inducing suffix) in arrays.  Beyond ``memory`` entries all queues are
written to an unlinked scratch file of the task (like a sort's spill: private to the task,
gone with it) and read back a range at a time.  Arrays over all places (text, ranks, orders)
are mapped files of that kind too where they have more than ``memory`` entries.
"""

from __future__ import annotations

import tempfile

BATCH = 1 << 14


def _places(n: int):
    """The type of places in a text of n symbols."""
    import numpy as np

    return np.int32 if n < 1 << 31 else np.int64


def _array(n: int, kind, memory: int):
    """An array of n entries; a mapped scratch file beyond ``memory``."""
    import numpy as np

    if n <= memory:
        return np.empty(n, dtype=kind)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, dtype=kind, mode="w+", shape=(n,))


class Queues:
    def __init__(self, memory: int = 4_000_000, kind="int64"):
        self.memory, self.kind, self.held, self.spilled = memory, kind, 0, 0
        self.now: dict[int, list] = {}
        self.disk: dict[int, list[tuple[int, int]]] = {}
        self.file = None

    def push(self, symbol: int, items) -> None:
        self.now.setdefault(symbol, []).append(items)
        self.held += len(items)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.spilled += self.held
        for symbol, parts in self.now.items():
            for p in parts:
                at = self.file.seek(0, 2)
                self.file.write(p.tobytes())
                self.disk.setdefault(symbol, []).append((at, len(p)))
        self.now, self.held = {}, 0

    def pop(self, symbol: int):
        """All entries of a symbol so far, in order, or None."""
        import numpy as np

        parts = []
        for at, n in self.disk.pop(symbol, ()):
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(np.dtype(self.kind).itemsize * n), dtype=self.kind))
        mine = self.now.pop(symbol, [])
        self.held -= sum(map(len, mine))
        parts += mine
        return None if not parts else parts[0] if len(parts) == 1 else np.concatenate(parts)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(text):
    """Whether each suffix is S; the end of the text counts as the smallest symbol."""
    import numpy as np

    n = len(text)
    sign = np.zeros(n, dtype=np.int8)
    sign[:-1] = np.where(text[:-1] < text[1:], 1, np.where(text[:-1] > text[1:], -1, 0))
    sign[-1] = -1
    place = np.where(sign != 0, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(place[::-1])[::-1]
    return sign[nearest] > 0


def _stable(values):
    """A stable argsort of numbers from 0 up; short ones are sorted by their digits."""
    import numpy as np

    if len(values) and values.max() < 1 << 16:
        values = values.astype(np.uint16)
    return np.argsort(values, kind="stable")


def _ranges(key, counts):
    """The range of each symbol: ascending numbers, about BATCH suffixes a range, and a range of its own for a frequent symbol."""
    import numpy as np

    upto = np.cumsum(counts)
    number = (upto - 1) // BATCH
    large = counts > BATCH // 4
    mark = np.ones(len(counts), dtype=bool)
    mark[1:] = (number[1:] != number[:-1]) | large[1:] | large[:-1]
    return np.cumsum(mark) - 1


def _closure(key, b, of, start, seeds):
    """Entries of range b that begin with ``start`` and what follows from them and the seeds within the range, and what goes to later ranges.

    Returns places, their symbols, parents (numbers among the entries, -1 for none), whether an entry is a seed, and
    places, parents and ranges of later entries.
    """
    import numpy as np

    now = np.concatenate([start, seeds])
    strict = np.arange(len(now)) >= len(start)
    number, its = np.arange(len(now), dtype=np.int32), key[now]  # a range fits 32 bits
    places, symbols, parents, later, held = [now], [its], [np.full(len(now), -1, dtype=np.int32)], [], len(now)
    while len(now):
        left = now - 1
        mine = key[left]
        good = mine > its
        same = mine == its
        if strict is not None:
            same &= ~strict
        good |= same
        good &= now > 0
        left, number, mine = left[good], number[good], mine[good]
        to = of[mine]
        here = to == b
        away = ~here
        later.append((left[away], number[away], to[away]))
        now, its = left[here], mine[here]
        places.append(now)
        symbols.append(its)
        parents.append(number[here])
        strict = None
        number = np.arange(held, held + len(now), dtype=np.int32)
        held += len(now)
    is_seed = np.zeros(held, dtype=bool)
    is_seed[len(start) : len(start) + len(seeds)] = True
    return np.concatenate(places), np.concatenate(symbols), np.concatenate(parents), is_seed, [np.concatenate(x) for x in zip(*later)]


def _ranked(symbol, parents, is_seed):
    """Numbers of a range's entries in order: by symbol, seeds last, then by the place of the parent; those from earlier ranges come first, as they are.

    None if they are in order already.
    """
    import numpy as np

    child = parents >= 0
    if not child.any() and (symbol == symbol[0]).all():  # start, then seeds
        return None
    symbol = symbol.astype(np.int64)
    group = (symbol - symbol.min()) * 3 + np.where(is_seed, 2, child)
    order = _stable(group)
    if not child.any():
        return order
    # a child's key is the groups of its ancestors up to its origin: ties are settled over twice as many of them in each round
    n = len(group)
    new = ~child[order]
    new[1:] |= group[order[1:]] != group[order[:-1]]
    new[0] = True
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(first, size)
    live = order[np.repeat(size > 1, size)]
    jump = np.where(child, parents, np.arange(n))
    while len(live):
        key = rank[live] * n + rank[jump[live]]
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        old = rank[live]
        new = np.ones(len(live), dtype=bool)
        new[1:] = old[1:] != old[:-1]
        begin = np.flatnonzero(new)
        place = old + np.arange(len(live)) - np.repeat(begin, np.diff(np.append(begin, len(live))))
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(live)))
        rank[live] = np.repeat(place[first], size)
        live = live[np.repeat(size > 1, size)]
        jump = jump[jump]
    order[rank] = np.arange(n)
    return order


def _induce(key, counts, seeds, first, memory: int):
    """Places that the sorted seeds induce (and ``first``), in ascending order of ``key``."""
    import numpy as np

    of = _ranges(key, counts)
    queues, n_out = Queues(memory, _places(len(key))), 0
    kind = _places(len(key))
    out = _array(len(key), kind, memory)
    cut = np.searchsorted(of[key[seeds]], np.arange(int(of[-1]) + 2))
    if first is not None:
        queues.push(int(of[key[first]]), np.array([first], dtype=kind))
    none = np.zeros(0, dtype=kind)
    for b in range(int(of[-1]) + 1):
        start, mine = queues.pop(b), seeds[cut[b] : cut[b + 1]]
        if start is None and not len(mine):
            continue
        places, symbols, parents, is_seed, (later, its, to) = _closure(key, b, of, none if start is None else start, np.asarray(mine))
        order = _ranked(symbols, parents, is_seed)
        found = places[: len(places) - len(mine)] if order is None else places[order][~is_seed[order]]
        out[n_out : n_out + len(found)] = found
        n_out += len(found)
        if len(later):
            if order is not None:
                place = np.empty(len(order), dtype=np.int32)
                place[order] = np.arange(len(order), dtype=np.int32)
                by = _stable(place[its])
                later, to = later[by], to[by]
            by = _stable(to - b)
            later, to = later[by], to[by]
            at = np.flatnonzero(to[1:] != to[:-1]) + 1
            for r, part in zip(to[np.concatenate(([0], at))].tolist(), np.split(later, at)):
                queues.push(r, part)
    queues.close()
    return out[:n_out]


def _all_from(text, seeds, memory: int):
    """All suffixes in order, from the order of the LMS suffixes (or, for LMS substrings, from their first symbols)."""
    import numpy as np

    n = len(text)
    counts = np.bincount(text)
    larger = _induce(text, counts, seeds, n - 1, memory)
    turned = _array(n, text.dtype, memory)
    np.subtract(len(counts) - 1, text, out=turned, dtype=text.dtype, casting="unsafe")
    smaller = _induce(turned, counts[::-1], larger[::-1], None, memory)[::-1]
    begin = np.concatenate(([0], np.cumsum(counts)))
    few = np.bincount(text[larger], minlength=len(counts))
    out = _array(n, _places(n), memory)
    for part, skip in ((larger, None), (smaller, few)):
        c = text[part]
        own = np.concatenate(([0], np.cumsum(np.bincount(c, minlength=len(counts)))))
        out[begin[c] + (0 if skip is None else skip[c]) + np.arange(len(part)) - own[c]] = part
    return out


def suffix_array(text, symbols: int = 256, memory: int = 4_000_000, depth: int | None = None):
    """Places of all suffixes of an integer array in ascending order; the end counts as the smallest symbol.

    With ``depth``, suffixes that agree in their first ``depth`` symbols may come in any order.
    """
    import numpy as np

    n = len(text)
    if n < 2:
        return np.arange(n)
    if depth is not None and depth < 2:
        return np.argsort(text, kind="stable")
    small = _types(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(_places(n))

    def induce(seeds):
        return _all_from(text, seeds, memory)

    if len(lms) < 2:
        return induce(lms)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    order = induce(lms[np.argsort(text[lms], kind="stable")])
    order = order[is_lms[order]]
    # names of LMS substrings, equal for equal ones; a substring ends with the next LMS place
    size = np.zeros(n, dtype=_places(n))
    size[lms] = np.append(np.diff(lms), n - lms[-1]) + 1
    a, b = order[:-1], order[1:]
    same = size[a] == size[b]
    same &= (a + size[a] <= n) & (b + size[b] <= n)  # the last one reaches the end and equals no other
    live, step = np.flatnonzero(same), 0
    while len(live):
        live = live[size[a[live]] > step]
        equal = text[a[live] + step] == text[b[live] + step]
        same[live[~equal]] = False
        live = live[equal]
        step += 1
    rank = np.concatenate(([0], np.cumsum(~same)))
    if rank[-1] + 1 < len(lms):
        names = _array(n, _places(n), memory)
        names[order] = rank
        reduced = names[lms]
        del names
        # a rank stands for two symbols and more, so half the depth is enough among ranks
        order = lms[suffix_array(reduced, int(rank[-1]) + 1, memory, None if depth is None else depth // 2 + 1)]
    return induce(order)
