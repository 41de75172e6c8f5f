"""Induced sorting of suffixes and of their common prefixes, with disk-backed bucket queues.

Suffixes are L (greater than the next) or S; an S suffix after an L one is a seed. Seeds are sorted first, then all L
suffixes are induced from left to right and all S suffixes from right to left: each suffix taken from the queue puts
the one before it into the queue, under its first letter. Letters only ever grow on one way and fall on the other, and
within a letter the order of arrival is the order of the rest, so the queue is one first-in first-out run for each
letter. A run is taken as a whole and handled with array operations; what it puts into its own run makes the next round.

The queue holds tuples: a suffix, and the length of the prefix that it shares with the one before it in its run. That
is one more than the least such length between the two suffixes that put them there, so common prefixes are induced
along with the order and nothing is compared. They count up to a depth. Queues, and the sorted runs that come out, go to
disk beyond a bound of memory.

Seeds are sorted by the same pass over their substrings, which get names; equal names are settled by recursion on the
string of names, which doubles the names that are compared, for the seeds still tied only, and ends when they differ or
reach as deep as asked.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

from .kernels import mix, powers

U64 = np.uint64
#: Bytes of tuples that a queue, and the runs that come out of it, hold in memory.
QUEUE_BYTES = 64 << 20
#: Different bytes of a text, with one for the end and one between its parts.
LETTERS = 258
TUPLE = np.dtype([("at", np.int32), ("lcp", np.int32)])


def tuples(at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), TUPLE)
    out["at"], out["lcp"] = at, lcp
    return out


class BucketQueue:
    """First-in first-out runs of tuples by letter, taken in letter order; they go to one unnamed file beyond a bound."""

    def __init__(self, limit: int = QUEUE_BYTES) -> None:
        self.runs: dict[int, list] = defaultdict(list)
        self.limit, self.held, self.file, self.end, self.spilled = limit, 0, None, 0, 0

    def put(self, bucket: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        self.runs[bucket].append(rows)
        self.held += rows.nbytes
        if self.held > self.limit:
            self.spill()

    def put_all(self, letters: np.ndarray, rows: np.ndarray) -> None:
        """Rows sorted by letter go to the runs of their letters, in the order they come."""
        if not len(rows):
            return
        cuts = np.flatnonzero(np.diff(letters)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(letters)], strict=True):
            self.put(int(letters[a]), rows[a:b])

    def spill(self) -> None:
        """Write each run's rows to the file; what stays in memory is where they lie."""
        self.file = self.file or tempfile.TemporaryFile()
        for parts in self.runs.values():
            own = [p for p in parts if isinstance(p, np.ndarray)]
            if own:
                whole = np.concatenate(own)
                self.file.seek(self.end)
                whole.tofile(self.file)
                kept = [p for p in parts if not isinstance(p, np.ndarray)]
                parts[:] = [*kept, (self.end, len(whole), whole.dtype)]
                self.end += whole.nbytes
                self.spilled += whole.nbytes
        self.held = 0

    def take(self, bucket: int) -> np.ndarray | None:
        parts = self.runs.pop(bucket, None)
        if not parts:
            return None
        out = []
        for p in parts:
            if isinstance(p, np.ndarray):
                self.held -= p.nbytes
                out.append(p)
            else:
                self.file.seek(p[0])
                out.append(np.fromfile(self.file, p[2], p[1]))
        return out[0] if len(out) == 1 else np.concatenate(out)

    def close(self) -> None:
        self.runs.clear()
        if self.file is not None:
            self.file.close()


def kinds(text: np.ndarray) -> np.ndarray:
    """True for S suffixes. The text ends with its only 0."""
    n = len(text)
    falls = text[:-1].astype(np.int16) - text[1:]
    # The next place at or after each where neighbours differ; equal neighbours are of the kind that comes there.
    place = np.where(falls != 0, np.arange(n - 1, dtype=np.int32), np.int32(n))
    place = np.minimum.accumulate(place[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = falls[np.minimum(place, n - 2)] < 0
    return out


def repeated(text: np.ndarray, at: int, depth: int) -> int:
    """How often the letter at a place comes in a row there, up to a depth."""
    part = text[at : at + depth]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


class Pushes:
    """Puts the suffixes before those that are taken into a queue, with what they share with the one put there before."""

    def __init__(self, text: np.ndarray, kind: np.ndarray, queue: BucketQueue, depth: int) -> None:
        self.text, self.kind, self.queue, self.depth = text, kind, queue, depth
        #: By letter the least common prefix since its last push, and none before its first.
        self.since = np.full(int(text.max()) + 1, -1, np.int32)

    def __call__(self, rows: np.ndarray, same: int | None) -> np.ndarray:
        """rows: what is taken, each with its common prefix with the one taken before. Pushes under the letter `same`
        come back, all others go to the queue."""
        place = np.flatnonzero(rows["at"] > 0)
        before = rows["at"][place] - 1
        keep = self.kind[before]
        place, before = place[keep], before[keep]
        letters = self.text[before]
        order = np.argsort(letters, kind="stable")
        place, before, letters = place[order], before[order], letters[order]
        out = tuples(before, self.shared(rows["lcp"], place, letters) if self.depth else np.zeros(len(place), np.int32))
        mine = letters == same
        self.queue.put_all(letters[~mine], out[~mine])
        return out[mine]

    def shared(self, lcp: np.ndarray, place: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """What each push, sorted by letter, shares with the one before it under its letter."""
        # Least common prefix over runs of rows, by doubling: it is asked from one push of a letter to the next.
        levels = [lcp]
        step = 1
        while 2 * step <= len(lcp):
            levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
            step *= 2
        first = np.concatenate([[True], letters[1:] != letters[:-1]]) if len(letters) else np.zeros(0, bool)
        low = np.where(first, 0, np.concatenate([[0], place[:-1] + 1])[: len(place)])
        least = np.empty(len(place), np.int32)
        level = np.frexp((place + 1 - low).astype(float))[1] - 1
        for k in range(len(levels)):
            own = np.flatnonzero(level == k)
            least[own] = np.minimum(levels[k][low[own]], levels[k][place[own] + 1 - (1 << k)])
        started = first & (self.since[letters] >= 0)
        least[started] = np.minimum(least[started], self.since[letters[started]])
        shared = np.minimum(least + 1, self.depth)
        shared[first & ~started] = 0
        # What letters have seen since their last push.
        if len(lcp):
            self.since = np.where(self.since >= 0, np.minimum(self.since, lcp.min()), -1).astype(np.int32)
        last = np.flatnonzero(np.concatenate([letters[1:] != letters[:-1], [True]])) if len(letters) else np.zeros(0, np.int64)
        tail = np.minimum.accumulate(lcp[::-1])[::-1]
        after = place[last] + 1
        self.since[letters[last]] = np.where(
            after < len(lcp),
            tail[np.minimum(after, max(len(lcp) - 1, 0))],
            self.depth,
        ) if len(last) else 0
        return shared


def induce(text: np.ndarray, s_kind: np.ndarray, seeds: np.ndarray, limit: int, depth: int) -> tuple[BucketQueue, BucketQueue]:
    """All L and all S suffixes by letter, ascending, each with the prefix it shares with the one before it among those
    of its kind and letter; from seeds (tuples) in order."""
    letters = int(text.max()) + 1
    queue, left, right = BucketQueue(limit), BucketQueue(limit), BucketQueue(limit)
    by_letter = np.searchsorted(text[seeds["at"]], np.arange(letters + 1))
    none = np.zeros(0, TUPLE)

    def rounds(push: Pushes, c: int) -> np.ndarray:
        """Takes the run of a letter and what it puts into itself."""
        out, wave = [], queue.take(c)
        while wave is not None and len(wave):
            out.append(wave)
            wave = push(wave, c)
        return np.concatenate(out) if len(out) > 1 else out[0] if out else none

    def then(own: np.ndarray, last: np.ndarray) -> np.ndarray:
        """own after `last` of the same letter and the other kind: they share the letters that both repeat."""
        if len(own):
            own = own.copy()
            both = min(repeated(text, int(last["at"][-1]), depth), repeated(text, int(own["at"][0]), depth)) if depth and len(last) else 0
            own["lcp"][0] = both
        return own

    push = Pushes(text, ~s_kind, queue, depth)
    for c in range(letters):
        found = rounds(push, c)
        left.put(c, found)
        own = then(seeds[by_letter[c] : by_letter[c + 1]], found)
        if len(own):
            push(own, None)
    queue.close()
    queue = BucketQueue(limit)
    push = Pushes(text, s_kind, queue, depth)
    for c in range(letters - 1, -1, -1):
        found = rounds(push, c)
        # Taken from the greatest down: what each shares with the next smaller one stands at that one.
        up = tuples(found["at"][::-1], np.append(found["lcp"][:0:-1], 0) if len(found) else found["lcp"])
        right.put(c, tuples(up["at"], np.concatenate([[0], up["lcp"][:-1]])) if len(up) else up)
        own = left.take(c)
        if own is not None:
            left.put(c, own)
            down = tuples(own["at"][::-1], np.concatenate([[0], own["lcp"][:0:-1]]))
            push(then(down, found), None)
    queue.close()
    right.take(0)
    right.put(0, tuples(np.array([len(text) - 1]), np.array([0])))
    return left, right


def settle(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by their first `depth` names; ties stay in any order."""
    rank = names.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    n, step = len(rank), 1
    while step < depth:
        value = rank[order]
        new = np.concatenate([[True], value[1:] != value[:-1]])
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [n]]))
        group = np.repeat(start, size)
        rank = np.empty(n, np.int64)
        rank[order] = group
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        suffix = order[tied]
        after = suffix + step
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.lexsort((key, group[tied]))
        order[tied] = suffix[again]
        key, held = key[again], group[tied]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (held[1:] != held[:-1])])
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        step *= 2
    return order


def shared_prefixes(text: np.ndarray, places: np.ndarray, total: np.ndarray, down: np.ndarray, depth: int) -> np.ndarray:
    """What each place's suffix shares with that of the place before it, up to a depth, by halving over hashes."""
    a, b = places[:-1].astype(np.int64), places[1:].astype(np.int64)
    most = np.minimum(depth, len(text) - np.maximum(a, b))
    low, high = np.zeros(len(a), np.int64), most
    while (open_ := np.flatnonzero(low < high)).size:
        x, y, m = a[open_], b[open_], (low[open_] + high[open_] + 1) // 2
        same = (total[x + m] - total[x]) * down[x] == (total[y + m] - total[y]) * down[y]
        low[open_[same]] = m[same]
        high[open_[~same]] = m[~same] - 1
    return np.concatenate([[0], low]) if len(places) else low


def sorted_runs_of(text: np.ndarray, depth: int, limit: int = QUEUE_BYTES) -> Iterator[np.ndarray]:
    """Tuples of all suffixes of a text (numbers below LETTERS, ended by its only 0) in the order of their first `depth`
    letters, a run for each first letter and kind; each with the prefix it shares with the one before it, up to depth.

    Suffixes that agree so far stand next to each other, in any order.
    """
    text = np.ascontiguousarray(text, np.uint16)
    s_kind = kinds(text)
    is_seed = s_kind.copy()
    is_seed[0] = False
    is_seed[1:] &= ~s_kind[:-1]
    seeds = np.flatnonzero(is_seed).astype(np.int32)
    by_letter = seeds[np.argsort(text[seeds], kind="stable")]
    left, right = induce(text, s_kind, tuples(by_letter, np.zeros(len(seeds), np.int32)), limit, 0)
    left.close()
    parts = [p["at"] for c in sorted(right.runs) if (p := right.take(c)) is not None]
    right.close()
    ranked = np.concatenate(parts)
    ranked = ranked[is_seed[ranked]]
    # Names of seed substrings: from a seed through the next one. Equal ones stand together.
    up, down = powers(len(text) + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(text.astype(U64) + U64(1)) * up[:-1])])
    place = np.empty(len(text), np.int32)
    place[seeds] = np.arange(len(seeds), dtype=np.int32)
    at = place[ranked]
    ends = np.minimum(np.append(seeds, len(text) - 1)[at + 1] + 1, len(text))
    value = (total[ends] - total[ranked]) * down[ranked]
    fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (np.diff(ends - ranked) != 0)])
    names = np.empty(len(seeds), np.int64)
    names[at] = np.cumsum(fresh)
    if not fresh.all():
        ranked = seeds[settle(names, depth)]
    left, right = induce(text, s_kind, tuples(ranked, shared_prefixes(text, ranked, total, down, depth)), limit, depth)
    last = None
    for c in range(int(text.max()) + 1):
        for run in (left.take(c), right.take(c)):
            if run is not None and len(run):
                run = run.copy()
                alike = last is not None and text[last] == text[run["at"][0]]
                run["lcp"][0] = min(repeated(text, int(last), depth), repeated(text, int(run["at"][0]), depth)) if alike else 0
                last = run["at"][-1]
                yield run
    left.close()
    right.close()


def suffix_order(text: np.ndarray, depth: int, limit: int = QUEUE_BYTES) -> np.ndarray:
    """The sorted runs as one array of tuples."""
    return np.concatenate(list(sorted_runs_of(text, depth, limit)))
