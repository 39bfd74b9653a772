"""External induced sorting of a shard's suffixes with their common-prefix values.

The order of the suffixes at left-most-smaller ("LMS") places is found first, by recursion: the substrings between
these places get names, and the suffixes of the string of names are sorted by the same procedure until all names
differ. All other suffixes are induced from that order. A suffix waits in a priority queue as a tuple (character,
arrival, place, common prefix with the tuple before it). The least tuples are taken off, and for each of them
the suffix one place to the left is put in. All characters between which no tuple is handed on are taken off
together, so that every step is an array operation also for the large alphabets of names.

Beyond ``memory`` tuples a queue keeps its runs on disk, and so are a shard's texts, types and sorted suffixes
beyond ``memory`` characters. The files are unnamed spill files of one task, in the folder of Spark's own spills.
Naming sorts 16 bytes for each LMS place in memory; one bucket of a character is taken off as a whole.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


def held(array: np.ndarray, memory: int) -> np.ndarray:
    """The array, on disk if it has more than ``memory`` entries."""
    if len(array) <= memory:
        return array
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    with tempfile.TemporaryFile(dir=folder) as file:
        array.tofile(file)
        file.flush()
        return np.memmap(file, array.dtype, "r+", shape=array.shape).view(np.ndarray)


class SuffixQueue:
    """A priority queue of tuples (character, arrival, place, lcp), least character and then first arrival first.

    It is a list of sorted runs. Neighbouring runs of like size are merged; runs beyond ``memory`` tuples in all
    go to disk. ``pop`` merges what all runs have of the least characters.
    """

    def __init__(self, memory: int):
        self.memory, self.runs, self.on_disk, self.spilled = memory, [], 0, 0

    def push(self, char: np.ndarray, place: np.ndarray, lcp: np.ndarray) -> None:
        """Tuples in order of character and arrival, later than all that were pushed before."""
        run = [char, place, lcp]
        while len(self.runs) > self.on_disk and len(self.runs[-1][0]) <= 2 * len(run[0]):
            both = [np.concatenate(c) for c in zip(self.runs.pop(), run)]
            order = np.argsort(both[0], kind="stable")
            run = [c[order] for c in both]
        self.runs.append(run)
        if sum(len(r[0]) for r in self.runs[self.on_disk :]) > self.memory:
            self.runs[self.on_disk :] = [[held(c, 0) for c in r] for r in self.runs[self.on_disk :] if len(r[0])]
            self.on_disk = len(self.runs)
            self.spilled += 1

    def pop(self, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tuples of characters up to ``last``, merged; the first of each character has no common prefix."""
        parts = []
        for i, run in enumerate(self.runs):
            if len(run[0]) and run[0][0] <= last:
                at = int(np.searchsorted(run[0], last, "right"))
                parts.append([np.asarray(c[:at]) for c in run])
                self.runs[i] = [c[at:] for c in run]
        left = [bool(len(r[0])) for r in self.runs]
        self.on_disk = sum(left[: self.on_disk])
        self.runs = [r for r, some in zip(self.runs, left) if some]
        if not parts:
            return (np.empty(0, np.int32),) * 3
        char, place, lcp = (np.concatenate(c) for c in zip(*parts))
        if len(parts) > 1:
            order = np.argsort(char, kind="stable")
            char, place, lcp = char[order], place[order], lcp[order]
        lcp = lcp.copy()
        lcp[firsts(char)] = 0
        return char, place, lcp


def firsts(char: np.ndarray) -> np.ndarray:
    """Where each character's tuples begin."""
    return np.flatnonzero(np.append(True, char[1:] != char[:-1])) if len(char) else np.empty(0, np.int64)


def least_between(v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """min(v[i+1..j]) for each pair i < j."""
    out = np.empty(len(i), np.int32)
    if not len(i):
        return out
    level = np.frexp(j - i)[1] - 1
    now = v
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            now = np.minimum(now[:-half], now[half:])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(now[i[at] + 1], now[j[at] - (1 << k) + 1])
    return out


def classify(text: np.ndarray, memory: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place: whether its suffix is less than the next one, and how far its run of one character goes on to
    the right and to the left, itself included.
    """
    n, block = len(text), max(1024, min(memory, 1 << 22))
    small, run, back = held(np.zeros(n, bool), memory), held(np.zeros(n, np.int32), memory), held(np.zeros(n, np.int32), memory)
    for lo in range(0, n, block):
        part = text[lo : lo + block]
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        size = np.diff(np.append(begin, len(part)))
        back[lo : lo + block] = np.arange(len(part)) - np.repeat(begin, size) + 1
        if lo and part[0] == text[lo - 1]:
            back[lo : lo + int(size[0])] += back[lo - 1]
    for lo in range((n - 1) // block * block, -1, -block):
        hi = min(n, lo + block)
        part = np.append(text[lo:hi], text[hi] if hi < n else -1)
        edge = np.flatnonzero(part[1:] != part[:-1])
        if hi < n and (not len(edge) or edge[-1] != hi - lo - 1):
            edge = np.append(edge, hi - lo - 1)  # this run goes on in the next block
        size = np.diff(np.append(-1, edge))
        last = np.repeat(edge, size)
        run[lo:hi], small[lo:hi] = last - np.arange(hi - lo) + 1, part[last + 1] > part[:-1]
        if hi < n and part[-1] == part[-2]:
            tail = slice(hi - int(size[-1]), hi)
            run[tail] += run[hi]
            small[tail] = small[hi]
    return small, run, back


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, compared directly, ``most`` at most."""
    out, live, k, n = np.zeros(len(a), np.int32), np.arange(len(a)), 0, len(text)
    while len(live) and k < most:
        live = live[(a[live] + k < n) & (b[live] + k < n)]
        live = live[text[a[live] + k] == text[b[live] + k]]
        k += 1
        out[live] = k
    return out


def names_of(text: np.ndarray, small: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Dense ranks of the substrings from one LMS place to the next, by (character, type), ``depth`` at most.

    A rank is the place of a group's first member in the order so far, so groups are refined on their own, a few
    characters at a time, while they have several members. Equal members end together, for types are compared.
    """
    n, bits = len(text), int(text.max()).bit_length() + 2
    size = np.append(np.diff(places) + 1, n - places[-1] + 1)
    step = max(1, 62 // bits)
    rank, live, done = np.zeros(len(places), np.int64), np.arange(len(places)), 0
    while len(live) and done < depth:
        key, start, most = np.zeros(len(live), np.int64), places[live], size[live]
        for k in range(done, done + step):
            at = np.minimum(start + k, n - 1)
            unit = 2 * text[at].astype(np.int64) + small[at] + 1
            unit[(start + k >= n) | (k >= most)] = 0
            key = (key << bits) | unit
        order = np.lexsort((key, rank[live])) if done else np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        old = rank[live]
        whole = np.append(True, old[1:] != old[:-1])
        new = whole | np.append(True, key[1:] != key[:-1])
        place = np.arange(len(live))
        rank[live] = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(whole, place, 0))
        done += step
        live = live[~(new & np.append(new[1:], True))]
        live = live[size[live] > done]
    used = np.zeros(len(places), np.int64)
    used[rank] = 1
    return (np.cumsum(used) - 1)[rank]


def blocks_of(chars: np.ndarray, to: np.ndarray) -> list[int]:
    """Ends (indexes) of the blocks of ``chars`` between whose members no tuple is handed on; to: the least that each hands on to."""
    ends, limit = [], np.inf
    for i, (c, t) in enumerate(zip(chars.tolist(), to.tolist())):
        if c >= limit:
            ends.append(i)
            limit = np.inf
        limit = min(limit, t)
    return [*ends, len(chars)]


def induce(text, small, run, back, seeds, fixed, want_small, sign, memory):
    """One scan: all suffixes of one type, and what was ``fixed``, in order of sign * character.

    seeds: tuples to begin with. fixed: (sign * character, place, lcp) in order; within a character they come after
    the suffixes that the scan finds. Yields (sign * character, place, lcp, is found) block by block.
    """
    n = len(text)
    queue = SuffixQueue(memory)
    queue.push(*seeds)
    size = int(text.max()) + 1
    present, hands = np.zeros(size, bool), np.full(size, np.iinfo(np.int64).max)
    for lo in range(0, n, 1 << 22):
        part = text[lo : lo + (1 << 22) + 1].astype(np.int64)
        present[part] = True
        at = np.flatnonzero((small[lo : lo + len(part) - 1] == want_small) & (part[1:] != part[:-1]))
        np.minimum.at(hands, part[at + 1], sign * part[at])
    chars = np.flatnonzero(present)
    keys = (sign * chars)[::sign]
    i = 0
    for end in blocks_of(keys, hands[chars][::sign]):
        last = np.int32(keys[end - 1])
        char, place, lcp = queue.pop(last)
        extra = back[place] - 1
        if extra.any():  # a run of the character goes on to the left: longer runs follow shorter ones
            member = np.repeat(np.arange(len(place)), extra)
            longer = np.arange(len(member)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
            order = np.lexsort((member, longer, char[member]))
            member, longer = member[order], longer[order]
            value = longer.astype(np.int32)
            inner = np.flatnonzero((char[member[1:]] == char[member[:-1]]) & (longer[1:] == longer[:-1])) + 1
            value[inner] += least_between(lcp, member[inner - 1], member[inner])
            every = np.concatenate([char, char[member]])
            order = np.argsort(every, kind="stable")
            char, lcp = every[order], np.concatenate([lcp, value])[order]
            place = np.concatenate([place, (place[member] - longer).astype(np.int32)])[order]
        j = int(np.searchsorted(fixed[0], last, "right"))
        order = np.argsort(np.concatenate([char, fixed[0][i:j]]), kind="stable")
        n_found = len(char)
        char, place, lcp = (np.concatenate([a, b[i:j]])[order] for a, b in zip((char, place, lcp), fixed))
        i = j
        is_found = order < n_found
        edge = np.flatnonzero(is_found[:-1] & ~is_found[1:] & (char[1:] == char[:-1])) + 1
        lcp[edge] = np.minimum(run[place[edge - 1]], run[place[edge]])
        yield char, place, lcp, is_found
        at = np.flatnonzero(place > 0)
        left = place[at] - 1
        to = sign * text[left].astype(np.int32)
        on = (small[left] == want_small) & (to != char[at])
        at, left, to = at[on], left[on], to[on]
        if len(at):
            order = np.argsort(to, kind="stable")
            at, left, to = at[order], left[order], to[order]
            value = np.ones(len(at), np.int32)
            inner = np.flatnonzero(to[1:] == to[:-1]) + 1
            value[inner] += least_between(lcp, at[inner - 1], at[inner])
            queue.push(to, left.astype(np.int32), value)


def sort_suffixes(text: np.ndarray, depth: int, memory: int = 1 << 24, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and common prefixes with the suffix before, exact up to ``depth`` characters.

    text: characters from 0 on. The end of the text is smaller than any of them. trace: gets the length of each
    level of the recursion.
    """
    n = len(text)
    if trace is not None:
        trace.append(n)
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    text = held(text, memory)
    small, run, back = classify(text, memory)
    places = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    lms = lms_lcp = np.empty(0, np.int32)
    if len(places):
        name = names_of(text, small, places, depth)
        if int(name.max()) + 1 == len(name):
            order, lcp = np.argsort(name), np.zeros(len(name), np.int32)
        else:  # a name stands for two characters at least
            order, lcp = sort_suffixes(name.astype(np.int32), depth // 2 + 2, memory, trace)
        del name
        lms, a = places[order], np.append(0, order[:-1])
        skip_a, skip_b = np.minimum(a + lcp, len(places) - 1), np.minimum(order + lcp, len(places) - 1)
        lms_lcp = places[skip_b] - lms + common_prefix(text, places[skip_a], places[skip_b], depth)
        lms_lcp[0] = 0
        lms, lms_lcp = lms.astype(np.int32), np.minimum(lms_lcp, n - lms).astype(np.int32)
    large: list[list[np.ndarray]] = [[], [], []]
    lms_char = text[lms].astype(np.int32)
    seed = (np.array([text[-1]], np.int32), np.array([n - 1], np.int32), np.zeros(1, np.int32))
    for char, place, lcp, is_found in induce(text, small, run, back, seed, (lms_char, lms, lms_lcp), False, 1, memory):
        for out, c in zip(large, (char, place, lcp)):
            out.append(held(c[is_found], memory))
    char, place, lcp = (held(np.concatenate(c), memory) for c in large)
    # From the largest character down, small suffixes before the large ones of their character; lcp with the one before.
    down = np.append(lcp[:1] * 0, lcp[:0:-1])
    none = (np.empty(0, np.int32),) * 3
    orders, lcps = [], []
    for _, place, lcp, _ in induce(text, small, run, back, none, (-char[::-1], place[::-1], down), True, -1, memory):
        orders.append(place)
        lcps.append(lcp)
    order, lcp = np.concatenate(orders)[::-1], np.concatenate(lcps)[::-1]
    return order, np.append(np.int32(0), lcp[:-1])

