"""External induced sorting of the suffixes of one text, with common prefixes.

The text is a byte array whose strings end in separators (value 0).  Suffixes
that start a descent-to-ascent (LMS suffixes) are sorted first; every other
suffix is then induced from its right neighbour in two sweeps: L-type ones in
rising order, S-type ones in falling order.  The sweeps run over one
priority queue keyed by a suffix's first byte: entries of a byte leave in the
order they came, which is their order as suffixes.  Queues hold
(position, common prefix with the entry before) and go to disk beyond a
memory budget.  All steps move whole arrays: a queue's entries are taken,
their left neighbours dealt to the queues of their first bytes, and the common
prefix of two that land in one queue is one more than the least common
prefix of the stretch between their sources.

Order and common prefixes are exact up to ``depth`` bytes, which is all that
matching needs: so sorting the LMS seeds needs ``depth`` bytes only, eight at a
time, instead of a recursion on their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from pricelens.llm.shared import store, unique_name

#: Bytes of queue entries held in memory; beyond it the fullest queues go to disk.
QUEUE_BYTES = 96 << 20
#: Entries dealt to the queues at a time.
BLOCK = 1 << 17


class BucketQueues:
    """A FIFO of (positions, prefixes) arrays for each first byte, disk-backed.

    Beyond ``budget`` bytes the fullest queue is written to a file of its own
    under ``spill`` (a URI of the shared folder) and read back, once, when its
    byte's turn comes.  Without ``spill`` all stays in memory.
    """

    def __init__(self, budget: int = QUEUE_BYTES, spill: str | None = None):
        self.budget, self.held, self.spill = budget, 0, spill
        self.parts: list[list] = [[] for _ in range(256)]
        self.weight = [0] * 256

    def put(self, byte: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.parts[byte].append((positions, prefixes))
        size = (positions.itemsize + 1) * len(positions)
        self.weight[byte] += size
        self.held += size
        if self.held > self.budget and self.spill is not None:
            self._write_out(max(range(256), key=self.weight.__getitem__))

    def _write_out(self, byte: int) -> None:
        held = [p for p in self.parts[byte] if isinstance(p, tuple)]
        positions, prefixes = _joined(held)
        filesystem, root = store(self.spill)
        filesystem.create_dir(root, recursive=True)
        path = f"{root}/{unique_name('queue', '.bin')}"
        with filesystem.open_output_stream(path, compression=None) as out:
            out.write(positions.astype("<i8").tobytes())
            out.write(prefixes.tobytes())
        # what is in memory came after everything already written
        self.parts[byte] = [p for p in self.parts[byte] if not isinstance(p, tuple)] + [path]
        self.held -= self.weight[byte]
        self.weight[byte] = 0

    def _read_back(self, path: str) -> tuple[np.ndarray, np.ndarray]:
        filesystem, _ = store(self.spill)
        with filesystem.open_input_stream(path, compression=None) as f:
            data = f.read()
        filesystem.delete_file(path)
        n = len(data) // 9
        return np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n)

    def take(self, byte: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All entries of a byte put so far, in order; the queue is empty afterwards."""
        parts, self.parts[byte] = self.parts[byte], []
        self.held -= self.weight[byte]
        self.weight[byte] = 0
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for part in parts:
            if not isinstance(part, tuple):
                part = self._read_back(part)
            ready.append(part)
            count += len(part[0])
            if count >= BLOCK:
                yield _joined(ready)
                ready, count = [], 0
        if ready:
            yield _joined(ready)


class _Dealer:
    """Deals the left neighbours of a sorted stream of suffixes to queues, with their common prefixes."""

    def __init__(self, text: np.ndarray, queues: BucketQueues, depth: int):
        self.text, self.queues, self.depth = text, queues, depth
        #: Least prefix in the stream since the last entry dealt to each byte; 0 before the first.
        self.since = np.zeros(256, np.uint8)
        self.started = np.zeros(256, bool)

    def deal(self, positions: np.ndarray, prefixes: np.ndarray, wanted: np.ndarray) -> None:
        """``wanted``: whose left neighbour is to be dealt.  ``prefixes[i]``: with the entry before in the stream."""
        for a in range(0, len(positions), BLOCK):
            self._block(positions[a:a + BLOCK], prefixes[a:a + BLOCK], wanted[a:a + BLOCK])

    def _block(self, positions: np.ndarray, prefixes: np.ndarray, wanted: np.ndarray) -> None:
        n = len(positions)
        source = np.nonzero(wanted)[0]
        if not len(source):
            np.minimum(self.since, prefixes.min(), out=self.since)
            return
        left = positions[source] - 1
        bytes_ = self.text[left]
        order = np.argsort(bytes_, kind="stable")
        source, left, bytes_ = source[order], left[order], bytes_[order]
        cuts = np.concatenate([[0], np.nonzero(bytes_[1:] != bytes_[:-1])[0] + 1, [len(bytes_)]])
        heads = cuts[:-1]
        begin = np.empty(len(source), np.int64)
        begin[1:] = source[:-1] + 1
        begin[heads] = 0
        table = _RangeMin(prefixes)
        low = table(begin, source + 1)
        present = bytes_[heads]
        low[heads] = np.where(self.started[present], np.minimum(low[heads], self.since[present]), 0)
        common = np.minimum(low.astype(np.int16) + 1, self.depth).astype(np.uint8)
        common[heads[~self.started[present]]] = 0
        for byte, a, b in zip(present.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.queues.put(byte, left[a:b], common[a:b])
        last = source[cuts[1:] - 1] + 1
        np.minimum(self.since, prefixes.min(), out=self.since)
        self.since[present] = 255
        inside = last < n
        self.since[present[inside]] = table(last[inside], np.full(int(inside.sum()), n))
        self.started[present] = True


class _RangeMin:
    """Least value of [a, b) for arrays of ranges, from tables of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (width := 1 << len(self.levels)) <= len(values):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:len(below) - width // 2], below[width // 2:]))

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        level = np.frexp((end - begin).astype(np.float64))[1] - 1
        out = np.empty(len(begin), np.uint8)
        for k in np.unique(level):
            at = level == k
            rows = self.levels[k]
            out[at] = np.minimum(rows[begin[at]], rows[end[at] - (1 << int(k))])
        return out


class SuffixOrder:
    """Sorted suffixes of ``text`` (uint8, strings separated and ended by 0), first byte by first byte."""

    def __init__(self, text: np.ndarray, depth: int, budget: int = QUEUE_BYTES, spill: str | None = None):
        if not len(text) or text[-1] != 0:
            raise ValueError("the text must end in a separator")
        self.text, self.depth, self.budget, self.spill = text, depth, budget, spill
        n = len(text)
        # S-type: smaller than the suffix to its right; equal bytes take the type of the next
        step = np.zeros(n, np.int8)
        step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
        step[-1] = 1
        moves = step != 0
        self.rising = step[moves][np.cumsum(moves, dtype=np.int32) - moves] > 0
        self.words = _words(text)

    def prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of pairs of suffixes, up to ``depth``."""
        out = np.full(len(a), self.depth, np.uint8)
        open_ = np.arange(len(a))
        for at in range(0, self.depth, 8):
            x = self.words[a[open_] + at] ^ self.words[b[open_] + at]
            differ = x != 0
            # bytes before the highest bit that differs
            lead = (64 - np.frexp(np.where(x[differ] >> np.uint64(11), x[differ] >> np.uint64(11), x[differ]).astype(np.float64))[1]
                    - np.where(x[differ] >> np.uint64(11), 11, 0)) // 8
            out[open_[differ]] = np.minimum(at + lead, self.depth)
            open_ = open_[~differ]
            if not len(open_):
                break
        return out

    def seeds(self) -> np.ndarray:
        """LMS suffixes in order, up to ``depth``: eight bytes at a time, only those still tied."""
        lms = (np.nonzero(self.rising[1:] & ~self.rising[:-1])[0] + 1).astype(np.int32 if len(self.text) < 1 << 31 else np.int64)
        order = lms[np.argsort(self.words[lms], kind="stable")]
        tied = np.arange(len(order))
        key = self.words[order]
        new = np.ones(len(order), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new)
        for at in range(8, self.depth, 8):
            same = np.zeros(len(tied), bool)
            same[1:] = group[1:] == group[:-1]
            same[:-1] |= same[1:]
            tied, group = tied[same], group[same]
            if not len(tied):
                break
            words = self.words[order[tied] + at]
            sort = np.lexsort((words, group))
            order[tied] = order[tied][sort]
            words, group = words[sort], group[sort]
            new = np.ones(len(tied), bool)
            new[1:] = (group[1:] != group[:-1]) | (words[1:] != words[:-1])
            group = np.cumsum(new)
        return order

    def buckets(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, common prefix with the one before) of each first byte, suffixes rising; bytes falling."""
        text, rising = self.text, self.rising
        seeds = self.seeds()
        seed_bytes = text[seeds]
        queues, kept = BucketQueues(self.budget, self.spill), BucketQueues(self.budget, self.spill)
        dealer = _Dealer(text, queues, self.depth)
        for byte in range(256):
            last = None
            first = True
            while queues.parts[byte]:  # entries of this byte may add more of it
                for positions, prefixes in queues.take(byte):
                    if first:
                        prefixes = np.concatenate([[np.uint8(0)], prefixes[1:]])
                        first = False
                    kept.put(byte, positions, prefixes)
                    last = positions[-1:]
                    wanted = positions > 0
                    wanted[wanted] = ~rising[positions[wanted] - 1]
                    dealer.deal(positions, prefixes, wanted)
            own = seeds[slice(*np.searchsorted(seed_bytes, [byte, byte + 1]))]
            if len(own):
                before = np.concatenate([own[:1] if last is None else last, own[:-1]])
                prefixes = self.prefix(before, own)
                if last is None:
                    prefixes[0] = 0
                dealer.deal(own, prefixes, np.ones(len(own), bool))
        queues = BucketQueues(self.budget, self.spill)
        dealer = _Dealer(text, queues, self.depth)
        none = (seeds[:0], np.zeros(0, np.uint8))
        for byte in range(255, -1, -1):
            falling: list[tuple[np.ndarray, np.ndarray]] = []
            while queues.parts[byte]:
                for positions, prefixes in queues.take(byte):
                    if not falling:
                        prefixes = np.concatenate([[np.uint8(0)], prefixes[1:]])
                    falling.append((positions, prefixes))
                    wanted = positions > 0
                    wanted[wanted] = rising[positions[wanted] - 1]
                    dealer.deal(positions, prefixes, wanted)
            low_p, low_c = _joined(list(kept.take(byte))) or none
            high_p, high_c = _joined(falling) or none
            seam = self.prefix(low_p[-1:], high_p[-1:]) if len(low_p) and len(high_p) else np.zeros(1, np.uint8)
            if len(low_p):
                positions = low_p[::-1]
                prefixes = np.concatenate([seam, low_c[:0:-1]]) if len(high_p) else np.concatenate([[np.uint8(0)], low_c[:0:-1]])
                wanted = positions > 0
                wanted[wanted] = rising[positions[wanted] - 1]
                dealer.deal(positions, prefixes, wanted)
            if len(low_p) or len(high_p):
                rise = np.concatenate([seam, high_c[:0:-1]]) if len(high_p) else none[1]
                yield np.concatenate([low_p, high_p[::-1]]), np.concatenate([low_c, rise])


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray] | None:
    return (np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])) if parts else None


def _words(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, big-endian, zeros past the end (with room to look past it)."""
    padded = np.concatenate([text, np.zeros(72, np.uint8)])
    out = padded.astype(np.uint64)
    for width in (1, 2, 4):
        out[:-width] = (out[:-width] << np.uint64(8 * width)) | out[width:]
    return out
