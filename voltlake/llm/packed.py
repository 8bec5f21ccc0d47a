"""Packed postings: (token, set) pairs travel as arrays, a constant number of bytes each, instead of rows.

Tokens are 48-bit numbers. A task's pairs are cut into flushes; in each, the pairs are sorted by token and dealt
to token blocks. A row holds a block's share of a flush: per pair the token's distance to the one before (32 bits where
that fits) and its set (16 bits), and per set in that share its number in the flush with 48 bits of its digest.
The sets' own records stay in one row of their flush, and what a block finds out goes back to the flush, not
to each set, so bytes a pair don't grow with the number of blocks: 6 to 12.
(A flush has a row for each block. With the sizes below shares keep a hundred pairs up to some 2 * 10^10 pairs,
beyond which flushes and blocks should be made larger.)

A token held by a large part of a flush's sets is frequent in all; its pairs needn't meet those of other
flushes to know that. They go straight home as settled, and the token's own block gets a marker. So a token that all
sets hold sends a block one number a flush.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

HOT, FLUSH_PAIRS, FLUSH_SETS = 64, 1_000_000, 60_000
HOT_LEAST, HOT_PART = 8, 8  # settled: held by HOT sets of a flush, or by an eighth of its sets where these are fewer
TOKEN_BITS = 48
SCHEMA = "block int, flush long, kind int, sets binary, idx binary, tok binary, width int"
RETURNED = "flush long, kind int, sets binary, idx binary, tok binary, width int, n binary"
PLAIN, SETTLED, MARKER, HOME = 0, 1, 2, 3
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_LOW48 = np.uint64((1 << 48) - 1)


def arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(cols, kinds, strict=True)], names=list(names))


class Flush:
    """Gathers (set record, sorted distinct tokens) and gives rows of SCHEMA. ``source`` numbers the task, the same at each attempt."""

    def __init__(self, blocks: int, source: int = 0):
        self.blocks, self.number = blocks, source << 32
        self.clear()

    def clear(self) -> None:
        self.records: list[bytes] = []
        self.tokens: list[np.ndarray] = []
        self.seen: set[bytes] = set()
        self.pairs = 0
        self.number += 1

    def add(self, record: bytes, tokens: np.ndarray) -> None:
        """The record stands for the set's content and begins with its digest; copies within a flush travel once."""
        if record not in self.seen:
            self.seen.add(record)
            self.records.append(record)
            self.tokens.append(tokens)
            self.pairs += len(tokens)

    def full(self) -> bool:
        return self.pairs >= FLUSH_PAIRS or len(self.records) >= FLUSH_SETS

    def rows(self) -> pa.RecordBatch | None:
        if not self.pairs:
            self.clear()
            return None
        tok = np.concatenate(self.tokens)
        idx = np.repeat(np.arange(len(self.tokens), dtype=np.uint16), [len(t) for t in self.tokens])
        order = np.argsort(tok, kind="stable")
        tok, idx = tok[order], idx[order]
        first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
        many = np.diff(np.append(first, len(tok)))
        hot = np.repeat(many >= min(HOT, max(HOT_LEAST, len(self.records) // HOT_PART)), many)
        self.named = np.array([int.from_bytes(r[:6], "little") for r in self.records], np.uint64) | np.arange(len(self.records), dtype=np.uint64) << np.uint64(48)
        out: list[tuple] = [(self.number % self.blocks, self.number, HOME, b"".join(self.records), b"", b"", 8)]
        self._deal(tok[~hot], idx[~hot], block_of(tok[~hot], self.blocks), PLAIN, out)
        if hot.any():
            spread = (idx[hot].astype(np.int64) + self.number) % self.blocks
            by = np.argsort(spread, kind="stable")
            self._deal(tok[hot][by], idx[hot][by], spread[by], SETTLED, out)
            marks = np.unique(tok[hot])
            for b, own in runs(block_of(marks, self.blocks)):
                out.append((b, self.number, MARKER, b"", b"", marks[own].astype("<u8").tobytes(), 8))
        self.clear()
        return arrow(out, SCHEMA)

    def _deal(self, tok, idx, block, kind, out) -> None:
        for number, own in runs(block):
            used, local = np.unique(idx[own], return_inverse=True)
            data, width = gaps(tok[own])
            few = 8 * len(used) + 2 * len(local) < 8 * len(local)  # else a name for each pair
            names = self.named[used] if few else self.named[used][local]
            out.append((number, self.number, kind, names.astype("<u8").tobytes(), local.astype("<u2").tobytes() if few else b"", data, width))


def gaps(tok: np.ndarray) -> tuple[bytes, int]:
    """Sorted tokens as the first and distances of as many bytes (4 at least) as the widest needs."""
    steps = np.diff(tok)
    width = max(4, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 4
    narrow = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width] if width > 4 else steps.astype("<u4")
    return tok[:1].astype("<u8").tobytes() + narrow.tobytes(), width


def from_gaps(data, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    steps = np.zeros(((len(raw) - 8) // width + 1, 8), np.uint8)
    steps[0] = raw[:8]
    steps[1:, :width] = raw[8:].reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _named(sets, idx) -> np.ndarray:
    """Of each pair its set's number in the flush and digest."""
    sets, idx = np.frombuffer(sets, "<u8"), np.frombuffer(idx, "<u2")
    return sets[idx] if len(idx) else sets


def runs(values: np.ndarray):
    """(value, slice) of each run of equal values."""
    if len(values):
        cuts = np.flatnonzero(np.diff(values)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
            yield int(values[a]), slice(a, b)


def block_of(tok: np.ndarray, blocks: int) -> np.ndarray:
    return ((tok >> np.uint64(TOKEN_BITS - 24)).astype(np.int64) * blocks) >> 24


def shared(rows: pa.Table) -> pa.Table:
    """Of a token block: the pairs whose token two sets hold at least, back to their flushes with the number of sets (at most HOT)."""
    out, marks, plain, total = [], [np.zeros(0, np.uint64)], [], 0
    for batch in rows.select([f.split()[0] for f in SCHEMA.split(", ")]).to_batches():
        _, flush, kind, sets, idx, tok, width = (batch.column(k) for k in range(7))
        for r in range(batch.num_rows):
            which, data = kind[r].as_py(), tok[r].as_buffer()
            if which == MARKER:
                marks.append(np.frombuffer(data, "<u8"))
            elif which == HOME:
                out.append((flush[r].as_py(), HOME, sets[r].as_py(), b"", b"", 8, b""))
            elif which == SETTLED:
                number = (_named(sets[r].as_buffer(), idx[r].as_buffer()) >> np.uint64(48)).astype("<u2")
                out.append((flush[r].as_py(), PLAIN, b"", number.tobytes(), tok[r].as_py(), width[r].as_py(), np.full(len(number), HOT, np.uint8).tobytes()))
            else:
                plain.append((flush[r].as_py(), sets[r].as_buffer(), idx[r].as_buffer(), data, width[r].as_py()))
                total += (data.size - 8) // width[r].as_py() + 1
    tok, named = np.empty(total, np.uint64), np.empty(total, np.uint64)  # filled in place
    bounds = np.zeros(len(plain) + 1, np.int64)
    for r, (_, sets, idx, data, step) in enumerate(plain):
        own = from_gaps(data, step)
        a, b = bounds[r], bounds[r] + len(own)
        tok[a:b] = own
        named[a:b] = _named(sets, idx)
        bounds[r + 1] = b
    if total:
        counts = _counts(tok, named, np.unique(np.concatenate(marks)))
        for r, row in enumerate(plain):
            own = np.flatnonzero(counts[bounds[r] : bounds[r + 1]] > 1) + bounds[r]
            if len(own):
                data, step = gaps(tok[own])
                out.append((row[0], PLAIN, b"", (named[own] >> np.uint64(48)).astype("<u2").tobytes(), data, step, counts[own].tobytes()))
    return pa.Table.from_batches([arrow(out, RETURNED)])


def _counts(tok: np.ndarray, named: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Of each pair, the number of distinct sets that hold its token: flushes may hold copies of a set."""
    order = np.argsort(named & _LOW48)
    order = order[np.argsort(tok[order], kind="stable")]
    tok = tok[order]
    new = np.append(True, tok[1:] != tok[:-1])
    digest = (named & _LOW48)[order]
    other = new | np.append(True, digest[1:] != digest[:-1])
    del digest
    first = np.flatnonzero(new)
    n = np.minimum(np.add.reduceat(other, first, dtype=np.int32), HOT).astype(np.uint8)
    at = np.searchsorted(tok[first], marks)
    at = at[at < len(first)]
    n[at[np.isin(tok[first[at]], marks)]] = HOT
    out = np.empty(len(tok), np.uint8)
    out[order] = np.repeat(n, np.diff(np.append(first, len(tok))))
    return out


def at_home(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a flush: the records of its sets, and number, token and count of its shared pairs, by number."""
    records, idx, tok, n = np.zeros(0, f"V{width}"), [np.zeros(0, np.uint16)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for batch in rows.select([f.split()[0] for f in RETURNED.split(", ")]).to_batches():
        for r in range(batch.num_rows):
            if batch.column(1)[r].as_py() == HOME:
                records = np.frombuffer(batch.column(2)[r].as_buffer(), f"V{width}")
            else:
                idx.append(np.frombuffer(batch.column(3)[r].as_buffer(), "<u2"))
                tok.append(from_gaps(batch.column(4)[r].as_buffer(), batch.column(5)[r].as_py()))
                n.append(np.frombuffer(batch.column(6)[r].as_buffer(), np.uint8))
    idx, tok, n = np.concatenate(idx), np.concatenate(tok), np.concatenate(n)
    order = np.argsort(idx, kind="stable")
    return records, idx[order], tok[order], n[order]


_libc = ctypes.CDLL(None)


def give_back() -> None:
    """Returns to the system what a task no longer holds: idle Python workers count beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit hashes."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^n and their inverses modulo 2^64."""
    if not _powers or len(_powers["up"]) <= n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, 1 << 16) + 1, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = sum of values[k] * base^k over i <= k < j; times base^-i it is the hash of values[i:j]."""
    up, _ = powers(len(values))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
