import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from voltlake.llm import packed


def home(tables, blocks):
    """Per flush what comes back of all blocks: {(record, token): count}."""
    table = pa.Table.from_batches(tables)
    back = pa.concat_tables([packed.shared(table.filter(pc.equal(table["block"], b))) for b in range(blocks)])
    out = []
    for flush in pc.unique(back["flush"]).to_pylist():
        records, idx, tok, n = packed.at_home(back.filter(pc.equal(back["flush"], flush)), 12)
        assert (np.diff(idx.astype(int)) >= 0).all()
        found = {(records[i].tobytes(), t): c for i, t, c in zip(idx.tolist(), tok.tolist(), n.tolist(), strict=True)}
        assert len(found) == len(tok)
        out.append((set(records.tolist()), found))
    return out


def test_counts_against_brute_force():
    """Three flushes with copies of sets, unique, shared and hot tokens."""
    rng = np.random.default_rng(0)
    blocks = 5
    flush, tables, holders, own = packed.Flush(blocks), [], {}, []
    for number in range(3):
        own.append({})
        for d in range(200):
            tokens = np.unique(np.concatenate([rng.integers(0, 2**48, 30).astype(np.uint64), rng.choice(np.arange(1, 400, dtype=np.uint64) * np.uint64(2**39), 10), np.array([7 * 2**40], np.uint64)]))
            record = (number * 150 + d).to_bytes(12, "little") if d < 150 else (2000 + d).to_bytes(12, "little")
            if d >= 150:  # copies in all flushes
                tokens = np.unique(np.random.default_rng(d).integers(0, 2**48, 40).astype(np.uint64))
            flush.add(record, tokens)
            flush.add(record, tokens)
            own[-1][record] = tokens.tolist()
            for t in tokens.tolist():
                holders.setdefault(t, set()).add(record)
        tables.append(flush.rows())
    for (records, got), sets in zip(home(tables, blocks), own, strict=True):
        want = {(r, t): min(packed.HOT, len(holders[t])) for r, tokens in sets.items() for t in tokens if len(holders[t]) > 1}
        assert {r for r, _ in got} <= {r for r in sets} and len(records) == len(sets)
        assert set(got) == set(want)
        settled = {t for t in holders if sum(t in x for x in sets.values()) >= 25}
        assert all(got[k] == want[k] or got[k] == packed.HOT for k in want) and all(got[k] == packed.HOT for k in want if k[1] in settled)
    assert all((np.array([len(holders[t]) for _, t in got]) > 1).all() for _, got in home(tables, blocks))


def test_hot_tokens_are_spread_and_marked():
    flush = packed.Flush(8)
    for d in range(500):
        flush.add(d.to_bytes(12, "little"), np.array([5, 1000 + d], np.uint64))
    rows = flush.rows().to_pylist()
    assert len({r["block"] for r in rows if r["kind"] == packed.SETTLED}) == 8
    assert sum(r["kind"] == packed.MARKER for r in rows) == 1


def test_few_long_sets_settle_what_most_hold():
    flush = packed.Flush(8)
    for d in range(40):
        flush.add(d.to_bytes(12, "little"), np.array([5, 1000 + d], np.uint64))
    rows = flush.rows().to_pylist()
    plain = [packed.from_gaps(r["tok"], r["width"]).tolist() for r in rows if r["kind"] == packed.PLAIN]
    assert 5 not in sum(plain, []) and sum(r["kind"] == packed.MARKER for r in rows) == 1


def test_bytes_a_pair_do_not_grow_with_blocks():
    rng = np.random.default_rng(1)
    sizes = {}
    for blocks in (12, 240, 2400):
        flush = packed.Flush(blocks)
        for d in range(2000):
            flush.add(rng.bytes(16), np.unique(rng.integers(0, 2**48, 200).astype(np.uint64)))
        sizes[blocks] = flush.rows().nbytes / 400_000
    assert sizes[12] < 8 and sizes[240] < 13 and sizes[2400] < 14, sizes


def test_nothing():
    assert packed.Flush(3).rows() is None


def test_more_sets_than_16_bits_hold():
    flush, tables = packed.Flush(1), []
    for d in range(140_000):
        flush.add(d.to_bytes(12, "little"), np.array([d // 2 + 1], np.uint64))
        if flush.full():
            tables.append(flush.rows())
    tables.append(flush.rows())
    got = {k: c for _, found in home(tables, 1) for k, c in found.items()}
    assert len(got) == 140_000 and set(got.values()) == {2}
    assert all(int.from_bytes(r, "little") // 2 + 1 == t for r, t in list(got)[::997])
