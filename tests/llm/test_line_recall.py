"""Recall of the line bands right above the threshold, against exact similarity."""
import time

import numpy as np

from dealflow.llm import line_dedup as L


def test_pairs_at_the_threshold_share_a_band():
    rng, made = np.random.default_rng(5), []
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    grams = lambda x: {x[i:i + L.GRAM] for i in range(max(1, len(x) - L.GRAM + 1))}
    while len(made) < 40_000:
        x = letters[rng.integers(0, 27, rng.integers(80, 200))]
        y = x.copy()
        for k in rng.integers(0, len(x), rng.integers(1, 6)):
            y[k] = letters[rng.integers(0, 27)]
        a, b = x.tobytes(), y.tobytes()
        if 0.8 <= len(grams(a) & grams(b)) / len(grams(a) | grams(b)) <= 0.85:
            made += [a, b]
    ends = np.cumsum([len(x) for x in made])
    line, value = L._grams(np.frombuffer(b"".join(made), np.uint8), np.r_[0, ends[:-1]], ends, L.GRAM)
    sign = L.signature(line, value, len(made), L.BANDS * L.ROWS).reshape(len(made), L.BANDS, L.ROWS)
    missed = (~(sign[::2] == sign[1::2]).all(2).any(1)).sum()
    assert missed <= 8, missed  # of 20,000


def plain(values, bins):
    """Least hash of each bin of one line; an empty bin looks at one place a turn until that is filled."""
    none = 2**64 - 1
    least = [min((int(v) for v in values if int(v) % bins == b), default=none) for b in range(bins)]
    out = list(least)
    for b in range(bins):
        turn = 0
        while out[b] == none:
            turn += 1
            have = least[int(L.mix(np.array([b + turn * bins], np.uint64))[0]) % bins]
            if have != none:
                out[b] = int(L.mix(np.array([have + b], np.uint64) if have + b < 2**64 else np.array([have + b - 2**64], np.uint64))[0])
    return out


def test_signatures_of_short_lines():
    """Lines of a few grams leave most bins empty; filling them costs by empty bin, not by batch and turn."""
    rng = np.random.default_rng(7)
    counts = np.r_[1, 2, 5, 200, np.ones(3000, np.int64)]
    line = np.repeat(np.arange(len(counts)), counts)
    value = rng.integers(0, 2**63, len(line), dtype=np.uint64)
    began = time.process_time()
    sign = L.signature(line, value, len(counts), 144)
    assert time.process_time() - began < 4
    for k in range(4):
        assert sign[k].tolist() == plain(value[line == k], 144)


def test_keys_of_several_lines_come_out_whole():
    """Packed band keys: every key that different lines share, with all its lines, across batches."""
    import pyarrow as pa
    base = "a line that is long enough to have many grams of its own, number {} of them all"
    texts = [base.format(i) for i in range(30)] + ["quite another line here"] + [base.format(0)]
    batches = [pa.RecordBatch.from_pydict({"text": [t]}) for t in texts]
    rows = [r for b in L._bands(L.GRAM, 6)(iter(batches)) for r in b.to_pylist()]
    rows += [r for b in L._bands(L.GRAM, 6)(iter(batches[:1])) for r in b.to_pylist()]  # another task
    rows.sort(key=lambda r: r["bucket"])
    made = pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("marks", pa.binary())]))
    got = {}
    for b in L._met(iter([made])):
        for r in b.to_pylist():
            got.setdefault(r["key"], []).append((r["mark"], r["size"]))
    want = {}
    for t in dict.fromkeys(texts):
        buf = np.frombuffer(t.encode(), np.uint8)
        ends = np.array([len(buf)])
        line, value = L._grams(buf, ends * 0, ends, L.GRAM)
        mark = int(L._line_hash(buf, ends * 0, ends)[:, 0].view(np.int64)[0])
        for key in L.band_keys(L.signature(line, value, 1, L.BANDS * L.ROWS))[0]:
            full = int(key) % 2**40 | int(key) // 2**40 % 6 << 40
            want.setdefault(full, set()).add(mark)
    want = {k: v for k, v in want.items() if len(v) > 1}
    assert want and {k: {m for m, _ in v} for k, v in got.items()} == want
    assert all(len(v) == len(want[k]) and {s for _, s in v} == {min(len(v), L.FEW + 1)} for k, v in got.items())
