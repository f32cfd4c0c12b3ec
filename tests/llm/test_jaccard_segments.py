"""Two sets that link and differ share a segment key, and their sketches let them link."""

import numpy as np
import pytest

from citygrid.llm import jaccard


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_key(percent):
    rng, bands, tried = np.random.default_rng(3), jaccard.Bands(percent), 0
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone = int(rng.integers(0, n // 4 + 2))
        new = rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 2))).astype(np.uint64)
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], new]))
        common = len(np.intersect1d(x, y))
        if not len(y) or common == len(x) == len(y) or 100 * common < percent * (len(x) + len(y) - common):
            continue
        tried += 1
        assert len(np.intersect1d(bands.segments(x), bands.segments(y)))
        differ = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in jaccard.sketch(x) ^ jaccard.sketch(y))
        assert differ <= len(x) + len(y) - 2 * common
    assert tried > 200


def test_empty_segments_are_rarely_sent():
    """Unlike sets of one size share nothing, or nearly so."""
    rng, bands = np.random.default_rng(5), jaccard.Bands(90)
    keys = np.concatenate([bands.segments(np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))) for _ in range(300)])
    assert len(np.unique(keys)) > 0.99 * len(keys)


def test_rows_that_repeat_an_id(spark):
    """Texts under one id are one node with the links of each; other columns may clash."""
    from tests.llm.test_llm import brute_groups

    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    near = " ".join(["new", *text(1).split()[1:]])
    rows = [(5, text(0)), (5, text(1)), (9, text(1)), (12, near), (20, text(2)), (21, text(2)), (21, text(2)), (7, None), (7, " ")]
    given = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "doc_id long, text string, n long, cls long, keys string, rep long")
    got = sorted(map(tuple, jaccard.near_groups(given, 3, 90).collect()))
    assert got == brute_groups(rows, 3, 90) and (12, 58, 5) in got
    assert jaccard.near_groups(given.limit(0), 3, 90).count() == 0


@pytest.mark.parametrize("block,few", [(8, 0), (4096, 2)])
def test_buckets_in_blocks(spark, monkeypatch, block, few):
    """One bucket, many components: sketches, pairs and sets find what brute force finds, with any block size."""
    from tests.llm.test_llm import brute_groups

    rng = np.random.default_rng(8)
    monkeypatch.setattr(jaccard, "SKETCHES", block)
    monkeypatch.setattr(jaccard, "SETS", block)
    monkeypatch.setattr(jaccard, "FEW", few)
    # every document has the same passage and nothing else that all share
    common = [f"c{i}" for i in range(40)]
    rows = []
    for k in range(60):
        own = [f"o{k // 4}x{i}" for i in range(12)]
        own[int(rng.integers(12))] = f"n{k}"
        rows.append((k, " ".join(common + own)))
    given = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_groups(given, 3, 80, rounds=1).collect())) == brute_groups(rows, 3, 80)


def test_long_text(spark):
    words = [f"w{i}" for i in range(40_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:39_000])), (3, " ".join(words[:20_000]))]
    got = dict((r[0], r[2]) for r in jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect())
    assert got == {1: 1, 2: 1, 3: 3}


def test_long_sketches_fold():
    """Sketches of different lengths compare at the shorter one and never say more than the sets."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 6000).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 6000 - 200 * k], rng.integers(0, 1 << 63, 40 * k + 1).astype(np.uint64)])) for k in range(8)] + [np.unique(base[:900]), np.unique(base[:1500])]
    held = jaccard.Sketches(np.stack([jaccard.sketch(x) for x in sets]).view(np.uint64), [jaccard.long_sketch(x) for x in sets])
    x, y = np.triu_indices(len(sets), 1)
    got = held.differ(x, y, np.full(len(x), 10**9))
    for i, j, d in zip(x, y, got):
        apart = len(np.setxor1d(sets[i], sets[j]))
        assert d <= apart and (d - apart) % 2 == 0
        if min(len(sets[i]), len(sets[j])) > jaccard.LONG and apart < 1500:
            assert d > 0.75 * apart
