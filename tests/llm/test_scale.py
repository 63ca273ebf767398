"""What large tables do to the text operators, on small ones: full sketches, many near copies, many files."""

import os

import numpy as np
import pytest

pytest.importorskip("tarnlake.llm")

from tarnlake.llm import common, jaccard, kneser_ney  # noqa: E402


def shingle_sets(texts):
    words = [t.split() for t in texts]
    return [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) for w in words]


def smallest_linked(sets):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(sets))]


def joined(spark, monkeypatch, texts):
    """The components, and how many rows each intermediate table had."""
    rows, save = {}, common.Stash.save

    def counted(self, df, name):
        out = save(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(common.Stash, "save", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    return [found[k] for k in range(len(texts))], rows


def near_copies(rng, n, most, base):
    out = []
    for _ in range(n):
        t = list(base)
        for k in rng.choice(len(base), rng.integers(1, most), replace=False):
            t[k] = f"x{rng.integers(0, 500)}"
        out.append(" ".join(t))
    return out


def test_chance_meetings_make_no_group(spark, monkeypatch):
    """Texts that share a few phrases, with a sketch that tells nothing: only those with links are candidates."""
    rng = np.random.default_rng(1)
    phrases = [" ".join(f"p{k}q{j}" for j in range(6)) for k in range(60)]
    texts = [" ".join([*(f"d{k}w{j}" for j in range(150)), *(phrases[p] for p in rng.choice(60, 4, replace=False))]) for k in range(120)]
    texts += [t.replace("w17 ", "y ") for t in texts[:10]]
    monkeypatch.setattr(jaccard, "SKETCH_BITS", 6)
    found, rows = joined(spark, monkeypatch, texts)
    assert found == smallest_linked(shingle_sets(texts))
    assert rows["placed_members"] <= 30


def test_blocks_of_a_large_group_are_few(spark, monkeypatch):
    """Near copies of one text, of which many link with none: how often their blocks are read."""
    texts = near_copies(np.random.default_rng(2), 400, 24, [f"w{k}" for k in range(200)])
    found, rows = joined(spark, monkeypatch, texts)
    assert found == smallest_linked(shingle_sets(texts))
    assert rows["spread"] <= 2


def test_small_limits_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = near_copies(rng, 60, 12, [f"w{k}" for k in range(100)]) + near_copies(rng, 60, 20, [f"w{k}" for k in range(40, 180)])
    texts += [" ".join(f"w{j}" for j in rng.integers(0, 6, rng.integers(1, 9))) for _ in range(60)]
    for name, value in {"GROUP_DOCS": 8, "CROSS_DOCS": 10, "SCAN_ENTRIES": 8, "PAIR_LIST": 3, "PAIR_POSTINGS": 50, "FLUSH_CLASSES": 40}.items():
        monkeypatch.setattr(jaccard, name, value)
    found, _ = joined(spark, monkeypatch, texts)
    assert found == smallest_linked(shingle_sets(texts))


def test_linked_sets_meet_often_enough():
    rng = np.random.default_rng(4)
    for _ in range(2000):
        b = int(rng.integers(2, 120))
        a = int(rng.integers(b, b * 4 // 3 + 1))
        both = -(-3 * (a + b) // 7)
        if both > b:
            continue
        x, y = set(range(a)), set(range(a - both, a - both + b))
        order = {t: k for k, t in enumerate(rng.permutation(a + b))}
        probe, index = jaccard.prefix_sizes(np.array([a, b]))
        meet = set(sorted(x, key=order.get)[: probe[0]]) & set(sorted(y, key=order.get)[: index[1]])
        assert len(meet) >= 1 + b // jaccard.HIT_SHARE >= jaccard.least_hits(b)
        assert len(meet) >= jaccard.least_hits(a)


def test_a_model_of_many_buckets_holds_few_files(spark, monkeypatch):
    """Looking up all buckets leaves no descriptor open, and a worker that may map few files gives the same scores."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(" ".join(f"w{x}" for x in rng.integers(0, 400, 60)),) for _ in range(40)], "text string")
    monkeypatch.setattr(kneser_ney, "BUCKET_BYTES", 200)
    stash = common.Stash(spark, "many-buckets")
    model = kneser_ney.fit_kneser_ney(df, stash)
    text = " ".join(f"w{x}" for x in range(400)).encode()
    h, first = kneser_ney.token_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    before = len(os.listdir("/proc/self/fd"))
    scores = model.score(h, first)
    assert model.bits >= 5
    assert len(os.listdir("/proc/self/fd")) <= before + 8
    monkeypatch.setattr(kneser_ney, "MAPPED_FILES", 2, raising=False)
    model.maps.clear()
    assert np.array_equal(model.score(h, first), scores)
    assert len(model.maps) <= 2
    stash.close()
