"""N-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from annolith.llm import near_dup as N
from annolith.llm.components import components, restored, shuffled


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for r, (d, _) in zip(root, rows, strict=True):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(s), least[r] if s else d) for (d, _), s, r in zip(rows, sets, root, strict=True)), key=str)


def corpus(seed, families=12, members=6):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(families):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 7, 20, 60, 75, 150, 500]))]
        for m in range(members):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 60)) if m else 0):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            if rnd.random() < 0.2:
                w = w[: max(1, int(len(w) * 0.9))]
            rows.append(" ".join(w))
    rnd.shuffle(rows)
    return list(enumerate(rows))


SPECIAL = [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one  TWO"), (1004, "one two"), (None, "one two"), (None, None), (1005, "É two"), (1006, "é two")]


@pytest.mark.parametrize(("size", "percent", "block_sets", "many"), [(4, 85, 4000, 64), (5, 80, 3, 2), (3, 90, 7, 5)])
def test_matches_brute_force(spark, size, percent, block_sets, many):
    rows = corpus(size) + SPECIAL
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string").repartition(3)
    got = N.near_duplicates(docs, size=size, percent=percent, block_sets=block_sets, many=many)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, size, percent)


def test_large_blocks_with_few_samples(spark, monkeypatch):
    """A family in parts whose samples hardly join, and chains across parts."""
    monkeypatch.setattr(N, "SAMPLE", 1)
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = [" ".join(base)]
    for _ in range(40):  # each a change of one before: some are far from the first
        w = rows[rnd.randrange(max(0, len(rows) - 4), len(rows))].split()
        w[rnd.randrange(len(w))] = f"n{rnd.randrange(9)}"
        rows.append(" ".join(w))
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = N.near_duplicates(docs, size=4, percent=85, block_sets=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, 85)


def chained(n=60, family=14):
    """Texts that share each half of their words with another one, and a family of near copies in the same chain."""
    half = lambda i: [f"h{i}x{k}" for k in range(30)]
    own = lambda i: [f"o{i}x{k}" for k in range(30)]
    rows = [" ".join([*half(i), *own(i), *half(i + 1)]) for i in range(n)]
    for i in range(family):
        w = [*half(n), *own(n), *half(n + 1)]
        w[3 * i] = "changed"
        rows.append(" ".join(w))
    return list(enumerate(rows))


@pytest.mark.parametrize("percent", [80, 90])
def test_rare_shingles_connect_all_links(spark, percent):
    rows = corpus(11, 20, 8) + [(1000 + i, t) for i, t in chained()]
    keys = {d: N.set_key(s) for (d, t), s in zip(rows, N.shingle_sets(pa.array([t for _, t in rows]), 4), strict=True)}
    sets = {keys[d]: s for (d, t), s in zip(rows, N.shingle_sets(pa.array([t for _, t in rows]), 4), strict=True)}
    table = spark.createDataFrame([(5, k, bytearray(s.tobytes())) for k, s in sets.items()], "root long, vertex long, shingles binary").repartition(3)
    found = {r.vertex: r.root for r in components(N._rare_shingles(table, percent)).collect()}
    want = brute(rows, 4, percent)
    family = {}
    for d, _, c in want:
        family.setdefault(c, set()).add(keys[d])
    for members in family.values():
        if len(members) > 1:
            assert len({found[k] for k in members}) == 1
    chain = [keys[1000 + i] for i in range(60)]
    assert not set(chain) & set(found)  # a third of their shingles are their own


def test_sets_chained_by_passages_are_not_compared_with_all(spark, monkeypatch):
    """One block by its signatures, but only the near copies in it are left to meet all others."""
    rows = chained()
    monkeypatch.setattr(N, "_candidate_edges", lambda docs, size, *_: spark.createDataFrame([(N.set_key(s), 0) for s in N.shingle_sets(pa.array([t for _, t in rows]), size)], "a long, b long"))
    met, large = [], N._large_links

    def counted(sets, *more):
        met.append(sets.count())
        return large(sets, *more)

    monkeypatch.setattr(N, "_large_links", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block_sets, most in ((20, []), (5, [14])):
        met.clear()
        got = N.near_duplicates(docs, size=4, percent=80, block_sets=block_sets)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, 80)
        assert met == most


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keep_one_keeps_all_columns(spark):
    rows = corpus(1, 4, 4) + SPECIAL
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    want = [d for d, _, c in brute(rows, 5, 80) if d == c]
    assert sorted({r.doc_id for r in kept.collect()}, key=str) == sorted(set(want), key=str)


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_signature(percent):
    rnd = np.random.default_rng(5)
    dealer = N.Dealer(percent)
    for n in [1, 2, 4, 5, 6, 7, 12, 20, 22, 24, 25, 27, 38, 39, 40, 62, 74, 101, 130, 900, 3000]:
        for _ in range(40):
            a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
            both = N.needed(len(a), len(a), percent)
            new = np.unique(rnd.integers(0, 2**63, len(a) - both).astype(np.uint64))
            more = a[rnd.permutation(len(a))[: -(-percent * len(a) // 100)]]
            for b in (np.unique(np.concatenate([a[rnd.permutation(len(a))[:both]], new])), np.sort(more)):
                inter = np.intersect1d(a, b).size
                if inter < max(len(a), len(b)) and 100 * inter >= percent * (len(a) + len(b) - inter):
                    both = np.intersect1d(dealer.signatures(a), dealer.signatures(b))
                    assert len(both) >= N.AGREE or (both & np.uint64(1)).any()


def test_sets_meet_through_outsiders_of_several_flushes(spark, monkeypatch):
    texts = [f"t{i}" for i in range(8)]
    key = {t: N.set_key(s) for t, s in zip(texts, N.shingle_sets(pa.array(texts), 4), strict=True)}
    *outsiders, p, q = sorted(texts, key=key.get)  # roots are the smallest keys
    # two sets agree on three signatures, each of which is wide in its task by another outsider, which has no more of them
    held = {key[p]: [2, 4, 6], key[q]: [2, 4, 6]} | {key[t]: [2 * (i % 3) + 2] for i, t in enumerate(outsiders)}

    class Given:
        def __init__(self, percent):
            self.held = held

        def signatures(self, s):
            return np.array(self.held[N.set_key(s)], dtype=np.uint64)

    monkeypatch.setattr(N, "Dealer", Given)
    for tasks in ([*outsiders[:3], p, *outsiders[3:], q], [*outsiders[3:], p, *outsiders[:3], q]):
        docs = spark.createDataFrame(spark.sparkContext.parallelize([(t,) for t in tasks], 2), "text string")
        root = {r.vertex: r.root for r in components(N._candidate_edges(docs, 4, 85, 2, 1)).collect()}
        assert root[key[p]] == root[key[q]]


def test_tree_misses_nothing():
    rnd = np.random.default_rng(6)
    sets = [np.unique(rnd.integers(0, 400, rnd.integers(50, 400)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(300)]
    points, sizes = N.count_vectors(sets), np.array([len(s) for s in sets])
    tree = N.CountVectorTree(points, sizes)
    for i in range(0, 300, 7):
        want = [j for j in range(300) if np.minimum(points[i], points[j]).sum() >= N.needed(sizes[i], sizes[j], 60)]
        assert sorted(tree.search(points[i], int(sizes[i]), 60).tolist()) == want


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(60), 100 + rnd.randrange(60)) for _ in range(45)] + [(7, None), (300, 300)] + [(500, 501 + i) for i in range(50)]
    root = {}
    for a, b in edges:
        if b is not None:
            ra, rb = root.setdefault(a, a), root.setdefault(b, b)
            root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.vertex: r.root for r in got.collect()} == root
    for alone, names in ((6, 3), (25, 1000)):  # several rounds, names by joins and by broadcasts
        got = components(spark.createDataFrame(edges, "a long, b long").repartition(5), alone=alone, names=names).collect()
        assert len(got) == len(root)
        assert {r.vertex: r.root for r in got} == root
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_percent_out_of_range(spark):
    with pytest.raises(ValueError, match="percent"):
        N.near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"), percent=50)


def test_order_of_a_round_has_an_inverse():
    x = np.array([0, 1, -1, 2**62, -(2**63), 12345678901], dtype=np.int64)
    for turn in (1, 2, 9):
        assert np.array_equal(restored(shuffled(x, turn), turn), x)
