"""The trie, whitening and mixing against plain versions, on small and awkward tables."""

import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from cadence.llm import mixing, prefix_trie, queries, whitening

TURNS = "conv_id long, turn long, role string, text string, place long, k1 string, depth int, n_bytes string"


def conversations() -> list[tuple]:
    """Copies, shared openings, long ones, nulls, ties, repeated rows, rows without a conversation."""
    rows = []
    for c in range(60):
        n = (c * 7) % 13 if c % 3 else 4
        opening = "hello" if c % 3 == 0 else f"o{c % 4}"
        rows += [(c, t, "user" if t % 2 else None, f"{opening} {t % 5}" if c % 2 else None if t == 3 else "é same") for t in range(n)]
    rows += [(70, t, "user", "é same" if t < 50 else f"x{t}") for t in range(120)]
    rows += [(90, None, "b", "later"), (90, None, "a", "first"), (90, None, None, None), (91, 5, "a", "tie"), (91, 5, "a", "tie"), (91, 5, "a", "no tie")]
    rows += [(None, 1, "user", "nobody"), (-7, 1, "user", "é same"), (-10, 1, None, "é same"), (2**53, 1, "user", "z" * 5000)]
    return rows


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    found = set()
    for node, ids in members.items():
        under = [n for n in members if n[: len(node)] == node]
        children = [n for n in under if len(n) == len(node) + 1]
        leaves = [n for n in under if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in under)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        found.add((min(ids), len(node), parent, len(ids), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return found


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1, "y") for r in rows], TURNS).repartition(3)


@pytest.mark.parametrize("shard_nodes", [1, 3, 40, 100_000])
def test_trie_of_rebuilt_conversations(spark, shard_nodes):
    rows = conversations()
    turns, ids = queries.rebuilt(prefix_trie.turn_rows(turns_frame(spark, rows)))
    found = [tuple(r) for r in prefix_trie.prefix_trie(turns, ids, shard_nodes).collect()]
    want = plain_trie(plain_rebuilt(rows))
    assert len(found) == len(set(found)) == len(want) and set(found) == want


def test_trie_of_plain_conversations_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CELL", 7)
    rows = conversations()
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    want = plain_trie({c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()})
    assert {tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.turn_rows(turns_frame(spark, rows)), shard_nodes=10).collect()} == want


def test_trie_of_empty_tables(spark):
    for rows in ([], [(None, 1, "a", "b")]):
        turns, ids = queries.rebuilt(prefix_trie.turn_rows(turns_frame(spark, rows)))
        assert prefix_trie.prefix_trie(turns, ids).collect() == []


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(5)
    held = np.unique(rng.integers(0, 1 << 62, (5000, 3), dtype=np.uint64), axis=0)
    table = prefix_trie.SlotTable(held)
    assert sorted(table.find(held)) == list(range(len(held)))
    assert (table.find(rng.integers(0, 1 << 62, (5000, 3), dtype=np.uint64)) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.zeros((2, 3), dtype=np.uint64))


VECTORS = "vec_id long, embedding array<float>, label int, v int, whitened string, n string"


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", "y") for i, v in rows], VECTORS).repartition(3)


def vectors():
    rng = np.random.default_rng(3)
    made = (rng.normal(size=(400, 6)) * [3, 1, 0.5, 0.2, 0.1, 40] + [0, 5, -300, 0, 0, 0]).astype(np.float32)
    rows = [(i % 390, v.tolist()) for i, v in enumerate(made)] + [(None, made[0].tolist())] * 50
    bad = [None, [], [1.0], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    return rows, rows + [(1000 + i, v) for i, v in enumerate(bad)]


def test_whitening(spark):
    kept, rows = vectors()
    found = whitening.whiten(vectors_frame(spark, rows), components=4).collect()
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in kept])
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    assert sorted((r.vec_id, int(r.deviation)) for r in found if r.vec_id is not None) == sorted(
        (i, sum((n * int(c) - s) ** 2 for c, s in zip(row, sums))) for (i, _), row in zip(kept, x) if i is not None
    )
    centre = x - x.mean(axis=0)
    values, directions = np.linalg.eigh(centre.T @ centre / n)
    values, directions = values[::-1][:4], directions[:, ::-1][:, :4]
    want = centre @ directions / np.sqrt(values)
    got = {r.deviation: r.whitened for r in found}
    dev = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert np.allclose(np.abs([got[d] for d in dev]), np.abs(want), atol=1e-7)
    assert {r.n for r in found} == {n} and len(found) == n
    assert np.allclose(found[0].explained, values / np.trace(centre.T @ centre / n))
    assert 0 <= found[0].identity_error < 1e-9


def test_cross_products_are_exact():
    rng = np.random.default_rng(9)
    for x in (rng.integers(-5, 6, (130, 3)), rng.integers(-(1 << 61), 1 << 61, (65, 3)), np.full((10, 3), 7)):
        ones = np.column_stack([x, np.ones(len(x), dtype=np.int64)]).astype(object)
        assert (whitening.cross_products(x) == ones.T @ ones).all()


def test_whitening_of_large_entries_and_empty_tables(spark):
    assert whitening.whiten(vectors_frame(spark, [])).collect() == []
    assert whitening.whiten(vectors_frame(spark, [(1, None), (2, [])])).collect() == []
    rows = [(i, [float(i) * 1e30, -1e12 * i, 3.0]) for i in range(5)]
    found = {r.vec_id: r for r in whitening.whiten(vectors_frame(spark, rows), components=8).collect()}
    x = [[int(np.clip(np.floor(1024 * float(np.float32(c))), -(2**52), 2**52)) + 100000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    assert {i: int(r.deviation) for i, r in found.items()} == {i: sum((5 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    # The constant dimension has no variance.
    assert all(len(r.whitened) == 3 and r.whitened[2] is None for r in found.values())


def plain_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), Fraction(3, 2) * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            break
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        more = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not more:
            break
        capped |= more
    return {s: Fraction(2 * sizes[s]) if s in capped else level * weight[s] for s in order}


def mix_rows():
    texts = [(i, "w " * ((i * 37) % 60), f"s{i % 7}" if i % 3 else "hot") for i in range(300)]
    texts += [(i, "long " * 9000 if i == 400 else "a\x0bb", None) for i in range(400, 420)] + [(500, None, ""), (501, "", "none"), (502, " \t", "none")]
    return texts + [(None, "a b c", "nameless")] * 9 + [(7, "same row", "twice")] * 5 + [(600, "one two", "Z"), (601, "é", "é")]



def test_mixing(spark):
    rows = mix_rows()
    docs = spark.createDataFrame([(i, t, s, 1, 2, 3) for i, t, s in rows], "doc_id long, text string, source string, size int, target int, h int").repartition(3)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = plain_targets(sizes), Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - float(want[r.source])) < 1e-6
        n = r.copies * r.size + r.part
        assert 0 <= n <= 2 * r.size and 0 <= r.part <= r.size
        taken[r.source] += n
    many = Counter(s for _, _, s in rows)
    for s, goal in want.items():
        # To the word, but for rows that share one hash.
        assert abs(taken[s] - goal) <= (1 if s not in ("nameless", "twice") else many[s]), s
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mixing_is_nested(spark):
    docs = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string")
    less = {r.doc_id: r.copies for r in mixing.mix(docs, share=0.4).collect() if r.doc_id is not None}
    more = {r.doc_id: r.copies for r in mixing.mix(docs, share=0.7).collect() if r.doc_id is not None}
    assert all(more[i] >= n for i, n in less.items()) and sum(more.values()) > sum(less.values())


def test_mixing_of_empty_tables(spark):
    kinds = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kinds)).collect() == []
    found = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], kinds)).collect()
    assert all((r.size, r.source_size, r.target, r.copies, r.part) == (0, 0, 0.0, 0, 0) for r in found) and len(found) == 2


def test_mixing_needs_no_python(spark):
    docs = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
