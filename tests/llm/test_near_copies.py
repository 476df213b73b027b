"""The near-duplicate stage against brute-force Jaccard similarity of word shingles."""

import random

import corpus_pipeline as P
import numpy as np
import pytest

from quire.llm import _bytes, _lists, _spark, near_copies

from . import brute


def shingles(text, n=5):
    w = brute.spaced((text or "").translate(brute.LOW))
    return frozenset([tuple(w[k : k + n]) for k in range(len(w) - n + 1)] or ([tuple(w)] if w else []))


def kept(rows):
    """Indexes of the rows that stay: of each component the least id, nulls last."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * both >= 4 * either:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return sorted(min(ids, key=lambda i: (i is None, i or 0)) for ids in groups.values())


def edited():
    """Copies with some words changed, on both sides of 0.8, chains of copies, and a large group."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = []
    for n in [5, 6, 8, 9, 10, 12, 30, 60, 60, 200, 200, 400, 400, 400, 1500]:
        base = [word() for _ in range(n)]
        texts.append(base)
        for share in [0.0, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.05, 0.1]:
            texts.append([word() if r.random() < share else w for w in base])
        texts += [base + [word()], base[1:], base[: n - n // 10], base[: n - n // 5], base + [word() for _ in range(n // 4)], [w.upper() for w in base]]
    base = [word() for _ in range(100)]
    texts += [[*base[:k], word(), *base[k + 1 :]] for k in range(100)]
    passage = [word() for _ in range(40)]
    texts += [passage + [word() for _ in range(k)] for k in range(0, 60, 3)]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)]


def stage(spark, rows, sf_dir):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return [(r.doc_id, r.text) for r in P.near_dedup(spark, frame, sf_dir).collect()]


@pytest.mark.parametrize(("members", "tile", "long"), [(512, 256, 1024), (3, 4, 16)])
def test_edited_copies(spark, sf_dir, members, tile, long, monkeypatch):
    """The same rows stay where components are compared in one place and where they are spread over tasks."""
    monkeypatch.setattr(near_copies, "MEMBERS", members)
    monkeypatch.setattr(near_copies, "TILE", tile)
    monkeypatch.setattr(_lists, "LONG", long)
    rows = edited()
    want = kept(rows)
    assert 20 < len(want) < len(rows)
    assert sorted(i for i, _ in stage(spark, rows, sf_dir)) == want


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(i for i, _ in stage(spark, rows, sf_dir)) == kept(rows)


def test_edge_rows(spark, rows, sf_dir):
    key = lambda i: (i is None, i or 0)
    assert sorted((i for i, _ in stage(spark, rows, sf_dir)), key=key) == sorted(kept_nulls(rows), key=key)


def kept_nulls(rows):
    """``kept`` for ids that may be null, which don't sort."""
    none = 10**9
    return [None if i == none else i for i in kept([(none if i is None else i, t) for i, t in rows])]


def test_empty(spark, sf_dir):
    assert stage(spark, [], sf_dir) == []


def sets_at(r, whole, both, n):
    """n pairs of sets of hashes, ``both`` of whose ``whole`` members are shared, the others dealt to either."""
    for _ in range(n):
        every = np.array([r.getrandbits(64) for _ in range(whole)], np.uint64)
        cut = both + (whole - both) // 2
        yield np.sort(every[:cut]), np.sort(np.append(every[:both], every[cut:]))


def test_candidates_come_from_simhash(spark):
    """Fingerprints are majorities of bits, members share a list for each positional byte they have in common, and
    pairs at 0.8, of few shingles and many, all meet and are near; unrelated ones don't."""
    r = random.Random(9)
    pairs = [p for whole, both in ((5, 4), (10, 8), (100, 80), (700, 560)) for p in sets_at(r, whole, both, 200)]
    sets = [x for p in pairs for x in p]
    prints = near_copies.fingerprints(sets)
    for k in (0, 1, 500, 1599):
        want = []
        for salt in near_copies._SALTS:
            votes = [int(h) for h in _bytes.mix(sets[k] ^ salt)]
            want.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in votes) > len(votes)))
        assert prints[k].tolist() == want
    classes = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(prints)], "key long, sketch binary")
    rows = near_copies.postings(classes).orderBy("list").collect()
    held = {}
    for x in rows:
        held.setdefault(x["member"], set()).add(x["list"])
    shared = (prints[::2].view(np.uint8) == prints[1::2].view(np.uint8)).sum(axis=1)
    assert [len(held[2 * k] & held[2 * k + 1]) for k in range(len(pairs))] == shared.tolist()
    keys, members = (np.array([x[c] for x in rows], np.int64) for c in ("list", "member"))
    sketch = np.frombuffer(b"".join(x["sketch"] for x in rows), np.uint64).reshape(-1, 4)
    u, v = near_copies.links(keys, members.view(np.uint64), sketch)
    found = set(zip(u.tolist(), v.tolist(), strict=True))
    assert found == {(2 * k + 1, 2 * k) for k in range(len(pairs))}


def test_long_lists_are_split(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(near_copies, "LISTS", 1)
    monkeypatch.setattr(near_copies, "FEW", 3)
    monkeypatch.setattr(_lists, "LONG", 20)
    rows = edited()
    assert sorted(i for i, _ in stage(spark, rows, sf_dir)) == kept(rows)


def test_a_link_is_not_found_in_every_list(spark, sf_dir, monkeypatch):
    """The members of a group of near copies share most of the 64 lists; few of these join them again."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base, n = [word() for _ in range(200)], 150
    texts = [[*base[:k], word(), *base[k + 1 :]] for k in range(n)] + [[word() for _ in range(30)] for _ in range(20)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    real, made = _lists.met, []

    def met(*args, **more):
        links = _spark.written(real(*args, **more), "links")
        made.append(links.count())
        return links

    monkeypatch.setattr(_lists, "met", met)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert sorted(i for i, _ in stage(spark, rows, sf_dir)) == kept(rows) == [0, *range(n, n + 20)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert n <= sum(made) <= 12 * n


def test_rows_of_one_member_are_joined(spark):
    """Each row of a member may link it to another, in long lists too, where equal rows go; its own rows make no link."""
    r = random.Random(13)
    own, other, far = (np.array([r.getrandbits(64) for _ in range(4)], np.uint64) for _ in range(3))
    near = other ^ np.uint64(7 << 32)
    keys, members = np.zeros(4, np.int64), np.array([5, 5, 9, 11], np.uint64)
    u, v = near_copies.links(keys, members, np.stack([own, other, near, far]))
    assert list(zip(u.tolist(), v.tolist(), strict=True)) == [(9, 5)]
    rows = [(0, int(m), bytearray(x.tobytes())) for m, x in zip(members, (own, other, near, far), strict=True) for _ in range(5)]
    postings = spark.createDataFrame(rows, "list long, member long, sketch binary")
    compare = lambda keys, members, data: near_copies.links(keys, members, np.frombuffer(data, np.uint64).reshape(-1, 4))
    found = _lists.met(postings, compare, "sketch", 3, True).collect()
    assert {(x.u, x.v) for x in found} == {(9, 5)}
    assert _lists.dealt(postings, 3, True).distinct().count() == _lists.dealt(postings, 3, True).count()


def test_links_of_long_lists_grow_with_their_members(spark, monkeypatch):
    """Where lists are split, each member would meet the others in as many tiles, so links grew with the square."""
    r = random.Random(17)
    base = [r.getrandbits(63) for _ in range(200)]
    sets = [np.sort(np.array([*base[:k], r.getrandbits(63), *base[k + 1 :]], np.uint64)) for k in range(160)]
    classes = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(near_copies.fingerprints(sets))], "key long, sketch binary")
    real, made = _lists.met, []

    def met(*args, **more):
        links = _spark.written(real(*args, **more), "links")
        made.append(links.count())
        return links

    monkeypatch.setattr(_lists, "met", met)
    monkeypatch.setattr(near_copies, "LISTS", 1)
    monkeypatch.setattr(_lists, "LONG", 10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert sorted((x.node, x.root) for x in near_copies.candidates(_spark.written(classes, "classes")).collect()) == [(k, 0) for k in range(1, 160)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(made) <= 12 * 160
