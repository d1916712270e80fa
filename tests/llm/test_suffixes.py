import collections
import random

import pytest

from dualview.llm import suffixes
from .conftest import prose


def brute(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans, kept = [], bytes(b for b, g in zip(t, gone, strict=True) if not g)
        for i, g in enumerate(gone):
            if g and (i == 0 or not gone[i - 1]):
                spans.append(i)
        out.append((len(t), sum(gone), len(spans), kept))
    return out


def test_family_equals_brute_force():
    r = random.Random(5)
    length = 40
    for _ in range(25):
        base = [bytes(r.choice(b"ab c") for _ in range(r.randint(30, 200))) for _ in range(3)]
        texts = [b"".join(r.choice(base)[r.randint(0, 60) :] if r.random() < 0.6 else bytes(r.choice(b"abcd") for _ in range(50)) for _ in range(3)) for _ in range(6)]
        texts = [t for t in dict.fromkeys([*texts, b"ab" * 80]) if len(t) >= length]
        families, where = collections.defaultdict(lambda: suffixes.Family(length, 300)), collections.defaultdict(list)
        for i, t in enumerate(texts):
            for a, n, h in zip(*(x.tolist() for x in suffixes.stretches(t, length)), strict=True):
                families[h % 3].add(t[a : a + n + length - 1])
                where[h % 3].append((i, a))
        got = [[False] * (len(t) - length + 1) for t in texts]
        for k, family in families.items():
            for (i, a), flags in zip(where[k], family.met(), strict=True):
                for j, f in enumerate(flags):
                    got[i][a + j] |= bool(f)
        count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        assert got == [[count[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]


def test_segments_give_the_same(monkeypatch):
    data = prose(1, 2000).encode()
    one = suffixes.anchors(data, 60)
    monkeypatch.setattr(suffixes, "SEGMENT", 1000)
    many = suffixes.stretches(data, 60)
    assert {(s + i, h) for s, n, h in zip(*one, strict=True) for i in range(n)} == {(s + i, h) for s, n, h in zip(*many, strict=True) for i in range(n)}


@pytest.mark.parametrize("sizes", [{}, {"batch": 4000, "task": 20_000}, {"crowd": 1}])
def test_rows(spark, documents, odd, empty, sizes):
    passage = prose(9, 30)
    texts = [f"{prose(i)} {passage if i % 3 else ''} {prose(i + 50)}" for i in range(12)] + ["ab" * 300, prose(2, 80), prose(2, 80), None, "", "短い" * 60]
    for docs in (documents(texts), odd):
        rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
        got = suffixes.cut(docs, length=100, **sizes).collect()
        want = collections.Counter((k, n, m, s, kept if m else None) for (k, _), (n, m, s, kept) in zip(rows, brute([t for _, t in rows], 100), strict=True))
        assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]) if r["n_removed"] else None) for r in got) == want
    assert suffixes.cut(empty).count() == 0


def test_default_sizes_merge_levels():
    family = suffixes.Family()
    pieces = [prose(i, 200).encode() for i in range(1700)]
    assert sum(map(len, pieces)) >= suffixes.TASK
    for p in [*pieces, pieces[3][100:900]]:
        family.add(p)
    flags = list(family.met())
    assert family.merges > 0 and len(family.levels) > 1
    assert flags[-1].all() and flags[3].sum() >= len(flags[-1]) and not flags[5].any()


@pytest.mark.parametrize("size", [399, 400, 401, 700])
def test_planted_passages_around_the_bound(spark, documents, size):
    """Passages of over 50 words that repeat go from 400 bytes on, and only then."""
    passage = prose(77, 200)[:size]
    texts = [f"{prose(i, 90)}@{i % 10}{passage}{i % 10}#{prose(i + 40, 90)}" for i in range(8)]
    got = {r["doc_id"]: r for r in suffixes.cut(documents(texts)).collect()}
    want = brute([t.encode() for t in texts], 400)
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"]) for _, r in sorted(got.items())] == [w[:3] for w in want]
    assert all((w[1] >= size) == (size >= 400) for w in want)
