import random

import numpy as np
import xxhash

from synthaudit.llm.simhash import drop_near_duplicates, fingerprint, list_links, near_duplicates


def slow_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) > len(h) / 2)


def components(rows, most=3):
    fps = [slow_fingerprint(t) for _, t in rows]
    left, out = set(range(len(rows))), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            group.add(i)
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= most}
            left -= near
            todo += near
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out[i] = min(ids) if ids else None
    return fps, out


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 120)))) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1].replace(" ", "\t", 1).upper()) for i in range(20)]
    for i in range(40):                                    # near copies of one long text
        words = (rows[0][1] + " " + rows[1][1] + " " + rows[2][1]).split()
        words[rng.randrange(len(words))] = word()
        rows.append((200 + i, " ".join(words)))
    return rows + [(300, None), (301, ""), (302, " \n\t"), (None, rows[3][1]), (3, rows[3][1]), (303, "É é x " * 2000)]


def test_against_all_pairs(make_docs):
    rows = corpus()
    assert all(fingerprint(t) == slow_fingerprint(t) for _, t in rows)
    fps, comp = components(rows)
    want = sorted((str(r[0]), fp, str(comp[i])) for i, (r, fp) in enumerate(zip(rows, fps)))
    got = near_duplicates(make_docs(rows, extra=True)).collect()
    assert sorted((str(r.doc_id), r.fp & (2 ** 64 - 1), str(r.component_id)) for r in got) == want
    kept = drop_near_duplicates(make_docs(rows, extra=True))
    assert "kept_id" in kept.columns
    named = [c for i, c in comp.items() if rows[i][0] is not None]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(named))
    assert near_duplicates(make_docs([])).count() == 0


def test_long_list_has_the_same_components():
    rng = np.random.default_rng(5)
    fps = np.unique(np.uint64(0xABCD000000000000) | rng.integers(0, 1 << 12, 700).astype(np.uint64) * np.uint64(37))
    roots = []
    for limit in (10, 10_000):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        a, b = list_links(fps, (3, 4, 5, 6, 7), 3, long_list=limit)
        assert len(a) < len(fps)
        for x, y in zip(a.tolist(), b.tolist()):
            assert (x ^ y).bit_count() <= 3
            root[max(find(x), find(y))] = min(find(x), find(y))
        roots.append([find(int(f)) for f in fps])
    assert roots[0] == roots[1]
