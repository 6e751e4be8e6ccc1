import random

import numpy as np
import xxhash

from framesift.llm import simhash


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_plain_one():
    rng = random.Random(0)
    texts = [None, "", "A", "A b", " ".join(rng.choice(["ÄB", "cd", "EF", "g"]) for _ in range(1200)), "x\x0by\x1fz q \n w"]
    for t in texts:
        assert simhash.fingerprint(t) == plain(t)


def test_blocks_cover_any_three_bytes():
    blocks = [set(b) for b in simhash.BLOCKS]
    assert len(blocks) == 14
    for a in range(8):
        for b in range(a):
            for c in range(b):
                assert any(not {a, b, c} & x for x in blocks)


def test_links_join_what_all_pairs_join(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set(base.tolist()) | {0, 1, 7, 15, (1 << 64) - 1}
    for x in base[:20].tolist():
        for _ in range(40):  # chains of near copies, and one list longer than a part
            x ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))
            fps.add(x)
    hub = int(base[0])
    fps |= {hub ^ (1 << a) ^ (1 << b) for a in range(32) for b in range(a)}
    fps = np.array(sorted(fps), np.uint64)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= 3):
            a, b = sorted((root(i), root(int(j))))
            parent[b] = a
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.near_links(frame, part=64).collect()
    assert all(int(np.uint64(r.a & (2**64 - 1)) ^ np.uint64(r.b & (2**64 - 1))) >= 0 for r in links)
    mine = {int(x): int(x) for x in fps.view(np.int64)}

    def top(x):
        while mine[x] != x:
            x = mine[x]
        return x

    for r in links:
        a, b = sorted((top(r.a), top(r.b)))
        mine[b] = a
    groups = {}
    for i, x in enumerate(fps.view(np.int64).tolist()):
        groups.setdefault(root(i), set()).add(top(x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({top(x) for x in mine}) == len(groups)


def test_documents(spark):
    rows = [(5, "a b c d e"), (3, "A B C D E"), (9, "quite another text of words"), (2, None), (7, "")]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5].component_id == got[3].component_id == 3 and got[9].component_id == 9
    assert got[2].fp == 0 and got[7].component_id == 2
