"""Conversation repair, line dedup and whitening against plain versions, and on hostile input."""

import hashlib
import heapq
import itertools
import math
import re
import zlib

import numpy as np
import pytest

from framesift.llm import conversations, lines, whitening
from framesift.llm.entry import ORACLE_SQL, QUERIES
from tests.oracle import rows_of, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_line_dedup", "embedding_deviations"])
def test_agrees_with_sql(spark, name):
    assert rows_of(QUERIES[name], spark, SF) == sql_rows(ORACLE_SQL[name], SF)


# Conversations


def cheapest(signature):
    """Cheapest, then ASCII-least edits by a search over all of them in order of cost."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(signature) and last in ("", "a"):
            return cost, audit
        if (i, last) in done:
            continue
        done.add((i, last))
        heapq.heappush(heap, (cost + 5, audit + "I", i, after[last]))
        if i < len(signature):
            c = signature[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last))
            if c != "x":
                more = 5 * c.isupper()
                if c.lower() == after[last] or (c.lower() == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, c.lower()))
                heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, after[last]))


def test_solved_as_by_search():
    for n in range(5):
        for letters in itertools.product("suaoSUAOx", repeat=n):
            assert conversations.solve("".join(letters)) == cheapest("".join(letters))
    long_ = "suauaUxaaosuAuuuaSxx" * 60
    assert conversations.solve(long_) == cheapest(long_)
    assert len(conversations.solve("ua" * 50_000)[1]) == 100_000


def plain_repair(rows):
    """The contract, conversation by conversation."""
    held = {}
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        held.setdefault(conv, []).extend([(turn, "user" if fault == 4 else role, text)] * ((fault != 0) + (fault == 3)))
    out = []
    for conv, items in held.items():
        items.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        counts, letters, seen = [0, 0, 0], "", set()
        for _, role, text in items:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if fault in (0, 1) else letter.upper() if fault == 2 else letter
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(items, items[1:]))
        turns = [t for t, _, _ in items if t is not None]
        cost, audit = cheapest(letters)
        said, i = [], 0
        for edit in audit:
            if edit != "I":
                i += 1
            if edit != "D":
                last = said[-1][0] if said else ""
                said.append((items[i - 1][1] if edit == "K" else "assistant" if last == "u" else "user") + ":" + ("" if edit == "I" else items[i - 1][2]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said))
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = (
    [(None, t, "user", f"Lost {t}.") for t in range(9)] + [(None, None, None, None)] * 3
    + [(1, t, ["system", "user", "assistant", "tool", "", None][t % 6], ["Hello.", "", None, " \n", "why", "Why?\t", "é!", "Hello."][t % 8]) for t in range(-20, 400)]
    + [(2, 5, "user", "Same."), (2, 5, "user", "Same."), (2, 5, "assistant", "Other."), (2, None, "system", "Be brief."), (2, 2**40, "assistant", "x" * 300_000 + ".")]
    + [(c, 0, "user", "only") for c in range(100, 160)] + [(7, None, "user", "A."), (7, None, "assistant", "B.")]
)


def test_conversations(spark):
    rows = spark.createDataFrame([r + (1, "z") for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, present int, audit string")
    for given in (rows, rows.repartition(7)):
        found = conversations._digested(conversations._replayed(conversations._clean(conversations.damage(given), "conv_id", "turn", "role", "text", "present")))
        assert sorted(map(tuple, found.collect()), key=str) == plain_repair(CONVERSATIONS)
    assert conversations.audits(rows.limit(0)).collect() == conversations.repair(rows.limit(0)).collect() == []


def test_repaired_rows(spark):
    rows = spark.createDataFrame([("c", 1, "user", "Hi."), ("c", 2, "user", "Still there?"), ("c", 4, "assistant", "Yes."), (None, 1, "assistant", "Alone.")], "id string, at int, who string, said string")
    names = {"conv_col": "id", "turn_col": "at", "role_col": "who", "text_col": "said"}
    assert sorted(map(tuple, conversations.audits(rows, **names).select("conv_id", "gaps", "illegal", "cost", "audit").collect()), key=str) == [("c", 1, 1, 2, "DKK"), (None, 0, 0, 2, "D")]
    assert [tuple(r) for r in conversations.repair(rows, **names).orderBy("place").collect()] == [("c", 0, "K", "user", "Still there?"), ("c", 1, "K", "assistant", "Yes.")]


# Lines


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 1000, 50_000):
        h1, h2 = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(2))
        if n > 3:
            h1[: n // 2] = h1[0]  # told apart by the other hash
        made = lines.PerfectHash.over(h1, h2)
        assert sorted(lines.PerfectHash.unpacked(made.packed()).places(h1, h2).tolist()) == list(range(n))
        shard = lines.Shard.of_row(*lines.Shard.over(h1, h2, np.arange(n), np.arange(n) * 7).row())
        known, owner = shard.owner(h1, h2)
        assert known.all() and (owner == np.arange(n) * 7).all()
        assert not shard.owner(rng.integers(0, 1 << 64, 999, dtype=np.uint64), rng.integers(0, 1 << 64, 999, dtype=np.uint64))[0].any()


def plain_lines(docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for doc_id, text in docs:
        for x in (text or "").split("\n"):
            held.setdefault(key(x), set()).add(math.inf if doc_id is None else doc_id)
    out = []
    for doc_id, text in docs:
        given = (text or "").split("\n")
        goes = lambda x: len(key(x)) >= 10 and len(held[key(x)]) > 1 and min(held[key(x)]) != (math.inf if doc_id is None else doc_id)
        kept = [x for x in given if not goes(x)]
        out.append((doc_id, len(given), len(given) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1, 3, 1 << 14])
def test_lines(spark, hot, monkeypatch):
    monkeypatch.setattr(lines, "HOT_KEYS", hot)
    rng = np.random.default_rng(hot)
    said = [" The SAME line ", "the same line", "THE same line", "short", "ÉTÉ est là, oui", "été est là, oui", "", "\t", "another shared line\r", "Another shared line", "123456789", "1234567890", "a\x0bb 1234567890"]
    docs = [(int(i), "\n".join(rng.choice(said, rng.integers(0, 9)).tolist() + [f"a line of {i % 17} alone"])) for i in rng.integers(-5, 60, 150)]
    docs += [(None, None), (None, "the same line\n1234567890\nnobody else has this"), (None, "nobody else has this"), (3, ""), (3, None), (70, "the same line\n" * 4000), (71, "the same line\nx\n" * 4000 + "y" * 200_000), (71, "the same line\nx\n" * 4000 + "y" * 200_000)]
    frame = spark.createDataFrame([d + (1, "a", 5, True) for d in docs], "doc_id long, text string, no int, of string, h1 int, settled boolean")
    found = lines.drop_repeated_lines(frame.repartition(5)).collect()
    assert sorted(map(tuple, found), key=str) == plain_lines(docs)


def test_no_lines(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    assert lines.drop_repeated_lines(docs.limit(0)).collect() == []
    assert [tuple(r) for r in lines.drop_repeated_lines(docs).collect()] == [(1, 1, 0, "x")]


# Whitening


def check_white(rows, vectors, ids):
    """rows of whiten against the definition, by numpy and whole numbers."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    exact = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    c = np.array([[float(v - s // n) - s % n / n for v, s in zip(r, sums)] for r in x])
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(8, int((values > 1e-11 * values[0]).sum()))
    assert len(rows) == n * k and {r.n for r in rows} == {n}
    assert {(r.vec_id, r.deviation) for r in rows} == {(i, d if d < 1 << 63 else None) for i, d in zip(ids, exact)}
    assert all(r.identity_error <= 1e-4 and math.isclose(r.explained, values[r.component - 1] / (sum(exact) / n**3), rel_tol=1e-9) for r in rows)
    for j in range(k):
        white = {r.vec_id: r.whitened for r in rows if r.component == j + 1}
        want = c @ axes[:, j] / math.sqrt(values[j])
        assert min(max(abs(white[i] - sign * w) for i, w in zip(ids, want)) for sign in (1, -1)) < 1e-7


def test_whitening(spark):
    rng = np.random.default_rng(3)
    mixed = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) / 5).astype(np.float32).astype(float).tolist()
    bad = [None, [], [1.0] * 11, [None] + [0.0] * 11, [float("nan")] * 12, [float("inf")] + [0.0] * 11]
    frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in enumerate(mixed + bad)], "vec_id long, embedding array<float>, n int, whitened double")
    check_white(whitening.whiten(frame).collect(), mixed, range(300))
    check_white(whitening.whiten(frame.repartition(3)).collect(), mixed, range(300))
    flat = [[*v[:2], v[0] + 0.5, 7.0] for v in mixed]  # two components
    flat = [[math.floor(1024 * e) / 1024 for e in v] for v in flat]
    check_white(whitening.whiten(spark.createDataFrame(list(enumerate(flat)), "vec_id long, embedding array<double>")).collect(), flat, range(300))


def test_whitening_edges(spark):
    make = lambda vs: spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<double>")
    for vs in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, []]):
        assert whitening.whiten(make(vs).filter("vec_id >= 0") if vs else make([[1.0]]).limit(0)).collect() == []
    ids = spark.createDataFrame([(None, [1.0, 0.0]), (None, [0.0, 1.0]), (4, [5.0, 5.0]), (4, [5.0, 5.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(ids).count() == 8
    huge = whitening.whiten(make([[1e300, 0.0], [-1e300, 1.0], [0.0, 2.0]])).collect()
    assert huge and {r.deviation for r in huge if r.vec_id < 2} == {None}


def test_deviations_exact():
    rng = np.random.default_rng(1)
    for scale, n in ((1000, 5), (1 << 30, 1000), (1 << 50, 1 << 40)):
        x = rng.integers(-scale, scale, (20, 6)) + 100_000
        sums = [int(v) for v in rng.integers(-scale, scale, 6) * n // 2]
        assert whitening.deviations(x, n, sums) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
