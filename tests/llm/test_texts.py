"""Substrings, rules, tokens, mixing, contamination, language and quality against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framesift.llm import decontam, langid, mixing, quality, rules, substrings, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def without_repeats(rows):
    """Plain version: every byte under a 50-byte string that a row with a smaller id holds."""
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            least[b[s : s + 50]] = min(d, least.get(b[s : s + 50], d))
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if least[b[s : s + 50]] < d:
                gone[s : s + 50] = b"\1" * 50
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        want.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(want)


def removed(spark, rows, parts=4):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(frame).collect())


def test_substrings(spark):
    rng = random.Random(4)
    shared = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (49, 50, 51, 80, 200, 400)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.6 else "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(0, 6))]
        rows.append((100 - i, "".join(parts)))
    rows += [(7, "ab" * 300), (8, "ab" * 300), (9, "b" + "ab" * 40), (8, "z" * 200), (6, None)]
    assert removed(spark, rows) == without_repeats(rows)


def test_substrings_of_long_texts_and_hot_passages(spark):
    """Texts longer than a piece, passages in very many texts with other words beside each, passages twice in
    one text and partly in a smaller one, repeated ids and repeated rows."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    hot, line = word(130), word(60) + "\n"
    rows = [(i, word(rng.randint(0, 90)) + hot[rng.randint(0, 70) :] + word(rng.randint(0, 90)) + (hot if i % 3 else "")) for i in range(400)]
    long = word(150_000)
    rows += [(1000, long), (1001, "x" * 31 + long[:70_000] + hot + long[65_000:]), (999, long[65_500:65_580] + long[30:90]), (1002, line * 2500), (1003, "q" + line * 40), (1003, line[:55]), (1004, line[3:58])]
    for i in range(60):
        inner = word(rng.randint(50, 80))
        paragraph = word(40) + inner + word(40)
        rows += [(2000 + 2 * i, word(20) + inner + word(20)), (2001 + 2 * i, paragraph + word(9) + paragraph), (2001 + 2 * i, paragraph[10:] + "z" + paragraph[5:])]
    rows += rows[5:9]
    assert removed(spark, rows) == without_repeats(rows)
    assert removed(spark, rows, 1) == without_repeats(rows)


def test_combined_rows_still_learn(spark):
    """A string that stands twice in one text and in a smaller document of another batch goes at both places."""
    s = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = [(1, s + "one"), (2, "x" + s + "y" + s + "z"), (3, s[:55] + "q" + s[5:] + "w" + s)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substrings.remove_repeats(frame).collect()}
    assert got == {1: (0, 0), 2: (2 * len(s), 2), 3: (55 + len(s) - 5 + len(s), 3)}


def test_repeats_inside_the_owner(spark):
    """A paragraph that stands twice in one text goes at both places where a smaller document holds its inner passage."""
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(40):
        edge, inner, other, between = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (60, 50 + i % 31, 60, 7))
        paragraph = edge + "x" + inner + "x" + edge[::-1]
        rows += [(2 * i, other + "y" + inner + "y" + other[::-1]), (2 * i + 1, paragraph + between + paragraph)]
        want |= {2 * i: (0, 0), 2 * i + 1: (2 * len(inner), 2)}
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_statistics(spark):
    rng = random.Random(6)
    every = ["", None, "a", "a a", "a a a a", "x\x0by #1 <b>|&%$*", "l\nl\n \nl"] + ["".join(rng.choice(["a", "b ", "c\n", "é", " ", "#", "AB! "]) for _ in range(rng.randint(0, 200))) for _ in range(200)]
    rows = rules.text_statistics(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")).collect()
    for r in rows:
        t = every[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def covered_plainly(rows, cuts):
    """Sequential covering restated: rows (good, prunes, values by statistic); conditions are (statistic, above, threshold)."""

    def holds(rule, v):
        return all((v[s] > t) if above else (v[s] <= t) for s, above, t in rule)

    out, left = [], list(rows)
    while len(out) < rules.MOST_RULES:
        rule, grow = [], [r for r in left if not r[1]]
        while len(rule) < rules.MOST_CONDITIONS:
            here = [r for r in grow if holds(rule, r[2])]
            p0, n0, best = sum(not r[0] for r in here), sum(r[0] for r in here), None
            for s in rules.STATISTICS:
                for t in cuts[s]:
                    for above in (False, True):
                        p = sum(not r[0] for r in here if holds([(s, above, t)], r[2]))
                        n = sum(r[0] for r in here if holds([(s, above, t)], r[2]))
                        if p >= rules.LEAST_COVERED and p + n < p0 + n0:
                            gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                                best = (gain, (s, above, t), n)
            if not best:
                break
            rule.append(best[1])
            if not best[2]:
                break
        if not rule:
            break
        prune = [r for r in left if r[1]]
        worth = []
        for k in range(len(rule)):
            p, n = (sum(r[0] == good for r in prune if holds(rule[: k + 1], r[2])) for good in (False, True))
            worth.append(((p - n) / max(1, p + n), p))
        keep = max(range(len(rule)), key=lambda k: (worth[k][0], -k))
        if worth[keep][0] <= 0 or worth[keep][1] < rules.LEAST_COVERED // 2:
            break
        out.append(rule[: keep + 1])
        left = [r for r in left if not holds(out[-1], r[2])]
    return out


def test_learner_by_plain_covering(spark):
    rng = random.Random(21)
    rows = []
    for i in range(400):
        v = [rng.choice([0, 0.1, 0.2, 0.4, 0.8]) if k % 2 else round(rng.random(), 2) for k in range(len(rules.STATISTICS))]
        bad = v[0] > 0.6 or (v[1] >= 0.4 and v[2] < 0.3) or rng.random() < 0.05
        rows.append((i, not bad, *map(float, v)))
    frame = spark.createDataFrame(rows, "doc_id long, good boolean, " + ", ".join(f"{s} double" for s in rules.STATISTICS))
    told = frame.withColumn("prunes", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).collect()
    quantiles = frame.agg(*[F.percentile_approx(s, [i / rules.BINS for i in range(1, rules.BINS)], 10000).alias(s) for s in rules.STATISTICS]).first()
    want = covered_plainly([(r.good, r.prunes, r.asDict()) for r in told], {s: sorted(set(quantiles[s])) for s in rules.STATISTICS})
    got = rules.learn(frame)
    assert len(want) >= 2 and [[(c.statistic, c.above) for c in rule] for rule in got] == [[(s, above) for s, above, _ in rule] for rule in want]
    for rule, plain in zip(got, want):
        for c, (s, above, t) in zip(rule, plain):  # thresholds moved, but no row changes sides
            assert [r[s] > c.threshold for r in told] == [r[s] > t for r in told]


def test_rules_on_held_out(spark):
    big = "/root/testdata/sf0.01"
    d, marks = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = rules.apply_rules(d, marks).join(marks, "doc_id").filter("NOT base_failed").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    right = got.filter("kept = (quality = 1)").count()
    assert right >= 0.95 * got.count()


def test_quality_on_held_out(spark):
    big = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{big}/labels.parquet")
    got = quality.op2_line_crf(spark, big).join(marks, "doc_id").filter("held_out")
    assert got.filter("predicted = quality").count() >= 0.95 * got.count()
    assert got.filter("score < 0 OR score > 1").count() == 0


def test_chain_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    chain = quality.Chain(rng.normal(size=4), rng.normal(size=(2, 2)))
    x, first = rng.normal(size=(7, 4)), np.array([0, 3, 4])
    good, pairs = chain.marginals(x, first)
    expected, joint = np.zeros(7), np.zeros((2, 2))
    for a, b in zip(first, [3, 4, 7]):
        total = 0.0
        for code in range(1 << (b - a)):
            y = [(code >> i) & 1 for i in range(b - a)]
            p = np.exp(sum(y[i] * (x[a + i] @ chain.weights) for i in range(b - a)) + sum(chain.couple[y[i], y[i + 1]] for i in range(b - a - 1)))
            total += p
        for code in range(1 << (b - a)):
            y = [(code >> i) & 1 for i in range(b - a)]
            p = np.exp(sum(y[i] * (x[a + i] @ chain.weights) for i in range(b - a)) + sum(chain.couple[y[i], y[i + 1]] for i in range(b - a - 1))) / total
            for i in range(b - a):
                expected[a + i] += p * y[i]
            for i in range(b - a - 1):
                joint[y[i], y[i + 1]] += p
    assert np.allclose(good, expected) and np.allclose(pairs, joint)


def test_lines_may_differ_from_their_document():
    """Good lines inside bad documents are told apart, though only documents are labelled."""
    rng = np.random.default_rng(2)
    features, first, labels, truth = [], [], [], []
    for d in range(300):
        good = d % 2
        own = np.array([good] * 10)
        if not good:
            own[rng.choice(10, 3, replace=False)] = 1
        first.append(len(truth))
        labels.append(good)
        truth += own.tolist()
        features += [rng.normal(1.5 if g else -1.5, 0.7, 2) for g in own]
    features, first, labels, truth = np.array(features), np.array(first), np.array(labels), np.array(truth)
    chain = quality.fit(features, np.ones(len(features)), first, labels)
    told, _ = chain.marginals(quality.with_neighbours(features, first), first)
    assert ((told > 0.5) == truth).mean() > 0.95
    share = np.add.reduceat(told, first) / 10
    assert ((share >= quality.GOOD_FROM) == labels).mean() > 0.97


def test_language_on_held_out(spark):
    big = "/root/testdata/sf0.01"
    got = langid.op8_language_id(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count()
    assert got.filter("accepted").count() >= 0.99 * got.count()


def test_model_sums_to_one():
    model = langid._estimate([("a", "\x02\x02\x02h", 3), ("a", "\x02\x02he", 2), ("a", "\x02hey", 1), ("a", "hey\x03", 1), ("a", "\x02\x02hi", 1), ("a", "\x02hi\x03", 1), ("b", "\x02\x02\x02o", 2), ("b", "\x02\x02o\x03", 1)])
    for context in ("\x02\x02\x02", "\x02\x02h", "\x02he", "zzz"):
        letters = "heyio\x03"
        codes = np.array([ord(c) for g in letters for c in context + g], np.uint64)
        p = np.exp(model.symbol_scores(codes)[:: len(context) + 1])
        rest = np.exp(model.symbol_scores(np.array([ord(c) for c in context + "Z"], np.uint64)))
        assert np.allclose(p.sum(axis=0) + rest[0], 1)


def test_entropies_by_the_definition():
    """Interpolated Kneser-Ney restated by recursion, letter by letter."""
    rng = random.Random(3)
    order, start, end = langid.ORDER, langid._START, langid._END
    samples = {k: ["".join(rng.choice(a) for _ in range(rng.randint(1, 7))) for _ in range(60)] for k, a in (("a", "aabcé"), ("b", "bcdd"), ("c", "xyzab"))}
    counts = {k: Counter(p[i : i + order] for w in ws for p in [start * (order - 1) + w + end] for i in range(len(w) + 1)) for k, ws in samples.items()}
    symbols = len({g[-1] for c in counts.values() for g in c}) + 1

    def tables(full):
        out = {order: full}
        for n in range(order - 1, 0, -1):
            out[n] = Counter(g[1:] for g in out[n + 1])
        return out

    def chance(grams, context, letter):
        n = len(context) + 1
        lower = chance(grams, context[1:], letter) if n > 1 else 1 / symbols
        after = {g: k for g, k in grams[n].items() if g[:-1] == context}
        if not after:
            return lower
        ones, twos = (sum(k == x for k in grams[n].values()) for x in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        return (max(after.get(context + letter, 0) - d, 0) + d * len(after) * lower) / sum(after.values())

    model = langid._estimate([(k, g, n) for k, c in counts.items() for g, n in c.items()])
    texts = ["abc dd", "xyz q éa", "zzzz bcd", "A-b c", "", None, "12"]
    got, n = model.texts(pa.array(texts))
    for i, text in enumerate(texts):
        words = [re.sub(r"[^\w]|[0-9_]", "", w) for w in (text or "").lower().split()]
        pairs = [(p[j : j + order - 1], p[j + order - 1]) for w in words if w for p in [start * (order - 1) + w + end] for j in range(len(w) + 1)]
        assert n[i] == len(pairs)
        for k, language in enumerate(model.languages):
            want = -sum(np.log(chance(tables(counts[language]), c, x)) for c, x in pairs) / max(1, len(pairs))
            assert np.isclose(got[i, k], want), (text, language)


def test_language_without_calibration(spark):
    rows = [(i, "the house and the garden", "en") for i in range(40)] + [(100, "das haus und der garten", "de")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert np.isfinite(model.limits).all()


def test_token_sections_add_up(docs, spark):
    rows = docs.select("doc_id", "text").collect()
    encoding, lengths = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    for rule in tokens.RULES:
        got = Counter()
        for r in tokens.count_tokens(docs, rule=rule).collect():
            got[r.doc_id] += r.n_tokens
        assert all(got[r.doc_id] == len(encoding.encode_ordinary(r.text)) for r in rows)
    ids = encoding.encode_ordinary("aé\n\U0001f600 x")
    assert lengths[ids].sum() == len("aé\n\U0001f600 x".encode())


def test_section_counts_by_bytes():
    """Tokens of each section, and those that reach beyond it, told byte by byte."""
    ranks = open(tokens.VOCABULARY, "rb").read()
    encoding, lengths = tokens.encoder(ranks)
    rng = random.Random(12)
    for _ in range(60):
        text = "".join(rng.choice(["hello ", "wörld", "\n", " 12", "\U0001f600", "a", "...", "internationalisation"]) for _ in range(rng.randint(0, 25)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(2 * rng.randint(0, 5)))
        sections = [(f"s{k}", a, b) for k, (a, b) in enumerate(zip(cuts[::2], cuts[1::2]))]
        byte = [0]
        for c in text:
            byte.append(byte[-1] + len(c.encode()))
        place, owner_of = 0, {}
        ends = [(byte[a], byte[b]) for _, a, b in sections]
        for rule in tokens.RULES:
            want, crossing, none, place = Counter(), Counter(), 0, 0
            for token in encoding.encode_ordinary(text):
                span = range(place, place + int(lengths[token]))
                place = span.stop
                inside = [sum(a <= i < b for i in span) for a, b in ends]
                if rule == "largest":
                    owner = inside.index(max(inside)) if inside and max(inside) else None
                else:
                    at = span[0] if rule == "start" else span[-1]
                    owner = next((k for k, (a, b) in enumerate(ends) if a <= at < b), None)
                if owner is None:
                    none += 1
                else:
                    want[owner] += 1
                    crossing[owner] += inside[owner] < len(span)
            rows = tokens.count_sections(text, sections, ranks, rule)
            got = {r[1]: (r[4], r[5]) for r in rows if r[0] >= 0}
            assert got == {name: (want[k], crossing[k]) for k, (name, _, _) in enumerate(sections)}, (text, sections, rule)
            assert [r[4] for r in rows if r[0] < 0] == ([none] if none else [])


def test_fields_keep_their_places(spark):
    frame = spark.createDataFrame([(1, "né", None, "last one", 7), (2, None, "", None, 8)], "k long, a string, b string, c string, sections int")
    given = tokens.with_fields(frame, "k", ["a", "b", "c"])
    rows = {(r.doc_id, r.name): r for r in tokens.count_tokens(given, sections_col="sections", rule="largest").collect() if r.section >= 0}
    texts = {r.doc_id: r.text for r in given.collect()}
    assert {k: texts[k[0]][r.char_start : r.char_end] for k, r in rows.items()} == {(1, "a"): "né", (1, "b"): "", (1, "c"): "last one", (2, "a"): "", (2, "b"): "", (2, "c"): ""}
    encoding, _ = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    assert sum(r.n_tokens for r in tokens.count_tokens(given, sections_col="sections").filter("doc_id = 1").collect()) == len(encoding.encode_ordinary("né\n\nlast one"))


def test_token_owner_rules():
    ranks = open(tokens.VOCABULARY, "rb").read()
    text, spans = "hello world", [("x", 0, 3), ("y", 5, 9)]
    per = {rule: [(r[0], r[4], r[5]) for r in tokens.count_sections(text, spans, ranks, rule)] for rule in tokens.RULES}
    assert per["start"] == [(0, 1, 1), (1, 1, 1)] and per["end"] == [(0, 0, 0), (1, 0, 0), (-1, 2, 0)] and per["largest"] == [(0, 1, 1), (1, 1, 1)]
    a, b = np.array([0, 4]), np.array([4, 6])
    assert tokens.owners(np.array([2]), np.array([6]), a, b, "largest").tolist() == [0]


def test_apportionment_is_highest_quotients():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 9)
        claims, limits, seats = [rng.choice([0.0, rng.random() * 50, 7.0]) for _ in range(n)], [rng.randint(0, 40) for _ in range(n)], rng.randint(0, 120)
        quotients = sorted(((-claims[i] / (2 * k + 1), i) for i in range(n) if claims[i] > 0 for k in range(limits[i])))[:seats]
        want = Counter(i for _, i in quotients)
        got = mixing.sainte_lague(claims, limits, seats)
        assert got == [want[i] for i in range(n)], (claims, limits, seats)


def test_targets_are_filled():
    assert mixing.fill_targets([100, 100], [5, 1], 200) == pytest.approx([500 / 3, 100 / 3])
    assert mixing.fill_targets([10, 1000, 1000], [5, 2, 1], 2010) == pytest.approx([30, 1320, 660])
    assert mixing.fill_targets([], [], 0) == [] and mixing.fill_targets([0, 0], [5, 2], 0) == [0, 0]


def test_mix(spark, docs):
    for shard_words, group_shards in ((mixing.SHARD_WORDS, mixing.GROUP_SHARDS), (700, 1024), (700, 3)):
        rows = mixing.mix_sources(docs, shard_words=shard_words, group_shards=group_shards).collect()
        assert sorted(rows) == sorted(mixing.mix_sources(docs.repartition(5), shard_words=shard_words, group_shards=group_shards).collect())
        source = {r.doc_id: r.source for r in docs.collect()}
        taken = Counter()
        for r in rows:
            assert 0 <= r.taken <= 3 * r.size
            taken[source[r.doc_id]] += r.taken
        # A block of rounding, and in each shard a short last block in each of up to three passes.
        for r in rows:
            assert abs(taken[source[r.doc_id]] - r.target) <= mixing.BLOCK_WORDS * (1 + 3 * -(-r.source_size // shard_words))


def test_best_match_by_table():
    rng = random.Random(1)
    for _ in range(200):
        p, s = ("".join(rng.choice("ab c") for _ in range(rng.randint(lo, hi))) for lo, hi in ((1, 30), (0, 50)))
        row = [0] * (len(s) + 1)
        for i, c in enumerate(p, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(s, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        d, start, end = decontam.best_match(p, s, 99)
        assert d == min(row) and 0 <= start <= end <= len(s)


def _edited(rng, text, share, kind):
    """text with that share of its letters edited: letters at random places, or whole words."""
    most = int(share * len(decontam.normal(text)))
    if kind == "letters":
        out = list(text)
        for _ in range(most):
            i = rng.randrange(len(out))
            out[i : i + 1] = rng.choice([[rng.choice("abcdefgh")], [], [out[i], rng.choice("abcdefgh")]])
        return "".join(out)
    words, left = text.split(" "), most
    while left > 0:
        i = rng.randrange(len(words))
        left -= len(words[i]) + 1
        if left >= 0:
            words[i : i + 1] = rng.choice([["zq%d" % rng.randrange(99)], [], [words[i], "q" * len(words[i])]])
    return " ".join(words)


@pytest.mark.parametrize("kind", ["letters", "words"])
def test_contamination_recall(spark, kind):
    """Of passages that are similar enough by the exact distance, nine of ten are found, up to the limit of 0.8."""
    items = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()
    block = decontam.Items([r.item_id for r in items], [r.text for r in items])
    rng = random.Random(3)
    other = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()]
    for share, least in ((0.0, 1.0), (0.05, 1.0), (0.1, 0.98), (0.15, 0.95), (0.18, 0.9), (0.2, 0.9)):
        every = [rng.choice(other)[:300] + " " + _edited(rng, r.text, share, kind) + " " + rng.choice(other)[:300] for r in items]
        got = {(d, i) for d, i, *_ in decontam.find_items(pa.array(every), block)}
        truth = {d for d, t in enumerate(every) if decontam.best_match(block.norm[d], decontam.normal(t), decontam.edit_limit(len(block.norm[d]), 0.8))}
        found = len({d for d in truth if (d, d) in got})
        print(kind, share, found, len(truth))
        assert found >= least * len(truth), (share, found, len(truth))
    clean = decontam.find_items(pa.array(["nothing of this stands in any item at all, not one bit"] * 3), block)
    assert clean == []


@pytest.mark.parametrize("least, most", [(20, 35), (36, 45), (46, 60), (61, 79), (80, 95), (96, 127), (128, 200), (200, 380)])
def test_recall_by_length(spark, least, most):
    """Items of every length, cut afresh from documents and edited by a fifth of their letters: all that are short, nine of ten others."""
    rng = random.Random(least)
    words = [w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect() for w in decontam.normal(r.text).split()]
    items = []
    while len(items) < 150:
        a, size = rng.randrange(len(words) - 200), rng.randint(least, most)
        items += [x for x in [" ".join(words[a : a + 200])[:size].strip()] if least <= len(x)]
    block = decontam.Items(list(range(150)), items)
    texts = [" ".join(rng.choices(words, k=30)) + " " + _edited(rng, x, 0.2, "letters") + " " + " ".join(rng.choices(words, k=30)) for x in items]
    truth = {i for i, x in enumerate(items) if decontam.best_match(x, decontam.normal(texts[i]), decontam.edit_limit(len(x), 0.8))}
    found = decontam.find_items(pa.array(texts), block)
    assert all(like >= 0.8 for *_, like in found)
    assert len(truth & {d for d, i, *_ in found if d == i}) >= (1 if most < decontam.EXACT else 0.9) * len(truth)


def test_short_items_are_found_unchanged():
    items = decontam.Items(["a", "b", "c", None], ["Paris", "same text, here again!", "", "x y"])
    texts = ["In Paris, then", "comparison of parish", "the SAME text here again", "same text here", "x y x", None, "", "y x", "x", "y"]
    assert [(d, i, distance) for d, i, _, _, distance, _ in decontam.find_items(pa.array(texts), items)] == [(0, "a", 0), (2, "b", 0), (4, None, 0)]


def test_contamination_at_the_threshold():
    """A passage at a similarity of exactly 0.8 counts, one edit less like does not."""
    assert [decontam.edit_limit(n, 0.8) for n in (4, 5, 99, 100, 1995)] == [0, 1, 19, 20, 399]
    rng = random.Random(3)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(20)) + "k"
    block = decontam.Items([1], [item])
    assert len(item) == 100
    found = decontam.find_items(pa.array([item[:80] + "9999", item[:79] + "9999"]), block)
    assert [(d, i, distance, round(like, 9)) for d, i, _, _, distance, like in found] == [(0, 1, 20, 0.8)]


def test_contamination_places(spark):
    item = "Seven gray owls quietly watched eleven brown mice near the old stone mill at dusk today"
    frame = spark.createDataFrame([(4, f"Élan! intro words go here. {item} then more"), (5, "quite different words in this one")], "doc_id long, text string")
    found = decontam.contaminated(frame, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.distance, r.similarity) for r in found] == [(4, 9, 0, 1.0)]
    text = frame.filter("doc_id = 4").first().text
    assert text[found[0].start : found[0].end] == item


def test_items_in_several_blocks(spark, docs, monkeypatch):
    """More blocks of items take more passes, and find the same."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda: sorted((r.doc_id, r.item_id, r.start, r.end, r.distance) for r in decontam.contaminated(docs, items).collect())
    ids = lambda: sorted(r.doc_id for r in decontam.uncontaminated(docs, items).select("doc_id").collect())
    one, free = rows(), ids()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", sum(len(r.text) for r in items.collect()) // 3)
    assert rows() == one and one
    assert ids() == free == sorted({r.doc_id for r in docs.select("doc_id").collect()} - {d for d, *_ in one})
