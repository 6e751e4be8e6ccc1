"""Secrets and personal data against plain scans; automata."""

import hashlib
import math
import random
import re

from framesift.llm import pii, secrets

BASE = {
    "assign": r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def base(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            if len(m[1] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), order, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def texts(seed=1, n=300):
    rng = random.Random(seed)
    bits = ["password", "Token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdef", "0123456789abcdef01234567", "AKIA", "ABCDEFGH12345678", "x", "é", "\U0001f600", "secret: token: abcdefgh", "ſecret=abcdefg", "4111111111111111", "4111 1111-1111 1111", "a@b.co", "@", ".", "192.168.0.1", "256.1.1.1", "+1 (555) 123-4567", "+", "-", "GB82WEST12345698765432"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_base_spans():
    for t in texts():
        found = secrets.base_spans(t)
        assert secrets.joined(found) == base(t)


def test_automata_tell_formats_apart(spark):
    rng = random.Random(2)
    make = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    words = [make(rng.randint(3, 12), "abcdefghijklmnopqrstuvwxyz") for _ in range(2000)]
    samples = {"hex": [make(40, "0123456789abcdef") for _ in range(300)], "access": ["AKIA" + make(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(300)]}
    formats = secrets._fit(samples, words)
    hits = sum(formats.score(make(40, "0123456789abcdef")) > 0 for _ in range(200)) + sum(formats.score("AKIA" + make(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) > 0 for _ in range(200))
    assert hits > 380
    assert sum(formats.score(make(24, "abcdefghijklmnopqrstuvwxyz")) > 0 for _ in range(200)) == 0
    assert len(formats.automata["hex"].go) < 60
    upper = "ABCDEF0123456789ABCDEF0123456789ABCDEF01"
    frame = spark.createDataFrame([(1, f"see {upper} and an ordinary sentence"), (2, "token = abcdef123456, kept")], "doc_id long, text string")
    rows = {r.doc_id: r for r in secrets.scan(frame, formats).collect()}
    assert rows[1].spans == f"format:4:{4 + len(upper)}" and rows[1].n_added == 1
    assert rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in secrets.redact(frame, formats).collect()}
    assert clean == {1: "see [SECRET] and an ordinary sentence", 2: "[SECRET], kept"}


def merged_plainly(words, alpha):
    """State merging restated on sets of prefixes: a state is the set of prefixes that lead to it."""
    coded = list(words)
    blocks = {p: p for w in coded for p in (w[:i] for i in range(len(w) + 1))}  # prefix -> its state's name

    def futures(name):
        inside = [p for p, n in blocks.items() if n == name]
        ended = sum(w == p for p in inside for w in coded)
        left = {}
        for p in inside:
            for w in coded:
                if w.startswith(p) and len(w) > len(p):
                    left[w[len(p)]] = left.get(w[len(p)], 0) + 1
        return ended, left, {s: next(blocks[p + s] for p in inside if p + s in blocks) for s in left}

    def alike(p, q, seen):
        if p == q or (p, q) in seen:
            return True
        seen.add((p, q))
        (e, left, go), (f, other, went) = futures(p), futures(q)
        n, m = e + sum(left.values()), f + sum(other.values())
        if not n or not m:
            return True
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (n**-0.5 + m**-0.5)
        if abs(e / n - f / m) > bound or any(abs(left.get(s, 0) / n - other.get(s, 0) / m) > bound for s in {*left, *other}):
            return False
        return all(alike(go[s], went[s], seen) for s in go if s in went)

    def fold(p, q):
        if p == q:
            return
        go, went = futures(p)[2], futures(q)[2]
        for k in [k for k, n in blocks.items() if n == q]:
            blocks[k] = p
        for s in go:
            if s in went:
                fold(blocks[go[s]], blocks[went[s]])

    kept = [""]
    while True:
        edge = next(((p, s) for p in kept for s in sorted(futures(p)[2]) if futures(p)[2][s] not in kept), None)
        if edge is None:
            return [futures(p)[:2] for p in kept]
        q = futures(edge[0])[2][edge[1]]
        into = next((r for r in kept if alike(r, q, set())), None)
        if into is None:
            kept.append(q)
        else:
            fold(into, q)


def test_merging_by_prefix_sets():
    rng = random.Random(5)
    for alpha in (0.05, 0.9):
        for _ in range(12):
            words = ["".join(rng.choice(rng.choice(["ag", "9G", "a9-"])) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 30))]
            got = secrets.infer(sorted(words), alpha)
            assert [(got.ended[q], got.left[q]) for q in range(len(got.go))] == merged_plainly(sorted(words), alpha)
            assert sum(got.ended) == len(words)


def test_background_counts_every_token():
    rng = random.Random(8)
    text = "".join(rng.choice("ab9ZC-+ é.\n") for _ in range(3000))
    ground, want, tokens = secrets.Background(), {}, re.findall(r"[A-Za-z0-9+/_=-]+", text)
    ground.add(text)
    for w in tokens:
        codes = [0, 0, 0] + [secrets._NUMBER[secrets.symbol(c)] for c in w] + [0]
        for i in range(3, len(codes)):
            key = (codes[i - 3] * 49 + codes[i - 2] * 7 + codes[i - 1], codes[i])
            want[key] = want.get(key, 0) + 1
    assert ground.tokens == len(tokens) and {(int(a), int(b)): int(ground.counts[a, b]) for a, b in zip(*ground.counts.nonzero())} == want
    plain = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text) if len(m[0]) >= 6]
    assert list(secrets.candidates(text)) == plain


def _credential(rng, kind):
    make = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    return {"hex": lambda: make(40, digits + "abcdef"), "ghp": lambda: "ghp_" + make(36, lower + upper + digits), "slack": lambda: f"xoxb-{make(11, digits)}-{make(24, lower + upper + digits)}",
            "digits": lambda: make(18, digits), "access": lambda: "AKIA" + make(16, upper + digits)}[kind]()


def test_formats_learn_prefix_length_and_punctuation():
    """Credentials held out, without the words that give them away, against ordinary words, names and numbers."""
    rng = random.Random(11)
    known = [_credential(rng, k) for k in ("hex", "ghp", "slack", "digits") for _ in range(150)]
    words = open("/opt/tokenizers/README.md").read().split() + re.findall(r"\w+", open(secrets.__file__).read()) * 3
    formats = secrets._fit({"assign": known, "access": [_credential(rng, "access") for _ in range(100)]}, words)
    assert all(len(a.go) > 10 for a in formats.automata.values())
    assert {"ghp_", "xoxb-"} <= formats.automata["assign"].prefixes and "AKIA" in formats.automata["access"].prefixes
    held = [_credential(rng, k) for k in ("hex", "ghp", "slack", "digits", "access") for _ in range(60)]
    text = " ".join(f"{rng.choice(words)} {x} {rng.choice(words)}" for x in held)
    found = {text[a:b] for a, b in formats.likely(text)}
    assert len(found & set(held)) >= 0.98 * len(held)
    plain = " ".join(words + ["internationalization", "HTTP/1", "2026-11-28T05:00", "20261128", "CamelCaseIdentifier", "snake_case_name", "v2beta1", "ghp", "xoxb"])
    assert not list(formats.likely(plain))
    exact = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]{6,}", text + plain) if formats.score(m[0]) > 0]
    assert list(formats.likely(text + plain)) == exact


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def test_personal_data(spark):
    every = texts(5) + ["1 2 " * 3000, "a" * 30000 + "@b" + ".c" * 9000, "9" * 20000, "+1" * 5000, "mail me: a.b@c.de, IBAN DE89370400440532013000 or DE89370400440532013001", " a@b.co "]
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")).collect()
    for r in rows:
        found = [f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in re.finditer(p, every[r.doc_id]) if passes(k, m[0])]
        assert [s for s in r.spans.split(",") if s and not s.startswith("iban")] == found
        assert r.base_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in found) for k in PII]
    told = next(r for r in rows if r.doc_id == len(every) - 2)
    assert told.n_iban == 1 and [s.score for s in told.scored] == [1.0, 1.0]


def test_very_many_matches(spark):
    """Work grows with the text, not with its square: some 60,000 matches in one text."""
    text = "write to né.ann@mail.example or 10.0.0.1; " * 25000 + "4111 1111 1111 1111"
    row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    found = [f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in re.finditer(p, text) if passes(k, m[0])]
    assert len(found) == 50001 and row.spans == ",".join(found)


def test_query_keeps_scores(spark, tmp_path):
    rows = [(1, "write to a.b@c.de or see 192.168.0.1"), (2, "a.b@c.de"), (3, None), (4, "call +1 (555) 123-4567")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.scored for r in pii.op9_pii(spark, str(tmp_path)).collect()}
    assert got == {1: "email:9:17:1.0,ip:25:36:0.5", 2: "email:0:8:0.8", 3: "", 4: "phone:5:22:0.7"}
