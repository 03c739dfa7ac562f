"""Filter interaction, source divergence and secret scans against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from graphwright.llm import divergence, filteraudit, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string"
NEVER = "quality int, toxic int"


def brute_masks(rows):
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, lang, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = [
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            bool(re.search(r"[#$%&*|]", text)),
            doc_id is not None and least[text] < doc_id,
        ]
        out.append((doc_id, lang or "", sum(f << i for i, f in enumerate(fails))))
    return out


def brute_audit(rows, labels):
    masks = brute_masks(rows)
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, t in labels if t == 1} - {None}
    out = {}
    for part in {p for _, p, _ in masks}:
        own = [(d, m) for d, p, m in masks if p == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = own, []
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                removed = [(d, m) for d, m in left if m & bit]
                kept = [(d, m) for d, m in left if not m & bit]
                shapley[letter] += len(removed)
                out[part, order, step] = [
                    len(kept),
                    len(removed),
                    sum(bool(m & bit) for _, m in gone),
                    sum(m == bit for _, m in own),
                    sum(d in good for d, _ in removed),
                    sum(d in toxic for d, _ in removed),
                ]
                left, gone = kept, gone + removed
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def audit_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["#", "BIG", "$9", "Ünï", "A"]
    texts = [" ".join(rng.choices(words[: rng.choice([20, 405])], k=rng.choice([0, 3, 199, 200, 260]))) for _ in range(30)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""]), "s") for i in range(200)]
    rows += [(1000 + i, texts[0], "en", "s") for i in range(150)]  # a hot text
    rows += [(None, texts[0], "en", "s"), (None, texts[0], None, "s"), (7, texts[1], "en", "s"), (7, texts[1], "en", "s"), (8, None, "en", "s")]
    return rows


@pytest.fixture
def many_partitions(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_masks_over_many_partitions(spark, many_partitions):
    rows = audit_rows()
    got = filteraudit.failure_masks(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_masks(rows))


def test_filter_audit(spark):
    rows = audit_rows()
    rng = random.Random(6)
    labels = [(i, rng.randint(0, 1), rng.choice([0, 1, None])) for i in range(150)]
    labels += [(3, 1, 1), (None, 1, 1), (99_999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", mask int, part string")
    got = filteraudit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, " + NEVER)).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in got} == brute_audit(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_filter_audit_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, " + NEVER)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in odd.collect()]
    got = filteraudit.filter_audit(odd, labels).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in got} == brute_audit(rows, [])
    assert filteraudit.filter_audit(empty, labels).collect() == []


def brute_divergence(rows, least=3, listed=200):
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    groups, documents = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = [t.translate(lower) for t in pattern.findall(text or "")]
        groups[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    out = set()
    for lang in documents.keys() | {g for g, _ in groups}:
        kept = sorted(t for t, n in documents[lang].items() if n >= least)

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        own = {s: c for (g, s), c in groups.items() if g == lang}
        share = {s: shares(c) for s, c in own.items()}
        of_lang = shares(sum(own.values(), Counter()))
        for s, p in share.items():
            pairs = [(-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o.encode(), o) for o, q in share.items() if o != s]
            terms = [(-((p[t] - of_lang[t]) ** 2 // of_lang[t]), t.encode(), t) for t in kept if own[s][t] and p[t] > of_lang[t]]
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms), 1) if i <= listed}
    return out


def divergence_rows():
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "abcdeé漢" for b in "xyzuvwÄ"] + ["THE", "The", "the", "😀", "one2two", "don't"]
    rows = []
    for i in range(300):
        lang, source = rng.choice(["en", "de", "", None]), rng.choice(["a", "b", "c", "", None])
        own = words if source != "a" else words[:20]
        rows.append((i, " ".join(rng.choices(own, k=rng.randint(0, 40))), lang, source))
    rows += [(500, "12 34", "xx", "a"), (501, None, "xx", "b"), (502, "lonely words", "xx", "c"), (503, "z", "yy", "only")]
    return rows


def test_divergence(spark, monkeypatch):
    rows = divergence_rows()
    docs = spark.createDataFrame([(*r, 5, 2) for r in rows], SCHEMA + ", n long, rank int")
    want = brute_divergence(rows)
    assert {tuple(r) for r in divergence.divergence(docs).collect()} == want
    assert {r[4] for r in want if r[0] == "xx" and r[2] == "pair"} == {0}
    monkeypatch.setattr(divergence, "CROSSED", 7)
    got = [tuple(r) for r in divergence.divergence(docs).collect()]
    assert len(got) == len(want) and set(got) == want


def test_divergence_lists_200_terms(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(700)]
    rows = [(i, " ".join(rng.sample(words, 300)), "en", "ab"[i % 2]) for i in range(40)]
    got = [tuple(r) for r in divergence.divergence(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert set(got) == brute_divergence(rows) and max(r[5] for r in got) == 200


def test_divergence_of_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in odd.collect()]
    assert {tuple(r) for r in divergence.divergence(odd).collect()} == brute_divergence(rows)
    assert divergence.divergence(empty).collect() == []


@pytest.mark.parametrize("n,size", [(0, 1), (7, 3), (10**12, 3 * 10**12 + 7), (8 * 10**15, 8 * 10**15 + 1)])
def test_share_is_exact(spark, n, size):
    from pyspark.sql import functions as F

    row = spark.range(1).select(divergence._share(F.lit(n).cast("long"), F.lit(size).cast("long"))).first()
    assert row[0] == 1 + 10**9 * (n + 1) // size


def brute_spans(text):
    kinds = [
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ]
    out = []
    for place, (kind, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return [s for _, _, s in sorted(out)]


def secret_texts():
    rng = random.Random(4)
    bits = [
        "password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "apikey", "mytoken", ":", "=", " ", "  ", "\t", '"', "'", "==", "abc", "abcdef", "é", "ſecret", "toKen",
        "AKIA", "AKIA" + "Z" * 16, "AKIAAKIA" + "Q" * 12, "Z" * 20, "0123456789abcdef", "deadbeef" * 3, "f" * 24, "f" * 23, "g", "\n", "漢字", "😀", "x.y-z/w+", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl",
        "-----BEGIN RSA PRIVATE KEY-----",
    ]
    return ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(400)]


def versions_of(spark, rows):
    return spark.createDataFrame(rows, "path string, version int, content string")


def test_spans():
    for text in secret_texts():
        got = [(s, i, f"{r.name}:{s}:{e}") for i, r in enumerate(secrets.BASE) for s, e in r.spans(text)]
        assert [x for _, _, x in sorted(got)] == brute_spans(text)


def test_secret_digests(spark, tmp_path):
    texts = [*secret_texts(), None, "", *["password: hunter22"] * 50, "pad " * 50_000 + "token=abcdefgh"]
    versions = versions_of(spark, [(f"p{i % 37}", i, t) for i, t in enumerate(texts)])
    ledger = f"file://{tmp_path}/ledger"
    secrets.scan(versions, ledger)
    got = {r.version: r for r in secrets.digests(secrets.findings(versions, ledger)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = brute_spans(t)
        counts = Counter(x.split(":")[0] for x in base)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (counts["assign"], counts["access"], counts["hex"])
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = got[i].spans.split(",") if got[i].spans else []
        assert [x for x in spans if x.split(":")[0] in counts] == base
        assert got[i].spans.count("jwt:") == len(re.findall(secrets.JWT.pattern, t or ""))
        assert got[i].spans.count("pem:") == (t or "").count("BEGIN RSA")


def test_ledger_scans_what_is_unseen(spark, tmp_path):
    ledger, n = f"file://{tmp_path}/ledger", len(secrets.RULES)
    first = versions_of(spark, [("a", 1, "token=abcdef"), ("a", 2, "nothing"), ("b", 1, "token=abcdef")])
    assert secrets.scan(first, ledger) == 2 * n
    assert secrets.scan(first, ledger) == 0
    more = first.union(versions_of(spark, [("c", 1, "nothing"), ("c", 2, "password='qwertz'"), (None, None, "token=abcdef")]))
    assert secrets.scan(more, ledger) == n
    longer = secrets.Rule("assign", secrets.ASSIGN.pattern, least=7, group=2, revision=2, any_case=True)
    rules = (longer, secrets.ACCESS, secrets.HEX)
    assert secrets.scan(more, ledger, rules) == 3  # three blobs, one new revision
    got = Counter(r.spans for r in secrets.digests(secrets.findings(more, ledger, rules), rules, rules).collect())
    assert got == {"": 6}
    old = secrets.digests(secrets.findings(more, ledger)).collect()
    assert Counter(r.spans for r in old) == {"assign:0:12": 3, "": 2, "assign:0:16": 1}
    # a batch written twice, as by two scans at a time, is read once
    spark.read.parquet(ledger).coalesce(1).write.mode("append").parquet(ledger)
    assert secrets.findings(more, ledger).count() == 6
    assert Counter(r.spans for r in secrets.digests(secrets.findings(more, ledger)).collect()) == Counter(r.spans for r in old)


def test_secrets_of_unscanned_and_empty(spark, tmp_path):
    versions = versions_of(spark, [("a", 1, "token=abcdef")])
    (row,) = secrets.digests(secrets.findings(versions, f"file://{tmp_path}/none")).collect()
    assert (row.n_assign, row.spans) == (0, "")
    empty = versions.limit(0)
    assert secrets.scan(empty, f"file://{tmp_path}/ledger") == 0
    assert secrets.findings(empty, f"file://{tmp_path}/ledger").collect() == []


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_source_divergence", "op13_secret_scans"])
def test_queries_same_as_sql(name, spark, sf_dir, duck):
    from graphwright.llm.queries import ORACLE_SQL, QUERIES

    other = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in other.description]
    got = QUERIES[name](spark, sf_dir).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(other.fetchall())
