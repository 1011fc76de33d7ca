"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, lang_pred string, score int"


# ---- language ---------------------------------------------------------------

def letters(text):
    """Lower-case letters, runs of anything else as one space, and one at both ends."""
    out = " "
    for c in text:
        c = c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " "
        out += c if c != " " or out[-1] != " " else ""
    return out if out[-1] == " " else out + " "


def buckets(text):
    from chirpsieve.llm.language import BASE, BITS, ORDERS

    out, s = Counter(), letters(text)
    for n in range(1, ORDERS + 1):
        for i in range(len(s) - n + 1):
            h = 0
            for c in s[i : i + n]:
                h = (h * BASE + ord(c)) % 2**64
            h = (h + n) % 2**64
            h ^= h >> 33
            h = h * 0xFF51AFD7ED558CCD % 2**64
            out[(h ^ h >> 29) >> (64 - BITS)] += 1
    return out


TEXTS = [
    (1, "der Hund und die Katze, 12 Mäuse", "de"), (2, "the dog AND the cat", "en"), (3, "le chien et l'été", "fr"), (4, None, "en"), (5, "", "de"), (6, "123 456 !", "fr"),
    (7, "Straße über Ägypten", None), (8, "the the the", "en"), (8, "the the the", "en"), (None, "où est le chat", "fr"), (10, "İx ΣΑΣ ῼ", None), (11, "日本語", "de"), (12, "a", None), (13, "\n\t", None),
]


def test_language_is_naive_bayes(spark, monkeypatch):
    from chirpsieve.llm import language

    df = spark.createDataFrame([(*t, "x", 1) for t in TEXTS], DOCS).repartition(3)
    model = language.fit(df.select("text", "lang"))
    langs = ["de", "en", "fr"]
    counts = {x: sum((buckets(t) for _, t, y in TEXTS if y == x and t), Counter()) for x in langs}
    total = {x: sum(counts[x].values()) + language.SMOOTHING * 2**language.BITS for x in langs}
    rows = Counter(y for _, _, y in TEXTS if y)
    assert model["langs"] == langs
    log = lambda x, b: round(math.log((counts[x][b] + language.SMOOTHING) / total[x]) * language.SCALE)
    prior = {x: round(math.log((rows[x] + 1) / (sum(rows.values()) + 3)) * language.SCALE) for x in langs}
    got = language.identify(df, model, ["doc_id"]).collect()
    assert len(got) == len(TEXTS)
    want = []
    for d, t, _ in TEXTS:
        if not t or not any(c.isalpha() for c in t):
            want.append((d, "und", 0.0))
            continue
        s = {x: prior[x] + sum(n * log(x, b) for b, n in buckets(t).items()) / language.ORDERS for x in langs}
        best = max(langs, key=lambda x: (s[x], -langs.index(x)))
        want.append((d, best, 1 / sum(math.exp((s[x] - s[best]) / language.SCALE) for x in langs)))
    key = lambda r: (str(r[0]), r[1], round(r[2], 9))
    assert sorted(map(key, got)) == sorted(map(key, want))
    long = "der Hund, the dog - " * 40
    whole = language.decide(model, [long, "x", long])
    monkeypatch.setattr(language, "PIECE", 7)
    cut = language.decide(model, [long, "x", long])
    assert whole[0] == cut[0] and (whole[1] == cut[1]).all() and cut[1][0] == cut[1][2]


def test_language_of_odd_tables(spark):
    from chirpsieve.llm import language

    df = spark.createDataFrame([(1, "a b", "x", "y", 2)], DOCS)
    none = language.fit(df.where("false").select("text", "lang"))
    assert [tuple(r) for r in language.identify(df, none, ["doc_id", "lang"]).collect()] == [(1, "x", "und", 0.0)]
    assert language.identify(df.where("false"), language.fit(df), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        language.identify(df, none, ["score"])
    many = spark.range(5).selectExpr("'a' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError):
        language.fit(many, most=4)
    assert len(language.fit(many, most=5)["langs"]) == 5


def test_language_of_held_out_documents(spark):
    from chirpsieve.llm import language

    got = language.op11(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


# ---- repair -----------------------------------------------------------------

VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
SENTENCE = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    """conv_id -> rows (turn, role, text) in order."""
    out = {}
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        mine = out.setdefault(c, [])
        if h:
            row = (t, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            mine += [row] * (1 + (h == 3))
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def faults_of(rows):
    out, seen = [], set()
    for _, role, text in rows:
        last = VISIBLE.findall(text)[-1:]
        out.append("b" if not last else "d" if (role, text) in seen else "" if last[0] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired rows) over all sequences of edits, with at most two insertions in a gap."""
    best = {"": (0, "", [])}  # by role initials so far, kept whole

    def inserted(b):
        for _ in range(2):
            for roles, (cost, audit, out) in list(b.items()):
                for name in ("user", "assistant"):
                    put(b, roles + name[0], (cost + 3, audit + "I", [*out, name + ":"]))
        return b

    def put(b, roles, v):
        if re.match(r"s?(ua)*u?\Z", roles) and (roles not in b or v[:2] < b[roles][:2]):
            b[roles] = v

    for (_, role, text), f in zip(rows, found):
        new = {}
        for roles, (cost, audit, out) in inserted(best).items():
            put(new, roles, (cost + 4, audit + "D", out))
            if f in ("", "t"):
                more = 3 if f else 0
                if role:
                    put(new, roles + role[0], (cost + more, audit + "K", [*out, f"{role}:{text}"]))
                for name in ("user", "assistant"):
                    put(new, roles + name[0], (cost + 3 + more, audit + "R", [*out, f"{name}:{text}"]))
        best = new
    return min((v for roles, v in inserted(best).items() if SENTENCE.match(roles)), key=lambda v: v[:2])


def digests_of(rows):
    for c, mine in damaged(rows).items():
        found = faults_of(mine)
        cost, audit, out = cheapest(mine, found)
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        yield (c, gaps, *(found.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(seed, n, longest):
    r = np.random.default_rng(seed)
    texts = ["Yes.", "No!", "why?", "cut", " \n", "", None, "More. ", "é…", "one. two"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "User", "", None, "sure"]
    out = []
    for c in range(n):
        at = int(r.integers(-2, 3))
        for i in range(int(r.integers(1, longest))):
            at += int(r.choice([1, 1, 1, 2, 0]))
            role = ["user", "assistant"][i % 2] if r.random() < 0.6 else roles[r.integers(len(roles))]
            out.append((None if c == 3 else c, None if r.random() < 0.03 else at, role, texts[r.integers(len(texts))] if r.random() < 0.7 else f"row {c} {i}."))
    return out


CONV = "conv_id long, turn long, role string, text string, part int, audit string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def run_repair(spark, rows, parts=3):
    from chirpsieve.llm import repair

    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONV).repartition(parts)
    got = repair.digests(repair.repair(repair.damage(df)))
    assert got.columns == NAMES
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("run", [256, 3, 1])
def test_repair_is_the_cheapest_of_all_edits(spark, monkeypatch, run):
    from chirpsieve.llm import repair

    monkeypatch.setattr(repair, "RUN", run)
    rows = conversations(run, 60, 9)
    assert run_repair(spark, rows) == sorted(digests_of(rows), key=str)


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    from chirpsieve.llm import repair

    monkeypatch.setattr(repair, "RUN", 16)
    rows = [(7, i, ["user", "assistant", "system"][(i * i) % 3], f"text {i % 50}" + ".!"[i % 2 :]) for i in range(600)] + [(8, 1, "user", "a."), (9, None, None, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = run_repair(spark, rows, 8)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    mine = damaged(rows)[7]
    found = faults_of(mine)
    cost, audit = repair.edits(tuple((r[:1], f) for (_, r, _), f in zip(mine, found)))
    roles, texts, _ = repair.replay(audit, [r for _, r, _ in mine], [t for *_, t in mine])
    assert SENTENCE.match("".join(r[0] for r in roles))
    one = next(r for r in got if r[0] == 7)
    assert one[6:] == (cost, audit, hashlib.sha256("\n".join(map(":".join, zip(roles, texts))).encode()).hexdigest())
    assert one[2:5] == tuple(found.count(x) for x in "bdt") and found.count("d") > 400
    assert [r for r in got if r[0] != 7] == sorted(digests_of(rows[600:]), key=str)


def test_stacks_are_those_of_the_grammar():
    from chirpsieve.llm.repair import edits, stacks

    s = stacks()
    for n in range(7):
        for word in map("".join, itertools.product("sua", repeat=n)):
            front = {0}
            for c in word:
                front = {y for x in front for y in s.shift[x][c]}
            assert any(s.accepting[x] for x in front) == bool(SENTENCE.match(word))
    assert edits(()) == (0, "") and edits((("s", ""),)) == (4, "D") and edits((("u", "t"),)) == (4, "D")


def test_conversations_without_rows(spark):
    drop = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert run_repair(spark, [(5, drop, "user", "a.")]) == [(5, 0, 0, 0, 0, 0, 0, "", empty)]
    assert run_repair(spark, []) == []


def test_repair_of_the_table(spark):
    from chirpsieve.llm import repair

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, repair.op12(spark, SF).collect()), key=str) == sorted(digests_of(rows), key=str)


def test_sql_of_repair():
    import duckdb

    from chirpsieve.llm.repair import OP12_SQL

    rows = conversations(5, 80, 9)
    c = duckdb.connect()
    c.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(c.execute(OP12_SQL).fetchall(), key=str) == sorted(digests_of(rows), key=str)


# ---- search -----------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranked(docs, items, k):
    per = [(d, Counter(terms_of(t))) for d, t in docs]
    per = [(d, c) for d, c in per if c]
    n, length = len(per), sum(sum(c.values()) for _, c in per)
    df = Counter(t for _, c in per for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in per:
            m = 50 + 50 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:k])]
    return out


def corpus():
    r = np.random.default_rng(3)
    vocab = [f"{a}{b}" for a in ("ba", "té", "KA", "öl", "x9") for b in ("ro", "si", "na", "日", "ñe", "")]
    say = lambda n: " ".join(vocab[min(len(vocab) - 1, int(r.exponential(6)))] for _ in range(n)) + ("." if n % 2 else "\x7f\x01_z")
    docs = [(i, say(int(r.integers(0, 60)))) for i in range(150)] + [(200 + i, "ba si ro") for i in range(9)] + [(7, "ba si ro"), (None, "ba si ro"), (None, None), (400, ""), (401, "?!"), (402, "ba " * 5000)]
    items = [(i, say(int(r.integers(1, 12)))) for i in range(12)] + [(5, "ba"), (None, "si"), (90, None), (91, "unseen words"), (92, "ba BA ba")]
    return docs, items


@pytest.mark.parametrize(("per_batch", "k", "buckets"), [(1024, 50, 1024), (3, 4, 8), (1024, 3, 2)])
def test_search_is_the_ranking_of_all(spark, monkeypatch, per_batch, k, buckets):
    from chirpsieve.llm import search

    docs, items = corpus()
    monkeypatch.setattr(search, "QUERIES", per_batch)
    monkeypatch.setattr(search, "BUCKETS", buckets)
    monkeypatch.setattr(search, "STEP", 5)
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, n int, score string").repartition(4)
    q = spark.createDataFrame([(*x, 1, "y") for x in items], "item_id long, text string, rank int, doc_id string").repartition(2)
    got = search.search(search.index(d), q, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, ranked(docs, items, k)))


def test_search_of_empty_tables(spark):
    from chirpsieve.llm import search

    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, items in ((d.where("false"), q), (d, q.where("false")), (d.where("false"), q.where("false"))):
        got = search.search(search.index(docs), items)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_bounds_are_never_below_scores(spark):
    from chirpsieve.llm import search

    r = np.random.default_rng(1)
    h = np.sort(r.integers(0, 2**63, 500).astype(np.uint64) * 2)
    counts = r.integers(1, 600, 500)
    sketch = np.zeros(search.BUCKETS, np.int64)
    np.maximum.at(sketch, search.bucket(h), np.minimum(counts, search.FULL))
    for norm in (50, 77, 10_000):
        bound = np.where(sketch < search.FULL, search.impact(sketch, norm), search.IMPACT)
        assert (bound[search.bucket(h)] >= search.impact(counts, norm)).all()
