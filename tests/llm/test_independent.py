"""Parts of operators against plainer code that shares nothing with them."""

import zlib

import numpy as np
import pytest
import xxhash

SF = "/root/testdata/sf0.01"


def naive_shingles(text, size=5):
    """32-bit hashes of a text's word shingles, one integer at a time."""
    from chirpsieve.llm.minhash import BASE

    out, ws = set(), text.encode().split()
    for i in range(max(1, len(ws) - size + 1) if ws else 0):
        h = 0
        for w in ws[i : i + size]:
            h = (h * BASE + xxhash.xxh64_intdigest(w)) % 2**64
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD % 2**64
        out.add((h ^ h >> 29) >> 32)
    return out


def test_minhash_fingerprints_are_those_of_single_integers():
    from chirpsieve.llm import minhash

    a, b = [int(x) for x in minhash._A], [int(x) for x in minhash._B]
    r = np.random.default_rng(2)
    texts = ["", " ", "one", "one two three four", "a b c d e", "é ß 日本 a b c"] + [" ".join(f"w{i}" for i in r.integers(0, 40, n)) for n in (6, 50, 300)]
    for t in texts:
        s = naive_shingles(t)
        want = bytes(min(((x * k + c) % 2**64 >> 32 for x in s), default=255) % 256 for k, c in zip(a, b))
        assert minhash.Document(t, 5).lanes() == want


def test_likeness_estimates_jaccard():
    from chirpsieve.llm.minhash import Document, likeness

    r, off = np.random.default_rng(4), []
    for _ in range(60):
        ws = [f"w{i}" for i in r.integers(0, 5000, 200)]
        other = list(ws)
        for i in r.integers(0, 200, int(r.integers(0, 30))):
            other[i] = "new"
        a, b = " ".join(ws), " ".join(other)
        x, y = naive_shingles(a), naive_shingles(b)
        off.append(likeness(Document(a, 5).lanes(), Document(b, 5).lanes()) - len(x & y) / len(x | y))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_quality_terms_are_those_of_a_loop():
    from chirpsieve.llm import quality

    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", None, ".,;:", "!?", "|", "%&$#*"]

    def kind(c):
        return 5 if c >= 128 else next((i for i, k in enumerate(kinds) if k and chr(c) in k), 10)

    for text in (b"", b"a", b"The cat, the cat | 12% of it!\n\n", "é à ß -- ok".encode(), b"x x x x"):
        want = np.zeros(quality.TERMS)
        for i in range(len(text) - 2):
            x, y, z = map(kind, text[i : i + 3])
            want[(x * 12 + y) * 12 + z] += 1 / len(text)
        ws = text.split()
        for a, b in zip(ws, ws[1:]):
            want[12**3] += (a == b) / len(ws)
        for w in text.lower().split() if text.isascii() else [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in ws]:
            want[12**3 + 1 + zlib.crc32(w) % 1024] += 1 / len(ws)
        want = np.sqrt(want)
        want[12**3 + 1 :] *= 0.5
        np.testing.assert_allclose(quality.terms(text), want, atol=1e-6)


def plain_entities(text):
    """Addresses, keys and card numbers among the words of a text, without a pattern."""
    for word in (text or "").split():
        w = word.strip(".,;:!?()\"'")
        local, at, host = w.partition("@")
        if at and local and "." in host and all(p and all(c.isalnum() or c == "-" for c in p) for p in host.split(".")) and w.isascii() and all(c.isalnum() or c in "._%+-" for c in local):
            yield w
        if len(w) == 20 and w[:4] in ("AKIA", "ASIA") and w.isalnum() and w.upper() == w and w.isascii():
            yield w
        parts = w.split(".")
        if len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) < 4 and int(p) < 256 for p in parts):
            yield w
        if len(w) == 16 and w.isdigit() and w.isascii() and w[0] in "23456" and sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(w)) % 10 == 0:
            yield w


def test_entities_that_plain_code_finds_are_gone(spark):
    from chirpsieve.llm import pii

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    old = {r.doc_id: r.text for r in docs.collect()}
    new = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    found = {d: set(plain_entities(t)) for d, t in old.items()}
    assert sum(map(len, found.values())) > 20
    for d, words in found.items():
        kept = words & set(plain_entities(new[d].text))
        assert not kept, (d, kept)
        if new[d].n_entities == 0:
            assert new[d].text == old[d] and not words


def test_columns_that_operators_make_raise(spark):
    from chirpsieve.llm import media, mixing, quality

    df = spark.createDataFrame([(1, "a b", "s", 1, 2, "z")], "doc_id long, text string, source string, mx_k1 int, score int, media_type string")
    with pytest.raises(ValueError):
        mixing.mixed_texts(df)
    assert mixing.mixed_texts(df.drop("mx_k1")).columns == ["doc_id", "text", "source", "score", "media_type"]
    with pytest.raises(ValueError):
        quality.score(df, {"z": np.zeros((0, 1)), "y": [], "map": None}, ["doc_id", "score"])
    with pytest.raises(ValueError):
        media.identify(df, "text", keep=["media_type"])


def test_sums_find_where_a_crc_ends():
    from chirpsieve.llm.media import crc16, same_sums

    b = bytes(np.random.default_rng(1).integers(0, 256, 40_000, dtype=np.uint8))
    for p in (0, 7, 39_000):
        for q in (p + 5, p + 900):
            mended = b[:q] + crc16(b[p:q]).to_bytes(2, "big") + b[q + 2 :]
            s = same_sums(mended)
            assert s[p] == s[q + 2] and crc16(mended[p : q + 2]) == 0
    s = same_sums(b)
    assert all((s[5] == s[q]) == (crc16(b[5:q]) == 0) for q in range(6, 400))


def test_hostile_bytes_take_no_square_of_their_length():
    import time

    from chirpsieve.llm import media

    a = media.automaton()
    frame = next(media.built("flac", b"xyz" * 9)[i:] for i in [media.built("flac", b"xyz" * 9).find(b"\xff\xf8")])
    head = media.built("flac", b"xyz" * 9)[:42]
    for unit in (b"GIF89a" + bytes(7) + b"!\xfe\x05", b"\xff\xd8\xff\xda\0\x04..", head + frame[:-2] + b"??", head + frame[:6] + bytes(60), b"fLaC"):
        took = []
        for n in (100_000, 800_000):
            b = unit * (n // len(unit))
            t = time.process_time()
            media.sniff(b, a)
            took.append(time.process_time() - t)
        assert took[1] < 20 * max(took[0], 0.1), (unit[:12], took)
    # media within and behind rubbish are found as before
    parts = [media.built(k, b"hello " * 20) for k in ("wav", "png", "gif", "jpeg", "bmp", "flac")]
    junk = b"GIF89a fLaC \xff\xd8\xff BM RIFF"
    at, want = 0, []
    blob = b""
    for kind, x in zip(("wav", "png", "gif", "jpeg", "bmp", "flac"), parts):
        blob += junk
        want.append((kind, len(blob), len(x)))
        blob += x
    assert [w for w in media.sniff(blob, a) if w[0] != "flac"] == want[:-1] and media.sniff(blob, a)[-1][:2] == want[-1][:2]


def test_flacs_of_short_texts_are_cheap():
    """What doesn't depend on a value is made once: 2,000 took 10 s when each made the table of powers."""
    import time

    from chirpsieve.llm import media

    a, begun = media.automaton(), time.time()
    for i in range(2000):
        blob = media.built("flac", f"text {i}".encode())
        assert media.sniff(b"x" + blob, a) == [("flac", 1, len(blob))]
    assert time.time() - begun < 4
