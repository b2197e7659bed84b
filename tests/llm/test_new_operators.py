"""Whitening, fill-in-middle and fingerprints against brute force, and on rows that are odd in some way."""

import base64
import hashlib
import math
import random
import re
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.llm import fill_in_middle as fim
from tesselon.llm import fingerprints as fp
from tesselon.llm import embedding_dedup, secrets, whitening

BLANK = r"\x20\x09-\x0D"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def texts(seed: int = 5, n: int = 120) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = ["and", "é", "straße", "Ñandú", "it's", "日本語", "😀", "<P", "S>", "--"] + ["".join(rng.choice("abcdefgKT") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    blank = [" "] * 12 + ["\n", "\t ", "  ", "\r\n", "\x0b\x0c"]
    out: list[str | None] = ["".join(rng.choice(vocabulary) + rng.choice(blank) for _ in range(rng.randint(1, 300))) for _ in range(n)]
    out += [t.strip() for t in out[:20]] + [" " + t for t in out[20:30]]
    return out + [None, "", " ", "\n\n \t", "one", " one", "one ", "a b", "<P>", "in <M> the text", "\x00 \x1f\x00", "x" * 3000, "é" * 40 + " " + "é" * 40, "- " * 200]


@pytest.fixture(scope="module")
def rows():
    return [(i * 3 - 9, t) for i, t in enumerate(texts())] + [(None, "without an id"), (None, None), (6, "twice"), (6, "twice")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()


def clashing(spark, rows, kinds="doc_id long, text string"):
    names = "n_tokens Form prefix_chars fim_text n n_chars edited_text fingerprint near_next id mark part tail to _vector vector dims Whitened deviation place component".split()
    return spark.createDataFrame(rows, kinds).withColumns({n: F.lit("mine") for n in names})


def test_base_spans_meet_candidates_in_order():
    """As every span against every run, and in a time that many findings of one text do not square."""
    rng = random.Random(6)
    for _ in range(60):
        cuts = sorted(rng.sample(range(200), 2 * rng.randint(0, 12)))
        runs = list(zip(cuts[::2], cuts[1::2], strict=True))
        base = sorted((a, rng.randrange(3), a + rng.randint(1, 40)) for a in rng.sample(range(200), rng.randint(0, 9)))
        low, high, met = secrets.meetings(base, runs)
        for (a, _, b), i, j in zip(base, low, high, strict=True):
            assert [r for r in runs if r[0] < b and a < r[1]] == runs[i:j]
        assert met.tolist() == [any(a < end and start < b for start, _, end in base) for a, b in runs]
    text = b" ".join(b"password = %012dabcdef" % i for i in range(20_000))
    data = np.frombuffer(text, np.uint8)
    began = time.time()
    _, starts, ends = secrets.candidates(data, np.array([0, len(data)]))
    runs = list(zip(starts.tolist(), ends.tolist(), strict=True))
    found = secrets.base_spans(text, runs)
    assert len(found) == 20_000 and secrets.meetings(found, runs)[2].all() and time.time() - began < 5


@pytest.mark.parametrize(("kind", "labels"), [("double", [1.2, 1.7, None]), ("string", ["1", "a", "a ", None]), ("long", [1, 2, None])])
def test_vectors_by_labels_as_they_are(spark, kind, labels):
    vectors = [[1.0, 0.0], [0.999, 0.01], [1e-200, 1e-203], [1e200, 0.0], [0.0, 5e-324], [0.0, 1.0]]
    rows = [(10 * i + k, v, x) for i, x in enumerate(labels) for k, v in enumerate(vectors)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
    for i, x in enumerate(labels):
        alone = x is None
        assert [got[10 * i + k] for k in range(6)] == [(0, 10 * i + k) if alone else (3, 10 * i) if k < 4 else (1, 10 * i + 4) for k in range(6)]


# --- fill in the middle --------------------------------------------------------------------------


def cut_by_regex(text: str, key, seed: int = 42, percent: int = 50, spm: int = 80) -> tuple:
    tokens = re.findall(rf"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+", text)
    digest = sha(f"{seed}:{'' if key is None else key}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("seed", "percent", "spm"), [(42, 50, 80), (7, 100, 50), (7, 0, 50)])
def test_fill_in_middle(docs, rows, seed, percent, spm):
    expected = Counter((k, *cut_by_regex(t or "", k, seed, percent, spm)) for k, t in rows)
    out = fim.fill_in_middle(docs, seed=seed, percent=percent, spm_percent=spm)
    assert Counter((r.doc_id, r.n_tokens, r.form, r.prefix_chars, r.middle_chars, r.fim_text) for r in out.collect()) == expected
    assert {k[2] for k in expected} == ({"plain"} if not percent else {"plain", "psm", "spm"})
    restored = out.select("text", fim.restore(F.col("fim_text"), F.col("form")).alias("again")).collect()
    assert all((r.text or "") == r.again for r in restored)


def test_masks_of_long_texts():
    rng = random.Random(3)
    for length in (1, 2, 63, 64, 65, 1000, 300_000):
        text = "".join(rng.choice("ab é\n") for _ in range(length))
        ends = [m.end() for m in re.finditer(rf"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+", text)]
        data = text.encode()
        mask = fim.token_ends(data)
        assert mask.bit_count() == len(ends)
        for k in {1, len(ends), (len(ends) + 1) // 2}:
            assert len(data[: fim.nth_bit(mask, len(data), k) + 1].decode()) == ends[k - 1]
    big = ("word " * 400_000).encode()
    assert fim.transform(big, 1, 1, 100, 50)[0] == 400_001


def test_fill_in_middle_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert fim.fill_in_middle(spark.createDataFrame([], schema)).count() == 0
    out = fim.fill_in_middle(clashing(spark, [(1, "a b c"), (None, None)]))
    assert {r.n_tokens for r in out.collect()} == {0, 3} and out.columns.count("form") == 1 and "Form" not in out.columns
    assert {r.mark for r in out.collect()} == {"mine"}
    assert [r.n_tokens for r in fim.fill_in_middle(spark.createDataFrame([("k", "x y")], "doc_id string, text string")).collect()] == [2]


# --- fingerprints --------------------------------------------------------------------------------


def step_of(window: bytes) -> int:
    total = sum(round(c * math.log2(c) * 2**20) for c in Counter(window).values())
    most = round(fp.WINDOW * math.log2(fp.WINDOW) * 2**20)
    return (most - total) * fp.STEPS // most


def features_by_force(text: bytes, rank) -> list[bytes]:
    """In their order, each once."""
    n = len(text) - fp.WINDOW + 1
    if n < 1:
        return [text] if text else []
    keys = [(rank[step_of(text[i : i + fp.WINDOW])], i) for i in range(n)]
    wins = Counter(min(keys[max(0, s) : s + fp.NEIGHBOURS])[1] for s in range(1 - fp.NEIGHBOURS, n))
    return list(dict.fromkeys(text[i : i + fp.WINDOW] for i in sorted(wins) if wins[i] >= fp.LEAST_WINS))


def likeness_by_force(a: list[int], b: list[int]) -> float:
    """Chains as lists of whole numbers."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)

    def score(f, g):
        if f == g:
            return 1.0
        x, y = f.bit_count(), g.bit_count()
        chance = x * y / fp.BITS
        least = chance + fp.CHANCE_MARGIN * (min(x, y) - chance)
        return min(1.0, max(0.0, ((f & g).bit_count() - least) / (min(x, y) - least)))

    return sum(f.bit_count() * max(score(f, g) for g in b) for f in a) / sum(f.bit_count() for f in a)


def numbers(fingerprint: str) -> list[int]:
    data = base64.b64decode(fingerprint)
    return [int.from_bytes(data[i : i + fp.BITS // 8], "big") for i in range(0, len(data), fp.BITS // 8)]


@pytest.fixture(scope="module")
def rarity(rows):
    counts = np.zeros(fp.STEPS + 1, np.int64)
    for _, t in rows:
        t = (t or "").encode()
        for i in range(len(t) - fp.WINDOW + 1):
            counts[step_of(t[i : i + fp.WINDOW])] += 1
    return counts


def test_rarity_counts_all_windows(docs, rarity, monkeypatch):
    assert fp.fit_rarity(docs).tolist() == rarity.tolist()
    monkeypatch.setattr(fp, "BLOCK", 77)
    assert fp.fit_rarity(docs).tolist() == rarity.tolist()


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_features(rows, rarity, monkeypatch, block):
    monkeypatch.setattr(fp, "BLOCK", block)
    rank = fp.ranks(rarity)
    data = [(t or "").encode() for _, t in rows]
    expected = [features_by_force(t, rank) for t in data]
    row, hashes = fp.features(data, rank)
    counts = np.bincount(row, minlength=len(data))
    assert counts.tolist() == [len(e) for e in expected]
    known: dict[int, tuple] = {}
    for h, (size, f) in zip(hashes.tolist(), ((min(len(t), fp.WINDOW), f) for t, e in zip(data, expected, strict=True) for f in e), strict=True):
        assert known.setdefault(h, (size, f)) == (size, f)
    assert len(set(known.values())) == len(known)
    for t, chain, e in zip(data, fp.chains(data, rank), expected, strict=True):
        assert len(chain) == -(-len(e) // fp.CAPACITY)
        alone = fp.chains([t], rank)[0]
        assert alone.tobytes() == chain.tobytes()


def test_compare_with_next(spark, docs, rows, rarity):
    rank = fp.ranks(rarity)
    got = {}
    for r in fp.compare_with_next(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    order = sorted((x for x in rows if x[0] is not None), key=lambda x: -x[0])
    nulls = [r for r in got[None]]
    assert Counter(r.n_chars for r in nulls) == Counter([13, 0])
    chain = lambda t: numbers(fp.to_text(fp.chains([t.encode()], rank)[0]))
    for (key, text), (_, after) in zip(order, order[1:], strict=False):
        if key == 6 or after is None:  # texts of one id are tried below
            continue
        (r,), text, after = got[key], text or "", after or ""
        made = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert (r.n_chars, r.edited_text, numbers(r.fingerprint), numbers(r.edited_fingerprint)) == (len(text), made, chain(text), chain(made))
        assert r.near_edited == pytest.approx(likeness_by_force(chain(text), chain(made)), abs=1e-12)
        if sum(k == _ for k, _t in rows) == 1:
            assert r.near_next == pytest.approx(likeness_by_force(chain(text), chain(after)), abs=1e-12)
    for seen in (r for rs in got.values() for r in rs):
        assert 0 <= seen.near_edited <= 1 and 0 <= seen.near_next <= 1


def test_order_of_repeated_and_missing_ids(spark, monkeypatch):
    """Every row has one next row, in a circle, however many parts there are."""
    rows = [(k, f"{k} {i} " + "abc" * i) for k in (5, 3, None) for i in range(4)] + [(9, "the first"), (-4, "the last before those without id")] + [(7, "same text")] * 5
    for parts in (1, 4, 40):
        monkeypatch.setattr(fp, "PARTS_PER_PARTITION", parts)
        out = fp.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert Counter(r.doc_id for r in out) == Counter(k for k, _ in rows)
        heads = Counter(t for _, t in rows)
        for r in out:
            third = r.n_chars // 3
            assert any(t[:third] == r.edited_text[r.n_chars - third :][:third] or t == r.edited_text[r.n_chars - third :] for t in heads)
        first = next(r for r in out if r.doc_id == 9)
        assert first.edited_text == "the fisam" and sorted(r.near_next for r in out if r.doc_id == 7)[-4:] == [1.0] * 4
        last = [r for r in out if r.doc_id is None and r.edited_text.endswith("the first"[: r.n_chars // 3])]
        assert len(last) >= 1


def test_fingerprints_of_odd_tables(spark, docs):
    schema = "doc_id long, text string"
    assert fp.compare_with_next(spark.createDataFrame([], schema)).count() == 0 and fp.fingerprints(spark.createDataFrame([], schema)).count() == 0
    (one,) = fp.compare_with_next(spark.createDataFrame([(1, "abcdef")], schema)).collect()
    assert (one.edited_text, one.near_next) == ("abcdab", 1.0)
    (one,) = fp.compare_with_next(spark.createDataFrame([(None, None)], schema)).collect()
    assert (one.n_chars, one.edited_text, one.fingerprint, one.near_edited, one.near_next) == (0, "", "", 1.0, 1.0)
    made = fp.fingerprints(clashing(spark, [(1, "some words that are long enough"), (2, "some words that are long enough")]))
    assert len({r.fingerprint for r in made.collect()}) == 1 and {r.mark for r in made.collect()} == {"mine"}
    assert fp.compare_with_next(clashing(spark, [(1, "x"), (2, None)])).count() == 2
    like = made.select(fp.likeness(F.col("fingerprint"), F.col("fingerprint")).alias("l"), fp.likeness(F.col("fingerprint"), F.lit(None).cast("string")).alias("n")).collect()
    assert {(r.l, r.n) for r in like} == {(1.0, None)}


def test_likeness_tells_edited_texts_from_others(spark, sf):
    out = fp.digest(spark.read.parquet(f"{sf}/documents.parquet")).where("n_chars >= 300").collect()
    assert sorted(r.near_edited for r in out)[len(out) // 50] > 0.25
    assert sum(r.near_next > 0.25 for r in out) < len(out) / 25
    assert fp.chain_likeness(*(fp.chains([t * 20000], fp.ranks(np.zeros(fp.STEPS + 1)))[0] for t in (b"abcdefghijklmnopqrstuvwxyz12", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ12"))) == 0.0


# --- whitening -----------------------------------------------------------------------------------


def test_symmetric_qr():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 65):
        for a in (rng.standard_normal((n, 2 * n)), rng.standard_normal((n, max(1, n // 2))), np.eye(n), np.zeros((n, n)), np.diag(np.arange(n) % 3.0)):
            a = a @ a.T
            values, vectors = whitening.symmetric_qr(a)
            assert values == pytest.approx(np.linalg.eigvalsh(a)[::-1], abs=1e-12 * max(1.0, np.abs(a).max() * n))
            assert np.abs(vectors @ vectors.T - np.eye(n)).max() < 1e-12
            assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-11 * max(1.0, np.abs(a).max() * n)


def expected_whitening(vectors: list[list[float]], k: int):
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n = len(x)
    sums = [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in x])
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, deviation, centred @ axes / np.sqrt(values), values / np.trace(covariance)


@pytest.mark.parametrize(("n", "dims", "fan"), [(300, 12, 2), (300, 12, 16), (40, 3, 3)])
def test_whitening(spark, monkeypatch, n, dims, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    rng = np.random.default_rng(2)
    data = (rng.standard_normal((n, dims)) * np.linspace(3, 0.2, dims) + 5).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    odd = [(900, None), (901, [None] + [1.0] * (dims - 1)), (902, [math.nan] * dims), (903, [math.inf] + [0.0] * (dims - 1)), (904, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(7)
    out = whitening.digest(table).collect()
    count, deviation, white, explained = expected_whitening(data.astype(float).tolist(), 8)
    k = min(8, dims)
    assert len(out) == n * k and {r.n for r in out} == {count}
    got = np.full((n, k), np.nan)
    for r in out:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id] and r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-9
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-12


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.digest(spark.createDataFrame([], schema)).count() == 0
    assert whitening.digest(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    alone = whitening.digest(spark.createDataFrame([(1, [0.5, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(alone, key=lambda r: r.component)] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    flat = whitening.digest(spark.createDataFrame([(None, [float(i), 7.0]) for i in range(9)], schema)).collect()
    assert len(flat) == 18 and {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)}
    mixed = [(i, [float(i * i % 11)] * 2 + [float(i)]) for i in range(20)] + [(100 + i, [float(i), float(-i * i % 7)]) for i in range(10)]
    seen = whitening.digest(spark.createDataFrame(mixed, schema)).collect()
    assert {(r.vec_id >= 100, r.n) for r in seen} == {(False, 20), (True, 10)} and all(r.identity_error < 1e-9 for r in seen)
    huge = [(i, [1e15 * (i % 5), float(i)]) for i in range(12)] + [(50, [1e30, 1.0])]
    far = {r.vec_id: r for r in whitening.digest(spark.createDataFrame(huge, schema)).collect()}
    x = [[math.floor(1024 * c) for c in v] for _, v in huge[:12]]
    exact = [sum((12 * c - s) ** 2 for c, s in zip(v, map(sum, zip(*x, strict=True)), strict=True)) for v in x]
    assert set(far) == set(range(12))
    kept = whitening.whiten(spark.createDataFrame(huge, schema)).collect()
    assert [int(r.deviation) if r.deviation is not None else None for r in sorted(kept, key=lambda r: r.vec_id)] == [e if e < 10**38 else None for e in exact]
    clash = clashing(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0])], schema)
    out = whitening.whiten(clash, vector_column="embedding")
    assert {r["_vector"] for r in out.collect()} == {"mine"} and "Whitened" not in out.columns and out.count() == 3
