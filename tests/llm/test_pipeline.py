"""The stages of corpus_pipeline on small tables."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tesselon.llm import minhash, mixing, toxicity


@pytest.fixture(scope="module")
def states(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def test_columns(states):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "decontaminate", "mix_sources"]
    assert all(s.columns == states[0].columns and s.schema == states[0].schema for s in states[1:-1])


def test_decisions_take_effect(states, spark, sf):
    docs, calm, lines, single, clean, mixed = states
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels)
    assert {r.doc_id for r in calm.collect()} == {r.doc_id for r in scored.where("toxicity < 0.7").collect()}
    assert lines.count() == calm.count() and lines.agg(F.sum(F.length("text"))).first()[0] <= calm.agg(F.sum(F.length("text"))).first()[0]
    assert minhash.near_duplicates(single).where("NOT kept").count() == 0 and single.count() < lines.count()
    assert clean.count() <= single.count()
    assert mixed.where("taken > size OR taken <= 0 OR epoch > 1").count() == 0
    budget = 1.5 * clean.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert mixed.select("source", "target").distinct().agg(F.sum("target")).first()[0] == pytest.approx(budget)
    assert mixed.agg(F.sum("taken")).first()[0] == pytest.approx(budget, abs=5 * 10)


def test_run_agrees(states, spark, sf):
    key = lambda df: sorted((r.doc_id, r.epoch, r.taken, r.text) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(states[-1])


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def brute_force(rows: list[tuple], toxic: set, items: list[str]) -> dict:
    """(doc_id, text) that each stage but the last keeps, by plain comparison; toxic are the ids that the first rejects."""
    now, out = [r for r in rows if r[0] not in toxic], {}
    out["toxicity"] = now
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    holders = defaultdict(set)
    for i, t in now:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    common = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    now = [(i, t if t is None else "\n".join(x for x in t.split("\n") if common.get(key(x), i) == i)) for i, t in now]
    out["line_dedup"] = now

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in now]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    now = [(i, t) for i, t in now if root(i) == i]
    out["minhash_near_dedup"] = now

    def holds(t, item):  # words are only ever replaced here
        w, own = (t or "").lower().split(), item.split()
        return any(sum(a == b for a, b in zip(w[k:], own, strict=False)) > 0.8 * len(own) for k in range(len(w)))

    out["decontaminate"] = [(i, t) for i, t in now if not any(holds(t, item) for item in items)]
    return out


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [prose(25) for _ in range(6)]
    line, rows = prose(15), []
    for i in range(150):
        text = prose(rng.randint(20, 80)) + "\n" + prose(rng.randint(1, 40))
        if i % 8 == 0:
            text += "\n " + line + " \n" + prose(4)
        if i % 10 == 3:
            w = rows[-1][1].split(" ")
            w[len(w) // 2] = "edited"
            text = " ".join(w)
        if i % 15 == 7:
            text = prose(10) + " " + items[i % 6] + " " + prose(9)
        if i % 9 == 4:
            text = "you idiot. " + text + " you moron, you scum"
        rows.append((i, text))
    rows += [(150, None), (151, ""), (152, rows[5][1]), (153, "x " * 30_000)]
    full = [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int((t or "").startswith("you idiot"))) for i, t in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    expected = brute_force(rows, {i for i, _, toxic in labels if toxic}, items)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(expected[name]), name
    taken = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        taken[r.doc_id] += r.taken
    assert taken == {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect() if r.taken}


def test_odd_rows(spark, sf):
    """Nulls, repeated ids with other texts, and further columns with clashing names go through every stage."""
    rows = [(None, None, None, None, None), (1, "some words here", "en", "s", 15), (1, "quite other words than before", None, "s", 29), (1, "some words here", "en", "s", 15), (2, "", "en", None, 0), (3, "a" * 100_000 + " b", "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("mine") for c in ("_gone", "_source", "_cell", "score", "kept", "toxicity_", "key", "grp")})
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        got = docs.collect()
        assert all(r["_gone"] == r["_source"] == r["key"] == "mine" for r in got)
        if "taken" not in docs.columns:
            assert len(got) == len(rows)
    assert {r.doc_id for r in got} <= {1, 3} and sum(r.taken for r in got) > 0
