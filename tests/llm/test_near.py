"""Near-duplicate documents, lines and vectors against brute force, and the pipeline."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threatflow.llm import covertree, lines, minhash, shared
from threatflow.llm.queries import op2, op3, op4

SF = "/root/testdata/sf0.001"


def joined(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("tied", [0, 5, 1000])
def test_components(spark, monkeypatch, tied):
    """In one task, by rounds of stars, and by both."""
    monkeypatch.setattr(shared, "TIED", tied)
    random.seed(4)
    links = [(random.randrange(90), random.randrange(90)) for _ in range(50)] + [(i, i + 1) for i in range(200, 240)]
    links += [(300, i) for i in range(301, 320)] + [(7, 7)]
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    roots = joined(nodes, [x for x in links if x[0] != x[1]])
    assert got == roots


def shingle_set(text, size=2):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def alike(a, b, percent=80):
    return bool(a) and 100 * len(a & b) >= percent * len(a | b)


def document_components(rows, size=2):
    sets = {d: shingle_set(t, size) for d, t in rows if d is not None}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if alike(sets[a], sets[b])]
    return sets, joined(ids, links)


def check_documents(got, rows, size=2):
    sets, roots = document_components(rows, size)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), roots[r.doc_id])
        assert r.kept == (r.doc_id is not None and r.component_id == r.doc_id)


def test_documents_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_documents(op3(spark, SF).collect(), rows)


def test_documents_of_all_kinds(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_documents(minhash.near_duplicates(docs).collect(), rows)
    assert minhash.near_duplicates(docs.where("1 = 0")).count() == 0


def test_large_groups_are_settled_in_blocks(spark, monkeypatch):
    """Chains and tight groups, with blocks and buckets far smaller than the groups."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "BUCKET", 3)
    random.seed(3)
    base = [f"t{i}" for i in range(60)]
    rows, text = [], base[:]
    for i in range(40):  # a chain: each differs from the one before by one word
        text = text[:]
        text[random.randrange(60)] = f"c{i}"
        rows.append((i, " ".join(text)))
    for i in range(40, 70):  # a tight group
        text = base[:]
        text[i % 60] = f"d{i}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    check_documents(minhash.near_duplicates(df).collect(), rows)
    check_documents(minhash.near_duplicates(df, size=5).collect(), rows, 5)


def test_large_buckets_stay_in_bounded_groups(spark, monkeypatch):
    """Versions of a template that are alike but not close, so that nearly every one is a hub."""
    sizes, grouped = [], minhash._grouped

    def counted(rows, key="g"):
        sizes.append(rows.groupBy(key).count().agg(F.max("count")).first()[0])
        return grouped(rows, key)

    monkeypatch.setattr(minhash, "BUCKET", 50)
    monkeypatch.setattr(minhash, "_grouped", counted)
    random.seed(8)
    rows = []
    for i in range(600):
        words = [f"t{j}" for j in range(60)]
        for j in random.sample(range(60), 2):
            words[j] = f"v{random.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    schema = "doc_id bigint, n bigint, key binary, est binary, bands array<bigint>"
    nodes = shared.saved(df.mapInArrow(minhash._sketches(2), schema))
    full = nodes.select(F.explode("bands").alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
    assert full > 200
    found = {bytes(r.node): bytes(r.root) for r in shared.components(minhash.candidates(nodes)).collect()}
    assert max(sizes) <= 100
    keys = {r.doc_id: bytes(r.key) for r in nodes.collect()}
    _, roots = document_components(rows)
    assert sum(d != r for d, r in roots.items()) > 300
    assert all(found.get(keys[d], keys[d]) == found.get(keys[r], keys[r]) for d, r in roots.items())


def test_estimates_are_near_the_truth():
    words = [f"a{i}" for i in range(1500)]
    a = minhash.registers(minhash.shingles(" ".join(words[:1000])))
    b = minhash.registers(minhash.shingles(" ".join(words[200:1200])))
    assert abs(minhash.estimates(a, b[None, :])[0] - 799 / 1199) < 0.12


def removed_places(rows, percent=80):
    first, placed = {}, []
    for d, text in sorted(set(rows), key=lambda r: (r[0], r[1] or "")):
        for n, line in enumerate((text or "").split("\n")):
            s = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            if s:
                placed.append((d, n, s))
                first[s] = min(first.get(s, (d, n)), (d, n))
    order = sorted(first, key=first.get)
    near = {s for i, s in enumerate(order) if any(alike(s, t, percent) for t in order[:i])}
    return {(d, n) for d, n, s in placed if s in near or first[s] != (d, n)}


def test_lines_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = removed_places(rows)
    got = op4(spark, SF).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, int(n)) for r in got for n in r.removed_lines.split(",") if n} == want
    assert all(r.n_lines == len(t.split("\n")) for r in got for d, t in rows if d == r.doc_id)


def test_many_versions_of_a_line(spark):
    """Versions that are alike in a chain, so that a likely partner often proves unlike."""
    random.seed(11)
    rows, words = [], [f"w{i}" for i in range(12)]
    for i in range(150):
        words = words[:]
        words[random.randrange(12)] = f"v{random.randrange(40)}"
        rows.append((i, " ".join(words) + "\n" + " ".join(random.sample(words, 3)) + "\n \n"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, n) for r in lines.later_lines(df).collect() for n in r.removed or ()}
    assert got == removed_places(rows)


def test_dedup_keeps_rows_and_first_lines(docs):
    got = lines.dedup(docs).collect()
    assert len(got) == docs.count()
    gone = removed_places([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    was = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        text = was[r.doc_id]
        want = text if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (r.doc_id, n) not in gone)
        assert r.text == want and r._range == "kept"
    assert lines.dedup(docs.where("1 = 0")).count() == 0


def test_texts_that_share_a_key_keep_their_own_lines(spark):
    """A line that occurs once stays, whatever lines other rows of its key lose."""
    rows = [
        (1, "alpha beta gamma\nkeep me one two"), (1, "other words here now\nalpha beta gamma"), (1, None),
        (2, "keep this\nalpha beta gamma\nand this"), (3, "x"), (3, "x"), (3, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'a' AS _no", "'b' AS removed_", "1 AS _place")
    got = sorted((r.doc_id, r.text or "") for r in lines.dedup(df).collect())
    alpha = [t for i, t in got if i == 1]
    assert sum("alpha beta gamma" in t for t in alpha) == 1
    assert any("keep me one two" in t for t in alpha) and any("other words here now" in t for t in alpha)
    assert [t for i, t in got if i == 2] == ["keep this\nand this"] and [t for i, t in got if i == 3] == ["x"] * 3


def test_rarity_fits_into_levels(spark, monkeypatch):
    """More octaves than levels: the rarest words share one, the result is the same."""
    monkeypatch.setattr(lines, "LEVELS", 2)
    rows = [(i, "very common " * 3 + f"word{i % 7} some{i % 3} other{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, n) for r in lines.later_lines(df).collect() for n in r.removed or ()}
    assert got == removed_places(rows)


def check_vectors(got, rows, threshold=0.93):
    good = {}
    for i, v, label in rows:
        x = None if v is None or any(c is None for c in v) else np.array(v, float)
        if label is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            good[i] = (label, x)
    ids = sorted(good)
    links = []
    for a in ids:
        for b in ids:
            (la, x), (lb, y) = good[a], good[b]
            if b < a and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links.append((a, b))
    roots, degree = joined([r[0] for r in rows], links), {}
    for a, b in links:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (degree.get(r.vec_id, 0), roots[r.vec_id], roots[r.vec_id] == r.vec_id)


def test_vectors_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 25)
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for label in (0, 1, 2):
        for _ in range(8):
            centre = rng.normal(size=8)
            for _ in range(8):
                rows.append((i, [float(c) for c in np.float32(centre + rng.normal(size=8) * 0.25)], label))
                i += 1
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [nan] * 8, [inf] + [0.0] * 7, [1.0, 2.0], [2.0, 4.0], rows[0][1], rows[0][1]]
    rows += [(i + k, v, 0) for k, v in enumerate(odd)] + [(i + 20, rows[0][1], None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("cell", F.lit(1))
    check_vectors(covertree.near_vectors(df).collect(), rows)
    assert covertree.near_vectors(df.where("1 = 0")).count() == 0


def test_vectors_of_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_vectors(op2(spark, SF).collect(), rows)


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    folder, found = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        found.append(docs)
    return found


def test_stages_take_effect(spark, staged):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good, cleaned, kept, mixed, coded = staged
    assert all(s.columns == docs.columns for s in staged[:4])
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    assert good.count() < docs.count()
    clean = docs.join(labels, "doc_id").count()
    assert good.join(labels, "doc_id").count() >= 0.98 * clean

    before = [(r.doc_id, r.text) for r in good.collect()]
    gone = removed_places(before)
    after = {r.doc_id: r for r in cleaned.collect()}
    for d, text in before:
        assert after[d].text == "\n".join(x for n, x in enumerate(text.split("\n")) if (d, n) not in gone)
        assert after[d].n_chars == len(after[d].text)

    _, roots = document_components([(r.doc_id, r.text) for r in cleaned.collect()], 5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in roots.items() if d == r)

    size = lambda df: df.selectExpr("sum(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+'))").first()[0]
    assert math.isclose(size(mixed), size(kept), rel_tol=0.15)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert coded.count() == mixed.count() and coded.where("not restored").count() == 0


def test_run_gives_the_stages_rows(spark, staged):
    got = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, r.n_tokens) for r in df.collect())
    assert key(got) == key(staged[-1])
