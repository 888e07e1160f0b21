"""BPE, the quality model and the URL filter."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from threatflow.llm import bpe, quality, urls
from threatflow.llm.queries import URL_RULES, op6, op7

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
CONTENT = bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_halves_join_to_the_librarys_ids(library, monkeypatch):
    random.seed(5)
    parts = ["a", "b", "'", "re", "'ll", " ", "  ", "\n", "1", "23", ".", "é", "日", " ", "th", "'v", "'s", "\t", "😀"]
    for _ in range(800):
        monkeypatch.setattr(bpe, "LEAF", random.choice([2, 3, 5, 8]))
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 60)))
        ids = list(bpe.encode_text(text, CONTENT, public_tokenizers.PATTERN))
        assert ids == library.encode_ordinary(text)
        assert bpe.decode_ids(ids, bpe._tokens(CONTENT)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 9000, " " * 9000 + "x", "ab'" * 4000, "\n \n" * 4000, "xyzw" * 4000 + " 1"])
def test_long_pieces(library, text):
    assert list(bpe.encode_text(text, CONTENT, public_tokenizers.PATTERN)) == library.encode_ordinary(text)


def test_columns_of_all_kinds_of_texts(docs, library):
    coded = docs.withColumn("ids", bpe.encode(F.col("text"), CONTENT, public_tokenizers.PATTERN))
    got = coded.withColumn("back", bpe.decode(F.col("ids"), CONTENT)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    assert coded.where("1 = 0").count() == 0


def test_additive_model_learns_lines_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((6000, 4))
    y = ((x[:, 0] > 0.6) | ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5))).astype(float)
    model = quality.Additive().fit(x[:4000], y[:4000])
    assert (1, 2) in model.pair_tables
    assert ((model.scores(x[4000:]) >= 0.5) == y[4000:]).mean() > 0.95


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op7(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.95


def test_quality_without_labels_or_classes(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None), (99, 0)], "doc_id bigint, quality int")
    for labels, good in ((none, 0.5), (one, 0.6)):
        model = quality.train(docs, labels)
        scores = [r[0] for r in docs.select(quality.score(F.col("text"), model)).collect()]
        assert len(scores) == docs.count() and all(s >= good for s in scores)


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def ruled(host, path):
    fits = [
        r for r in URL_RULES
        if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])
    ]
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme/at all", "http://", "HTTP://WWW.Example.ORG/en/12?x=1&y=2#z", "https://a.example.org/es/1", "x://org",
    "https://org/", "https://notorg/", "https://a.com/fr/?q", "https://a.com/de/1", "https://a.com/en/1", "https://ex.net?a/b",
    "https://example.org:80/en/1", "https://é.İ.com/de/ü", "https://example.org/en/1", "http://a.net/" + "long/" * 3000,
]


def test_urls_of_all_kinds(spark):
    rows = [(i, u, "old", 1.0) for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id int, url string, rule string, prediction double")
    got = urls.UrlFilter(URL_RULES, trees=3).fit(df).judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path) == split_url(r.url)
        assert r.rule == ruled(r.host, r.path)
        assert r.verdict == URL_RULES.get(r.rule, r.verdict) and r.verdict in ("allow", "block")
    none = df.where("1 = 0")
    assert urls.UrlFilter(URL_RULES).fit(none).judge(none).count() == 0


def test_copies_of_a_url_do_not_fill_the_sample(spark):
    """Each labelled URL has more copies than the sample has rows."""
    rules = {"good.org": "allow", "bad.org": "block"}
    links = [f"https://{h}.org/{w}/{i}" for i in range(10) for h, w in (("good", "read"), ("bad", "win-$$$-now-777"))]
    rows = [(u,) for u in links for _ in range(30)] + [("https://a.net/read/3",), ("https://b.net/win-$$$-now-777/3",)]
    df = spark.createDataFrame(rows, "url string")
    got = {r.url: r for r in urls.UrlFilter(rules, rows=20, trees=5).fit(df).judge(df).collect()}
    assert [got[u].verdict for u, in rows[-2:]] == ["allow", "block"]
    assert all(got[u].score is not None for u, in rows[-2:])


def test_suffixes_are_counted_over_all_labelled_rows(spark):
    """However few URLs the trees are fitted on."""
    rows = [(f"https://{h}/{i % 50}",) for i in range(200) for h in ("www.good.org", "a.bad.org", "b.ugly.net")]
    df = spark.createDataFrame(rows + [("https://free.org/",), (None,)], "url string")
    rules = {"good.org": "allow", "bad.org": "block", "ugly.net": "block"}
    model = urls.UrlFilter(rules, rows=12, trees=2).fit(df)
    got = {r.suffix: (r.blocked, r.f_suffix_rows) for r in model.suffixes.collect()}
    assert got == {"good.org": (0, 200), "bad.org": (200, 200), "ugly.net": (200, 200)} and model.mean == pytest.approx(2 / 3)


def test_a_urls_own_verdict_is_not_in_its_suffix_share(spark, monkeypatch):
    """Of suffixes with one URL each, the share tells nothing while training."""
    seen, fit = [], urls.GBTClassifier.fit

    def told(self, df, *more):
        seen.extend((r.features[urls.FEATURES.index("f_suffix")], r.features[urls.FEATURES.index("f_suffix_rows")]) for r in df.collect())
        return fit(self, df, *more)

    monkeypatch.setattr(urls.GBTClassifier, "fit", told)
    rows = [(f"https://host{i}.{'org' if i % 2 else 'net'}/a",) for i in range(40)] * 2
    model = urls.UrlFilter({"org": "allow", "net": "block"}, trees=2).fit(spark.createDataFrame(rows, "url string"))
    assert len(seen) == 40 and {(round(a, 9), b) for a, b in seen} == {(0.5, 0.0)}
    assert {r.f_suffix_rows for r in model.suffixes.collect()} == {2.0}


def test_rows_of_one_key_do_not_fill_the_training_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(7, f"text number {i}") for i in range(300)] + [(7, "the same")] * 300 + [(8, "other words")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0)], "doc_id bigint, quality int")
    held = {r.doc_id for r in docs.where(quality.held_out("doc_id")).collect()}
    sizes = []
    monkeypatch.setattr(quality.Additive, "fit", lambda self, x, y: sizes.append(len(x)) or self)
    quality.train(docs, labels, rows=10)
    assert sizes[0] <= 10 and (sizes[0] == 10) == (7 not in held)
    quality.train(docs, labels, rows=1000)
    assert sizes[1] == 301 * (7 not in held) + (8 not in held)


def test_url_trees_separate_labelled_urls(spark):
    got = op6(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all((r.score is None) == (r.rule is not None) for r in got)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = urls.UrlFilter(URL_RULES).fit(pages)
    labelled = [r for r in model.judge(pages).collect() if r.rule]
    free = urls.UrlFilter(URL_RULES).fit(pages)
    free.rules = {}
    guessed = {r.page_id: r.verdict for r in free.judge(pages).collect()}
    assert np.mean([guessed[r.page_id] == r.verdict for r in labelled]) > 0.9


def test_ids_of_halves_join_to_the_librarys_ids(library, monkeypatch):
    """Pieces without blanks, cut down to a few bytes, whose border windows have to grow."""
    monkeypatch.setattr(bpe, "LONG", 3)
    merges = bpe.Merges(CONTENT)
    rnd = random.Random(8)
    texts = ["a" * n for n in (1, 5, 64, 333)] + ["ab" * 77, "=" * 100, "日本語" * 30, "é" * 41]
    texts += ["".join(rnd.choices("abcdefghinorstu", k=rnd.randrange(1, 90))) for _ in range(300)]
    for text in texts:
        data = text.encode()
        assert merges.halved(data) == merges.merged([merges.bytes[b] for b in data])
    bpe._merges.cache_clear()
    for text in texts:
        assert list(bpe.encode_text(text, CONTENT, public_tokenizers.PATTERN)) == library.encode_ordinary(text)
