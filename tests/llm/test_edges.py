"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names; and each method's own parts."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from firmlens.llm import bpe, embed, html, licenses, lines, ngram_join, packing, pq, quality, runs, toxicity, urls, warc
from firmlens.llm.common import connected_components, extended
from firmlens.llm.queries import vocabulary

DOCS = "doc_id long, text string, source string, ids string, n_words string, kept string, toxicity string, n_lines string"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, source, "x", "x", "x", "x", "x") for i, t in enumerate(texts)], DOCS)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


LONG = prose(1, 30_000)
EDGES = [None, "", " \n\t ", "one", "one", prose(2, 200), prose(2, 200), LONG]


def test_bpe_edges(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary())
    odd = ["a<|endoftext|> b", "  x   y \n\n z", "don't it's' THE!!\nA.", "é́ 12½ ²", "日本語 テキスト😀", "a　b \x85c", "x" * 3000, "\n\n\nq \n w", "a b ", " a"]
    df = bpe.decode(bpe.encode(docs(spark, EDGES + odd), vocabulary()), vocabulary())
    for r in df.collect():
        assert r.ids == t.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert bpe.encode(docs(spark, []), vocabulary()).count() == 0


def test_bpe_random(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t, own, r = tokenizers.Tokenizer.from_file(vocabulary()), bpe.codec(vocabulary()), random.Random(5)
    for _ in range(3000):
        s = "".join(r.choice("ab eé'st.,!\n\t  0½日　|<>") for _ in range(r.randrange(30)))
        assert np.frombuffer(own.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s


def test_quality_edges(spark):
    got = {r.doc_id: r for r in quality.judge(docs(spark, EDGES)).collect()}
    assert [got[i].n_words for i in range(8)] == [0, 0, 0, 1, 1, 200, 200, 30_000]
    assert [got[i].kept for i in range(8)] == [False] * 5 + [True] * 3
    assert quality.judge(docs(spark, [])).count() == 0


def test_bad_host_goes(spark):
    good, bad = docs(spark, [prose(i, 60) for i in range(40)], "good"), docs(spark, ["junk"] * 200 + [prose(99, 60)], "bad")
    bad = bad.withColumn("doc_id", F.col("doc_id") + 1000)
    null = docs(spark, [prose(7, 60)], None).withColumn("doc_id", F.lit(5000).cast("long"))
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(good.unionByName(bad).unionByName(null)).collect()}
    assert got[1200] == (False, False) and got[0] == (False, True) and got[5000] == (False, True)
    few = {r.host: r.rate for r in quality.host_rates(spark.createDataFrame([("a", True)] + [("b", False)] * 50, "source string, base_failed boolean")).collect()}
    assert few["b"] < few["a"] < 1


def test_lines(spark):
    base = "the quick brown fox jumps over the lazy dog while many other animals look on in quiet amazement and do nothing about it at all today"
    near, other = base.replace("lazy", "hazy"), prose(3, 30)
    texts = [f"{base}\n{other}\nshort", f"x y z 1\n{near}\nshort", base, None, "", f"{prose(4, 25)}\n{prose(4, 25)}", LONG]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup(docs(spark, texts)).collect()}
    assert got[0] == (texts[0], 3, 0) and got[1] == ("x y z 1\nshort", 3, 1) and got[2] == ("", 1, 1)
    assert got[3] == (None, 0, 0) and got[4] == ("", 1, 0) and got[5] == (prose(4, 25), 2, 1) and got[6][2] == 0
    assert lines.dedup(docs(spark, [])).count() == 0
    corners = [set(b) for b in lines.BANDS]
    assert all(sum(x in b for b in corners) == 2 for x in range(lines.BINS)) and all(len(a & b) <= 1 for a in corners for b in corners if a is not b)


def test_lines_recall(spark):
    """Nearly all pairs of lines at or above the threshold are found; none below it joins."""
    r, rows = random.Random(11), []
    for i in range(120):
        w = prose(1000 + i, 40).split()
        rows.append(" ".join(w))
        w[r.randrange(40)] = "changed"
        rows.append(" ".join(w))

    def grams(s):
        return {s[k : k + lines.SHINGLE] for k in range(len(s) - lines.SHINGLE + 1)}

    same = [i for i in range(0, 240, 2) if len(grams(rows[i]) & grams(rows[i + 1])) >= 0.8 * len(grams(rows[i]) | grams(rows[i + 1]))]
    got = {x.doc_id: x.n_removed for x in lines.dedup(docs(spark, rows)).collect()}
    assert len(same) > 50 and sum(got[i + 1] for i in same) >= 0.97 * len(same)
    assert not any(got[i] for i in range(0, 240, 2)) and not any(got[i + 1] for i in range(0, 240, 2) if i not in same)


@pytest.mark.parametrize("times", [1, 8, 40, 200])
def test_lines_that_repeat_themselves(spark, times):
    """A unit repeated, and once more: equal or nearly equal shingle sets, and few of them for the lines' length."""
    r, rows = random.Random(times), []
    for i in range(100):
        unit = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(5, 9))) for _ in range(5)) + " "
        rows += [unit * times + unit[:1], unit * (times + 1) + unit[:1]] if i % 2 else [unit * times, unit * times + "end"]

    def grams(s):
        return {s[k : k + lines.SHINGLE] for k in range(len(s) - lines.SHINGLE + 1)}

    same = [i for i in range(0, 200, 2) if len(grams(rows[i]) & grams(rows[i + 1])) >= 0.8 * len(grams(rows[i]) | grams(rows[i + 1]))]
    got = {x.doc_id: x.n_removed for x in lines.dedup(docs(spark, rows)).collect()}
    assert len(same) >= 50 and sum(got[i + 1] for i in same) >= 0.97 * len(same)
    assert not any(got[i] for i in range(0, 200, 2)) and not any(got[i + 1] for i in range(0, 200, 2) if i not in same)


def template(r, n, shared, own):
    """`n` lines of `shared` words in common and `own` words each, in fixed places."""
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(4, 9))) for _ in range(3000)]
    common, places = [r.choice(words) for _ in range(shared + own)], r.sample(range(shared + own), own)
    return [[r.choice(words) if k in places else w for k, w in enumerate(common)] for _ in range(n)], places, words


def test_lines_of_one_template(spark):
    """Near copies are found where lines of the same boilerplate fill their buckets."""
    r = random.Random(3)
    base, places, words = template(r, 1500, 30, 9)
    copies = [list(w) for w in base[:150]]
    for w in copies:
        w[r.choice(places)] = r.choice(words)
    rows = [" ".join(w) for w in base + copies]

    def grams(s):
        return {s[k : k + lines.SHINGLE] for k in range(len(s) - lines.SHINGLE + 1)}

    same = [i for i in range(150) if len(grams(rows[i]) & grams(rows[1500 + i])) >= 0.8 * len(grams(rows[i]) | grams(rows[1500 + i]))]
    got = {x.doc_id: x.n_removed for x in lines.dedup(docs(spark, rows)).collect()}
    assert len(same) > 100 and sum(got[1500 + i] for i in same) >= 0.99 * len(same)


def kept_lines(rows, threshold=0.8):
    """Brute force: the first line of each component of rows whose shingle sets are similar enough."""
    from tests.llm.test_contracts import groups

    sets = [{s[k : k + lines.SHINGLE] for k in range(max(1, len(s) - lines.SHINGLE + 1))} for s in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) * (1 + threshold) >= threshold * (len(sets[i]) + len(sets[j])) - 1e-9]
    at = groups(range(len(rows)), pairs)
    return {i for i, c in at.items() if i == c}


def test_lines_of_families(spark):
    """Clusters of near copies and templated lines that share their buckets: against all pairs."""
    r, rows = random.Random(7), []
    for _ in range(12):
        base, places, words = template(r, 40, 24, 9)
        rows += [" ".join(w) for w in base]
        chain = list(base[0])
        for _ in range(15):
            chain[r.choice(places)] = r.choice(words)
            rows.append(" ".join(chain))
    for _ in range(20):
        line = prose(r.randrange(1 << 30), 30).split()
        for _ in range(25):
            line[r.randrange(30)] = "x" + str(r.randrange(100))
            rows.append(" ".join(line))
    r.shuffle(rows)
    want = kept_lines(rows)
    got = {x.doc_id for x in lines.dedup(docs(spark, rows)).collect() if not x.n_removed}
    assert len(rows) - len(want) > 300 and want <= got and len(got - want) <= 0.05 * (len(rows) - len(want))


def test_lines_few_exact_checks(spark, monkeypatch):
    """Bitmaps rule out most pairs of one template before the exact check, and none that is similar; no text of a line that meets none is stored."""
    r = random.Random(11)
    rows, common = [], prose(5, 22).split()
    for _ in range(40):
        rows.append(" ".join(common + [f"w{r.randrange(10**6)}" for _ in range(10)]))
    rows += [x + "y" for x in rows[:8]] + [prose(1000 + k, 30) for k in range(60)]
    sets = [{s[k : k + lines.SHINGLE] for k in range(len(s) - lines.SHINGLE + 1)} for s in rows]
    maps = lines.bitmaps(spark.createDataFrame(list(enumerate(rows)), "id long, line string")).localCheckpoint()
    every = spark.range(len(rows)).selectExpr("id as a").crossJoin(spark.range(len(rows)).selectExpr("id as b")).where("a > b")
    left = {(x.a, x.b) for x in lines.sieved(every, maps, lines.THRESHOLD).collect()}
    similar = {(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= lines.THRESHOLD * len(sets[a] | sets[b])}
    assert similar <= left and len(left) < 0.1 * len(rows) ** 2 / 2
    checked, kept, check, store = [], {}, lines.similar, lines.stored
    monkeypatch.setattr(lines, "similar", lambda pairs, *a: checked.append(pairs.count()) or check(pairs, *a))
    monkeypatch.setattr(lines, "stored", lambda df, name: kept.setdefault(name, store(df, name)) if "line" in df.columns else store(df, name))
    got = {x.doc_id for x in lines.dedup(docs(spark, rows)).collect() if not x.n_removed}
    assert got == kept_lines(rows) and sum(checked) <= 40
    assert set(kept) == {"texts"} and kept["texts"].count() <= 48


def test_line_signatures_in_few_columns(spark, monkeypatch):
    """Minima are stored two in a column, and come back as they were."""
    rows, columns, store = [prose(k, 30) for k in range(6)] + ["abcdefgh " * 40], {}, lines.stored
    monkeypatch.setattr(lines, "stored", lambda df, name: columns.setdefault(name, df.columns) and store(df, name))
    got = {x.id >> 24: x.asDict() for x in lines.signatures(docs(spark, rows), "doc_id", "text", 20).collect()}
    found = lines._hashed(spark.createDataFrame(list(enumerate(rows)), "id long, line string"), "id").selectExpr("id", f"(h & 65535) % {lines.BINS} as b", "shiftrightunsigned(h, 33) + 1 as v")
    want = {(x.id, x.b): x.v for x in found.groupBy("id", "b").agg(F.min("v").alias("v")).collect()}
    assert all(got[i][f"v{b}"] == want.get((i, b), 0) for i in range(7) for b in range(lines.BINS)) and len(columns["minima"]) <= 5 + lines.BINS // 2


def test_lines_of_repeated_ids(spark):
    """Rows with one doc_id have different lines at one place: each is compared as itself."""
    a, b, c = prose(1, 30), prose(2, 30), prose(3, 30)
    df = spark.createDataFrame([(1, a), (1, b), (2, b + "y"), (3, c), (4, c + "y"), (5, a + "y")], "doc_id long, text string")
    got = sorted((x.doc_id, x.n_removed) for x in lines.dedup(df).collect())
    assert got == [(1, 0), (1, 0), (2, 1), (3, 0), (4, 1), (5, 1)]


def test_hot_line_and_bucket(spark):
    """One line with a third of all places, and near copies of it."""
    base = prose(77, 30)
    near = [base + " " + "abcdefghij"[: k % 10] for k in range(400)]
    rows = [base] * 400 + near + [prose(5000 + k, 20) for k in range(400)]
    got = {x.doc_id: x.n_removed for x in lines.dedup(docs(spark, rows)).collect()}
    assert {i for i, n in got.items() if not n} == {0, *range(800, 1200)}


def test_jaccard_edges(spark):
    base = prose(21, 300).split()
    texts = [*EDGES, "ONE", "one two", "One  two"]
    for k in range(30):
        w = list(base)
        for j in random.Random(k).sample(range(300), k % 12):
            w[j] = f"new{k}"
        texts.append(" ".join(w))
    from tests.llm.test_contracts import groups, shingle_sets, similar

    for n, bound in ((4, (85, 100)), (5, (80, 100))):
        sets = shingle_sets(list(enumerate(texts)), n)
        want = groups(sets, similar(sets, *bound))
        for parts, spare in ((2, 1), (1, 0), (3, 1)):
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs(spark, texts), words=n, bound=bound, parts=parts, spare=spare).collect()}
            assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    assert ngram_join.join(docs(spark, [])).count() == 0


def test_shingles():
    """As many shingles as the distinct windows of words; long words, texts over several slices, all white space and case."""
    long = ["x" * 100 + " b c d e " + "Y" * 200_000 + " q " * 70_000 + "z" * 70_000, "word " * 50_000, "a\x0bb\x0cc\x1fd A B C\x1fD\te\r\nf é É"]
    texts = [*EDGES, "a b", "b a", "A B", "a b c d", " a  b\nC d ", *long, *(prose(i, i) for i in range(40))]
    for words in (1, 4, 5, 7):
        sets = list(ngram_join.shingled(ngram_join.pa.array(texts), words))
        distinct = set()
        for t, s in zip(texts, sets, strict=True):
            w = (t or "").encode().lower().split()
            windows = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
            distinct |= windows
            assert len(windows) == len(s) and (s == ngram_join.shingles(t, words)).all() and (s[1:] > s[:-1]).all()
        assert len(np.unique(np.concatenate(sets))) == len(distinct)


def test_signatures_together():
    sets = [s for s in ngram_join.shingle_sets([prose(i, 3 * i) for i in range(60)] + [LONG]) if len(s)]
    for parts, spare in ((2, 1), (1, 0), (3, 1)):
        sigs, at = ngram_join.signed(sets, (85, 100), parts, spare)
        for i, s in enumerate(sets):
            assert (np.unique(sigs[at == i]) == ngram_join.signatures(s, (85, 100), parts, spare)).all()


def test_signatures_lose_nothing():
    """Random pairs of sets that link always share a signature; sketches never rule one out."""
    r = np.random.default_rng(2)
    for _ in range(400):
        n = int(r.choice([1, 2, 3, 5, 8, 13, 40, 150, 600]))
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        most = int(ngram_join.differ(2 * len(x), 85, 100))
        out, add = r.integers(0, most + 1), 0
        out = min(int(out), len(x) - 1)
        add = int(r.integers(0, max(most - out, 0) + 1))
        y = np.unique(np.concatenate([r.permutation(x)[out:], r.integers(0, 1 << 63, add).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            for parts, spare in ((2, 1), (1, 0), (3, 1)):
                assert np.intersect1d(*(ngram_join.signatures(s, (85, 100), parts, spare) for s in (x, y))).size
            i, j, _ = ngram_join.may_link(np.array([len(x), len(y)]), [ngram_join.sketch(x), ngram_join.sketch(y)], np.array([0, 1]), (85, 100))
            assert (i.tolist(), j.tolist()) == ([0], [1])


def test_large_bucket_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    base = prose(5, 400).split()
    texts = [" ".join(base[:k] + [f"w{k}"] + base[k + 1 :]) for k in range(30)]
    assert {r.component_id for r in ngram_join.join(docs(spark, texts)).collect()} == {0}


VECTORS = "vec_id long, embedding array<float>, label int, rep string, n string"


def test_embeddings(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows, x = [], r.standard_normal((60, 16))
    for i, v in enumerate(x):
        rows += [(4 * i, v, i % 3), (4 * i + 1, v + 0.03 * r.standard_normal(16), i % 3), (4 * i + 2, v, i % 3), (4 * i + 3, 3 * v, 7)]
    rows = [(i, [float(np.float32(z)) for z in v], k) for i, v, k in rows]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [1.0] * 16, None), (905, [], 1), (906, [1.0] * 8, 1), (907, [1.0] * 8, 1)]
    df = spark.createDataFrame([(*t, "x", "x") for t in rows + odd], VECTORS)
    from tests.llm.test_contracts import groups

    good = {i: (np.array(v, np.float64), k) for i, v, k in [*rows, odd[-2], odd[-1]]}
    pairs = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0])
             and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.98]
    want = groups([t[0] for t in rows + odd], pairs)
    for block in (1024, 3):
        monkeypatch.setattr(embed, "BLOCK", block)
        got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in embed.near(df, miss=1e-6).collect()}
        assert got == {i: (sum(i in p for p in pairs), want[i], want[i] == i) for i in want}
    assert embed.near(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    """Bit counts estimate inner products without bias; bounds hold, and leave few pairs to recompute."""
    r = np.random.default_rng(1)
    for dim in (64, 200):
        x = embed.unit(r.standard_normal((300, dim)))
        y = embed.unit(x + 0.16 / dim**0.5 * r.standard_normal(x.shape))
        v = np.concatenate([x, y])
        i, j = (z.ravel() for z in np.meshgrid(np.arange(600), np.arange(600), indexing="ij"))
        i, j = i[i != j], j[i != j]
        estimate, off = embed.estimates(*embed.sketches(v), dim, i, j)
        exact = (v[i] * v[j]).sum(axis=1)
        assert abs((estimate - exact).mean()) < 0.005 and (abs(estimate - exact) <= off).mean() > 0.999
        open_, linked = estimate + off >= 0.98, exact >= 0.98
        assert (open_ | ~linked).all() and linked.sum() == 600 and open_.sum() < 0.05 * len(i)


PAGES = "page_id long, url string, html string, id string, key string"


def test_warc(spark):
    rows = [(1, "http://www.a.org/x?q=1#f", "same"), (2, "https://a.org/x?q=1", "same"), (3, None, None), (4, "no scheme", ""), (5, "http://b.org/", "ü" * 50_000), (6, "http://b.org:81/é", "<p>\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], PAGES)
    folder, cdx = warc.write(df)
    found = warc.index(folder, cdx, block_lines=2)
    got = {r.id: r for r in warc.captures(folder, found).collect()}
    assert {i: (g.record_type, g.refers_to, g.payload_bytes) for i, g in got.items()} == {
        1: ("revisit", 2, 4), 2: ("response", None, 4), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, 100_000), 6: ("response", None, 17)
    }
    assert got[5].payload.decode() == "ü" * 50_000 and got[6].url == "http://b.org:81/é"
    directory = [tuple(r) for r in found.orderBy("key", "id").select("key", "file", "offset", "length").collect()]
    hits = warc.lookup(folder, directory, "http://a.org/x?q=1")
    assert sorted(h["head"]["WARC-Type"] for h in hits) == ["response", "revisit"] and warc.lookup(folder, directory, "http://none.org/") == []
    big = {r.id: r.record_type for r in warc.captures(*(lambda w: (w[0], warc.index(*w)))(warc.write(df, min_bytes=5))).collect()}
    assert set(big.values()) == {"response"}
    empty = warc.write(df.limit(0))
    assert warc.captures(empty[0], warc.index(*empty)).count() == 0
    assert warc.sort_key("http://www.A.org:8/x?y#z") == "org,a:8)/x?y"


def test_toxicity():
    r = random.Random(1)
    texts, labels = [], []
    for i in range(400):
        s = [prose(i * 10 + k, 12) for k in range(r.randrange(1, 8))]
        if i % 4 == 0:
            s.insert(r.randrange(len(s) + 1), f"you {r.choice(['vilewort', 'vileling', 'grot'])} {prose(i, 5)}")
        texts.append(". ".join(s) + ".")
        labels.append(int(i % 4 == 0))
    scorer = toxicity.Scorer(toxicity.fit(texts[:300], labels[:300]))
    for t, y in zip(texts[300:], labels[300:], strict=True):
        p, spans = scorer.score(t)
        assert (p >= toxicity.THRESHOLD) == bool(y)
        if y:
            assert any("vile" in t[a:b] or "grot" in t[a:b] for a, b, q in spans if q >= toxicity.THRESHOLD)
    assert scorer.score(None) == (0.0, []) == scorer.score("") and scorer.score("Oh, vilewords!")[0] > 0.3
    assert toxicity.Scorer(toxicity.fit([], [])).score("x")[0] == 0.0 and toxicity.Scorer(toxicity.fit(["a"], [1])).score("x")[0] == 1.0


def test_toxicity_edges(spark):
    d = docs(spark, EDGES)
    labels = spark.createDataFrame([(0, 1), (3, 0), (5, 1), (5, 1), (7, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.score(d, toxicity.train(d, labels)).collect()
    assert len(got) == 8 and all(0 <= r.toxicity.score <= 1 for r in got)
    assert toxicity.score(d.limit(0), toxicity.train(d, labels.limit(0))).count() == 0


def test_urls(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [
        (1, "http://good.com/a", link("fine.io", "fine.io")), (2, "http://bad.net/es/a", link("worse.io")), (3, "http://farm.io/", link("bad.net")), (4, "http://fine.io/", link("good.com")),
        (5, "http://worse.io/", ""), (6, None, None), (7, "relative/x", "<a href='/x'>"), (8, "HTTP://Sub.Example.COM", None), (9, "http://www.example.com/en/x?q", None), (10, "http://a.example.com/en/", None), (11, "http://notcom/", None),
    ]
    from firmlens.llm.queries import RULES

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, host string, verdict string"), RULES).collect()}
    assert got[1] == ("good.com", "/a", "com/", "allow") and got[2] == ("bad.net", "/es/a", "net/es/", "block")
    assert got[3][2:] == (None, "block") and got[4][2:] == (None, "allow") and got[5][2:] == (None, "allow")
    assert got[6] == ("", "", None, "allow") == got[7] and got[8] == ("sub.example.com", "", None, "allow")
    assert got[9][2:] == ("www.example.com/en/", "allow") and got[10][2:] == ("example.com/en/", "block") and got[11][2:] == (None, "allow")
    assert urls.filter_urls(spark.createDataFrame([], PAGES), RULES).count() == 0


def test_pagerank_equals_power_iteration(spark):
    r = random.Random(6)
    edges = sorted({(r.randrange(12), r.randrange(12), r.randrange(1, 4)) for _ in range(40)})
    edges = list({(a, b): (f"h{a}", f"h{b}", w) for a, b, w in edges if a != b}.values())
    got = {x.host: x.score for x in urls.spread(spark.createDataFrame(edges, "src string, dst string, w long"), spark.createDataFrame([("h0", 0.5), ("h1", 0.5)], "host string, seed double")).collect()}
    base = {"h0": 0.5, "h1": 0.5}
    now, total = dict(base), {}
    for a, _, w in edges:
        total[a] = total.get(a, 0) + w
    for _ in range(urls.ROUNDS):
        new = {h: 0.15 * s for h, s in base.items()}
        for a, b, w in edges:
            if a in now:
                new[b] = new.get(b, 0) + 0.85 * w / total[a] * now[a]
        now = new
    assert got.keys() == now.keys() and all(abs(got[h] - now[h]) < 1e-12 for h in now)


def verdicts(spark, graph, rules):
    rows = [(h, f"http://{h}/x", "".join(f'<a href="http://{g}/">x</a>' for g in to)) for h, to in graph.items()]
    return {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows, "page_id string, url string, html string"), rules).collect()}


def test_one_link_does_not_condemn_seeds(spark):
    """A seed's pages that no rule fits have the same verdict whether or not there are links elsewhere."""
    rows = [(1, "http://bad.net/es/a", ""), (2, "http://bad.net/en/a", ""), (3, "http://a.io/", ""), (4, "http://b.io/", "")]
    for link in ("", '<a href="http://b.io/">x</a>'):
        df = spark.createDataFrame([(i, u, link if i == 3 else h) for i, u, h in rows], "page_id long, url string, html string")
        got = {r.page_id: r.verdict for r in urls.filter_urls(df, [("block", "net", "/es/")]).collect()}
        assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow"}


def test_equal_linkers_are_all_condemned(spark):
    for n in (1, 2, 100):
        graph = {f"f{i}.io": ["bad.net"] for i in range(n)} | {"bad.net": [], "fine.io": ["good.com"], "good.com": []}
        got = verdicts(spark, graph, [("block", "net", "/"), ("allow", "com", "/")])
        assert all((v == "block") == (h == "bad.net" or h[0] == "f" and h != "fine.io") for h, v in got.items())


def test_distrust_falls_along_a_chain(spark):
    chain = {"bad.net": []} | {f"h{i}.io": [f"h{i - 1}.io" if i > 1 else "bad.net"] for i in range(1, 15)}
    got = verdicts(spark, chain, [("block", "net", "/")])
    order = [got[f"h{i}.io"] for i in range(1, 15)]
    far = order.count("block")
    assert order == ["block"] * far + ["allow"] * (14 - far) and 1 < far < 10


def test_packing(spark):
    out = packing.pack(docs(spark, EDGES), vocabulary(), keep_ids=True).collect()
    assert sorted({r.doc_id for r in out}) == list(range(8))
    for r in out:
        assert len(r.ids) == r.length <= 1024
    assert {r.doc_id: r.length for r in out if r.doc_id < 2} == {0: 1, 1: 1}
    assert packing.pack(docs(spark, []), vocabulary()).count() == 0


def test_plan():
    r = random.Random(2)
    for size, n in ((10, 50), (64, 500), (1024, 3000)):
        need = {}
        for _ in range(n):
            k = min(size, max(1, int(r.lognormvariate(0, 1) * size / 3)))
            need[k] = need.get(k, 0) + 1
        have, total = {}, 0
        chosen, rest = packing.plan(need, size)
        for pattern, times in chosen + rest:
            assert sum(a * b for a, b in pattern) <= size
            total += times
            for a, b in pattern:
                have[a] = have.get(a, 0) + b * times
        assert have == need and total <= sum(c for _, c in packing.best_fit(need, size))


def test_plan_comes_from_the_program():
    """The program covers every piece; most sequences are its configurations, and best fit alone needs no fewer."""
    r, need = random.Random(4), {}
    for _ in range(9000):
        k = max(1, int(r.lognormvariate(0, 1) * 250)) % 1024 + 1
        need[k] = need.get(k, 0) + 1
    covered = {}
    for pattern, times in packing.solve({k: n for k, n in need.items() if k < 1024}):
        for a, b in pattern:
            covered[a] = covered.get(a, 0) + b * times
    assert covered == {k: n for k, n in need.items() if k < 1024}
    chosen, rest = packing.plan(need)
    made, left = sum(n for _, n in chosen), sum(n for _, n in rest)
    assert made > left and made + left <= sum(c for _, c in packing.best_fit(need))


CASES = [
    (None, ""), ("", ""), ("<p>", ""), ("just text &amp; more", "just text & more"), ("<p>a<p>b", "a b"), ("<ul><li>a<li>b</ul>", "a b"), ("<p>un<b>bold</b>ed", "unbolded"),
    ("<nav>x</nav><article><h1>T</h1><p>one, two<br>three &eacute;&nbsp; four</p><div class='comments'><p>no, no, no</p></div></article><aside>y</aside><footer>z</footer>", "T one, two three é four"),
    ("<article><p>a</p><form><p>f</p></form><script>if (a < b) { '</p>' }</script><style>p{}</style><!-- <p>c</p> --><p>d</p></article>", "a d"),
    ("<body><div id='sidebar'><p>" + "s, " * 50 + "</p></div><div><p>real text, of some length, in a block</p><p>and more, of it</p></div></body>", "real text, of some length, in a block and more, of it"),
    ("<div><a href='/1'>one, two, three, four, five</a><a href='/2'>six, seven, eight</a></div><div><p>the story, as told, at some length, goes on</p></div>", "the story, as told, at some length, goes on"),
    ("<article><p>cut off <b>here", "cut off here"), ("<article><p>a</div></span></p><p>b</p></article>", "a b"),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_html(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("name", ["content no-sidebar", "layout has-sidebar", "post with-comments", "page-header-fixed", "left-sidebar", "site without-nav"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_html_layout_classes(name, tag):
    """A layout's class around the article cuts nothing; what is named so itself goes."""
    page = f"<body><div class='{name}'><{tag}><p>the story, as told, at some length, goes on and on</p></{tag}><div class='sidebar'><p>menu, of, many, words</p></div></div><div class='comments'><p>no, no, no</p></div></body>"
    assert html.main_text(page) == "the story, as told, at some length, goes on and on"


ARTICLE = "<p>the story, as told, at some length, goes on and on</p>"
TOLD = "the story, as told, at some length, goes on and on"


@pytest.mark.parametrize("attrs", ["class='content has-sidebar'", "class='post with-comments'", 'title="a hidden gem"', 'style="overflow: hidden ; x"', 'data-x="hidden"', "data-note='display: none'"])
def test_html_wrappers(attrs):
    """A wrapper whose attributes only mention what is cut keeps the article."""
    assert html.main_text(f"<body><div {attrs}>{ARTICLE}</div></body>") == TOLD
    assert html.main_text(f"<body><div hidden>no</div><div style='color: red; display:none'>no</div><div aria-hidden=true>no</div>{ARTICLE}</body>") == TOLD


def test_html_split_article():
    one, two = "first part, of the story, with some words " * 8, "second part, of the same, with other words " * 4
    page = f"<body><nav><a href=/>menu, of, words</a></nav><div id=a><p>{one}</p></div><div id=b><p>{two}</p></div><div><a href=/1>{'link, ' * 30}</a></div></body>"
    assert html.main_text(page) == " ".join((one + two).split())


@pytest.mark.parametrize("tag", ["form", "header", "aside", "nav", "footer"])
def test_html_article_inside_a_soft_tag(tag):
    """A page that stands in one form, or another such element, keeps its article; beside it such elements go."""
    body = "".join(f"<p>part {i}, of the story, with some more words to it</p>" for i in range(9))
    told = " ".join(f"part {i}, of the story, with some more words to it" for i in range(9))
    assert html.main_text(f"<body><{tag} id=f><input type=hidden><div>{body}</div><button>go</button></{tag}></body>") == told
    assert html.main_text(f"<body><{tag}><p>a note, or two, of few words</p></{tag}><div>{body}</div></body>") == told
    assert html.main_text(f"<body><{tag}>{body * 2}</{tag}><article>{body}</article></body>") == told


def test_html_form_without_paragraphs():
    text = "words, and more words, and yet more of them, for a whole page of text " * 6
    assert html.main_text(f"<body><form><div>{text}</div></form></body>") == text.strip()


def test_html_article_in_two_wrappers():
    parts = [" ".join(f"the {n} part, sentence {i}, goes on, and on, as told." for i in range(12)) for n in ("first", "second")]
    page = "<body>" + "".join(f"<div><div><p>{p}</p></div></div>" for p in parts) + "<div><div>short foot of the page, with some ninety characters in it, that no article would have</div></div></body>"
    assert html.main_text(page) == " ".join(parts)


def test_html_deep_and_broken():
    """Deep nesting and tags that never end take time in proportion, and no recursion."""
    import time

    for tag in ("b", "span", "div"):
        assert html.main_text("<p>" * (tag == "b") + f"<{tag}>" * 5000 + "deep, and, so on" + f"</{tag}>" * 2500 + "</i>" * 5000) == "deep, and, so on"
    began = time.process_time()
    for junk in ("<a ", "<a b='", '<a b="', "<", "<!-- ", "<script>", "</script ", "<script></script "):
        assert html.main_text(ARTICLE + junk * (1_000_000 // len(junk))).startswith(TOLD)
    assert time.process_time() - began < 30


def test_html_edges(spark):
    rows = [(1, None), (1, None), (2, "<div>" * 5000 + "deep"), (3, "<p>" + "x, " * 100_000)]
    got = html.extract(spark.createDataFrame([(i, h, "x") for i, h in rows], "page_id long, html string, main_text string")).collect()
    assert [(r.page_id, len(r.main_text)) for r in got] == [(1, 0), (1, 0), (2, 4), (3, 299_999)]
    assert html.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_extended_components(spark):
    r = random.Random(9)
    from tests.llm.test_contracts import groups

    first = [(r.randrange(80), r.randrange(80)) for _ in range(40)]
    more = [(r.randrange(120), r.randrange(120)) for _ in range(40)] + [(50, 50 + k) for k in range(1, 20)]
    plain = [e for e in first + more if e[0] != e[1]]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = {x.node: x.component for x in extended(connected_components(frame(first)), frame(more)).collect()}
    assert got == groups({x for e in plain for x in e}, plain)
    assert extended(connected_components(frame([])), frame([])).count() == 0


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 1), (5, 5)]
    from tests.llm.test_contracts import groups

    plain = [(a, b) for a, b in edges if a is not None and a != b]
    want = groups({x for e in plain for x in e}, plain)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, small):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as C

    documents = spark.read.parquet(f"{small}/documents.parquet")
    names = documents.columns
    now, kept = documents, [documents.count()]
    for name, stage in C.STAGES:
        now = C.stored(stage(spark, now, small), name)
        if name != "packing":
            assert now.columns == names and now.select("doc_id").distinct().count() == now.count()
            kept.append(now.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.5 * kept[0]
    assert sorted(now.collect()) == sorted(C.run(spark, small).collect())
    ids = {d["doc_id"] for d in pq.read_table(f"{small}/documents.parquet").to_pylist()}
    assert {r.doc_id for r in now.collect()} <= ids


def test_search_is_exact():
    r = np.random.default_rng(0)
    for m, entries, big in ((8, 16, 4096), (2, 16, 3), (1, 40, 9), (0, 16, 1), (3, 1, 9)):
        x, book = r.integers(-big, big, (800, m)), r.integers(-big, big, (entries, m))
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        at, best = pq.search(x, book)
        assert (at == d.argmin(1)).all() and (best == d.min(1)).all()


def test_pq_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [nan, 1.0], 0), (3, [inf, 1.0], 0), (4, [None, 1.0], 0), (5, [], 1), (None, [0.5, -0.00001], None), (6, [1e30, -1e30], None), (7, [0.0, 0.0], 2), (7, [0.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, embedding array<double>, label int, code string, id string")
    coded, books = pq.compress(df)
    got = sorted(((r.vec_id, r.label, r.dim, r.code, r.error, r.label_error) for r in coded.collect()), key=repr)
    assert sorted(books) == [0, 2] and books[2].shape == (8, 4, 1) and len(got) == 5
    assert (5, 1, 0, "00" * 8, 0, 0) in got and sum(g[0] == 7 for g in got) == 2 and all(g[4] == g[5] == 0 for g in got)
    assert {tuple(r.approx) for r in pq.decode(coded.where("vec_id is null"), books).collect()} == {(0.5, -1 / 4096)}
    none, books = pq.compress(df.where("vec_id < 3"))
    assert none.count() == 0 and books == {}
    assert pq.compress(df.withColumn("embedding", F.col("embedding").cast("array<float>")), entries=2)[0].count() == 5


def test_runs_of_random_texts():
    from tests.llm.test_contracts import runs_of

    r = random.Random(8)
    for _ in range(60):
        texts = []
        for _ in range(r.randrange(1, 9)):
            n = r.choice([0, 1, 5, 6, 30, 200, 700])
            t = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(n)]
            if n and r.random() < 0.5:
                p = r.randrange(1, n // 3 + 2)
                t = (t[:p] * n)[:n]
                t[r.randrange(n)] = 99
            texts.append(t)
        got = runs.runs_of([np.array(t, np.int64) for t in texts])
        assert [[tuple(x) for x in g.tolist()] for g in got] == [runs_of(t) for t in texts]


def test_grammar_extends_exactly():
    r = random.Random(4)
    for _ in range(30):
        t = np.array([r.randrange(2) for _ in range(400)] * 2 + [r.randrange(3) for _ in range(300)])
        row = np.concatenate([[-1], t, [-2]])
        g = runs.Grammar(row)
        a = np.array([r.randrange(1, 600) for _ in range(50)])
        b = np.array([r.randrange(x + 1, 1101) for x in a.tolist()])
        for by in (1, -1):
            for x, y, n in zip(a.tolist(), b.tolist(), g.extend(a, b, by).tolist(), strict=True):
                k = 0
                while row[x + by * k] == row[y + by * k]:
                    k += 1
                assert k == n
    assert len(g.levels) > 8


def test_runs_edges(spark):
    texts = [None, "", " \n\t ", "one", "a b " * 3, "a b " * 4, "x " * 6, "a b " * 4, LONG, "la le " * 40_000 + "end", "a　b " * 8]
    df = docs(spark, texts).withColumn("runs", F.lit("x")).withColumn("key", F.lit("x"))
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find(df).collect()}
    assert got[0] == got[1] == got[2] == (0, [], "") and got[3] == (1, [], "one") and got[4] == (6, [], "a b a b a b")
    assert got[5] == got[7] == (8, [(0, 8, 2)], "a b") and got[6] == (6, [(0, 6, 1)], "x") and got[8][1] == []
    assert got[9] == (80_001, [(0, 80_000, 2)], "la le end") and got[10] == (8, [(0, 8, 1)], "a　b")
    assert runs.find(docs(spark, [])).count() == 0
    twice = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert runs.find(twice).count() == len(texts)


def test_license_edges(spark):
    mit = dict(licenses.NOTICES)["mit"]
    words = mit.split()
    changed = " ".join("thing" if k == 9 else w for k, w in enumerate(words))
    longer = " ".join([*words[:8], "really", "any", *words[8:]])
    texts = [None, "", " \n ", "cc", "CC-BY cc by,cc BY", f"x {mit} y", f"{changed} z", f"q r {longer}", " ".join(words[:10]), "The MIT License " * 9, LONG, f"x {mit} y"]
    for listed in (licenses.MAX_LISTED, 0):
        df = docs(spark, texts).withColumn("words", F.lit("x")).withColumn("row", F.lit("x")).withColumn("hits", F.lit("x"))
        got = {r.doc_id: r for r in licenses.scan(df, max_listed=listed).withColumn("labels", licenses.labels_of()).collect()}
        assert [got[i].n_words for i in range(5)] == [0, 0, 0, 1, 6] and all(not got[i].spans and got[i].labels == "" for i in (0, 1, 2, 3, 10))
        assert [(s.start, s.end, s.label) for s in got[4].spans] == [(0, 2, "cc-by"), (2, 4, "cc-by"), (4, 6, "cc-by")]
        assert [(s.start, s.end, s.label, s.share) for s in got[5].spans] == [(1, 1 + len(words), "mit", 1.0)] and got[11].spans == got[5].spans
        assert got[6].labels == got[7].labels == "mit" and 0.9 < got[6].spans[0].share < 1 and got[7].spans[0].share > 0.9
        assert got[8].labels == "" and 0 < got[8].spans[0].share < 0.8 and [s.start for s in got[9].spans] == list(range(1, 27, 3))
    assert licenses.scan(docs(spark, [])).count() == 0
    same = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert licenses.scan(same).count() == len(texts)


def fewest(pieces, size):
    """The least number of sequences, by trying all."""
    pieces = sorted(pieces, reverse=True)

    def fits(rooms, k):
        if k == len(pieces):
            return True
        return any(fits((*rooms[:i], r - pieces[k], *rooms[i + 1 :]), k + 1) for i, r in enumerate(rooms) if r >= pieces[k] and r not in rooms[:i])

    n = -(-sum(pieces) // size)
    while not fits((size,) * n, 0):
        n += 1
    return n


def test_packing_against_the_optimum():
    r, more = random.Random(12), 0
    for _ in range(80):
        pieces = [r.randrange(1, 21) for _ in range(r.randrange(1, 10))]
        need = {x: pieces.count(x) for x in set(pieces)}
        chosen, rest = packing.plan(need, 20)
        more += sum(n for _, n in chosen + rest) - fewest(pieces, 20)
    assert 0 <= more <= 3


def test_packing_never_takes_more_than_best_fit():
    r = random.Random(2)
    need = {x: r.randrange(20, 400) for x in range(1, 1025, 3)}
    chosen, rest = packing.plan(need)
    total = sum(n for _, n in chosen + rest)
    assert total > 10_000 and total <= sum(n for _, n in packing.best_fit(need))
