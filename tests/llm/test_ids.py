"""Repeated and null ids in the operators that link rows or archive them: every row counts, none is mixed up or lost."""

import numpy as np

from firmlens.llm import embed, ngram_join, warc
from tests.llm.test_edges import prose


def _least(ids, links):
    """The smallest id that each row reaches, null where none has one."""
    part = list(range(len(ids)))
    for a, b in links:
        x, y = part[a], part[b]
        part = [x if p == y else p for p in part]
    return [min((i for i, q in zip(ids, part, strict=True) if q == p and i is not None), default=None) for p in part]


def _sorted(rows):
    return sorted(rows, key=repr)


def test_documents_of_one_id(spark):
    a, b, c = prose(31, 200), prose(32, 200), prose(33, 200)
    near = lambda t: " ".join([*t.split()[:-1], "changed"])
    rows = [(5, a), (5, b), (5, b), (3, near(b)), (None, near(a)), (None, c), (None, near(c)), (9, c), (None, prose(34, 100)), (None, None), (7, ""), (7, None), (None, prose(35, 100)), (None, near(prose(35, 100)))]
    rows += [(r[0], r[1]) for r in rows[:2]]
    n = len(rows)
    from tests.llm.test_contracts import shingle_sets, similar

    sets = shingle_sets(list(enumerate(t for _, t in rows)), 4)
    least = _least([i for i, _ in rows], similar(sets, 85, 100))
    want = _sorted((i, len(sets[k]), least[k]) for k, (i, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = _sorted(tuple(r) for r in ngram_join.join(df).select("doc_id", "n_shingles", "component_id").collect())
    assert len(got) == n and got == want and (None, len(sets[5]), 9) in got and (5, len(sets[0]), 5) in got and (5, len(sets[1]), 3) in got


def test_vectors_of_one_id(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((6, 32))
    ids = [4, 4, 4, 2, None, None, None, None, 8]
    vectors = [x[0], x[1], x[1], 2 * x[1], x[2], x[2] + 1e-3, x[3], 3 * x[0], x[4]]
    rows = [(i, [float(np.float32(z)) for z in v], 1) for i, v in zip(ids, vectors, strict=True)] + [(None, None, 1), (4, None, 1)]
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows[:9]]
    links = [(a, b) for a in range(9) for b in range(a) if unit[a] @ unit[b] >= 0.98]
    least = _least([i for i, _, _ in rows], links)
    want = _sorted((i, sum(k in p for p in links), least[k], i is not None and i == least[k]) for k, (i, _, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    assert _sorted(tuple(g) for g in embed.near(df, miss=1e-6).select("vec_id", "n_links", "component_id", "kept").collect()) == want


def test_captures_of_one_id(spark):
    rows = [(1, "http://a.org/", "x"), (1, "http://a.org/2", "y"), (1, "http://a.org/2", "y"), (None, "http://b.org/", "y"), (None, "http://b.org/", "z"), (None, "http://c.org/", "z"), (2, "http://d.org/", "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder, cdx = warc.write(df)
    got = _sorted((r.id, r.url, r.record_type, r.refers_to) for r in warc.captures(folder, warc.index(folder, cdx, block_lines=2)).collect())
    assert got == _sorted([
        (1, "http://a.org/", "revisit", 2), (1, "http://a.org/2", "response", None), (1, "http://a.org/2", "response", None), (None, "http://b.org/", "revisit", 1),
        (None, "http://b.org/", "response", None), (None, "http://c.org/", "response", None), (2, "http://d.org/", "response", None), (None, "", "response", None),
    ])


def test_near_duplicates_keeps_rows_without_id(spark):
    import corpus_pipeline

    a, b = prose(41, 100), prose(42, 100)
    rows = [(4, a), (2, a), (None, b), (None, a), (7, b), (7, prose(43, 100))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert _sorted(tuple(r) for r in got) == _sorted([rows[1], rows[2], rows[3], rows[4], rows[5]])
