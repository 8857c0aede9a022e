"""Pages at any depth, and distinct counts kept up batch by batch."""

import random

import pytest
from pyspark.sql import functions as F

from firmlens.operators import distinct as N
from firmlens.operators import paging as G
from firmlens.sources import bucketed as B

KEYS = {"up": [("a", True), ("id", True)], "down": [("a", False), ("b", True), ("id", True)], "both": [("b", False), ("id", False)]}


@pytest.fixture(scope="module")
def rows(spark):
    """Nulls and ties in every key but the last."""
    r = random.Random(1)
    data = [(i, r.choice([None, 1, 2, 3]), r.choice([None, "x", "y"])) for i in range(137)]
    return spark.createDataFrame(data, "id long, a int, b string").repartition(5).cache()


@pytest.mark.parametrize("name", KEYS)
def test_cursors_walk_the_order(rows, name):
    keys = KEYS[name]
    want = [r.id for r in rows.orderBy(*G.by(keys)).collect()]
    got, cursor = [], None
    while True:
        page = G.page_after(rows, keys, cursor, 30)
        ids = [r.id for r in page.collect()]
        if not ids:
            break
        got, cursor = got + ids, G.cursor_of(page, keys)
    assert got == want and G.cursor_of(page, keys) is None


@pytest.mark.parametrize("name", KEYS)
def test_pages_of_a_stored_order(spark, rows, tmp_path, name):
    keys = KEYS[name]
    want = [r.id for r in rows.orderBy(*G.by(keys)).collect()]
    G.write_order(rows, keys, str(tmp_path / "o"), block_rows=40)
    ordered = G.read_order(spark, str(tmp_path / "o"))
    pages = [[r.id for r in G.page_at(ordered, n, 30, 40).collect()] for n in range(1, 7)]
    assert sum(pages, []) == want and pages[5] == []
    # A page deep in the order reads the blocks that hold it and no other.
    read = {str(f).split("_block=")[1].split("/")[0] for f in G.page_at(ordered, 5, 10, 40).inputFiles()}
    plan = G.page_at(ordered, 5, 10, 40)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_block" in plan and read
    files = {r[0].split("_block=")[1].split("/")[0] for r in ordered.where("_block between 1 and 1").select(F.input_file_name()).distinct().collect()}
    assert files == {"1"}


def test_order_of_nothing(spark, rows, tmp_path):
    G.write_order(rows.limit(0), KEYS["up"], str(tmp_path / "o"))
    assert G.numbered(rows.limit(0), KEYS["up"]).count() == 0 and G.page_after(rows.limit(0), KEYS["up"], (1, 2), 5).count() == 0


def test_distinct_counts_equal_a_recount(spark, tmp_path):
    """Three overlapping batches with a hot group, null values and null groups; small batches leave most buckets alone."""
    r = random.Random(2)
    schema, root = "g long, v string, hr boolean", str(tmp_path)
    all_ = []
    for version, n in ((1, 400), (2, 300), (3, 5)):
        batch = [(r.choice([0, 0, 0, 1, 2, None, 9]), r.choice([None, *(f"m{i}" for i in range(60))]), r.choice([True, False, None])) for _ in range(n)] + [(77, None, True)]
        all_ += batch
        df = spark.createDataFrame(batch, schema)
        before = {p for p in tmp_path.rglob("*.parquet")}
        N.add_values(df, root, "t", version, "g", "v", ("hr",), spread=4, buckets=32)
        N.add_values(df, root, "t", version, "g", "v", ("hr",), spread=4, buckets=32)  # repeated: nothing changes
        new = {p for p in tmp_path.rglob("*.parquet")} - before
        assert version < 3 or len({p.parent.name for p in new}) <= 6
        want = {}
        for g, v, hr in all_:
            got = want.setdefault(g, (set(), set()))
            if v is not None:
                got[0].add(v)
                if hr:
                    got[1].add(v)
        assert {x.g: (x.n, x.n_hr) for x in N.value_counts(spark, root, "t", "g").collect()} == {g: (len(a), len(b)) for g, (a, b) in want.items()}


def test_distinct_counts_after_a_break(spark, tmp_path, monkeypatch):
    """Sets written and counts not: the repeated call writes the counts."""
    root, df = str(tmp_path), spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "g long, v string")
    N.add_values(df.where("v = 'a'"), root, "t", 1, "g", "v", buckets=8)
    merge = B.merge
    monkeypatch.setattr(B, "merge", lambda b, r, name, *x: (_ for _ in ()).throw(RuntimeError("broke")) if name == "t_counts" else merge(b, r, name, *x))
    with pytest.raises(RuntimeError):
        N.add_values(df, root, "t", 2, "g", "v", buckets=8)
    monkeypatch.undo()
    assert {x.g: x.n for x in N.value_counts(spark, root, "t", "g").collect()} == {1: 1, 2: 1}
    N.add_values(df, root, "t", 2, "g", "v", buckets=8)
    assert {x.g: x.n for x in N.value_counts(spark, root, "t", "g").collect()} == {1: 2, 2: 1}
