"""Sources, sinks and incremental jobs."""

import datetime

import json

import pytest
from pyspark.sql import functions as F

from firmlens.operators import postings as J
from firmlens.sources import io
from firmlens.streaming import incremental as S


def test_seeds(spark, tmp_path):
    (tmp_path / "istanbul.json").write_text('{"name":" Acme ","website":"a.com"}\n{"name":" "}\n')
    (tmp_path / "ankara.json").write_text('{"name":"Beta"}\n')
    got = sorted((r.source_key, r.name) for r in io.read_seeds(spark, f"{tmp_path}/*.json").collect())
    assert got == [("ankara", "Beta"), ("istanbul", "Acme")]
    (tmp_path / "own.json").write_text('{"name": "Gama", "source_key": "list"}\n{"name": "Delta", "source_key": " "}\n')
    assert sorted((r.source_key, r.name) for r in io.read_seeds(spark, f"{tmp_path}/own.json").collect()) == [("list", "Gama"), ("own", "Delta")]
    (tmp_path / "izmir.csv").write_text("name,website\n Epsilon ,e.com\n ,x.com\n")
    assert [tuple(r) for r in io.read_seeds(spark, f"{tmp_path}/*.csv", "csv").select("source_key", "name", "website", "city").collect()] == [("izmir", "Epsilon", "e.com", None)]


def test_results(spark, tmp_path):
    good = json.dumps({"company_id": 1, "seq": 1, "classification": {"domain": ["oyun"], "confidence": 0.5}})
    (tmp_path / "a.jsonl").write_text(good + "\n\n")
    assert io.read_label_results(spark, f"{tmp_path}/a.jsonl").first().domain == ["oyun"]
    (tmp_path / "b.jsonl").write_text(good + "\n{broken\n")
    with pytest.raises(Exception, match="malformed line"):
        io.read_label_results(spark, f"{tmp_path}/b.jsonl").collect()


def test_batch_and_export(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "u1", "two"), (1, 0, "u0", "one"), (2, 0, "u", "  ")], "company_id long, pos int, url string, text string")
    names = spark.createDataFrame([(1, "A"), (2, "B")], "company_id long, name string")
    io.write_batch(pages, names, f"{tmp_path}/batch", "Do: ")
    rows = spark.read.json(f"{tmp_path}/batch").collect()
    assert [(r.company_id, r.prompt) for r in rows] == [(1, "Do: === u0 ===\none\n\n=== u1 ===\ntwo")]
    io.export_csv(names, f"{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("part-*.csv")).read_bytes().decode()
    assert text.startswith("﻿company_id;name\n1;A")


F_NOW = datetime.datetime(2024, 1, 2)  # noqa: DTZ001


def test_versions(spark, tmp_path):
    df = spark.range(3)
    io.save_table(df, str(tmp_path), "t", 1)
    io.save_table(df.limit(1), str(tmp_path), "t", 2)
    assert io.load_table(spark, str(tmp_path), "t").count() == 1


def test_new_pages_once(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{x}" for x in ("in", "out", "cp"))
    page = lambda u, b: spark.createDataFrame([(u, 200, b, False, False, False, None, None)], io.PAGES).write.mode("append").parquet(src)
    page("a", "x@a.com 0312 555 12 34")
    S.extract_new_pages(spark, src, out, cp)
    page("b", "y@b.com")
    S.extract_new_pages(spark, src, out, cp)
    S.extract_new_pages(spark, src, out, cp)
    assert sorted((r.url, r.emails) for r in spark.read.parquet(out).collect()) == [("a", ["x@a.com"]), ("b", ["y@b.com"])]


def test_new_postings(spark, tmp_path):
    raw = "company_id long, external_id string, title string, location string, url string, posted_at string, remote boolean, valid boolean, provider string, slug string"
    snap = lambda *t: J.snapshot(spark.createDataFrame([(1, x, x, None, None, None, None, True, "p", "s") for x in t], raw)).withColumn("run_ts", F.to_timestamp(F.lit("2024-01-01")))
    first = snap("Dev", "Ops")
    state = first.drop("run_ts").limit(0).withColumns({"first_seen": F.lit(None).cast("timestamp"), "last_seen": F.lit(None).cast("timestamp"), "is_active": F.lit(True)})
    io.save_table(state.select("fingerprint", *[c for c in state.columns if c != "fingerprint"]), str(tmp_path), "jobs", 1)
    src, cp = f"{tmp_path}/in", f"{tmp_path}/cp"
    for part in (first, snap("Dev")):
        part.coalesce(1).write.mode("append").parquet(src)
        S.sync_new_postings(spark, src, str(tmp_path), cp, part.schema)
    assert sorted((r.title, r.is_active) for r in io.load_table(spark, str(tmp_path), "jobs").collect()) == [("Dev", True), ("Ops", False)]
    # A board that was read and is empty closes its postings; what a broken attempt left is not in the way.
    (tmp_path / "jobs" / "v000004-broken").mkdir()
    none = spark.createDataFrame([(1, F_NOW)], "company_id long, run_ts timestamp")
    first.limit(0).unionByName(none, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(src)
    S.sync_new_postings(spark, src, str(tmp_path), cp, first.schema)
    assert sorted((r.title, r.is_active) for r in io.load_table(spark, str(tmp_path), "jobs").collect()) == [("Dev", False), ("Ops", False)]
    with pytest.raises(ValueError, match="already"):
        io.save_table(first, str(tmp_path), "jobs", 2)


def test_page_store(spark, tmp_path):
    """One row a url, the newest copy; choosing reads no body; a fetch reads only its buckets and moves what is asked."""
    from firmlens.sources import pages as store

    rows = [(f"https://a{i}.com/", 200, f"body {i}", False, i) for i in range(200)] + [("https://a1.com/", 404, "new", False, 500), ("https://a2.com/", 200, "newer", False, 501), ("https://a2.com/", 200, "newer", False, 501), ("https://a3.com/", 200, None, True, 502), ("u", None, None, None, None)]
    df = spark.createDataFrame([(u, st, b, x, t) for u, st, b, x, t in rows], "url string, status int, body string, blocked_by_robots boolean, t int").withColumn("fetched_at", F.timestamp_seconds("t"))
    store.write_page_store(df, str(tmp_path / "store"))
    kept = store.read_page_store(spark, str(tmp_path / "store"))
    got = {r.url: (r.outcome, r.body) for r in kept.collect()}
    assert len(got) == kept.count() == 201 and got["https://a1.com/"] == ("error", None) and got["https://a2.com/"] == ("ok", "newer") and got["https://a3.com/"] == ("blocked", None) and got["u"] == ("error", None)
    plan = store.outcomes(kept)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string,outcome:string>" in plan
    asked = spark.createDataFrame([(1, "https://a2.com/"), (2, "https://a2.com/"), (3, "https://a9.com/"), (4, "none"), (5, "https://a1.com/")], "k long, url string")
    for of in (kept, df.dropDuplicates(["url"])):
        assert {(r.k, r.url) for r in store.with_bodies(asked, of).collect()} >= {(1, "https://a2.com/"), (2, "https://a2.com/"), (3, "https://a9.com/")}
    assert sorted((r.k, r.body) for r in store.with_bodies(asked, kept).collect()) == [(1, "newer"), (2, "newer"), (3, "body 9")]
    assert store.with_bodies(asked.limit(0), kept).count() == 0


def _files(root, name):
    return {str(p.relative_to(root)) for p in (root / name).rglob("*.parquet")}


def test_buckets_rewrite_only_what_changes(spark, tmp_path):
    """A batch writes the buckets of its keys and leaves all other files; old versions stay readable."""
    from firmlens.sources import bucketed as B

    root = str(tmp_path)
    df = spark.range(1000).select("id", F.lit("old").alias("v"))
    B.create(df, root, "t", ["id"], 64)
    before = _files(tmp_path, "t")
    assert len(B.manifest(spark, root, "t").folders) == 64
    batch = spark.createDataFrame([(5, "new"), (2000, "new")], "id long, v string")
    put = lambda old, new: old.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)
    changed = B.merge(batch, root, "t", 2, put)
    after = _files(tmp_path, "t")
    assert len(changed) == 2 and before <= after and len(after - before) == 2
    assert B.changed_in(B.manifest(spark, root, "t"), 2) == changed
    now = {r.id: r.v for r in B.read(spark, root, "t").collect()}
    assert len(now) == 1001 and now[5] == now[2000] == "new" and now[6] == "old"
    assert B.read(spark, root, "t", version=1).where("v = 'new'").count() == 0 and B.read(spark, root, "t", version=1).count() == 1000
    assert {5, 2000} <= {r.id for r in B.read(spark, root, "t", buckets=changed).collect()} < set(now)
    # Emptied buckets leave the manifest; new columns are null in older buckets; keys may be null.
    B.merge(batch.select("id"), root, "t", 3, lambda old, new: old.join(new, "id", "left_anti"))
    assert B.read(spark, root, "t").where("id in (5, 2000)").isEmpty()
    wide = spark.createDataFrame([(None, "n", 1)], "id long, v string, w int")
    B.merge(wide, root, "t", 4, lambda old, new: old.unionByName(new, allowMissingColumns=True))
    assert B.read(spark, root, "t").where("w is null").count() == 999 and B.read(spark, root, "t").where("id is null").first().w == 1
    # A repeated version is refused, and so are rows of buckets that the batch does not touch; both leave the table as it is.
    with pytest.raises(ValueError, match="already"):
        B.merge(batch, root, "t", 4, put)
    with pytest.raises(ValueError, match="does not touch"):
        B.merge(batch, root, "t", 5, lambda old, new: df.withColumn("w", F.lit(None).cast("int")))
    assert B.read(spark, root, "t").count() == 1000 and not B.has_version(spark, root, "t", 5)
    with pytest.raises(ValueError, match="no version"):
        B.manifest(spark, root, "none")


def test_buckets_of_nothing(spark, tmp_path):
    from firmlens.sources import bucketed as B

    empty = spark.createDataFrame([], "k string, x array<struct<a: int>>")
    B.create(empty, str(tmp_path), "t", ["k"], 4)
    assert B.read(spark, str(tmp_path), "t").count() == 0 and B.read(spark, str(tmp_path), "t").schema == empty.schema
    assert B.merge(empty, str(tmp_path), "t", 2, lambda old, new: old.unionByName(new)) == []
    one = spark.createDataFrame([("a", [(1,)])], empty.schema)
    B.merge(one, str(tmp_path), "t", 3, lambda old, new: old.unionByName(new))
    assert B.read(spark, str(tmp_path), "t").first().x[0].a == 1


def test_new_postings_in_buckets(spark, tmp_path):
    """The stream's batches rewrite the buckets of their companies only, with the rows that a plain table has."""
    from firmlens.sources import bucketed as B

    raw = "company_id long, external_id string, title string, location string, url string, posted_at string, remote boolean, valid boolean, provider string, slug string"
    snap = lambda rows: J.snapshot(spark.createDataFrame([(c, t, t, None, None, None, None, True, "p", "s") for c, t in rows], raw)).withColumn("run_ts", F.to_timestamp(F.lit("2024-01-01")))
    first = snap([(c, "Dev") for c in range(50)])
    state = first.drop("run_ts").withColumns({"first_seen": F.to_timestamp(F.lit("2023-01-01")), "last_seen": F.to_timestamp(F.lit("2023-01-01")), "is_active": F.lit(True)})
    state = J.sync_jobs(state, first.drop("run_ts").limit(0), first.select("company_id").limit(0), F.to_timestamp(F.lit("2023-01-01")))
    B.create(state, f"{tmp_path}/b", "jobs", ["company_id"], 32)
    io.save_table(state, f"{tmp_path}/p", "jobs", 1)
    before, src = _files(tmp_path / "b", "jobs"), f"{tmp_path}/in"
    for part in (snap([(3, "Ops")]), snap([(3, "Ops"), (4, "Dev")])):
        part.coalesce(1).write.mode("append").parquet(src)
        for kind in "bp":
            S.sync_new_postings(spark, src, f"{tmp_path}/{kind}", f"{tmp_path}/cp-{kind}", part.schema)
    rows = lambda df: sorted((r.company_id, r.title, r.is_active, str(r.last_seen)) for r in df.collect())
    got = rows(B.read(spark, f"{tmp_path}/b", "jobs"))
    assert got == rows(io.load_table(spark, f"{tmp_path}/p", "jobs")) and len(got) == 51
    assert {(t, a) for c, t, a, _ in got if c == 3} == {("Dev", False), ("Ops", True)}
    assert len(_files(tmp_path / "b", "jobs") - before) <= 3
