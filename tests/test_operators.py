"""Operators on small tables: the literal cases that the behaviour is known by."""

import json

import pytest
from pyspark.sql import functions as F

from firmlens.operators import catalog as C
from firmlens.operators import contacts as K
from firmlens.operators import discovery as D
from firmlens.operators import frontier as R
from firmlens.operators import labels as B
from firmlens.operators import links as L
from firmlens.operators import people as P
from firmlens.operators import postings as J
from firmlens.operators import resolve as E
from firmlens.sources import io

LISTING = "seq long, name string, website string, city string, source_key string, listed_url string"


def ts():
    return F.to_timestamp(F.lit("2024-01-01"))



def resolved(spark, rows, **options):
    df = spark.createDataFrame([(i, n, w, c, s, None) for i, (n, w, c, s) in enumerate(rows)], LISTING)
    return E.resolve_entities(df, **options)


@pytest.mark.parametrize(
    ("rows", "n"),
    [
        ([("ACME A.Ş.", "acme.com.tr", None, "a"), ("ACME", "www.acme.com.tr/tr", None, "b")], 1),
        ([("A", "acme.com.tr", None, "a"), ("B", "https://kariyer.acme.com.tr", None, "b")], 1),
        ([("Öztürk Yazılım San. ve Tic. A.Ş.", None, None, "a"), ("OZTURK YAZILIM", None, None, "b")], 1),
        ([("Alfa Teknoloji", "alfa.com", None, "a"), ("Beta Teknoloji", "beta.com", None, "b")], 2),
        ([("Abc", None, None, "a"), ("Abc", None, None, "b")], 2),
        ([("Istanbul Robotik Sistemleri Uzay", None, None, "a"), ("Istanbul Robotik Sistemlari Uzay", "irs.com", None, "b")], 1),
        ([], 0),
    ],
)
def test_entities(spark, rows, n):
    assert resolved(spark, rows).select("entity").distinct().count() == n


def test_entity_attributes(spark):
    r = resolved(spark, [("ACME", "acme.com", "Ankara", "a"), ("ACME", None, None, "b"), ("ACME", "acme.net", None, "b")])
    c = E.companies_of(r, ts()).collect()
    assert [(x.name, x.domain, x.city, x.aliases) for x in c] == [("ACME", "acme.com", "Ankara", ["acme.net"])]
    assert E.company_links(r).count() == 2


def test_fuzzy_score(spark):
    rows = [("kitten sitting", "sitting kitten", 100.0), ("abcd", "abxd", 75.0), ("", "", 0.0), ("abc", "", 0.0), ("xaybzc", "abc", 200 * 3 / 9)]
    got = spark.createDataFrame(rows, "a string, b string, want double").select("want", E.token_sort_score(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(abs(r.got - r.want) < 1e-9 for r in got)


def test_fuzzy_edges_equal_brute_force(spark):
    import random

    random.seed(3)
    words = ["alfa", "alpha", "robotik", "robotic", "sistem", "sistemi", "uzay", "yazilim", "yazlim"]
    names = sorted({" ".join(random.choices(words, k=3)) for _ in range(60)})

    def score(x, y):
        x, y = (" ".join(sorted(s.split())) for s in (x, y))
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, q in enumerate(y):
                new.append(row[j] + 1 if q == c else max(row[j + 1], new[-1]))
            row = new
        return 200 * row[-1] / (len(x) + len(y))

    want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if score(names[i], names[j]) >= 85}
    got = E.fuzzy_name_edges(spark.createDataFrame(list(enumerate(names)), "key long, name_norm string"), 85).collect()
    assert {(r.a, r.b) for r in got} == want and want


PAGE = "company_id long, domain string, url string, body string"


def test_page_contacts(spark):
    html = '<a href="mailto:IK@acme.com">x</a> ik@acme.com ornek@mail.com acme@x.kep.tr Tel 0312 555 12 34'
    got = K.page_contacts(spark.createDataFrame([(1, "acme.com", "https://acme.com/i", html), (2, "b.com", "u", "0312 555 12 34"), (3, "c.com", "u", None)], PAGE)).orderBy("pos").collect()
    assert [(r.company_id, r.email, r.phone) for r in got] == [(1, "ik@acme.com", "0312 555 12 34"), (1, "acme@x.kep.tr", None)]


def pages(spark, rows):
    return spark.createDataFrame([(u, s, b, bl) for u, s, b, bl in rows], "url string, status int, body string, blocked_by_robots boolean")


def test_harvest(spark):
    c = spark.createDataFrame([(1, "acme.com", None, None), (2, "zed.com", None, None), (3, "dead.com", None, None)], "company_id long, domain string, website string, careers_url string")
    p = pages(spark, [
        ("https://acme.com/", 200, '<a href="/kurumsal">Kurumsal</a> info@acme.com', False), ("https://acme.com/kurumsal", 200, '<a href="/kurumsal/ust-yonetim">x</a> info@acme.com', False),
        ("https://acme.com/kurumsal/ust-yonetim", 200, "ceo@acme.com", False), ("https://zed.com/", 200, "x", True), ("https://www.zed.com/", 200, "a@zed.com", False),
    ])
    got = K.harvest_contacts(c, p).orderBy("email").collect()
    assert [(r.company_id, r.email, r.contact_type, r.source_url) for r in got] == [(1, "ceo@acme.com", "personal", "https://acme.com/kurumsal/ust-yonetim"), (1, "info@acme.com", "generic", "https://acme.com/")]


def test_save_contacts(spark):
    rows = [(1, None, None, " A@x.com", None, None, "u", "regex", None), (1, None, None, "a@x.com", None, None, "v", "regex", None), (1, "Ad Soyad", None, None, None, None, "u", "llm", 0.9), (1, " ", None, "", None, None, "u", "regex", None)]
    new = spark.createDataFrame(rows, K.CONTACT_COLUMNS)
    once = K.save_contacts(spark.createDataFrame([], K.CONTACT_COLUMNS), new)
    assert {(r.email, r.name, r.contact_type) for r in once.collect()} == {("a@x.com", None, "generic"), (None, "Ad Soyad", "executive")}
    assert K.save_contacts(once, new).count() == 2
    with pytest.raises(Exception, match="source_url"):
        K.valid_contacts(new.withColumn("source_url", F.lit(None).cast("string"))).collect()


def test_careers(spark):
    c = spark.createDataFrame([(i, d, None) for i, d in enumerate(["acme.com", "bot.com", "rob.com", "gone.com", "plain.com", "bare.com"])], "company_id long, domain string, website string")
    p = pages(spark, [
        ("https://acme.com/", 200, '<a href="https://jobs.lever.co/acme">Kariyer</a>', False), ("https://bot.com/", 403, "x", False), ("https://rob.com/", 200, "x", True),
        ("https://plain.com/", 200, '<a href="/insan-kaynaklari">IK</a>', False), ("https://plain.com/insan-kaynaklari", 200, "ok", False), ("https://bare.com/", 200, "hi", False),
    ])
    pay = spark.createDataFrame([(0, "lever", "acme", "[]")], "company_id long, provider string, slug string, body string")
    got = {r.company_id: r for r in J.detect_careers(c, p, pay).collect()}
    assert [got[i].detect_status for i in range(6)] == ["ats", "protected", "blocked", "error", "careers", "none"]
    assert got[4].careers_url == "https://plain.com/insan-kaynaklari" and got[0].ats_slug == "acme"


def test_sitemap(spark):
    body = "<loc>https://a.com/kariyer</loc><loc>https://a.com/x</loc> <LOC> https://a.com/jobs </LOC>"
    got = L.sitemap_urls(spark.createDataFrame([(1, body)], "company_id long, body string"), L.CAREER_KEYWORDS).orderBy("pos").collect()
    assert [r.url for r in got] == ["https://a.com/kariyer", "https://a.com/jobs"]


PAYLOADS = {
    "greenhouse": ({"jobs": [{"id": 1, "title": " Dev ", "location": {"name": "Ankara"}, "absolute_url": "u", "updated_at": "t"}, {"id": 2, "title": " "}]}, [("1", "Dev", "Ankara", None)]),
    "lever": ([{"id": "a", "text": "Dev", "categories": {"location": "Remote"}, "createdAt": 1700000000000, "hostedUrl": "u"}], [("a", "Dev", "Remote", True)]),
    "ashby": ({"jobs": [{"id": "a", "title": "Dev", "location": "X", "jobUrl": "", "applyUrl": "v", "isRemote": True}]}, [("a", "Dev", "X", True)]),
    "workable": ({"jobs": [{"shortcode": "S1", "title": "Dev", "city": "Ankara", "country": "TR", "telecommuting": False}]}, [("S1", "Dev", "Ankara, TR", False)]),
    "recruitee": ({"offers": [{"id": 7, "title": "Dev", "location": "X", "careers_url": "u", "remote": True}]}, [("7", "Dev", "X", True)]),
    "smartrecruiters": ({"content": [{"id": "9", "name": "Dev", "location": {"city": "A", "country": "tr", "remote": False}}]}, [("9", "Dev", "A, tr", False)]),
    "breezy": ([{"_id": "b", "name": "Dev", "location": {"city": "X"}, "url": "u"}], [("b", "Dev", "X", None)]),
    "personio": ("<workzag-jobs><position><id>5</id><name>Dev</name><office>B</office></position></workzag-jobs>", [("5", "Dev", "B", None)]),
}


@pytest.mark.parametrize("provider", J.PROVIDERS)
def test_payloads(spark, provider):
    body, want = PAYLOADS[provider]
    body = body if isinstance(body, str) else json.dumps(body)
    empty = {"greenhouse": '{"jobs": []}', "lever": "[]", "breezy": "[]", "recruitee": '{"offers": []}', "smartrecruiters": '{"content": []}', "personio": "<workzag-jobs></workzag-jobs>"}.get(provider, '{"jobs": []}')
    rows = [(1, body), (2, empty), (3, None), (4, "<html" if provider == "personio" else '{"other": 1}'), (5, "not it")]
    df = spark.createDataFrame([(i, provider, "slug", b) for i, b in rows], "company_id long, provider string, slug string, body string")
    out = J.parse_job_payloads(df, provider)
    got = out.where("company_id = 1 and title is not null").collect()
    assert [(r.external_id, r.title, r.location, r.remote) for r in got] == want
    assert {r.company_id: r.n_jobs for r in J.verify_ats(df.select("company_id", "provider", "slug"), out).collect()} == {1: 1, 2: 0, 3: None, 4: None, 5: None}


def test_signatures(spark):
    rows = [("boards.greenhouse.io/embed", None), ("x boards.greenhouse.io/embed/job_board?for=Acme y", ("greenhouse", "acme")), ("https://acme.recruitee.com", ("recruitee", "acme")), ("www.workable.com", None), (None, None)]
    got = spark.createDataFrame([(b,) for b, _ in rows], "b string").select(J.signatures(F.col("b")).alias("s")).collect()
    assert [tuple(r.s) if r.s else None for r in got] == [w for _, w in rows]


def test_sync_jobs(spark):
    schema = "company_id long, external_id string, title string, location string, url string, posted_at string, remote boolean, valid boolean, provider string, slug string"
    make = lambda *titles: J.snapshot(spark.createDataFrame([(1, str(i), t, None, None, None, None, True, "p", "s") for i, t in enumerate(titles)], schema))
    first, c = make("Dev", "Stajyer", "dev"), spark.createDataFrame([(1,)], "company_id long")
    assert first.count() == 2
    empty = first.limit(0).withColumns({"first_seen": ts(), "last_seen": ts(), "is_active": F.lit(True)})
    one = J.sync_jobs(empty, first, c, ts())
    two = J.sync_jobs(one, make("Dev"), c, ts())
    assert sorted((r.title, r.is_active) for r in two.collect()) == [("Dev", True), ("Stajyer", False)]
    assert J.sync_jobs(two, make("Dev"), c, ts()).count() == 2
    assert J.sync_jobs(one, make(), c.limit(0), ts()).where("is_active").count() == 2
    assert {(r.change) for r in J.job_diff(two, make("Stajyer", "New")).collect()} == {"reopened", "added", "closed"}


def test_labels(spark):
    r = spark.createDataFrame([(1, ["oyun", "nope", "oyun"], "dev", "kamu", ["python", " "], 0.5, "u", "m")], "company_id long, domain array<string>, size_bucket string, sector string, stack array<string>, confidence double, page_url string, model string")
    v = B.validate_labels(r)
    x = v.first()
    assert (x.domain, x.size_bucket, x.sector, x.rejected) == (["oyun", "oyun"], None, "kamu", ["nope", "dev"])
    state = spark.createDataFrame([(1, "domain", "oyun", 0.9, "first", "old", None)], "company_id long, dimension string, label string, confidence double, evidence_url string, model string, as_of timestamp")
    got = {(y.dimension, y.label): (y.confidence, y.evidence_url) for y in B.add_labels(state, B.label_rows(v), ts()).collect()}
    assert got == {("domain", "oyun"): (0.5, "first"), ("stack", "python"): (0.5, "u")}
    hints = spark.createDataFrame([(1, "directory_sector", "Yazılım"), (1, "directory_sector", "Bilişim ve Yazılım")], "company_id long, dimension string, label string")
    assert B.directory_hint(hints).first().hint == "Yazılım"
    assert spark.createDataFrame([("x" * 81,), ("",), ("ok",)], "h string").select(B.clean_hint(F.col("h")).alias("h")).where("h is not null").count() == 1
    assert B.taxonomy_df(spark).count() == 25


def test_evidence(spark):
    people = spark.createDataFrame([(1, 0, "KURUCU ORTAK Işık", 0.9), (1, 1, "kısa", 0.9), (1, 2, "not in any page", 0.9), (2, 0, "kurucu ortak ışık", 0.9)], "company_id long, person_no int, evidence_quote string, confidence double")
    p = spark.createDataFrame([(1, 0, "a", "boş"), (1, 1, "b", "Biz: kurucu ortak IŞIK Bey"), (1, 2, "c", "kurucu ortak ışık"), (2, 0, "d", None)], "company_id long, pos int, url string, text string")
    got = {(r.company_id, r.person_no): (r.source_url, r.reason) for r in P.verify_evidence(people, p).collect()}
    assert got == {(1, 0): ("b", None), (1, 1): (None, "quote too short"), (1, 2): (None, "quote not found"), (2, 0): (None, "quote not found")}
    assert {r.company_id for r in P.needs_second_tier(P.verify_evidence(people, p)).collect()} == {1, 2}


SOURCE = "key string, mode string, item_selector string, name_selector string, name_attr string, website_selector string, sector_selector string, sector_attr string, detail_selector string, enabled boolean, city string"


def discover(spark, source, bodies, details=None):
    p = spark.createDataFrame([(i, "s", i + 1, f"https://dir.org/l?p={i + 1}", st, b) for i, (st, b) in enumerate(bodies)], "page_id long, source_key string, page_no int, url string, status int, body string")
    base = {"key": "s", "mode": "structured", "item_selector": None, "name_selector": None, "name_attr": None, "website_selector": "a", "sector_selector": None, "sector_attr": None, "detail_selector": "a", "enabled": True, "city": "Ankara"}
    s = spark.createDataFrame([tuple((base | source)[k.split()[0]] for k in SOURCE.split(", "))], SOURCE)
    return D.discover_listings(p, s, details).orderBy("page_no", "pos").collect()


def test_structured(spark):
    html = '<div class="card"><h3 class="t">Alfa</h3><a href="https://alfa.com">w</a><p title="Uzun Sektör">kısa</p></div><div class="card x"><a href="https://beta.com"></a></div><div class="card"></div><div class="card"><a href="/in" title="Gama">g</a></div>'
    got = discover(spark, {"item_selector": "div.card", "name_selector": "h3.t", "sector_selector": "p", "sector_attr": "title"}, [(200, html), (200, html), (200, "<div class=card><a title=Z></a></div>")])
    assert [(r.name, r.website, r.sector, r.city) for r in got] == [("Alfa", "https://alfa.com", "Uzun Sektör", "Ankara"), ("beta.com", "https://beta.com", None, "Ankara"), ("Gama", None, None, "Ankara")]


def test_outbound_and_detail(spark):
    html = '<a href="https://x.com/a">X</a><div class="box"><a href="https://a.com" title="Alfa">t</a><a href="https://www.a.com/b">Again</a><a href="https://b.com">https://b.com</a><a href="/own">o</a></div><a href="https://c.com">C Ltd</a>'
    assert [r.name for r in discover(spark, {"mode": "outbound"}, [(200, html)])] == ["Alfa", "b.com", "C Ltd"]
    assert [r.name for r in discover(spark, {"mode": "outbound", "item_selector": "div.box"}, [(200, html)])] == ["Alfa", "b.com"]
    details = spark.createDataFrame([("https://dir.org/f/1", 200, '<a href="https://promo.com">promo</a><a href="https://www.adik.com.tr/">adik.com.tr</a>')], "url string, status int, body string")
    got = discover(spark, {"mode": "detail", "item_selector": "li"}, [(200, '<ul><li><a href="/f/1">Adik</a><li><a>none</a></ul>'), (404, "x")], details)
    assert [(r.name, r.website) for r in got] == [("Adik", "https://www.adik.com.tr/")]


def test_company_info(spark):
    rows = [("1", '{"company":{"title":"T","website":"a.com","website_url":""}}'), ("2", "[]"), ("3", '{"company": 5}'), ("4", '{"company":{"website_url":"https://b.com"}}'), ("5", None)]
    got = {r.row_id: r.website for r in D.parse_company_info(spark.createDataFrame(rows, "row_id string, body string")).collect()}
    assert got == {"1": "a.com", "2": None, "3": None, "4": "https://b.com", "5": None}
    cards = spark.createDataFrame([(0, 1, 200, '<div class="company-card" data-row-id="1" title="Acme A.Ş."></div>'), (1, 2, 200, '<div class="company-card" data-row-id="1" title="Acme"></div>'), (2, 3, 200, '<div class="company-card" data-row-id="9" title="Late"></div>')], "page_id long, page_no int, status int, body string")
    ids = D.row_ids(cards)
    assert [(r.row_id, r.title) for r in ids.collect()] == [("1", "Acme A.Ş.")]
    c = spark.createDataFrame([(7, "acme", None, None), (8, "other", None, None)], "id long, name_norm string, website string, domain string")
    assert {r.id: r.domain for r in D.enrich_websites(c, ids, spark.createDataFrame(rows, "row_id string, body string")).collect()} == {7: "a.com", 8: None}


def test_frontier(spark):
    log = spark.createDataFrame([("https://a.com/1", 200, "x", False, "2024-01-09"), ("https://a.com/2", 200, "x", False, "2023-01-01")], "url string, status int, body string, blocked_by_robots boolean, t string").withColumn("fetched_at", F.to_timestamp("t"))
    urls = spark.createDataFrame([("https://a.com/1",), ("https://a.com/2",), ("https://a.com/2",), ("https://a.com/admin/x",), ("https://b.com/",)], "url string")
    rules = spark.createDataFrame([("https://a.com", "/admin"), ("https://b.com", "")], "origin string, path string")
    got = {r.url: (r.decision, r.slot_no) for r in R.plan_frontier(urls, log, rules, F.to_timestamp(F.lit("2024-01-10"))).collect()}
    assert got == {"https://a.com/1": ("fresh", None), "https://a.com/2": ("fetch", 1), "https://a.com/admin/x": ("disallowed", None), "https://b.com/": ("fetch", 1)}


def test_status_and_share(spark):
    with pytest.raises(Exception, match="unknown status"):
        c = spark.createDataFrame([(1, None, None, None)], "id long, user_status string, user_note string, user_updated_at timestamp")
        C.annotate(c, spark.createDataFrame([(1, "bad", None)], "id long, user_status string, user_note string"), ts()).collect()
    r = spark.range(1).select(C.share(F.lit(2), F.lit(3)).alias("a"), C.share(F.lit(2), F.lit(3), True).alias("b"), C.share(F.lit(0), F.lit(0)).alias("c")).first()
    assert tuple(r) == (66, 67, 0)


def test_upserts(spark):
    s = spark.createDataFrame([("a", "k", "n", "u", "p", False)], "key string, kind string, name string, url string, parser string, enabled boolean")
    new = spark.createDataFrame([("a", "k2", "n2", "u", "p", True), ("b", "k", "n", "u", "p", True)], s.schema)
    assert {r.key: (r.kind, r.enabled) for r in E.upsert_sources(s, new).collect()} == {"a": ("k2", False), "b": ("k", True)}
    c = spark.createDataFrame([(1, "A", "a", "a.com", "Ankara", None, None, None)], "id long, name string, name_norm string, domain string, city string, website string, first_seen timestamp, last_seen timestamp")
    n = spark.createDataFrame([(9, "A2", "a2", "a.com", None, "https://a.com"), (5, "B", "b", "b.com", None, None)], "id long, name string, name_norm string, domain string, city string, website string")
    got = {r.id: (r.name, r.city, r.website) for r in E.upsert_companies(c, n, ts()).collect()}
    assert got == {1: ("A", "Ankara", "https://a.com"), 5: ("B", None, None)}
    d = spark.createDataFrame([(1, "old", "lever", "x", None, None, None)], "id long, careers_url string, ats_provider string, ats_slug string, detect_status string, detect_note string, detect_checked_at timestamp")
    f = spark.createDataFrame([(1, None, None, None, "none", None)], "company_id long, careers_url string, ats_provider string, ats_slug string, detect_status string, detect_note string")
    r = J.save_detection(d, f, ts()).first()
    assert (r.careers_url, r.ats_provider, r.detect_status) == ("old", None, "none") and r.detect_checked_at


def test_label_and_people_jobs(spark):
    schema = "company_id long, seq long, domain array<string>, size_bucket string, sector string, stack array<string>, confidence double, page_url string, model string"
    first = spark.createDataFrame([(1, 1, ["nope"], None, None, [], 0.9, "u", "a"), (1, 2, ["oyun"], "orta", None, [], 0.5, "u", "a"), (2, 1, ["fintech", "bad"], None, "kamu", ["go"], 0.8, "v", "a")], schema)
    second = spark.createDataFrame([(1, 1, ["ai_ml"], "buyuk", None, [], 0.9, "u", "b"), (2, 1, ["oyun"], None, None, [], 0.9, "v", "b")], schema)
    state = spark.createDataFrame([], "company_id long, dimension string, label string, confidence double, evidence_url string, model string, as_of timestamp")
    companies = spark.createDataFrame([(1, "mikro", None, None), (2, None, None, None), (3, None, None, None)], "id long, size_bucket string, sector string, classify_checked_at timestamp")
    labels, saved, rejected = B.label_companies(first, state, companies, ts(), second)
    assert {(r.company_id, r.label) for r in labels.collect()} == {(1, "ai_ml"), (2, "fintech"), (2, "go")}
    assert {r.id: (r.size_bucket, r.sector, r.classify_checked_at is not None) for r in saved.collect()} == {1: ("mikro", None, True), 2: (None, "kamu", True), 3: (None, None, False)}
    assert [(r.company_id, r.label) for r in rejected.collect()] == [(2, "bad")]
    person = "company_id long, seq long, people array<struct<name: string, role: string, email: string, contact_type: string, evidence_quote: string, confidence: double>>"
    one = spark.createDataFrame([(1, 1, [("Ad Soyad", "CEO", None, "executive", "Ad Soyad, CEO", 0.9), ("X", "Y", None, "executive", "invented quote", 0.9)]), (2, 1, [("B C", "IK", "ik@b.com", "hr", "B C ik@b.com", 0.8)])], person)
    two = spark.createDataFrame([(1, 1, [("Ad Soyad", "CEO", "ceo@a.com", "executive", "ad soyad, ceo", 0.95)])], person)
    pages = spark.createDataFrame([(1, 0, "https://a.com/t", "Ekip: AD SOYAD, CEO"), (2, 0, "https://b.com/t", "B C ik@b.com")], "company_id long, pos int, url string, text string")
    empty = spark.createDataFrame([], K.CONTACT_COLUMNS)
    got, bad = P.verify_people(one, pages, empty)
    assert {(r.company_id, r.name, r.email) for r in got.collect()} == {(1, "Ad Soyad", None), (2, "B C", "ik@b.com")} and [r.name for r in bad.collect()] == ["X"]
    got, bad = P.verify_people(one, pages, empty, two)
    assert {(r.company_id, r.email) for r in got.collect()} == {(1, "ceo@a.com"), (2, "ik@b.com")} and bad.count() == 0


def test_passages_of_any_length(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "prequick brownish"), (3, None), (4, "")], "doc_id long, text string")
    asked = [("a", "quick brown fox jumps over the lazy"), ("b", "brown fox jumps"), ("c", "quick brown"), ("d", "ick"), ("e", "jumps over a"), ("f", ""), ("g", None), ("h", "fox jumps over the")]
    got = P.passages_held(spark.createDataFrame(asked, "item_id string, q string"), docs).collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("b", 1), ("c", 1), ("c", 2), ("d", 1), ("d", 2), ("h", 1)]
    assert P.passages_held(spark.createDataFrame([], "item_id string, q string"), docs).count() == 0


def test_passages_against_all_pairs(spark, monkeypatch):
    import random

    r = random.Random(2)
    texts = ["".join(r.choice("aab ç\n😀") for _ in range(r.randrange(60))) for _ in range(60)]
    asked = [t[i : i + r.randrange(1, 30)] for t in texts[:40] if t for i in [r.randrange(len(t))]]
    docs, items = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(asked)), "item_id long, q string")
    want = sorted((i, d) for i, q in enumerate(asked) for d, t in enumerate(texts) if q in t)
    for limit in (P.MAX_BITS, 64):  # a full bitmap lets all windows pass
        monkeypatch.setattr(P, "MAX_BITS", limit)
        monkeypatch.setattr(P, "BROADCAST_KEYS", limit - 64)
        assert sorted(map(tuple, P.passages_held(items, docs).collect())) == want


def test_labels_do_not_depend_on_order(spark):
    state = spark.createDataFrame([], "company_id long, dimension string, label string, confidence double, evidence_url string, model string, as_of timestamp")
    rows = [(1, "domain", "x", 0.5 + k / 10, f"u{k}", f"m{k}", k) for k in range(4)]
    for some in (rows, rows[::-1]):
        new = spark.createDataFrame(some, "company_id long, dimension string, label string, confidence double, evidence_url string, model string, seq long").repartition(3)
        (r,) = B.add_labels(state, new, ts()).collect()
        assert (r.confidence, r.evidence_url, r.model) == (0.8, "u0", "m0")


def test_row_ids_stop_by_source(spark):
    card = lambda i: f"<div class='company-card' data-row-id='{i}' title='T{i}'></div>"
    rows = [(1, "s", 1, 200, card(1)), (2, "s", 2, 200, card(1)), (3, "s", 3, 200, card(2)), (4, "t", 1, 200, card(5)), (5, "t", 2, 200, card(6)), (6, "t", 3, 200, card(1))]
    got = D.row_ids(spark.createDataFrame(rows, "page_id long, source_key string, page_no int, status int, body string")).collect()
    assert sorted((r.source_key, r.row_id) for r in got) == [("s", "1"), ("t", "1"), ("t", "5"), ("t", "6")]


KNOWN = [(1, "ACME", "acme bilisim", "acme.com.tr"), (2, "Öztürk", "ozturk yazilim", None), (3, "Alfa", "alfa teknoloji", None), (4, "Alfa 2", "alfa teknoloji", "alfa.com"), (5, "abc", "abc", None), (6, "Robotik", "robotik sistemler ankara", None), (7, "Robotik", "robotik sistemler ankara x", "robotik.com")]


def known(spark):
    return spark.createDataFrame(KNOWN, "id long, name string, name_norm string, domain string")


def test_match_existing(spark):
    listed = [(1, "Anything", "https://kariyer.acme.com.tr/is"), (2, "OZTURK YAZILIM San. ve Tic. A.Ş.", None), (3, "Alfa Teknoloji", "https://beta.com"), (4, "ABC", None), (5, "Ankara Robotik Sistemlr", None), (6, "Brand New", "new.com"), (7, None, None), (8, "Robotik Sistemler Ankara X", None)]
    rows = E.keyed(spark.createDataFrame(listed, "seq long, name string, website string"))
    got = {r.seq: (r.known, r.how) for r in E.match_existing(rows, known(spark)).collect()}
    assert got == {1: (1, "domain"), 2: (2, "name"), 3: (3, "name"), 5: (6, "similar"), 8: (7, "name")}
    index = E.name_index(known(spark).select(F.col("id").alias("key"), "name_norm"))
    assert {r.seq: r.known for r in E.match_existing(rows, known(spark), index).collect()} == {k: v for k, (v, _) in got.items()}  # entries of companies with a domain don't count
    assert E.match_existing(rows.limit(0), known(spark)).count() == 0 and E.match_existing(rows, known(spark).limit(0)).count() == 0


def test_stored_name_index(spark, tmp_path):
    """Probes of an index that was kept and added to find what all pairs find."""
    import random

    r = random.Random(5)
    words = "alfa beta gama delta teknoloji yazilim robotik sistem ankara savunma enerji bulut".split()
    names = [" ".join(r.sample(words, r.randrange(1, 5))) + r.choice(["", "x", " 2"]) for _ in range(120)]
    first, later = ([(i, n) for i, n in enumerate(names) if i % 3 < k and i % 3 >= j] for j, k in ((0, 2), (2, 3)))
    make = lambda rows: spark.createDataFrame(rows, "key long, name_norm string")
    io.save_table(E.name_index(make(first)), str(tmp_path), "index", 1)
    old = io.load_table(spark, str(tmp_path), "index")
    io.save_table(old.unionByName(E.name_index(make(later), old)), str(tmp_path), "index", 2)
    asked = [n[: len(n) // 2] + r.choice("abc") + n[len(n) // 2 :] for n in names[:60]] + ["zz", "unheard of"]

    def score(a, b):
        a, b = (" ".join(sorted(x.split())) for x in (a, b))
        p = [0] * (len(b) + 1)
        for x in a:
            q = [0]
            for j, y in enumerate(b):
                q.append(p[j] + 1 if x == y else max(p[j + 1], q[-1]))
            p = q
        return 200 * p[-1] / (len(a) + len(b))

    want = {}
    for a in asked:
        s, i = min((-score(a, n), i) for i, n in enumerate(names) if len(n) >= 4)
        if s <= -85 and len(a) >= 4:
            want[a] = (i, round(-s, 6))
    got = E.probe_names(spark.createDataFrame([(a,) for a in asked], "name_norm string"), io.load_table(spark, str(tmp_path), "index"), 85)
    assert {g.name_norm: (g.known, round(g.score, 6)) for g in got.collect()} == want and len(want) > 30


def test_entities_of_known_companies(spark):
    """A component takes the known company of any of its rows, by domain first; others are new."""
    listed = [(1, "Alfa Teknoloji", "https://acme.com.tr", None, "a", "u"), (2, "Alfa Teknoloji", None, "Ankara", "b", "u"), (3, "Yeni Firma", "yeni.com", None, "a", "u"), (4, "Yeni Firma A.Ş.", None, "Izmir", "b", "u"), (5, "Ozturk Yazilm", None, None, "a", "u")]
    rows = spark.createDataFrame(listed, "seq long, name string, website string, city string, source_key string, listed_url string")
    resolved = E.resolve_entities(rows, state=known(spark))
    assert {r.seq: (r.entity, r.known) for r in resolved.collect()} == {1: (1, 1), 2: (1, 1), 3: (3, None), 4: (3, None), 5: (5, 2)}
    state = known(spark).withColumns({"city": F.lit(None).cast("string"), "website": F.lit(None).cast("string"), "first_seen": ts(), "last_seen": ts()})
    after = {r.id: r for r in E.upsert_companies(state, E.companies_of(resolved, ts()), ts()).collect()}
    assert len(after) == len(KNOWN) + 1 and after[1].city == "Ankara" and after[1].name == "ACME" and after[2].domain is None
    twice = E.upsert_companies(state, spark.createDataFrame([(90, "x", "ozturk yazilim", None, None, "w"), (91, "y", "ozturk yazilim", "o.com", "Van", "v")], "id long, name string, name_norm string, domain string, city string, website string"), ts())
    assert {(r.id, r.domain, r.city, r.website) for r in twice.where("id = 2").collect()} == {(2, "o.com", "Van", "w")} and twice.count() == len(KNOWN)


def test_subsequence_length(spark):
    import random

    r = random.Random(1)
    rows = [tuple("".join(r.choice("abcç ") for _ in range(r.choice([0, 1, 7, 61, 62, 63, 130]))) for _ in range(2)) for _ in range(80)]

    def lcs(a, b):
        p = [0] * (len(b) + 1)
        for x in a:
            q = [0]
            for j, y in enumerate(b):
                q.append(p[j] + 1 if x == y else max(p[j + 1], q[-1]))
            p = q
        return p[-1]

    got = spark.createDataFrame(rows, "x string, y string").select("x", "y", E.lcs_length(F.col("x"), F.col("y")).alias("n")).collect()
    assert all(g.n == lcs(g.x, g.y) for g in got)


def test_robots_and_slots_against_all_pairs(spark):
    """A hot origin over several ranges, and rules of many lengths, some of which begin others."""
    import random

    r = random.Random(3)
    path = lambda: "/" + "/".join(r.choice(["a", "ab", "é", "x y"]) for _ in range(r.randrange(4)))
    urls = sorted({f"https://{'hot' if r.random() < 0.6 else f'h{r.randrange(9)}'}.com{path()}{r.choice(['', '?q=1', '#f'])}{i if r.random() < 0.7 else ''}" for i in range(400)} | {"https://h1.com", "no url"})
    rules = [(f"https://{h}.com", path()) for h in ("hot", "h1", "h2", "h3") for _ in range(3)] + [("https://h4.com", ""), ("https://h5.com", "/")]
    log = spark.createDataFrame([], "url string, status int, body string, blocked_by_robots boolean, fetched_at timestamp")
    df, rf = spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(rules, "origin string, path string")
    plan = R.plan_frontier(df, log, rf, F.to_timestamp(F.lit("2024-01-10")))
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {x.url: (x.decision, x.slot_no, x.offset_s) for x in plan.collect()}
    want, slots = {}, {}
    for u in urls:
        o = u[: u.index("/", 8)] if u.count("/") > 2 else u
        p = u[len(o) :].split("#")[0] or "/"
        if any(o == ro and rp and p.startswith(rp) for ro, rp in rules):
            want[u] = ("disallowed", None, None)
        else:
            o = "" if u == "no url" else o
            slots[o] = slots.get(o, 0) + 1
            want[u] = ("fetch", slots[o], slots[o] - 1.0)
    assert got == want and sum(x[0] == "disallowed" for x in got.values()) > 20
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = R.ranked_within(spark.range(1000).select((F.col("id") % 2 == 0).cast("string").alias("g"), F.col("id").alias("o")).repartition(3), "g", "o", "n")
        assert all(x.n == x.o // 2 + 1 for x in many.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
