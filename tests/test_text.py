"""Text rules on literal values."""

import pytest
from pyspark.sql import functions as F

from firmlens.functions import text as T

CASES = [
    (T.fold, "İnsan Kaynakları", "insan kaynaklari"),
    (T.fold, "ÇĞİÖŞÜ", "cgiosu"),
    (T.tr_lower, "IŞIK", "ışık"),
    (T.normalize_name, "ACME Bilişim A.Ş.", "acme bilisim"),
    (T.normalize_name, "ACME Bilişim Ltd. Şti.", "acme bilisim"),
    (T.normalize_name, "Grup A.Ş.", "grup as"),
    (T.normalize_name, "Öztürk Yazılım San. ve Tic. A.Ş.", "ozturk yazilim"),
    (T.url_host, "https://www.acme.com.tr/kariyer", "acme.com.tr"),
    (T.url_host, "acme.com:8080/x", "acme.com"),
    (T.url_host, "https://me@acme.com", "acme.com"),
    (T.url_host, "localhost", None),
    (T.url_host, "", None),
    (T.url_host, None, None),
    (T.registrable_domain, "kariyer.acme.com.tr", "acme.com.tr"),
    (T.registrable_domain, "jobs.acme.com", "acme.com"),
    (T.registrable_domain, "com.tr", "com.tr"),
    (T.emails, "b@x.com, A@X.com b@x.com logo@2x.png", ["b@x.com", "a@x.com"]),
    (T.emails, r">legal@acme.com<", ["legal@acme.com"]),
    (T.mailto, 'href="mailto:info@acme.com?subject=x" mailto:no', ["info@acme.com"]),
    (T.mailto, 'mailto:info@acme.com\\"', ["info@acme.com"]),
    (T.email_class, "kariyer@a.com", "hr"),
    (T.email_class, "stajbasvurusu@a.com", "hr"),
    (T.email_class, "info@a.com", "generic"),
    (T.email_class, "ad.soyad@a.com", "personal"),
    (T.phone, "Tel: +90 (312) 555 12 34.", "+90 (312) 555 12 34"),
    (T.phone, "no number", None),
    (T.is_internship, "Yazılım Stajyeri", True),
    (T.is_internship, "Working Student - Backend", True),
    (T.is_internship, "Co-op Engineer", True),
    (T.is_internship, "İç Denetim Uzmanı", False),
    (T.is_internship, None, False),
    (T.match_haystack, "/insan-kaynaklari", " insan kaynaklari"),
    (T.squash_ws, "  a \n\t b ", "a b"),
    (T.clean, "   ", None),
    (T.skip_link, "https://linkedin.com/company/x", True),
    (T.skip_link, "https://linkedin.com/jobs/x", False),
    (T.page_text, "<p>a&amp;b</p><script>x < 1</script><style>y</style><!-- c --> d", "a&b d"),
]


@pytest.mark.parametrize(("rule", "given", "want"), CASES)
def test_value(spark, rule, given, want):
    row = spark.createDataFrame([(given,)], "x string").select(rule(F.col("x")).alias("y")).first()
    assert row.y == want


RESOLVE = [
    ("https://a.com/x/y", "z", "https://a.com/x/z"), ("https://a.com/x/y", "/z#f", "https://a.com/z"), ("https://a.com", "z", "https://a.com/z"),
    ("https://a.com/x/", "../z", "https://a.com/z"), ("https://a.com/x/y/q", "../../z", "https://a.com/z"), ("https://a.com/x", "../../z", "https://a.com/z"),
    ("https://a.com/x?q=1", "?p=2", "https://a.com/x?p=2"), ("https://a.com/x", "//b.com/y", "https://b.com/y"), ("https://a.com/x", "http://c.com/", "http://c.com/"),
    ("https://a.com/x", "#top", "https://a.com/x"), ("https://a.com/x/./y", "./z", "https://a.com/x/z"),
]


def test_resolve_url(spark):
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(RESOLVE)], "b string, h string, want string, i int")
    got = rows.select("i", "want", T.resolve_url(F.col("b"), F.col("h")).alias("got")).collect()
    assert [(r.i, r.got) for r in got if r.got != r.want] == []


SITES = [
    ("https://defensx.com", True), ("https://x.com/a", False), ("https://acme.com.tr", True), ("https://dir.org/a", False), ("https://sub.dir.org/a", False),
    ("https://acme.com/kid.pdf", False), ("ftp://acme.com", False), ("https://acme", False), ("https://www.linkedin.com/in", False),
]


def test_company_site(spark):
    rows = spark.createDataFrame(SITES, "u string, want boolean")
    got = rows.select("u", "want", T.is_company_site(F.col("u"), F.lit("www.dir.org")).alias("got")).collect()
    assert [r.u for r in got if r.got != r.want] == []


def test_pairs(spark):
    e = [("a@acme.com", "acme.com", True), ("a@mail.acme.com", "acme.com", True), ("a@notacme.com", "acme.com", False), ("a@x.kep.tr", "acme.com", True), ("ornek@mail.com", "acme.com", False), ("a@acme.com", "k.acme.com", True)]
    got = spark.createDataFrame(e, "e string, d string, want boolean").select("e", "want", T.own_domain_email(F.col("e"), F.col("d")).alias("got")).collect()
    assert [r.e for r in got if r.got != r.want] == []
    u = [("adik.com.tr", "https://www.adik.com.tr/", True), ("https://q.com", "https://z.com", True), ("Acme", "https://acme.com", False), (None, "https://acme.com", False)]
    got = spark.createDataFrame(u, "t string, u string, want boolean").select("t", "want", T.is_url_like(F.col("t"), F.col("u")).alias("got")).collect()
    assert [r.t for r in got if r.got != r.want] == []


def test_page_url_and_time(spark):
    rows = spark.createDataFrame([("https://a.com/l?x=1#f", "page", 2, "https://a.com/l?x=1&page=2#f"), ("https://a.com/l", "page", 1, "https://a.com/l"), ("https://a.com/l", None, 3, "https://a.com/l"), ("https://a.com/l", "p", 3, "https://a.com/l?p=3")], "u string, p string, n int, want string")
    assert all(r.got == r.want for r in rows.select("want", T.page_url(F.col("u"), F.col("p"), F.col("n")).alias("got")).collect())
    ms = spark.createDataFrame([("1700000000000",), ("x",), (None,)], "x string").select(T.epoch_ms_to_ts(F.col("x")).cast("string").alias("t")).collect()
    assert [r.t for r in ms] == ["2023-11-14 22:13:20", None, None]
