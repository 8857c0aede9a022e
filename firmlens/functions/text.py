"""Text, URL, date and hash rules as Column expressions; all run inside generated code.

Null in gives null out unless a rule says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turkish capitals and their small letters, and the folds to ASCII.
TR_CAPITALS, TR_SMALL = "IİŞĞÜÖÇ", "ıişğüöç"
FOLD_FROM, FOLD_TO = "ışğüöçâîû", "isguocaiu"
#: Legal-form words, folded and without dots.
LEGAL_WORDS = (
    "as", "anonim", "sirketi", "ltd", "limited", "sti", "san", "sanayi", "tic", "ticaret",
    "ve", "inc", "llc", "gmbh", "bv", "co", "corp", "holding", "grup", "group",
)
#: Suffixes under which the registrable domain has three labels.
TWO_LEVEL_SUFFIXES = ("com.tr", "net.tr", "org.tr", "edu.tr", "gov.tr", "bel.tr", "web.tr", "co.uk", "com.au")
#: Mailbox names.
HR_MAILBOXES = (
    "ik", "insankaynaklari", "insan.kaynaklari", "insan_kaynaklari", "ikbasvuru", "kariyer", "kariyer.basvuru", "staj", "stajyer",
    "hr", "jobs", "job", "career", "careers", "recruitment", "recruiting", "cv", "basvuru", "isealim",
)
HR_PARTS = ("kariyer", "insankaynak", "staj", "recruit")
GENERIC_MAILBOXES = (
    "info", "iletisim", "bilgi", "contact", "hello", "merhaba", "destek", "support",
    "admin", "office", "mail", "sales", "satis", "pazarlama", "marketing",
)
IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg")
#: Patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+90|0)?\s?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}\b"
MAILTO = r"""(?i)mailto:([^"'\s?\\]+)"""
INTERNSHIP = r"(?i)\b(staj(yer|\b)|bursiyer|intern\b|internship|co-?op\b|working\s+student|öğrenci\s+program|ogrenci\s+program)"
SKIP_LINK = r"(?i)(facebook|twitter|x\.com|instagram|linkedin\.com/(?!jobs)|youtube|whatsapp|mailto:|tel:|javascript:|\.pdf$|\.jpg$|\.png$|/blog/|/haber|/news/)"
NOT_A_SITE = (
    r"(?i)(facebook|twitter|(?<![a-z0-9])x\.com|instagram|linkedin|youtube|whatsapp|pinterest|tiktok|google\.|gstatic|googleapis|cloudflare|jquery|"
    r"bootstrap|fontawesome|\.gov\.tr|\.edu\.tr|mersis|ticaretsicil|mkk\.com\.tr|ttr\.com\.tr|apple\.com|play\.google|adobe\.com|w3\.org|schema\.org|"
    r"medium\.com|substack\.com|junipersquare\.com|carta\.com|list-manage\.com|eepurl\.com|mailchimp\.com|fliphtml5\.com)"
)
DOCUMENT_PATH = r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip)$"
URL_TEXT = r"(?i)^\s*(https?://|www\.)"


def tr_lower(c: Column) -> Column:
    return F.lower(F.translate(c, TR_CAPITALS, TR_SMALL))


def fold(c: Column) -> Column:
    return F.translate(tr_lower(c), FOLD_FROM, FOLD_TO)


def normalize_name(c: Column) -> Column:
    """Folded words without dots and legal forms; if only those are there, they stay."""
    words = F.filter(F.transform(F.split(F.regexp_replace(fold(c), r"[^\p{L}\p{N}_\s.]", " "), r"\s+"), lambda w: F.replace(w, F.lit("."), F.lit(""))), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(*LEGAL_WORDS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def clean(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def squash_ws(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def url_host(c: Column) -> Column:
    """Host of a URL with or without scheme: no user, port or `www.`; null if it has no dot or ends with one."""
    u = F.trim(c)
    u = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":.*$", ""), r"^www\.", "")
    return F.when(host.contains(".") & ~host.endswith("."), host)


def registrable_domain(c: Column, suffixes: Iterable[str] = TWO_LEVEL_SUFFIXES) -> Column:
    parts = F.split(c, r"\.")
    last = lambda n: F.array_join(F.slice(parts, -n, n), ".")
    return F.when(F.size(parts) <= 2, c).when(last(2).isin(*suffixes), last(3)).otherwise(last(2))


def host_of(c: Column) -> Column:
    """Lower-cased network location without `www.`; the port stays, no scheme gives an empty string."""
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), r"^www\.", "")


def same_site(url: Column, domain: Column) -> Column:
    return (host_of(url) == domain) | host_of(url).endswith(F.concat(F.lit("."), domain))


def match_haystack(*cols: Column) -> Column:
    return F.regexp_replace(fold(F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in cols))), r"[-_/.]+", " ")


def unescape_js(c: Column) -> Column:
    r"""`\uXXXX` escapes to their characters."""
    parts = F.split(c, r"(?=\\u[0-9a-fA-F]{4})")
    one = lambda p: F.when(p.rlike(r"^\\u[0-9a-fA-F]{4}"), F.concat(F.decode(F.unhex(F.substring(p, 3, 4)), "UTF-16BE"), F.substr(p, F.lit(7)))).otherwise(p)
    return F.array_join(F.transform(parts, one), "")


def emails(c: Column) -> Column:
    """Distinct addresses in order, lower-cased; image names don't count."""
    hits = F.transform(F.regexp_extract_all(unescape_js(F.coalesce(c, F.lit(""))), F.lit(f"({EMAIL})"), 1), lambda e: F.btrim(F.lower(e), F.lit(".")))
    good = lambda e: ~F.exists(F.array(*map(F.lit, IMAGE_ENDINGS)), lambda end: F.endswith(e, end))
    return F.array_distinct(F.filter(hits, good))


def mailto(c: Column) -> Column:
    hits = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MAILTO), 1), lambda e: F.lower(F.trim(e)))
    return F.filter(hits, lambda e: e.contains("@"))


def page_emails(c: Column) -> Column:
    """mailto: links first, then the text's addresses."""
    return F.array_distinct(F.concat(mailto(c), emails(c)))


def email_class(c: Column) -> Column:
    local = F.lower(F.substring_index(c, "@", 1))
    hr = local.isin(*HR_MAILBOXES)
    for part in HR_PARTS:
        hr |= local.contains(part)
    return F.when(hr, "hr").when(local.isin(*GENERIC_MAILBOXES), "generic").otherwise("personal")


def phone(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, PHONE, 0)), F.lit(""))


def own_domain_email(email: Column, domain: Column, suffixes: Iterable[str] = TWO_LEVEL_SUFFIXES) -> Column:
    at, root = F.lower(F.substring_index(email, "@", -1)), registrable_domain(domain, suffixes)
    return (at == "kep.tr") | at.endswith(".kep.tr") | (at == domain) | (at == root) | at.endswith(F.concat(F.lit("."), root))


def is_internship(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    return F.concat(fold(t), F.lit(" "), t).rlike(INTERNSHIP)


def epoch_ms_to_ts(c: Column) -> Column:
    return F.timestamp_millis(c.try_cast("bigint"))


def job_fingerprint(company: Column, title: Column, location: Column) -> Column:
    return F.sha2(F.concat_ws("|", company.cast("string"), normalize_name(F.coalesce(title, F.lit(""))), F.lower(F.trim(F.coalesce(location, F.lit(""))))), 256)


def url_key(c: Column) -> Column:
    return F.sha2(c, 256)


def url_bucket(c: Column) -> Column:
    return F.substring(url_key(c), 1, 2)


def page_url(list_url: Column, param: Column, n: Column) -> Column:
    """Page 1, or no parameter: the list itself; else `param=n` after the query, before the fragment."""
    base, query, mark = F.regexp_extract(list_url, r"^([^?#]*)", 1), F.regexp_extract(list_url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(list_url, r"(#.*)$", 1)
    added = F.concat(base, F.lit("?"), F.when(query != "", F.concat(query, F.lit("&"))).otherwise(""), param, F.lit("="), n.cast("string"), mark)
    return F.when((n <= 1) | param.isNull() | (param == ""), list_url).otherwise(added)


#: resolve_url folds at most so many `../` steps.
DOT_DEPTH = 6


def resolve_url(base: Column, href: Column) -> Column:
    """`href` against `base`, without fragment; dot segments fold DOT_DEPTH levels."""
    h = F.trim(href)
    scheme, root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    joined = (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("?"), F.concat(root, path, h))
        .when((h == "") | h.startswith("#"), base)
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), h))
    )
    out = F.regexp_replace(joined, r"#.*$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"/(\./)+", "/"), r"/\.$", "/")
    for _ in range(DOT_DEPTH):
        out = F.regexp_replace(out, r"(?<=[^/:])/(?!\.\./)[^/?#]+/\.\.(?:/|$)", "/")
    return F.regexp_replace(out, r"(://[^/]+)(/\.\.)+(?=/|$)", "$1")


def is_company_site(url: Column, directory_host: Column) -> Column:
    host = F.replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1)), F.lit("www."), F.lit(""))
    root, path = F.replace(directory_host, F.lit("www."), F.lit("")), F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    return url.rlike("^https?://") & ~url.rlike(NOT_A_SITE) & ~path.rlike(DOCUMENT_PATH) & host.contains(".") & ~((host == root) | host.endswith(F.concat(F.lit("."), root)))


def is_url_like(text: Column, url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "/+$", ""), r"^www\.", "")
    return F.coalesce(text.rlike(URL_TEXT) | (bare == url_host(url)), F.lit(False))


def skip_link(href: Column) -> Column:
    return href.rlike(SKIP_LINK)


#: The named character references that page_text decodes.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def page_text(html: Column, max_chars: int = 12_000) -> Column:
    """Visible text: scripts, styles, comments and tags removed, white space squashed, cut at max_chars."""
    t = F.coalesce(html, F.lit(""))
    for tag in ("script", "style", "noscript"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for name, char in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, max_chars)
