"""Directory discovery: HTML nodes, listing entries, pagination, website lookups."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import text as T
from firmlens.sources.shared import stored

SIGNATURE_NAMES = 10
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NODE = pa.struct([
    ("node", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("start", pa.int32()), ("end", pa.int32()),
])
NODE_SCHEMA = "node: int, parent: int, last: int, tag: string, classes: array<string>, attrs: map<string,string>, start: int, end: int"
#: Sources are broadcast up to so many.
BROADCAST_SOURCES = 10_000
_SPACES = {c: " " for c in range(0x3001) if chr(c).isspace()}


class _Nodes(HTMLParser):
    """Elements in page order: number, parent, last number inside, tag, classes, attributes, and where their text begins and ends in the page's.

    Any text is kept once, whatever depth it stands at.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.text: list[str] = []
        self.size = 0

    def handle_starttag(self, tag, attrs):
        have = {k: v or "" for k, v in attrs}
        n = len(self.rows)
        self.rows.append([n, self.open[-1] if self.open else None, n, tag, have.get("class", "").split(), list(have.items()), self.size, self.size])
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]][3] == tag:
                self._end(i)
                return

    def handle_data(self, data):
        self.text.append(data)
        self.size += len(data)

    def _end(self, i: int) -> None:
        for n in self.open[i:]:
            self.rows[n][2], self.rows[n][7] = len(self.rows) - 1, self.size
        del self.open[i:]

    def done(self) -> tuple[str, list[list]]:
        self._end(0)
        return "".join(self.text).translate(_SPACES), self.rows


def html_pages(pages: DataFrame, html: str = "body") -> DataFrame:
    """`pages` with `text` and `nodes` instead of the markup: a row per page, each element once, in page order.

    The one Python boundary: the standard parser, page by page in Arrow batches. Node k is
    the array's place k, and `last` makes "inside" a slice of the array; `start` and `end`
    are a node's stretch of the page's text.
    """
    rest = [c for c in pages.columns if c not in (html, "text", "nodes")]
    names = [f.name for f in NODE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                texts, nodes = [], []
                for body in some.column(html):
                    parser = _Nodes()
                    parser.feed(body.as_py() or "")
                    parser.close()
                    text, rows = parser.done()
                    texts.append(text)
                    nodes.append(rows)
                flat = list(zip(*(r for rows in nodes for r in rows), strict=True)) or [[] for _ in names]
                struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, NODE, strict=True)], fields=list(NODE))
                ends = pa.array([0, *accumulate(map(len, nodes))], pa.int32())
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in rest), pa.array(texts, pa.string()), pa.ListArray.from_arrays(ends, struct)], names=[*rest, "text", "nodes"])

    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "text string", f"nodes array<struct<{NODE_SCHEMA}>>"])
    return pages.select(*rest, html).mapInArrow(run, schema)


def _text(n: str) -> str:
    """SQL of the text of all inside node n, white space squashed; null if there is none or no node."""
    return f"nullif(trim(regexp_replace(substring(text, {n}.start + 1, {n}.`end` - {n}.start), ' +', ' ')), '')"


def html_nodes(pages: DataFrame, key: str = "page_id", html: str = "body", wanted: tuple[str, ...] | None = None) -> DataFrame:
    """(key, node, parent, last, tag, classes, attrs, text): a row per element; `wanted` keeps only these tags."""
    found = html_pages(pages.select(key, html), html)
    if wanted is not None:
        found = found.withColumn("nodes", F.filter("nodes", lambda x: x["tag"].isin(*wanted)))
    slim = found.withColumn("nodes", F.expr(f"transform(nodes, n -> struct(n.node, n.parent, n.last, n.tag, n.classes, n.attrs, coalesce({_text('n')}, '') as text))"))
    return slim.select(key, F.explode("nodes").alias("n")).select(key, *(F.col(f"n.{c}").alias(c) for c in ("node", "parent", "last", "tag", "classes", "attrs", "text")))


def _fits(n: str, selector: str) -> str:
    """SQL of whether a `tag` or `tag.class` selector names node n."""
    tag = f"substring_index({selector}, '.', 1)"
    return f"(({tag} = '' or {n}.tag = {tag}) and (not contains({selector}, '.') or array_contains({n}.classes, substring_index({selector}, '.', -1))))"


def _first_inside(it: str, selector: str) -> str:
    """SQL of the first node inside node `it` that the selector names, or null."""
    return f"get(filter(slice(nodes, {it}.node + 2, {it}.last - {it}.node), x -> {_fits('x', selector)}), 0)"


def list_entries(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_key, page_no, pos, name, website, sector, detail_url, listed_url): the entries of listing pages.

    pages: (page_id, source_key, page_no, url, status, body); sources: key, mode and
    selectors. structured reads name and site, detail a name and a detail link, outbound
    any outside link that may be a company's. Names fall back from selector to attribute,
    title or text, image, and domain. A page is parsed once and its entries are found in
    its own row, where what an element holds is a slice of the nodes: nothing is joined.
    """
    src = sources.select(F.col("key").alias("source_key"), "mode", "item_selector", "name_selector", "name_attr", "website_selector", "sector_selector", "sector_attr", "detail_selector")
    src = stored(src, "sources")
    good = pages.where(F.col("status").between(200, 299)).select("page_id", "source_key", "page_no", "url", "body")
    parsed = html_pages(good).join(F.broadcast(src) if src.count() <= BROADCAST_SOURCES else src.hint("shuffle_merge"), "source_key")
    link = "if(mode = 'detail', detail_selector, website_selector)"
    at = lambda n, k: f"nullif(trim({n}.attrs[{k}]), '')"
    items = f"""transform(filter(nodes, it -> mode != 'outbound' and {_fits('it', "coalesce(item_selector, 'body')")}), it -> struct(it.node as pos,
        {_first_inside('it', link)} as a, {_first_inside('it', 'name_selector')} as n, {_first_inside('it', 'sector_selector')} as s, {_first_inside('it', "'img'")} as i))"""
    # Of nested boxes the outer ones hold all that the inner ones do.
    boxes = f"""aggregate(filter(nodes, b -> {_fits('b', "item_selector")}), cast(array() as array<struct<node: int, last: int>>),
        (out, b) -> if(size(out) = 0 or element_at(out, -1).last < b.node, array_append(out, struct(b.node as node, b.last as last)), out))"""
    links = f"""if(mode = 'outbound', transform(filter(nodes, x -> x.tag = 'a' and (item_selector is null or exists(boxes, b -> x.node between b.node and b.last))), a -> struct(a.node as pos, a, {_first_inside('a', "'img'")} as i)), array())"""
    found = parsed.withColumn("items", F.expr(items)).withColumn("boxes", F.expr(f"if(mode = 'outbound' and item_selector is not null, {boxes}, array())")).withColumn("links", F.expr(links))
    slim = f"""concat(
        transform(items, e -> struct(e.pos as pos, {_text('e.n')} as own, {_text('e.a')} as said, {at('e.a', "'title'")} as title, {at('e.a', "'href'")} as href, nullif(trim(e.a.attrs[name_attr]), '') as attr,
            {at('e.i', "'alt'")} as alt, coalesce(nullif(trim(e.s.attrs[sector_attr]), ''), {_text('e.s')}) as sector)),
        transform(links, e -> struct(e.pos as pos, cast(null as string) as own, {_text('e.a')} as said, {at('e.a', "'title'")} as title, trim(e.a.attrs['href']) as href, cast(null as string) as attr,
            coalesce({at('e.i', "'alt'")}, {at('e.i', "'title'")}) as alt, cast(null as string) as sector)))"""
    rows = found.select("page_id", "source_key", "page_no", "url", "mode", F.expr(slim).alias("e")).select("page_id", "source_key", "page_no", "url", "mode", F.explode("e").alias("e")).select("*", "e.*")
    # Each step is a column of its own, and no filter stands before the write, which would be pushed below it with all its parts.
    mode, site = F.col("mode"), F.col("site")
    rows = rows.withColumn("link", T.resolve_url(F.col("url"), F.col("href"))).withColumn("site", F.when(T.is_company_site(F.col("link"), T.host_of(F.col("url"))), F.col("link"))).withColumn("domain", T.url_host(site))
    no_url = lambda c: F.when(c.rlike(T.URL_TEXT), None).otherwise(c)
    name = (
        F.when(mode == "detail", F.coalesce("title", "said"))
        .when(mode == "outbound", F.coalesce(no_url(F.coalesce("title", "said")), no_url(F.col("alt")), "domain"))
        .otherwise(F.coalesce("own", "attr", "title", "said", "alt", "domain"))
    )
    entries = rows.select(
        "page_id", "source_key", "page_no", "pos", "mode", "domain", T.squash_ws(name).alias("name"), F.when(mode != "detail", site).alias("website"), "sector", F.when(mode == "detail", F.col("link")).alias("detail_url"), F.col("url").alias("listed_url")
    )
    entries = stored(entries, "entries").where("name is not null and (mode != 'detail' or detail_url is not null)")
    columns = ["source_key", "page_no", "pos", "name", "website", "sector", "detail_url", "listed_url"]
    out = entries.where("mode = 'outbound'").where("website is not null and domain is not null and length(name) between 2 and 120")
    first = out.withColumn("_rn", F.row_number().over(Window.partitionBy("page_id", "domain").orderBy("pos"))).where("_rn = 1")
    return entries.where("mode != 'outbound'").select(columns).unionByName(first.select(columns))


def before_stop(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of each source up to its stop: a page that is missing or empty, or whose first ten names repeat the page before.

    pages: (source_key, page_no, status).
    """
    sig = entries.groupBy("source_key", "page_no").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), 1, SIGNATURE_NAMES).alias("sig"))
    w = Window.partitionBy("source_key").orderBy("page_no")
    p = pages.select("source_key", "page_no", "status").join(sig.hint("shuffle_merge"), ["source_key", "page_no"], "left")
    stop = ~F.col("status").between(200, 299) | F.col("sig").isNull() | F.coalesce(F.col("sig") == F.lag("sig").over(w), F.lit(False))
    p = p.withColumn("_stop", stop.cast("int")).withColumn("_stopped", F.max("_stop").over(w)).where("_stopped = 0")
    return entries.join(p.select("source_key", "page_no").hint("shuffle_merge"), ["source_key", "page_no"], "left_semi")


def first_entries(entries: DataFrame) -> DataFrame:
    """One entry per source and domain, or name where there is no site: the first by page and place."""
    key = F.coalesce(T.url_host(F.col("website")), F.lower(F.trim("name")))
    rn = F.row_number().over(Window.partitionBy("source_key", "_k").orderBy("page_no", "pos"))
    return entries.withColumn("_k", key).withColumn("_rn", rn).where("_rn = 1").drop("_k", "_rn")


def resolve_detail_sites(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries without a site get their detail page's best outside link: one whose text is its own address, else the first.

    pages: (url, status, body).
    """
    from firmlens.operators.links import anchors, fetched

    need = entries.where("website is null and detail_url is not null").select("detail_url").distinct()
    opened = pages.where(fetched(F.col("status"), F.col("body"))).join(need, F.col("url") == F.col("detail_url"), "left_semi").select("url", "body")
    a = anchors(opened).withColumn("link", T.resolve_url(F.col("url"), F.col("href"))).where("href != ''")
    a = a.where(T.is_company_site(F.col("link"), T.host_of(F.col("url"))))
    best = a.groupBy(F.col("url").alias("detail_url")).agg(F.min_by("link", F.struct(~T.is_url_like(F.col("text"), F.col("link")), "pos")).alias("_site"))
    return entries.join(best, "detail_url", "left").withColumn("website", F.coalesce("website", "_site")).select(*entries.columns)


def discover_listings(pages: DataFrame, sources: DataFrame, detail_pages: DataFrame | None = None) -> DataFrame:
    """Listing entries of all enabled sources: entries, page stop, first-wins, detail sites; with the source's city."""
    on = sources.where("enabled")
    keys = stored(on.select(F.col("key").alias("source_key"), "city"), "source_keys")
    side = F.broadcast(keys) if keys.count() <= BROADCAST_SOURCES else keys.hint("shuffle_merge")
    own = pages.join(side, "source_key", "left_semi")
    found = first_entries(before_stop(own, list_entries(own, on)))
    if detail_pages is not None:
        found = resolve_detail_sites(found, detail_pages)
    return found.join(side, "source_key", "left")


def run_summary(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(source_key, entries, with_site, health): health is ok, empty, or error where no page of the source was readable."""
    e = entries.groupBy("source_key").agg(F.count("*").alias("entries"), F.count("website").alias("with_site"))
    o = outcomes.groupBy("source_key").agg(F.max(F.col("status").between(200, 299)).alias("_ok"))
    j = o.join(e, "source_key", "left").na.fill(0, ["entries", "with_site"])
    return j.select("source_key", "entries", "with_site", F.when(~F.col("_ok"), "error").when(F.col("entries") == 0, "empty").otherwise("ok").alias("health"))


def row_ids(pages: DataFrame) -> DataFrame:
    """(row_id, title, page_no, pos): cards `div.company-card` with data-row-id and title; a source's pages count until one brings no new id.

    `pages` may carry source_key; without it all pages are one source's.
    """
    own = "source_key" in pages.columns
    pages = pages if own else pages.withColumn("source_key", F.lit(""))
    n = html_nodes(pages.where(F.col("status").between(200, 299)), wanted=("div",)).join(pages.select("page_id", "page_no", "source_key").hint("shuffle_hash"), "page_id")
    cards = n.where("tag = 'div' and array_contains(classes, 'company-card')").select("source_key", "page_no", F.col("node").alias("pos"), F.col("attrs")["data-row-id"].alias("row_id"), T.clean(F.col("attrs")["title"]).alias("title"))
    cards = cards.where("row_id is not null and row_id != '' and title is not null")
    once = stored(cards.groupBy("source_key", "row_id").agg(F.min(F.struct("page_no", "pos", "title")).alias("c")).select("source_key", "row_id", "c.*"), "cards")
    stale = pages.select("source_key", "page_no").distinct().join(once.select("source_key", "page_no").distinct().hint("shuffle_merge"), ["source_key", "page_no"], "left_anti")
    stops = stale.groupBy("source_key").agg(F.min("page_no").alias("_stop"))
    kept = once.join(stops.hint("shuffle_merge"), "source_key", "left").where("_stop is null or page_no < _stop")
    return kept.select(*(["source_key"] if own else []), "row_id", "title", "page_no", "pos")


def parse_company_info(payloads: DataFrame) -> DataFrame:
    """`payloads` (row_id, body) with website: website_url, else website; null for other shapes and empty values."""
    c = F.from_json("body", "company struct<title: string, website: string, website_url: string>")["company"]
    return payloads.select("row_id", F.coalesce(F.nullif(c["website_url"], F.lit("")), F.nullif(c["website"], F.lit(""))).alias("website"))


def enrich_websites(companies: DataFrame, rows: DataFrame, payloads: DataFrame) -> DataFrame:
    """Companies by normalised name get the website and domain they lack; none is added."""
    info = rows.join(parse_company_info(payloads), "row_id").where("website is not null").select(T.normalize_name(F.col("title")).alias("name_norm"), "website", "row_id")
    one = info.groupBy("name_norm").agg(F.min_by("website", "row_id").alias("_site"))
    j = companies.join(one, "name_norm", "left")
    return j.withColumns({"website": F.coalesce("website", "_site"), "domain": F.coalesce("domain", T.registrable_domain(T.url_host(F.col("_site"))))}).select(*companies.columns)


def upsert_counters(resolved: DataFrame, state: DataFrame) -> DataFrame:
    """(source_key, listed, new, updated, with_site): what a source's listings add to `state` (domain, name_norm).

    An entity is known where any of its members has a known domain, or a known name.
    """
    by_domain = state.where("domain is not null").select("domain", F.lit(True).alias("_d")).distinct()
    by_name = state.where(F.length("name_norm") >= 4).select("name_norm", F.lit(True).alias("_n")).distinct()
    seen = resolved.join(by_domain, "domain", "left").join(by_name, "name_norm", "left").withColumn("_known", F.coalesce("_d", "_n", F.lit(False)))
    known = seen.groupBy("entity").agg(F.max("_known").alias("_known"))
    per = resolved.where("source_key is not null").groupBy("source_key", "entity").agg(F.count("*").alias("listed"), F.max(F.col("website").isNotNull()).alias("_site")).join(known, "entity")
    return per.groupBy("source_key").agg(
        F.sum("listed").alias("listed"), F.count_if(~F.col("_known")).alias("new"), F.count_if("_known").alias("updated"), F.count_if("_site").alias("with_site")
    )
