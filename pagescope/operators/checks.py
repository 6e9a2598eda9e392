"""The twenty-four checks, each a column over one row a site, and their unpivot to check results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescope import registry as R
from pagescope.functions import text as X
from pagescope.functions import urls as U
from pagescope.operators.hold import hold

# Schema.org types and domains.
IDENTITY_TYPES = ["organization", "corporation", "localbusiness", "person", "brand", "ngo", "governmentorganization", "educationalorganization", "newsmediaorganization"]
NON_IDENTITY_TYPES = ["website", "webpage", "article", "newsarticle", "blogposting", "breadcrumblist", "listitem", "imageobject", "videoobject", "product", "offer", "searchaction", "faqpage", "question", "answer", "itemlist", "collectionpage", "review", "aggregaterating", "postaladdress", "contactpoint", "event"]
AUTHORITY = ["wikidata.org", "wikipedia.org", "dbpedia.org", "viaf.org", "isni.org", "ror.org", "orcid.org", "crunchbase.com", "opencorporates.com", "companieshouse.gov.uk", "sec.gov", "bloomberg.com", "linkedin.com", "g.page", "business.site", "maps.google.com", "yelp.com", "tripadvisor.com", "trustpilot.com", "bbb.org", "glassdoor.com", "indeed.com", "yellowpages.com", "thomasnet.com", "angi.com", "checkatrade.com", "trustedtraders.which.co.uk", "healthgrades.com", "zocdoc.com", "avvo.com", "justia.com", "github.com", "gitlab.com"]
SOCIAL = ["facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "tiktok.com", "pinterest.com", "threads.net", "threads.com", "snapchat.com", "reddit.com", "vimeo.com", "flickr.com", "tumblr.com", "medium.com", "substack.com", "bsky.app", "mastodon.social", "weibo.com", "vk.com", "xing.com", "line.me", "t.me", "telegram.me", "whatsapp.com", "wa.me"]
SHARE_MARKERS = ["/sharer", "/share", "/intent/", "/shareartic", "/submit", "/dialog/", "/send", "/post?", "/tweet", "/pin/create"]
NON_HANDLES = ["watch", "search", "results", "home", "login", "signin", "signup", "register", "privacy", "terms", "help", "support", "sitemap", "feed", "rss", "index", "explore", "trending", "download", "pricing"]


def result(check_id: str, state: Column, measurement: Column | None = None, evidence: Column | None = None, selector: str | None = None, page_url: Column | None = None, reason: Column | None = None) -> Column:
    """One row of check results; with_check_rows cleans the evidence."""
    text = lambda c: F.expr("cast(NULL AS string)") if c is None else c.cast("string")
    return F.struct(
        F.lit(check_id).alias("check_id"), state.alias("state"), text(measurement).alias("measurement"), text(evidence).alias("evidence"),
        F.lit(selector).cast("string").alias("selector"), text(page_url).alias("page_url"), text(reason).alias("reason"),
    )


# ---- access, rendering, extraction ---------------------------------------------


def http_ok(p: Column) -> Column:
    s = p["status"]
    return result("access.http_ok", F.when(s.isNull(), "unknown").when(s.between(200, 299), "pass").otherwise("fail"), s, F.concat(F.lit("HTTP status "), s.cast("string")), page_url=p["url"])


def ai_crawlers(robots: Column | None, url: Column) -> Column:
    if robots is None:
        return result("access.ai_crawlers_allowed", F.lit("unknown"), page_url=url, reason=F.lit("robots.txt was not read"))
    blocked = F.filter(F.map_keys(robots["ai"]), lambda k: ~F.element_at(robots["ai"], k))
    known = F.coalesce(robots["determinable"], F.lit(False))
    state = F.when(~known, "unknown").when(F.size(blocked) == 0, "pass").otherwise("fail")
    return result("access.ai_crawlers_allowed", state, F.when(known, F.size(blocked)), F.array_join(F.array_sort(blocked), ", "), page_url=url, reason=F.when(robots.isNull(), "robots.txt was not read").when(~known, "robots.txt could not be read"))


def indexable(p: Column) -> Column:
    both = F.lower(F.concat_ws(" ", p["meta_robots"], p["x_robots_tag"]))
    return result("access.indexable", F.when(F.contains(both, F.lit("noindex")), "fail").otherwise("pass"), both, both, 'meta[name="robots"]', p["url"])


def content_without_js(p: Column) -> Column:
    t, n = R.THRESHOLDS["render.content_without_js"], p["raw_chars"]
    grows = p["rendered"] & (p["rendered_chars"] > F.greatest(2 * n, n + 200))
    client = p["mount"].isNotNull() | (F.size(p["markers"]) > 0) | grows
    state = F.when(n >= t["min_chars"], "pass").when(client | (n < t["floor"]), "fail").otherwise("pass")
    return result("render.content_without_js", state, n, F.concat(n.cast("string"), F.lit(" characters of text in the raw HTML")), page_url=p["url"])


def semantic_html(p: Column) -> Column:
    """main or article marks the content; header and nav are some structure; aside and footer are none."""
    found = F.array_intersect(p["f"]["landmarks"], X.lit_array(["article", "header", "main", "nav"]))
    state = F.when(F.arrays_overlap(found, X.lit_array(["main", "article"])), "pass").when(F.size(found) > 0, "partial").otherwise("fail")
    return result("extraction.semantic_html", state, F.array_join(found, ","), F.array_join(found, ", "), "body", p["url"])


def facts_not_image_only(p: Column) -> Column:
    t = R.THRESHOLDS["extraction.facts_not_image_only"]
    judged = F.filter(p["f"]["images"], lambda i: ~X.declared_smaller(i["width"], i["height"], t["min_px"]))
    bad = F.filter(judged, lambda i: X.looks_like_data_filename(X.asset_filename(i["src"])) & (F.length(F.trim(F.coalesce(i["alt"], F.lit("")))) < 10))
    n, k = F.size(judged), F.size(bad)
    state = F.when((F.size(p["f"]["images"]) < t["min_images"]) | (n < t["min_images"]), "not_applicable").when(k == 0, "pass").when(k / n > t["max_ratio"], "fail").otherwise("partial")
    return result("extraction.facts_not_image_only", state, F.concat_ws("/", k.cast("string"), n.cast("string")), F.array_join(F.slice(F.transform(bad, lambda i: X.asset_filename(i["src"])), 1, 5), ", "), "img", p["url"])


# ---- comprehension ---------------------------------------------------------------


def title_descriptive(p: Column) -> Column:
    t, n = R.THRESHOLDS["content.title_descriptive"], F.length(p["f"]["title"])
    return result("content.title_descriptive", F.when(n == 0, "fail").when(n.between(t["min_chars"], t["max_chars"]), "pass").otherwise("partial"), n, p["f"]["title"], "title", p["url"])


def meta_description(p: Column) -> Column:
    t, d = R.THRESHOLDS["content.meta_description"], X.meta_content(p["f"]["metas"], "name", "description")
    n = F.length(d)
    return result("content.meta_description", F.when(n == 0, "fail").when(n.between(t["min_chars"], t["max_chars"]), "pass").otherwise("partial"), n, d, 'meta[name="description"]', p["url"])


def heading_skips(levels: Column) -> Column:
    """Places where a level exceeds the one before by more than the threshold."""
    skip = R.THRESHOLDS["content.heading_hierarchy"]["max_level_skip"]
    return F.size(F.filter(levels, lambda x, i: (i > 0) & (x - F.get(levels, i - 1) > skip)))


def heading_hierarchy(p: Column) -> Column:
    levels = p["f"]["headings"]["level"]
    ones, skips = F.size(F.filter(levels, lambda x: x == 1)), heading_skips(levels)
    state = F.when(F.size(levels) == 0, "fail").when((skips == 0) & (ones == 1), "pass").otherwise("partial")
    return result("content.heading_hierarchy", state, F.size(levels), F.concat_ws(" ", F.size(levels).cast("string"), F.lit("headings,"), ones.cast("string"), F.lit("h1,"), skips.cast("string"), F.lit("skips")), "h1", p["url"])


def scannable_blocks(p: Column) -> Column:
    t = R.THRESHOLDS["content.scannable_blocks"]
    n = F.size(F.filter(p["f"]["blocks"], lambda b: b["items"] >= t["min_items"]))
    state = F.when(n >= t["min_blocks"], "pass").when(F.length(p["f"]["text_tree"]) < t["short_page_chars"], "partial").otherwise("fail")
    return result("content.scannable_blocks", state, n, F.concat(n.cast("string"), F.lit(" lists or tables")), "ul, ol, table, dl", p["url"])


def quotable_counts(text: Column, openers: list[str]) -> Column:
    """Struct of the number of sentences and of quotable ones."""
    t = R.THRESHOLDS["quotability.self_contained_facts"]
    s = X.split_sentences(text)
    good = F.filter(s, lambda x: X.is_quotable(x, openers, t["min_chars"], t["max_chars"], t["min_words"]))
    return F.struct(F.size(s).alias("sentences"), F.size(good).alias("quotable"))


def quotability(p: Column, gate: Column) -> Column:
    t, c = R.THRESHOLDS["quotability.self_contained_facts"], quotable_counts(p["f"]["text_tree"], R.DANGLING_OPENERS)
    k = c["quotable"]
    state = F.when(~gate, "unknown").when(c["sentences"] == 0, "fail").when(k >= t["min_quotable"], "pass").when(k >= 1, "partial").otherwise("fail")
    return result("quotability.self_contained_facts", state, k, F.concat(k.cast("string"), F.lit(" quotable sentences")), page_url=p["url"], reason=F.when(~gate, "language_not_supported"))


def factual_ratio(p: Column, gate: Column) -> Column:
    """The share of quotable sentences; dangling openers are not part of this check's own thresholds."""
    t, c = R.THRESHOLDS["density.factual_ratio"], quotable_counts(p["f"]["text_tree"], [])
    ratio = c["quotable"] / c["sentences"]
    words = F.size(F.split(p["f"]["text_tree"], r"(?U)\s+"))
    state = F.when(~gate, "unknown").when(c["sentences"] == 0, "fail").when(ratio >= t["min_ratio"], "pass").when(words > t["long_page_words"], "fail").otherwise("partial")
    return result("density.factual_ratio", state, ratio, F.concat_ws("/", c["quotable"].cast("string"), c["sentences"].cast("string")), page_url=p["url"], reason=F.when(~gate, "language_not_supported"))


# ---- entity: over the pages of a site, the first that decides -------------------


def _lower(a: Column) -> Column:
    return F.transform(a, lambda t: F.lower(t))


def identity_nodes(nodes: Column) -> Column:
    """Nodes that say who the site is: not third parties, typed before described; persons only if there is nobody else."""
    third = F.flatten(nodes["third_party"])
    own = F.filter(nodes, lambda n: n["id"].isNull() | ~F.array_contains(third, n["id"]))

    def strength(n: Column) -> Column:
        kinds = _lower(n["types"])
        typed = F.arrays_overlap(kinds, X.lit_array(IDENTITY_TYPES))
        nothing = (F.size(kinds) == 0) | (F.arrays_overlap(kinds, X.lit_array(NON_IDENTITY_TYPES)) & ~typed) | (n["name"] == "")
        return F.when(nothing, 9).when(typed, 0).when(n["props"] >= R.THRESHOLDS["entity.organization_declared"]["min_properties"], 1).otherwise(9)

    found = F.filter(F.transform(own, lambda n, i: F.struct(strength(n).alias("s"), i.alias("i"), n.alias("n"))), lambda x: x["s"] < 9)
    others = F.filter(found, lambda x: ~F.array_contains(_lower(x["n"]["types"]), F.lit("person")))
    kept = F.when(F.size(others) > 0, others).otherwise(found)
    ordered = F.array_sort(kept, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["i"] - b["i"]))
    return ordered["n"]


def suffix_in(host: Column, domains: list[str]) -> Column:
    """The host or a parent domain of it is listed."""
    return F.arrays_overlap(U.host_suffixes(host), X.lit_array(domains))


def link_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def link_class(url: Column) -> Column:
    host = link_host(url)
    return F.when(host == "", None).when(suffix_in(host, AUTHORITY), "authority").when(suffix_in(host, SOCIAL), "social").otherwise("other")


def is_share_link(url: Column) -> Column:
    low = F.lower(url)
    return F.exists(X.lit_array(SHARE_MARKERS), lambda m: F.contains(low, m)) | low.rlike(r"\?u=http|&url=http|\?url=http")


def brand_tokens(url: Column, names: Column) -> Column:
    """Ways in which a site calls itself: labels of its host, segments of its names."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: ~x.isin(U.HOST_STOPS)), X.normalize_name)
    parts = F.transform(F.flatten(F.transform(F.filter(names, lambda n: n.isNotNull()), X.name_segments)), X.normalize_name)
    return F.array_distinct(F.filter(F.concat(labels, parts), lambda t: F.length(t) >= 3))


def is_profile_path(path: Column, tokens: Column, any_handle: bool = False) -> Column:
    """One or two segments, the last a handle; unless any handle will do, one that begins with a token and goes on for at most 6."""
    segments = F.filter(F.split(path, "/"), lambda s: F.trim(s) != "")
    handle = X.normalize_name(F.element_at(segments, -1))
    shape = F.size(segments).between(1, 2)
    good = F.when(shape, (handle != "") & ~handle.isin(NON_HANDLES)).otherwise(F.lit(False))
    if any_handle:
        return good
    return F.when(good, F.exists(tokens, lambda t: handle.startswith(t) & (F.length(handle) - F.length(t) <= 6))).otherwise(F.lit(False))


def identity_links(p: Column) -> Column:
    """Struct of declared (sameAs), rel_me and profile links of a page."""
    og = X.opengraph(p["f"]["metas"])
    names = F.concat(identity_nodes(p["f"]["nodes"])["name"], F.array(F.element_at(og, "og:site_name"), F.element_at(og, "og:title")))
    tokens, site = brand_tokens(p["url"], names), U.host_of(p["url"])
    declared = F.filter(F.concat(F.flatten(p["f"]["nodes"]["same_as"]), p["f"]["micro_same_as"]), lambda u: u.startswith("http"))

    def profile(a: Column) -> Column:
        host = link_host(a["href"])
        path = F.regexp_extract(a["href"], r"^https?://[^/?#]*([^?#]*)", 1)
        away = (host != "") & (host != site) & ~F.endswith(host, F.concat(F.lit("."), site)) & ~is_share_link(a["href"])
        known = suffix_in(host, AUTHORITY + SOCIAL)
        return a["href"].startswith("http") & away & (is_profile_path(path, tokens) | (a["in_chrome"] & known & is_profile_path(path, tokens, True)))

    links = F.filter(p["f"]["anchors"], profile)["href"]
    key = lambda u: F.concat(link_host(u), F.lit(" "), X.normalize_name(F.regexp_extract(u, r"^https?://[^/?#]*([^?#]*)", 1)))
    keys = F.transform(links, key)
    first = F.filter(links, lambda u, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return F.struct(F.array_distinct(declared).alias("declared"), F.array_distinct(p["f"]["rel_me"]).alias("rel_me"), F.slice(first, 1, 20).alias("profiles"))


def entity_row(p: Column) -> Column:
    """What the entity checks need of a page, computed once."""
    og = X.opengraph(p["f"]["metas"])
    idn = identity_nodes(p["f"]["nodes"])
    site_name = F.coalesce(F.element_at(og, "og:site_name"), F.lit(""))
    strong = F.array_distinct(F.filter(F.concat(idn["name"], F.array(site_name)), lambda n: n != ""))
    weak = F.array_distinct(F.filter(F.array(F.coalesce(F.element_at(og, "og:title"), F.lit("")), p["f"]["title"]), lambda n: n != ""))
    return F.struct(
        p["url"].alias("url"), p["f"]["jsonld_blocks"].alias("blocks"), p["f"]["microdata"].alias("microdata"), og.alias("og"), F.size(idn).alias("identities"),
        identity_links(p).alias("links"), strong.alias("strong"), weak.alias("weak"), brand_tokens(p["url"], F.array().cast("array<string>")).alias("tokens"),
    )


def first_where(pages: Column, test) -> Column:
    return F.get(F.filter(pages, test), F.lit(0))


def entity_checks(pages: Column) -> list[Column]:
    """pages: array of entity_row, in page order."""
    home = F.get(pages, F.lit(0))["url"]
    has = lambda row: row.isNotNull()
    ld, micro = first_where(pages, lambda p: p["blocks"] > 0), first_where(pages, lambda p: p["microdata"])
    structured = result("entity.structured_data_present", F.when(has(ld), "pass").when(has(micro), "partial").otherwise("fail"), ld["blocks"], selector='script[type="application/ld+json"]', page_url=F.coalesce(ld["url"], micro["url"], home))

    ident = first_where(pages, lambda p: p["identities"] > 0)
    og_name = first_where(pages, lambda p: p["og"]["og:site_name"].isNotNull() | (p["og"]["og:title"].isNotNull() & p["og"]["og:url"].isNotNull()))
    organization = result("entity.organization_declared", F.when(has(ident), "pass").when(has(og_name), "partial").otherwise("fail"), ident["identities"], page_url=F.coalesce(ident["url"], og_name["url"], home))

    claimed = first_where(pages, lambda p: F.size(p["links"]["declared"]) + F.size(p["links"]["rel_me"]) >= 1)
    profiled = first_where(pages, lambda p: F.size(p["links"]["profiles"]) >= 1)
    same_as = result("entity.sameas_present", F.when(has(claimed), "pass").when(has(profiled), "partial").otherwise("fail"), F.size(claimed["links"]["declared"]), page_url=F.coalesce(claimed["url"], profiled["url"], home))

    every = lambda p: F.array_distinct(F.concat(p["links"]["declared"], p["links"]["rel_me"], p["links"]["profiles"]))
    linked = first_where(pages, lambda p: F.size(every(p)) > 0)
    kinds = F.transform(every(linked), link_class)
    authority = result("entity.sameas_authority", F.when(~has(linked), "fail").when(F.array_contains(kinds, "authority"), "pass").when(F.array_contains(kinds, "social"), "partial").otherwise("fail"), F.array_join(F.array_sort(F.array_distinct(kinds)), ","), page_url=F.coalesce(linked["url"], home))

    wanted = R.THRESHOLDS["entity.opengraph_identity"]["required"]
    count = lambda p: F.size(F.filter(X.lit_array(wanted), lambda k: F.coalesce(F.element_at(p["og"], k), F.lit("")) != ""))
    best = F.array_max(F.transform(pages, count))
    graph = result("entity.opengraph_identity", F.when(best == len(wanted), "pass").when(best > 0, "partial").otherwise("fail"), best, selector='meta[property^="og:"]', page_url=F.coalesce(first_where(pages, lambda p: count(p) == best)["url"], home))

    named = first_where(pages, lambda p: (F.size(p["strong"]) > 0) | (F.size(p["weak"]) > 0))
    strong, weak, tokens = named["strong"], named["weak"], named["tokens"]
    lead = F.get(strong, F.lit(0))
    agrees_weak = lambda n: F.exists(weak, lambda w: X.names_agree(n, w))
    in_tokens = lambda n: F.exists(X.name_forms(n), lambda t: F.exists(tokens, lambda d: F.contains(d, t) | F.contains(t, d)))
    conflict = F.exists(strong, lambda n: ~X.names_agree(lead, n))
    ours = F.size(F.filter(strong, lambda n: in_tokens(n) | agrees_weak(n)))
    corroborated = agrees_weak(lead) | F.exists(F.transform(X.name_segments(lead), X.normalize_name), lambda t: F.exists(tokens, lambda d: F.contains(d, t)))
    state = (
        F.when(~has(named), "fail").when(F.size(strong) == 0, "partial").when(conflict, F.when(ours == 1, "pass").otherwise("fail"))
        .when((F.size(strong) >= R.THRESHOLDS["entity.name_consistency"]["min_sources"]) | corroborated, "pass").otherwise("partial")
    )
    name = result("entity.name_consistency", state, F.size(strong), F.array_join(F.array_sort(strong), ", "), page_url=F.coalesce(named["url"], home))
    return [structured, organization, same_as, authority, graph, name]


# ---- orientation -------------------------------------------------------------------


def above_fold(f: Column, tags: list[str], headline: bool = False) -> Column:
    """Labelled elements of the tags that begin within the first screen of text."""
    rows = F.zip_with(f["flow"], f["offsets"], lambda e, o: F.struct(e.alias("e"), o.alias("o")))
    limit = R.THRESHOLDS["orientation.heading_first_viewport"]["fold_chars"]
    test = lambda r: F.coalesce(r["e"]["tag"].isin(tags), F.lit(False)) & (r["o"] < limit) & (F.coalesce(r["e"]["label"], F.lit("")) != "")
    if headline:
        return F.filter(rows, lambda r: test(r) & (r["e"]["kind"].isNull() | (r["e"]["kind"] == "banner")))["e"]
    return F.filter(rows, test)["e"]


def _fold_px(g: Column) -> Column:
    return F.coalesce(F.when(g["viewport_height"] > 0, g["viewport_height"]), F.lit(float(R.THRESHOLDS["orientation.heading_first_viewport"]["fold_px"])))


def _seen(rows: Column, g: Column) -> Column:
    return F.filter(rows, lambda r: r["top"].isNotNull() & (r["top"] < _fold_px(g)) & (F.trim(F.coalesce(r["text"], F.lit(""))) != ""))


def heading_first_viewport(p: Column) -> Column:
    g = p["geometry"]
    measured, proxy = F.size(_seen(g["headings"], g)), F.size(above_fold(p["f"], ["h1", "h2", "h3"]))
    n = F.when(g.isNotNull(), measured).otherwise(proxy)
    state = F.when(g.isNull() & ~p["f"]["has_body"], "unknown").when(n > 0, "pass").otherwise("fail")
    return result("orientation.heading_first_viewport", state, n, F.concat(n.cast("string"), F.lit(" headings on arrival")), page_url=p["url"], reason=F.when(g.isNull(), "estimated from the order of text"))


def primary_cta(p: Column) -> Column:
    g = p["geometry"]
    n = F.when(g.isNotNull(), F.size(_seen(g["interactive"], g))).otherwise(F.size(above_fold(p["f"], ["a", "button"])))
    state = F.when(g.isNull() & ~p["f"]["has_body"], "unknown").when(n > 0, "pass").otherwise("fail")
    return result("orientation.primary_cta", state, n, F.concat(n.cast("string"), F.lit(" links or buttons on arrival")), page_url=p["url"], reason=F.when(g.isNull(), "estimated from the order of text"))


def not_obstructed(p: Column) -> Column:
    g, cap = p["geometry"], R.THRESHOLDS["orientation.content_not_obstructed"]["max_coverage"]
    worst = F.array_max(F.transform(g["overlays"], lambda o: F.coalesce(o["coverage"], F.lit(0.0))))
    state = F.when(p["blocked_kind"].isNotNull(), "fail").when(g.isNull(), "unknown").when(F.coalesce(worst, F.lit(0.0)) > cap, "fail").otherwise("pass")
    return result("orientation.content_not_obstructed", state, F.coalesce(p["blocked_kind"], F.coalesce(worst, F.lit(0.0)).cast("string")), page_url=p["url"], reason=F.when(g.isNull(), "needs a browser render"))


def viewport_meta(p: Column) -> Column:
    v = X.meta_content(p["f"]["metas"], "name", "viewport")
    return result("orientation.viewport_meta", F.when(v != "", "pass").otherwise("fail"), F.when(v != "", v).otherwise("absent"), v, 'meta[name="viewport"]', p["url"])


def _word(text: Column, words: list[str], tail: str) -> Column:
    return F.lower(text).rlike(r"(?U)\b(?:" + "|".join(words) + r")" + tail + r"\b")


def value_proposition(p: Column, gate: Column) -> Column:
    t, g = R.THRESHOLDS["orientation.value_proposition"], p["geometry"]
    use_g = g.isNotNull() & (F.size(F.coalesce(g["headings"], F.array())) > 0)
    top = F.get(above_fold(p["f"], ["h1", "h2"], headline=True), F.lit(0))
    heading = F.when(use_g, F.coalesce(F.get(_seen(g["headings"], g), F.lit(0))["text"], F.lit(""))).otherwise(F.coalesce(top["label"], F.lit("")))
    follow = F.when(use_g, F.substr(F.coalesce(g["above_fold_text"], F.lit("")), F.lit(1), F.lit(400))).otherwise(F.coalesce(top["follow"], F.lit("")))
    text = F.trim(F.concat(heading, F.lit(" "), follow))
    specific = text.rlike(X.ANCHOR_NUMBER) | X.has_proper_noun(text) | (_word(text, R.ACTION_VERBS, r"\w*") & _word(text, R.OFFERING_NOUNS, "s?"))
    vague = F.size(F.filter(X.lit_array(R.VAGUE_MARKERS), lambda m: F.contains(F.lower(text), m)))
    state = (
        F.when(~gate, "unknown").when(F.trim(heading) == "", "fail").when(F.length(text) < t["min_text"], "fail")
        .when(vague >= t["max_vague"], F.when(specific, "partial").otherwise("fail")).when(specific, "pass").otherwise("partial")
    )
    return result("orientation.value_proposition", state, F.concat_ws(" ", F.lit("specific"), specific.cast("string"), F.lit("vague"), vague.cast("string")), heading, page_url=p["url"], reason=F.when(~gate, "language_not_supported"))


def legibility(p: Column) -> Column:
    px = p["geometry"]["body_font_px"]
    return result("orientation.legibility", F.when(px.isNull(), "unknown").when(px >= R.THRESHOLDS["orientation.legibility"]["min_px"], "pass").otherwise("fail"), px, selector="body", page_url=p["url"], reason=F.when(px.isNull(), "needs a browser render"))


# ---- all ----------------------------------------------------------------------------


def with_check_rows(sites: DataFrame) -> DataFrame:
    """Adds checks: an array of check_id, state, measurement, evidence, selector, page_url, reason in registry order.

    A check that fails on a page's data is unknown with the reason `check failed`, the
    others stand: values that may be missing or odd are read by functions that give
    null instead of an error, and a state that comes out null becomes that row. A site whose homepage is blocked, failed or empty has only unknown rows with
    the reason.
    """
    home = F.get("pages", F.lit(0))
    robots = F.col("robots") if "robots" in sites.columns else None
    # Entity features are computed once a page, before the checks read them several times.
    sites = sites.withColumn("home", home).withColumn("entities", F.transform(F.filter("pages", lambda p: (p["page_status"] == "ok") & p["has_html"]), entity_row))
    p, gate = F.col("home"), X.language_supported(F.col("language"), R.SUPPORTED_LANGUAGES)
    rows = [
        http_ok(p), ai_crawlers(robots, p["url"]), indexable(p), content_without_js(p), semantic_html(p), facts_not_image_only(p),
        title_descriptive(p), meta_description(p), heading_hierarchy(p), scannable_blocks(p), quotability(p, gate), factual_ratio(p, gate),
        *entity_checks(F.col("entities")),
        heading_first_viewport(p), primary_cta(p), not_obstructed(p), viewport_meta(p), value_proposition(p, gate), legibility(p),
    ]
    problem = (
        F.when(p.isNull(), "no homepage").when(p["page_status"] == "blocked", F.concat(F.lit("blocked: "), F.coalesce(p["blocked_kind"], F.lit("robots"))))
        .when(p["page_status"] != "ok", p["page_status"]).when(~p["has_html"], "homepage has no HTML")
    )
    unknown = lambda check, reason: F.struct(check.alias("check_id"), F.lit("unknown").alias("state"), *[F.expr(f"cast(NULL AS string) AS {c}") for c in ("measurement", "evidence", "selector")], p["url"].alias("page_url"), reason.alias("reason"))
    none = F.transform(X.lit_array(list(R.CHECKS)), lambda c: unknown(c, problem))
    sites = sites.withColumn("checks", F.when(problem.isNull(), F.array(*rows)).otherwise(none))
    clean = lambda r: F.struct(*[(X.sanitize(r[c]) if c == "evidence" else r[c]).alias(c) for c in ("check_id", "state", "measurement", "evidence", "selector", "page_url", "reason")])
    whole = F.transform("checks", lambda r: F.when(r["state"].isNotNull(), clean(r)).otherwise(unknown(r["check_id"], F.lit("check failed"))))
    return sites.withColumn("checks", whole).drop("home", "entities")


def check_results(sites: DataFrame) -> DataFrame:
    """site_id, language and the check rows: 24 rows a site, unpivoted in place; nothing is shuffled here."""
    return hold(with_check_rows(sites), "checks").select("site_id", "language", F.inline("checks"))
