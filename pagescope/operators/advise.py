"""Advice: a filled template for each finding, and four detectors of chances that no check covers. Scores are never touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescope import registry as R
from pagescope.functions import text as X

_ORG = '{"@context": "https://schema.org", "@type": "Organization", "name": "{{BRAND_NAME}}", "url": "{{SITE_URL}}"'
# Own templates: check, where to change, snippet, how to confirm.
TEMPLATES = [
    ("access.http_ok", "web server", None, "Request {{SITE_URL}} and expect status 200."),
    ("access.ai_crawlers_allowed", "robots.txt", "User-agent: GPTBot\nAllow: /", "Read {{SITE_URL}} with the user agent GPTBot."),
    ("access.indexable", "<head>", '<meta name="robots" content="index,follow">', "The page has no noindex."),
    ("render.content_without_js", "server rendering", None, "Fetch {{SITE_URL}} without JavaScript and find the main text."),
    ("extraction.semantic_html", "<body>", "<main>\n  <article>{{MAIN_CONTENT}}</article>\n</main>", "The page has one main element."),
    ("extraction.facts_not_image_only", "<img>", '<img src="{{IMAGE_URL}}" alt="{{FACT_IN_WORDS}}">', "Each figure stands in text or alt text."),
    ("content.title_descriptive", "<head>", "<title>{{PAGE_TOPIC}} | {{BRAND_NAME}}</title>", "The title has 15 to 70 characters."),
    ("content.meta_description", "<head>", '<meta name="description" content="{{ONE_SENTENCE_SUMMARY}}">', "The description has 50 to 160 characters."),
    ("content.heading_hierarchy", "<body>", "<h1>{{PAGE_TOPIC}}</h1>\n<h2>{{SECTION}}</h2>", "One h1, no skipped level."),
    ("content.scannable_blocks", "<body>", "<ul>\n  <li>{{FACT_1}}</li>\n  <li>{{FACT_2}}</li>\n</ul>", "The page has a list of two items."),
    ("quotability.self_contained_facts", "body text", "{{BRAND_NAME}} {{WHAT_IT_DOES}} for {{HOW_MANY}} customers since {{YEAR}}.", "Three sentences stand on their own."),
    ("density.factual_ratio", "body text", None, "A quarter of the sentences name a figure or a name."),
    ("entity.structured_data_present", "<head>", f'<script type="application/ld+json">{_ORG}}}</script>', "A validator reads the JSON-LD."),
    ("entity.organization_declared", "<head>", f'<script type="application/ld+json">{_ORG}, "logo": "{{{{LOGO_URL}}}}"}}</script>', "The Organization node has name and url."),
    ("entity.sameas_present", "JSON-LD", f'{_ORG}, "sameAs": [\n{{{{SAMEAS_LINKS}}}}\n]}}', "Each link in sameAs opens the profile."),
    ("entity.sameas_authority", "JSON-LD", '"sameAs": [\n{{SAMEAS_LINKS_LEADING}}\n    "{{REGISTRY_RECORD_URL}}"\n]', "One link leads to a registry or directory."),
    ("entity.opengraph_identity", "<head>", '<meta property="og:title" content="{{PAGE_TITLE}}">\n<meta property="og:type" content="website">\n<meta property="og:url" content="{{SITE_URL}}">', "All three properties are set."),
    ("entity.name_consistency", "<head>", '<meta property="og:site_name" content="{{BRAND_NAME}}">', "Markup, title and og:site_name agree."),
    ("orientation.heading_first_viewport", "top of <body>", "<h1>{{PAGE_TOPIC}}</h1>", "The heading shows without scrolling."),
    ("orientation.primary_cta", "top of <body>", '<a href="{{NEXT_STEP_URL}}">{{NEXT_STEP}}</a>', "A link or button shows without scrolling."),
    ("orientation.content_not_obstructed", "overlay", "max-height: 30vh;", "The overlay covers less than 40 % of the screen."),
    ("orientation.viewport_meta", "<head>", '<meta name="viewport" content="width=device-width, initial-scale=1">', "The page fits a phone."),
    ("orientation.value_proposition", "<h1>", "<h1>{{WHAT_IT_DOES}} for {{WHOM}} in {{WHERE}}</h1>", "The headline names what is offered."),
    ("orientation.legibility", "CSS", "body { font-size: 16px; }", "Body text has 14 px at least."),
]
# Detector, category, title, language gate, check whose finding suppresses it.
DETECTORS = [
    ("faq_schema", R.E, "Mark questions and answers as FAQPage", False, "entity.structured_data_present"),
    ("facts_in_prose", R.C, "Move figures from prose to a list or table", True, "content.scannable_blocks"),
    ("undated_claims", R.C, "Date the figures", True, None),
    ("image_facts_with_alt", R.D, "Repeat figures of images in the text", False, "extraction.facts_not_image_only"),
]
MIN_PAIRS, MIN_ANSWER, MIN_STRANDED, MIN_CLAIMS, MIN_IMAGES, MIN_PX = 2, 40, 4, 3, 2, 64


def observed_values(p: Column, url: Column) -> Column:
    """Map of what the page itself says; a key is missing where it says nothing."""
    f = p["f"]
    title, og = f["title"], X.opengraph(f["metas"])
    kinds = lambda n: F.transform(n["types"], lambda t: F.lower(t))
    named = F.filter(f["graph_nodes"], lambda n: (F.arrays_overlap(kinds(n), X.lit_array(["organization", "localbusiness", "person"])) | (F.size(n["same_as"]) > 0)) & (n["name"] != ""))
    brand = F.coalesce(F.get(named, F.lit(0))["name"], F.nullif(F.element_at(og, "og:site_name"), F.lit("")), F.trim(F.get(F.split(title, r"\s[|–—\-:]\s"), F.lit(0))))
    logo = F.coalesce(F.get(F.filter(f["graph_nodes"]["logo"], lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0)), F.element_at(og, "og:image"))
    same = F.flatten(f["graph_nodes"]["same_as"])
    me = F.filter(f["anchors"], lambda a: a["me"])["href"]
    links = F.slice(F.array_distinct(F.transform(F.filter(F.concat(same, me), lambda u: u.rlike("^https?://")), lambda u: X.sanitize(u))), 1, 10)
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-z]+://([^/?#]*)", 1)
    quoted = F.transform(links, lambda u: F.concat(F.lit('    "'), u, F.lit('"')))
    values = {
        "SITE_URL": url, "SITE_HOST": host, "PAGE_TITLE": X.sanitize(title, 200), "META_DESCRIPTION": X.sanitize(X.meta_content(f["metas"], "name", "description")),
        "BRAND_NAME": X.sanitize(brand, 120), "LOGO_URL": X.sanitize(logo, 400), "SAMEAS_LINKS": F.array_join(quoted, ",\n"), "SAMEAS_LINKS_LEADING": F.array_join(F.transform(quoted, lambda q: F.concat(q, F.lit(","))), "\n"),
    }
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda _, v: F.coalesce(v, F.lit("")) != "")


def corrective(found: DataFrame, sites: DataFrame) -> DataFrame:
    """site_id, check_id, finding_id, target, snippet, validation, placeholders_remaining: a row for each finding with a template."""
    t = found.sparkSession.createDataFrame(TEMPLATES, "check_id string, target string, snippet string, validation string").coalesce(1)
    values = sites.select("site_id", observed_values(F.get("pages", F.lit(0)), F.col("url")).alias("v"))
    rows = found.select("site_id", "check_id", F.col("id").alias("finding_id")).join(F.broadcast(t), "check_id").join(values, "site_id")
    left = F.array_union(X.placeholders_left(F.col("snippet"), F.col("v")), X.placeholders_left(F.col("validation"), F.col("v")))
    return rows.select("site_id", "check_id", "finding_id", "target", X.fill(F.col("snippet"), F.col("v")).alias("snippet"), X.fill(F.col("validation"), F.col("v")).alias("validation"), left.alias("placeholders_remaining"))


# ---- detectors: the measurement where they fire, else null --------------------------


def faq_pairs(f: Column) -> Column:
    marked = F.exists(f["graph_nodes"], lambda n: F.exists(n["types"], lambda t: F.lower(t) == "faqpage"))
    n = F.size(F.filter(f["questions"], lambda q: F.length(q["answer"]) >= MIN_ANSWER))
    return F.when(~marked & (n >= MIN_PAIRS), n)


def _hits(texts: Column, pattern: str) -> Column:
    return F.aggregate(texts, F.lit(0), lambda s, t: s + F.regexp_count(t, F.lit(pattern)))


def facts_in_prose(f: Column) -> Column:
    prose, listed = _hits(f["paragraphs"], X.SPEC), _hits(f["structured"], X.SPEC)
    return F.when((prose >= MIN_STRANDED) & (prose > listed), prose)


def undated_claims(f: Column) -> Column:
    n = F.regexp_count(f["text_advice"], F.lit(X.CLAIM))
    dated = f["has_time"] | f["has_cite"] | (X.meta_content(f["metas"], "property", "article:published_time") != "") | F.exists(f["graph_nodes"], lambda x: x["dated"])
    return F.when((n >= MIN_CLAIMS) & ~dated, n)


def image_facts(f: Column) -> Column:
    numbers = lambda t, p: F.transform(F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1)), X.normalise_number)
    body = numbers(f["text_advice"], r"\d[\d,.]*")
    lost = lambda i: F.size(F.array_except(F.filter(numbers(F.coalesce(i["alt"], F.lit("")), X.QUANTITY), lambda x: x != ""), body)) > 0
    n = F.size(F.filter(f["images"], lambda i: ~X.declared_smaller(i["width"], i["height"], MIN_PX) & lost(i)))
    return F.when(n >= MIN_IMAGES, n)


_RUN = {"faq_schema": faq_pairs, "facts_in_prose": facts_in_prose, "undated_claims": undated_claims, "image_facts_with_alt": image_facts}


DETECTED = "array<struct<detector:string,place:int,category:string,title:string,check_id:string,measurement:int>>"


def detector_rows() -> Column:
    """Array of detector, place, category, title, check_id (that suppresses it), measurement (null: did not fire) of a site row."""
    f = F.get("pages", F.lit(0))["f"]
    gate = X.language_supported(F.col("language"), R.SUPPORTED_LANGUAGES)
    rows = []
    for i, (name, category, title, needs, check) in enumerate(DETECTORS):
        m = _RUN[name](f)
        rows.append(F.struct(F.lit(name).alias("detector"), F.lit(i).alias("place"), F.lit(category).alias("category"), F.lit(title).alias("title"), F.lit(check).cast("string").alias("check_id"), (F.when(gate, m) if needs else m).cast("int").alias("measurement")))
    return F.array(*rows)


def detections(sites: DataFrame) -> DataFrame:
    """site_id and the detector rows."""
    return sites.select("site_id", F.inline(detector_rows()))


def recommendations(sites: DataFrame, resolved: DataFrame) -> DataFrame:
    """Detections that no finding already covers, numbered in detector order; suppressed ones are in `suppressed_detectors`."""
    kept = _with_cover(sites, resolved).filter("NOT covered")
    order = Window.partitionBy("site_id").orderBy("place")
    return kept.withColumn("id", F.format_string("R-%03d", F.row_number().over(order))).select("site_id", "id", "detector", "category", "title", "measurement")


def suppressed_detectors(sites: DataFrame, resolved: DataFrame) -> DataFrame:
    return _with_cover(sites, resolved).filter("covered").select("site_id", "detector", F.col("check_id").alias("suppressed_by"))


def _with_cover(sites: DataFrame, resolved: DataFrame) -> DataFrame:
    fired = detections(sites).filter("measurement IS NOT NULL")
    cover = resolved.filter(F.col("state").isin("fail", "partial")).select("site_id", "check_id", F.lit(True).alias("_c"))
    return fired.join(cover, ["site_id", "check_id"], "left").withColumn("covered", F.coalesce("_c", F.lit(False))).drop("_c")
