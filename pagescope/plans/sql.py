"""DuckDB SQL of the oracles, built of common parts."""

from __future__ import annotations

from pagescope import registry as R
from pagescope.functions import text as X
from pagescope.functions import urls as U
from pagescope.sources.overlay import overlay_sql


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def visible(html: str) -> str:
    x = html
    for pattern in ("<!--.*?-->", r"<script\b[^>]*>.*?</script>", r"<style\b[^>]*>.*?</style>", "<[^>]+>"):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'gis')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sentences(text: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def named_inside(s: str) -> str:
    """A capitalised word of three letters or more that does not begin the text or follow a sentence end and one space."""
    return rf"regexp_matches(regexp_replace({s}, '[.!?]\s[A-Z]', '', 'g'), '(?s)^.+\b[A-Z][a-z]{{2,}}')"


def quotable(s: str, openers: list[str]) -> str:
    first = rf"lower(regexp_replace(regexp_extract({s}, '^\S+'), '^[,.:;]+|[,.:;]+$', '', 'g'))"
    gate = f"AND NOT list_contains({quoted(openers)}, {first})" if openers else ""
    return rf"(length({s}) BETWEEN 40 AND 300 AND len(regexp_split_to_array(trim({s}), '\s+')) >= 6 {gate} AND (regexp_matches({s}, '\d') OR {named_inside(s)}))"


HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '')"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
DEPTH = f"len(list_filter(string_split({PATH}, '/'), lambda x: x <> ''))"
#: page_id, url, html with the overlay, site_id, depth.
PAGES = f"p AS (SELECT page_id, url, {overlay_sql()} AS html, {HOST} AS site_id, {DEPTH} AS depth FROM pages)"
#: The pages of an audit: pos from 0.
CHOSEN = f"{PAGES}, c AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY depth, page_id) - 1 AS pos FROM p QUALIFY pos < {U.MAX_PAGES})"
LANG = r"nullif(lower(regexp_extract(left(html, 4000), '<html[^>]*\blang\s*=\s*[\x22\x27]?([A-Za-z]{2,3}(?:-[A-Za-z0-9]+)*)[\x22\x27\s/>]', 1, 'i')), '')"
ROBOTS = r"lower(trim(regexp_extract(left(html, 20000), '<meta[^>]+name\s*=\s*[\x22\x27]robots[\x22\x27][^>]+content\s*=\s*[\x22\x27]([^\x22\x27]*)[\x22\x27]', 1, 'is')))"


def meta(attribute: str, name: str) -> str:
    return rf"coalesce(trim(regexp_extract(html, '<meta {attribute}=\x22{name}\x22 content=\x22([^\x22]*)\x22', 1)), '')"


def unescape(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


TITLE = unescape(r"trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '\s+', ' ', 'g'))")
# Text of the tree: tags become separators; entities are decoded after.
TREE_TEXT = unescape(visible("html"))

# ---- states of checks by site: made up for each customer, or read from the pages -----

#: Every combination of the resolution rules occurs; i is a customer.
STATE_INDEX = "((i * 7919 + place * 104729 + (i * place) % 13 + (i % 11) * (place % 7)) % 7)"
STATE = f"CASE {STATE_INDEX} WHEN 0 THEN 'pass' WHEN 1 THEN 'partial' WHEN 2 THEN 'fail' WHEN 3 THEN 'unknown' WHEN 4 THEN 'not_applicable' WHEN 5 THEN 'pass' ELSE NULL END"
_DIM = f"dim AS (SELECT * FROM {R.checks_sql()})"
#: site_id, the registry, the measured state, whether the language is supported, whether the site refused.
_MADE_UP = f"{_DIM}, v AS (SELECT 's' || lpad(CAST(i AS VARCHAR), 9, '0') AS site_id, d.*, {STATE} AS measured, NULL::VARCHAR AS why, i % 3 <> 0 AS gate, i % 40 = 7 AS blocked FROM (SELECT c_custkey AS i FROM customer) AS r CROSS JOIN dim AS d)"
_RULES = """
e AS (SELECT *, CASE WHEN blocked THEN 'blocked' WHEN requires_language AND NOT gate THEN 'language_not_supported' END AS stop, coalesce(measured, 'unknown') AS own FROM v),
r0 AS (SELECT *, CASE WHEN stop IS NULL THEN own ELSE 'unknown' END AS state, NULL::VARCHAR AS cause FROM e WHERE level = 0),
"""


def _level(n: int) -> str:
    return f"""r{n} AS (SELECT e.*, CASE WHEN e.stop IS NOT NULL THEN 'unknown' WHEN b.cause2 IS NOT NULL THEN 'unknown' ELSE e.own END AS state, CASE WHEN e.stop IS NULL THEN b.cause2 END AS cause
 FROM e LEFT JOIN (SELECT site_id, check_id, CASE WHEN state = 'fail' AND confidence_class = 'verified' THEN check_id ELSE cause END AS cause2 FROM r{n - 1}) AS b ON b.site_id = e.site_id AND b.check_id = e.prerequisite WHERE e.level = {n})"""


_DEPTH = max(R.LEVELS.values())


SEVERITY = "CASE WHEN state = 'partial' THEN CASE severity WHEN 'critical' THEN 'high' ELSE 'medium' END ELSE severity END"
RANK = "CASE sev WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END"


def resolved(states: str) -> str:
    """CTEs up to res (states after gates and prerequisites), cat and cs (sums and scores by category), f (findings)."""
    steps = ",\n".join(_level(n) for n in range(1, _DEPTH + 1))
    return states + "," + _RULES + steps + ",\nr AS (" + " UNION ALL ".join(f"SELECT * FROM r{n}" for n in range(_DEPTH + 1)) + f"""),
res AS (SELECT site_id, check_id, category, weight, severity, confidence_class, place, state, own AS original_state, cause AS suppressed_by,
 CASE WHEN stop IS NOT NULL THEN stop WHEN cause IS NOT NULL THEN 'suppressed_by_failed_prerequisite' WHEN why IS NOT NULL THEN why WHEN measured IS NULL THEN 'not_measured' END AS reason FROM r),
cat AS (SELECT site_id, category, coalesce(sum(weight * CASE state WHEN 'pass' THEN 2 WHEN 'partial' THEN 1 WHEN 'fail' THEN 0 END), 0)::BIGINT AS earned2,
 coalesce(sum(weight) FILTER (state IN ('pass', 'partial', 'fail')), 0)::BIGINT AS scored,
 coalesce(sum(weight) FILTER (state IN ('pass', 'partial', 'fail') AND confidence_class = 'verified'), 0)::BIGINT AS verified,
 sum(weight)::BIGINT AS total, count(*) FILTER (state <> 'unknown') AS evaluated, count(*) FILTER (state = 'unknown') AS unknown FROM res GROUP BY ALL),
cs AS (SELECT *, CASE WHEN scored > 0 THEN 100.0::DOUBLE * earned2 / (2 * scored) END AS score, scored::DOUBLE / total AS coverage FROM cat),
f0 AS (SELECT *, {SEVERITY} AS sev, CASE state WHEN 'fail' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * weight * 25 / 100.0::DOUBLE AS pts FROM res WHERE state IN ('fail', 'partial')),
f AS (SELECT *, printf('F-%03d', row_number() OVER (PARTITION BY site_id ORDER BY {RANK}, category, check_id)) AS id FROM f0)"""


RESOLVED = SUMS = FINDINGS = resolved(_MADE_UP)

# ---- the checks of the test pages, by the survey's rules ------------------------------

CLEAN = lambda x: unescape(rf"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))")
_H1 = CLEAN("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")
#: Text of the menu (at a tenth) and of the advert, which stand before the headline.
_MENU = f"coalesce(list_sum(list_transform(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '>([^<]+)<', 1), lambda x: length(trim({unescape('x')})))), 0)"
_BEFORE = f"(least({_MENU}, 4000) * 0.1 + greatest({_MENU} - 4000, 0) + length(trim({unescape(chr(114) + 'egexp_extract(html, ' + chr(39) + '<div class=.ad.>([^<]*)<' + chr(39) + ', 1)')})))"
#: What follows the headline: paragraphs, second headings and items, to their end or the next block.
_AFTER = r"regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '</h1>(.*?)</article>', 1, 's'), '<(p|h2|li)>', chr(1), 'g'), '</(p|h2|li)>', chr(2), 'g'), '<(ul|table|dl|main|h3|div|footer)>', chr(2), 'g')"
_PARTS = f"list_slice(list_transform(list_slice(string_split({_AFTER}, chr(1)), 2, 4), lambda x: {CLEAN('string_split(x, chr(2))[1]')}), 1, 3)"
_LENGTH2 = "(length(a[1]) + length(a[2]) + 2 > 400)"
_FOLLOW = f"CASE WHEN len(a) = 0 THEN '' WHEN length(a[1]) + 1 > 400 THEN ' ' || a[1] WHEN len(a) > 1 AND {_LENGTH2} THEN ' ' || a[1] || ' ' || a[2] ELSE array_to_string(list_transform(a, lambda x: ' ' || x), '') END"
_ANCHOR = r"([$£€¥]\s?\d|\d[\d,.]*\s?%|\b\d[\d,.]*\s?[a-zA-Z]{1,12}\b)"
NAMED = r"""len(list_filter(range(2, len({t}) + 1), lambda i: ascii({t}[i]) BETWEEN 65 AND 90 AND length({t}[i]) > 2 AND substring({t}[i], 2) = lower(substring({t}[i], 2)) AND regexp_matches(substring({t}[i], 2), '[a-z]') AND ascii({t}[i - 1]) BETWEEN 97 AND 122)) > 0"""
TOKENS = r"regexp_extract_all({x}, '[A-Za-z][A-Za-z''’\-]*|[.!?]')"


def _word(x: str, words: list[str], tail: str) -> str:
    return rf"regexp_matches(lower({x}), '\b({'|'.join(words)}){tail}\b')"


def _forms(x: str) -> str:
    plain = lambda y: rf"regexp_replace(lower({y}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
    return rf"list_filter(list_distinct(list_append(list_transform(regexp_split_to_array({x}, '\s*[|·–—•»«:/\-‐]\s*|\s+[-–]\s+'), lambda y: {plain('y')}), {plain(x)})), lambda y: y <> '')"


_LEVELS = "list_transform(regexp_extract_all(html, '<h([1-6])>', 1), lambda x: x::INT)"
_ORG = """(contains(html, '"@type":"Organization"') OR contains(html, '"@type":"Dentist"'))"""
_GOOD = lambda openers: f"len(list_filter(s, lambda x: {quotable('x', openers)}))"
_OG = "len(list_filter(['og:title', 'og:type', 'og:url'], lambda k: contains(html, '<meta property=\"' || k || '\"')))"
_AGREE = f"len(list_filter({_forms('t.lead')}, lambda x: len(list_filter(list_concat({_forms('t.title')}, {_forms('t.og')}), lambda y: contains(x, y) OR contains(y, x))) > 0)) > 0"
_STATES = {
    "access.http_ok": "'pass'",
    "access.ai_crawlers_allowed": "'unknown'",
    "access.indexable": f"CASE WHEN contains({ROBOTS}, 'noindex') THEN 'fail' ELSE 'pass' END",
    "render.content_without_js": "CASE WHEN chars >= 500 THEN 'pass' WHEN chars < 50 THEN 'fail' ELSE 'pass' END",
    "extraction.semantic_html": "CASE WHEN contains(html, '<main>') OR contains(html, '<article>') THEN 'pass' WHEN contains(html, '<header>') OR contains(html, '<nav>') THEN 'partial' ELSE 'fail' END",
    "extraction.facts_not_image_only": "CASE k WHEN 1 THEN 'partial' WHEN 5 THEN 'pass' ELSE 'not_applicable' END",
    "content.title_descriptive": "CASE WHEN title = '' THEN 'fail' WHEN length(title) BETWEEN 15 AND 70 THEN 'pass' ELSE 'partial' END",
    "content.meta_description": f"CASE WHEN length({meta('name', 'description')}) = 0 THEN 'fail' WHEN length({meta('name', 'description')}) BETWEEN 50 AND 160 THEN 'pass' ELSE 'partial' END",
    "content.heading_hierarchy": "CASE WHEN len(l) = 0 THEN 'fail' WHEN len(list_filter(range(2, len(l) + 1), lambda i: l[i] - l[i - 1] > 1)) = 0 AND len(list_filter(l, lambda x: x = 1)) = 1 THEN 'pass' ELSE 'partial' END",
    "content.scannable_blocks": "'pass'",  # the menu is a list of two items or more
    "quotability.self_contained_facts": f"CASE WHEN NOT en THEN 'unknown' WHEN len(s) = 0 THEN 'fail' WHEN {_GOOD(R.DANGLING_OPENERS)} >= 3 THEN 'pass' WHEN {_GOOD(R.DANGLING_OPENERS)} >= 1 THEN 'partial' ELSE 'fail' END",
    "density.factual_ratio": rf"CASE WHEN NOT en THEN 'unknown' WHEN len(s) = 0 THEN 'fail' WHEN {_GOOD([])}::DOUBLE / len(s) >= 0.25 THEN 'pass' WHEN len(regexp_split_to_array(words, '\s+')) > 2000 THEN 'fail' ELSE 'partial' END",
    "entity.structured_data_present": "CASE WHEN any_org THEN 'pass' ELSE 'fail' END",
    "entity.organization_declared": "CASE WHEN any_org THEN 'pass' WHEN any_og THEN 'partial' ELSE 'fail' END",
    "entity.sameas_present": "CASE WHEN any_org THEN 'pass' ELSE 'fail' END",
    "entity.sameas_authority": "CASE coalesce(record, '') WHEN '' THEN 'fail' ELSE record END",
    "entity.opengraph_identity": "CASE WHEN most_og = 3 THEN 'pass' WHEN most_og > 0 THEN 'partial' ELSE 'fail' END",
    "entity.name_consistency": "CASE WHEN lead = '' AND title = '' AND og = '' THEN 'fail' WHEN lead = '' THEN 'partial' WHEN agree THEN 'pass' ELSE 'partial' END",
    "orientation.heading_first_viewport": "CASE WHEN before < 1200 AND h1 <> '' THEN 'pass' ELSE 'fail' END",
    "orientation.primary_cta": "'pass'",  # the menu's links
    "orientation.content_not_obstructed": "'unknown'",
    "orientation.viewport_meta": f"CASE WHEN {meta('name', 'viewport')} <> '' THEN 'pass' ELSE 'fail' END",
    "orientation.value_proposition": f"CASE WHEN NOT en THEN 'unknown' WHEN h1 = '' OR before >= 1200 THEN 'fail' WHEN length(said) < 80 THEN 'fail' WHEN vague >= 2 THEN CASE WHEN specific THEN 'partial' ELSE 'fail' END WHEN specific THEN 'pass' ELSE 'partial' END",
    "orientation.legibility": "'unknown'",
}
_WHY = "CASE WHEN check_id IN ('orientation.content_not_obstructed', 'orientation.legibility') THEN 'needs a browser render' WHEN check_id = 'access.ai_crawlers_allowed' THEN 'robots.txt was not read' WHEN check_id IN ('orientation.heading_first_viewport', 'orientation.primary_cta') THEN 'estimated from the order of text' END"
#: v of the sites of the test pages: the homepage's checks, and those that look at all pages of the audit.
_FROM_PAGES = f"""{CHOSEN}, {_DIM},
t0 AS (SELECT *, page_id % 7 AS k, length({visible('html')}) AS chars, {TITLE} AS title, coalesce({LANG} = 'en', false) AS en, {TREE_TEXT} AS words, {_LEVELS} AS l, {_H1} AS h1, {_BEFORE} AS before, {_PARTS} AS a,
 coalesce(CASE page_id % 7 WHEN 1 THEN 'Northwind' WHEN 3 THEN 'Bright Smile' WHEN 2 THEN 'Contoso' WHEN 4 THEN 'Fabrikam' END, '') AS lead, CASE page_id % 7 WHEN 0 THEN 'Leeds Bakery' WHEN 2 THEN 'Contoso | Tools' ELSE '' END AS og FROM c WHERE pos = 0),
t AS (SELECT *, {sentences('words')} AS s, trim(h1 || ' ' || {_FOLLOW}) AS said FROM t0),
t1 AS (SELECT *, {_AGREE} AS agree, regexp_matches(said, '{_ANCHOR}') OR {NAMED.format(t='w')} OR ({_word('said', R.ACTION_VERBS, '[a-z0-9_]*')} AND {_word('said', R.OFFERING_NOUNS, 's?')}) AS specific, len(list_filter({quoted(R.VAGUE_MARKERS)}, lambda m: contains(lower(said), m))) AS vague FROM (SELECT *, {TOKENS.format(x='said')} AS w FROM t) AS t),
site AS (SELECT site_id, bool_or({_ORG}) AS any_org, bool_or(contains(html, 'og:site_name') OR (contains(html, 'og:title') AND contains(html, 'og:url'))) AS any_og, max({_OG}) AS most_og,
 arg_min(CASE WHEN contains(html, 'wikidata.org') THEN 'pass' WHEN contains(html, '"Dentist"') THEN 'partial' END, pos) AS record FROM c GROUP BY site_id),
m AS (SELECT site_id, en AS gate, unnest([{', '.join(f"{{'c': '{k}', 's': {v}}}" for k, v in _STATES.items())}]) AS x FROM t1 JOIN site USING (site_id)),
v AS (SELECT site_id, dim.*, x.s AS measured, {_WHY} AS why, gate, false AS blocked FROM m JOIN dim ON dim.check_id = x.c)"""
AUDITED = resolved(_FROM_PAGES)
