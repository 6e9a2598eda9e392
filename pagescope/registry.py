"""The twenty-four checks: category, weight, severity, class, language gate, prerequisites, wording."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

D, C, E, H = "ai_discoverability", "ai_comprehension", "entity_trust", "human_orientation"
CATEGORIES = {D: 25, C: 25, E: 25, H: 25}
SEVERITIES = ["critical", "high", "medium"]
STATES = ["pass", "partial", "fail", "unknown", "not_applicable"]
SUPPORTED_LANGUAGES = ["en"]
COVERAGE_FLOOR = 0.5

_JS = "render.content_without_js"
_HTTP = "access.http_ok"

# Id, category, weight, severity, class, language gate, prerequisites.
_TABLE = [
    ("access.http_ok", D, 18, "critical", "verified", False, []),
    ("access.ai_crawlers_allowed", D, 22, "critical", "verified", False, []),
    ("access.indexable", D, 18, "critical", "verified", False, [_HTTP]),
    ("render.content_without_js", D, 24, "critical", "verified", False, [_HTTP]),
    ("extraction.semantic_html", D, 8, "medium", "verified", False, [_JS]),
    ("extraction.facts_not_image_only", D, 10, "high", "heuristic", False, [_JS]),
    ("content.title_descriptive", C, 20, "high", "verified", False, [_JS]),
    ("content.meta_description", C, 12, "medium", "verified", False, [_JS]),
    ("content.heading_hierarchy", C, 13, "medium", "verified", False, [_JS]),
    ("content.scannable_blocks", C, 12, "medium", "verified", False, [_JS]),
    ("quotability.self_contained_facts", C, 23, "critical", "heuristic", True, [_JS]),
    ("density.factual_ratio", C, 20, "high", "heuristic", True, [_JS]),
    ("entity.structured_data_present", E, 22, "critical", "verified", False, [_JS]),
    ("entity.organization_declared", E, 24, "critical", "verified", False, [_JS]),
    ("entity.sameas_present", E, 20, "high", "verified", False, [_JS]),
    ("entity.sameas_authority", E, 12, "medium", "verified", False, [_JS]),
    ("entity.opengraph_identity", E, 10, "medium", "verified", False, [_JS]),
    ("entity.name_consistency", E, 12, "high", "verified", False, [_JS]),
    ("orientation.heading_first_viewport", H, 24, "critical", "verified", False, [_JS]),
    ("orientation.primary_cta", H, 20, "high", "verified", False, [_JS]),
    ("orientation.content_not_obstructed", H, 18, "high", "verified", False, [_JS]),
    ("orientation.viewport_meta", H, 10, "medium", "verified", False, [_HTTP]),
    ("orientation.value_proposition", H, 18, "high", "heuristic", True, [_JS]),
    ("orientation.legibility", H, 10, "medium", "heuristic", False, [_JS]),
]

# Own wording: what a check is about, what a failure means, what to do.
_WORDS = {
    "access.http_ok": ("Home page answers", "The home page does not answer with success", "Serve the home page with a 2xx status."),
    "access.ai_crawlers_allowed": ("AI crawlers may read", "robots.txt keeps AI crawlers out", "Allow the AI crawlers in robots.txt."),
    "access.indexable": ("Page may be indexed", "The page asks not to be indexed", "Remove noindex from meta robots and X-Robots-Tag."),
    "render.content_without_js": ("Content without JavaScript", "The content appears only after JavaScript runs", "Send the main content in the first HTML response."),
    "extraction.semantic_html": ("Semantic landmarks", "Nothing marks the main content", "Wrap the main content in <main> or <article>."),
    "extraction.facts_not_image_only": ("Facts as text", "Facts are shown in images only", "State each figure in text or in alt text."),
    "content.title_descriptive": ("Descriptive title", "The title is missing or says little", "Write a title of 15 to 70 characters."),
    "content.meta_description": ("Meta description", "The meta description is missing or has a poor length", "Write a description of 50 to 160 characters."),
    "content.heading_hierarchy": ("Heading hierarchy", "Headings are missing or skip levels", "Use one h1 and descend one level at a time."),
    "content.scannable_blocks": ("Scannable blocks", "There is no list, table or definition list", "Put lists of facts in a list or table."),
    "quotability.self_contained_facts": ("Quotable sentences", "Few sentences can be quoted on their own", "Write sentences that name their subject and a figure."),
    "density.factual_ratio": ("Factual density", "Few sentences state anything specific", "Replace general remarks by facts."),
    "entity.structured_data_present": ("Structured data", "The site has no structured data", "Add JSON-LD to the page."),
    "entity.organization_declared": ("Organization declared", "No markup says who the site belongs to", "Add an Organization node with name and url."),
    "entity.sameas_present": ("Profile links", "Nothing links the site to its other profiles", "List the profiles in sameAs."),
    "entity.sameas_authority": ("Third-party records", "No link leads to a third-party record", "Link a registry or directory entry."),
    "entity.opengraph_identity": ("Open Graph identity", "Open Graph properties are missing", "Add og:title, og:type and og:url."),
    "entity.name_consistency": ("One name", "The site does not state one name", "Use the same name in markup, title and og:site_name."),
    "orientation.heading_first_viewport": ("Heading on arrival", "No heading is visible on arrival", "Put a heading near the top."),
    "orientation.primary_cta": ("Next step on arrival", "No link or button is visible on arrival", "Put a link or button near the top."),
    "orientation.content_not_obstructed": ("Content in sight", "An overlay hides the content", "Shrink or delay the overlay."),
    "orientation.viewport_meta": ("Mobile viewport", "The page sets no mobile viewport", "Add a viewport meta tag."),
    "orientation.value_proposition": ("Specific headline", "The headline says nothing specific", "Name what is offered in the headline."),
    "orientation.legibility": ("Legible text", "The text is small", "Use at least 14 px for body text."),
}

# Thresholds by check.
THRESHOLDS = {
    "render.content_without_js": {"min_chars": 500, "floor": 50},
    "extraction.facts_not_image_only": {"max_ratio": 0.5, "min_images": 3, "min_px": 64},
    "content.title_descriptive": {"min_chars": 15, "max_chars": 70},
    "content.meta_description": {"min_chars": 50, "max_chars": 160},
    "content.heading_hierarchy": {"max_level_skip": 1},
    "content.scannable_blocks": {"min_blocks": 1, "min_items": 2, "short_page_chars": 1000},
    "quotability.self_contained_facts": {"min_quotable": 3, "min_chars": 40, "max_chars": 300, "min_words": 6},
    "density.factual_ratio": {"min_ratio": 0.25, "long_page_words": 2000},
    "entity.organization_declared": {"min_properties": 2},
    "entity.opengraph_identity": {"required": ["og:title", "og:type", "og:url"]},
    "entity.name_consistency": {"min_sources": 2},
    "orientation.heading_first_viewport": {"fold_px": 800, "fold_chars": 1200, "chrome_weight": 0.1, "chrome_cap": 400},
    "orientation.content_not_obstructed": {"max_coverage": 0.4},
    "orientation.value_proposition": {"min_text": 80, "max_vague": 2},
    "orientation.legibility": {"min_px": 14},
}

# Own word lists, English only, used by checks behind the language gate.
DANGLING_OPENERS = ["it", "however", "this", "that", "these", "those", "they", "but", "and", "so", "also", "then"]
FILLERS = ["very", "really", "quite", "simply", "just", "actually", "basically", "literally"]
ACTION_VERBS = ["build", "buy", "book", "compare", "create", "design", "find", "hire", "learn", "manage", "order", "repair", "rent", "sell", "ship", "track"]
OFFERING_NOUNS = ["app", "bakery", "class", "clinic", "course", "data", "insurance", "platform", "product", "service", "shop", "software", "store", "tool", "training"]
VAGUE_MARKERS = ["best in class", "cutting edge", "innovative solutions", "leading provider", "next level", "next generation", "one stop", "seamless", "unlock", "world class"]

# Own wording by category: why a failure there matters. By check: what is measured, in the order of the table.
_IMPACT = {
    D: "What a crawler cannot fetch or read is not quoted by any assistant.",
    C: "Text that cannot be taken out of its page as a whole is passed over for text that can.",
    E: "A site whose owner is not stated is mixed up with others of a like name.",
    H: "A visitor who does not see at once where they are goes back to the answer they came from.",
}
_SIGNALS = [
    "HTTP status of the home page", "Rules of robots.txt for known AI crawlers", "noindex in meta robots or X-Robots-Tag", "Characters of visible text in the raw HTML",
    "main, article, header and nav elements", "Images whose names hold figures and whose alt text says little", "Length of the title", "Length of the meta description",
    "Number and order of heading levels", "Lists and tables with two items or more", "Sentences that can be quoted on their own", "Share of sentences with a figure or a name",
    "JSON-LD blocks or microdata", "Nodes that name the owner", "sameAs and rel=me links", "Kinds of the linked profiles",
    "og:title, og:type and og:url", "Names in markup, title and Open Graph", "Headings in the first screen", "Links and buttons in the first screen",
    "Share of the screen under overlays", "meta viewport", "Figures, names, verbs and nouns in the headline", "Font size of body text",
]

# Own verdict bands: least score and sentence, high to low.
BANDS = [(85, "Well prepared"), (60, "Partly prepared"), (0, "Poorly prepared")]
UNMEASURED = "Not enough could be measured"
CAVEAT = "Less than half of the weight could be measured, so the score says little."


@dataclass(frozen=True)
class Check:
    check_id: str
    category: str
    weight: int
    severity: str
    confidence_class: str
    requires_language: bool
    depends_on: list = field(default_factory=list)

    @property
    def title(self) -> str:
        return _WORDS[self.check_id][0]

    @property
    def failure_title(self) -> str:
        return _WORDS[self.check_id][1]

    @property
    def remedy(self) -> str:
        return _WORDS[self.check_id][2]

    @property
    def summary(self) -> str:
        return f"{self.failure_title}."

    @property
    def partial_summary(self) -> str:
        return f"{self.title}: this is there in part only."

    @property
    def signal(self) -> str:
        return _SIGNALS[list(CHECKS).index(self.check_id)]

    @property
    def impact(self) -> str:
        return _IMPACT[self.category]


CHECKS = {row[0]: Check(*row) for row in _TABLE}


def levels(checks: dict[str, Check]) -> dict[str, int]:
    """Depth of each check in the graph of prerequisites; raises on a cycle or an unknown prerequisite."""
    depth: dict[str, int] = {}
    left = dict(checks)
    while left:
        ready = [k for k, c in left.items() if all(d in depth for d in c.depends_on)]
        if not ready:
            raise ValueError(f"prerequisites of {sorted(left)} form a cycle or do not exist")
        for k in ready:
            depth[k] = 1 + max((depth[d] for d in left[k].depends_on), default=-1)
        for k in ready:
            del left[k]
    return depth


def validate(checks: dict[str, Check], categories: dict[str, int]) -> None:
    """Weights of each category sum to 100, enumerations hold, prerequisites form no cycle."""
    for c in checks.values():
        if c.weight <= 0 or c.severity not in SEVERITIES or c.confidence_class not in ("verified", "heuristic") or c.category not in categories:
            raise ValueError(f"bad check {c.check_id}")
    for name in categories:
        if (total := sum(c.weight for c in checks.values() if c.category == name)) != 100:
            raise ValueError(f"weights of {name} sum to {total}")
    levels(checks)


def read_registry(text: str, strict: bool = True) -> dict[str, Check]:
    """Checks of a JSON document: {"checks": [{"id", "category", "weight", "severity", "confidence_class", ...}]}.

    strict: ValueError on text that is no such document, on an id that occurs twice and
    on what `validate` refuses. Otherwise the first of an id stays, checks that cannot
    be read are left out, and a document that cannot be read has none.
    """
    found: dict[str, Check] = {}
    try:
        rows = json.loads(text)["checks"]
        if not isinstance(rows, list):
            raise TypeError("checks is not a list")
    except (ValueError, KeyError, TypeError) as e:
        if strict:
            raise ValueError(f"not a registry: {e}") from e
        return found
    for row in rows:
        try:
            c = Check(row["id"], row["category"], row["weight"], row["severity"], row["confidence_class"], bool(row.get("requires_language", False)), list(row.get("depends_on") or []))
            if not isinstance(c.check_id, str) or isinstance(c.weight, bool) or not isinstance(c.weight, int):
                raise TypeError(f"bad check {c.check_id!r}")
            if c.check_id in found:
                raise ValueError(f"{c.check_id} occurs twice")
            found[c.check_id] = c
        except (KeyError, TypeError, ValueError, AttributeError) as e:
            if strict:
                raise ValueError(f"bad check: {e}") from e
    if strict:
        validate(found, {c.category: 0 for c in found.values()})
    return found


validate(CHECKS, CATEGORIES)
LEVELS = levels(CHECKS)


def checks_frame(spark: SparkSession) -> DataFrame:
    """The registry as a dimension of 24 rows."""
    rows = [(c.check_id, c.category, c.weight, c.severity, c.confidence_class, c.requires_language, c.depends_on, LEVELS[c.check_id], i, CATEGORIES[c.category], c.title, c.failure_title, c.remedy) for i, c in enumerate(CHECKS.values())]
    return spark.createDataFrame(rows, "check_id string, category string, weight int, severity string, confidence_class string, requires_language boolean, depends_on array<string>, level int, place int, category_weight int, title string, failure_title string, remedy string").coalesce(1)


def checks_sql() -> str:
    """The same dimension as a VALUES list for SQL engines: check_id, category, weight, severity, class, gate, prerequisite, level, place."""
    q = lambda v: "NULL" if v is None else f"'{v}'"
    rows = [f"({q(c.check_id)}, {q(c.category)}, {c.weight}, {q(c.severity)}, {q(c.confidence_class)}, {str(c.requires_language).lower()}, {q(c.depends_on[0] if c.depends_on else None)}, {LEVELS[c.check_id]}, {i})" for i, c in enumerate(CHECKS.values())]
    return f"(VALUES {', '.join(rows)}) AS checks(check_id, category, weight, severity, confidence_class, requires_language, prerequisite, level, place)"
