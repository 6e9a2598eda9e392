"""Text functions as column expressions. `(?U)` gives \\s, \\w and \\b their Unicode meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches must equal the published semantics.
LANG = r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3}(?:-[A-Za-z0-9]+)*)(?=[\"'\s/>]|$)"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
META_ROBOTS = r"(?is)<meta[^>]+name\s*=\s*[\"']robots[\"'][^>]+content\s*=\s*[\"']([^\"']*)[\"']"
QUANTITY = r"(?:[$£€¥]\s?\d[\d,.]*|\d[\d,.]*\s?%|\b\d{1,3}(?:,\d{3})+\b)"
UNITS = "kg|km|mb|gb|tb|hz|ms|mm|cm|ft|lb|oz|ml|hrs?|hours?|mins?|minutes?|seconds?|days?|weeks?|months?|years?|users?|customers?|clients?|teams?|members?|countries|locations?|stores?|seats?|projects?|employees?|people|times"
CLAIM = rf"(?i){QUANTITY}|(?:\b\d[\d,.]*\s?(?:{UNITS})\b)"
SPEC = r"(?i)(?:\b[\w][\w \-/]{2,30}:\s*(?!//)\S)|(?:\d[\d,.]*\s?(?:%|[$£€¥]|kg|km|mb|gb|tb|hz|ms|mm|cm|m|ft|lb|oz|l|ml|hrs?|hours?|mins?|minutes?|days?|weeks?|months?|years?|users?|customers?|clients?|countries|locations?|seats?))"
NAME_SPLIT = r"\s*[|·–—•»«:/\-‐]\s*|\s+[-–]\s+"
ANCHOR_NUMBER = r"(?U)[$£€¥]\s?\d|\d[\d,.]*\s?%|\b\d[\d,.]*\s?[a-zA-Z]{1,12}\b"
NAME_TOKEN = r"[A-Za-z][A-Za-z'’\-]*|[.!?]"
FINGERPRINTS = [r"(?i)%[0-9a-f]{2}", r"(?i)[0-9a-f]{12,}", r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"]
SHORT_NUMBER, WORDY = r"(?<![0-9a-fA-F])\d{1,4}(?![0-9a-fA-F])", r"[A-Za-z]{3,}"
BLOCK_MARKERS = {
    "consent_wall": ["cookie consent", "we use cookies", "accept all cookies", "gdpr", "manage preferences", "cookiebot", "onetrust", "consent-manager"],
    "bot_challenge": ["checking your browser", "cf-browser-verification", "just a moment", "ddos protection", "enable javascript and cookies to continue", "verifying you are human"],
    "captcha": ["recaptcha", "hcaptcha", "captcha-delivery", "g-recaptcha"],
    "login_wall": ["please sign in to continue", "log in to view", "members only", "sign in to read"],
}
SPA_MARKERS = ["__NEXT_DATA__", "window.__NUXT__", "ng-version", "data-server-rendered", "__remixContext", "__sveltekit", "window.__INITIAL_STATE__", "data-vue-meta"]
SPA_MOUNTS = ["root", "app", "__next", "__nuxt"]
SCRIPT_TO_TEXT = 3.0


def sql_text(value: str) -> str:
    """A string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lit_rows(rows: list[dict]) -> Column:
    """Rows as one literal array of structs, which the optimizer folds."""
    value = lambda v: "cast(NULL AS string)" if v is None else str(v).lower() if isinstance(v, bool) else sql_text(v) if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else f"cast(array({', '.join(map(str, v))}) AS array<int>)" if isinstance(v, list) else str(v)
    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {value(v)}" for k, v in r.items()) + ")" for r in rows) + ")")


def lit_array(values: list[str]) -> Column:
    """An array of strings, as one expression: plans are built faster than from a literal each."""
    return F.expr(f"array({', '.join(map(sql_text, values))})") if values else F.expr("cast(array() AS array<string>)")


def visible_text(html: Column) -> Column:
    """Text of raw HTML: comments, scripts, styles and tags out, white space collapsed."""
    x = F.coalesce(html, F.lit(""))
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script\b[^>]*>.*?</script>", r"(?is)<style\b[^>]*>.*?</style>", r"(?s)<[^>]+>"):
        x = F.regexp_replace(x, pattern, " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def sanitize(text: Column, limit: int = 300) -> Column:
    """Without control characters, white space collapsed, cut at limit with an ellipsis."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x09\x0B-\x1F]", "")
    x = F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    return F.when(F.length(x) > limit, F.concat(F.substr(x, F.lit(1), F.lit(limit)), F.lit("…"))).otherwise(x)


def split_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def is_quotable(sentence: Column, openers: list[str], min_chars=40, max_chars=300, min_words=6) -> Column:
    """Long enough, enough words, no dangling opener, a digit or a name inside."""
    words = F.split(F.trim(sentence), r"(?U)\s+")
    first = F.lower(F.regexp_replace(F.element_at(words, 1), r"^[,.:;]+|[,.:;]+$", ""))
    named = sentence.rlike(r"\d") | sentence.rlike(r"(?<!^)(?<![.!?]\s)\b[A-Z][a-z]{2,}")
    return F.length(sentence).between(min_chars, max_chars) & (F.size(words) >= min_words) & ~(first.isin(openers) if openers else F.lit(False)) & named


def has_proper_noun(text: Column) -> Column:
    """A word of three characters or more, capital first and no other, whose predecessor in the sentence begins in lower case.

    A word goes on through apostrophes and hyphens, so a capital after a hyphen makes it none.
    """
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({NAME_TOKEN})"), F.lit(1))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.coalesce(F.exists(pairs, lambda p: (F.length(p["b"]) >= 3) & p["b"].rlike(r"^[A-Z]['’\-]*[a-z][a-z'’\-]*$") & p["a"].rlike("^[a-z]")), F.lit(False))


def normalize_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[\W_]+", "")


def name_segments(name: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(name, F.lit("")), rf"(?U){NAME_SPLIT}"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: normalize_name(p) != "")


def name_forms(name: Column) -> Column:
    """The normalised name and its normalised segments."""
    return F.array_distinct(F.filter(F.concat(F.transform(name_segments(name), normalize_name), F.array(normalize_name(name))), lambda x: x != ""))


def names_agree(a: Column, b: Column) -> Column:
    """Some form of one contains some form of the other."""
    return F.exists(name_forms(a), lambda x: F.exists(name_forms(b), lambda y: F.contains(x, y) | F.contains(y, x)))


def detect_language(html: Column) -> Column:
    found = F.lower(F.regexp_extract(F.substr(F.coalesce(html, F.lit("")), F.lit(1), F.lit(4000)), LANG, 1))
    return F.when(found != "", found)


def language_supported(tag: Column, languages: list[str]) -> Column:
    return F.coalesce(F.split_part(F.lower(tag), F.lit("-"), F.lit(1)).isin(languages), F.lit(False))


def meta_robots(html: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(F.substr(F.coalesce(html, F.lit("")), F.lit(1), F.lit(20000)), META_ROBOTS, 1)))


def title_of(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), TITLE, 1), r"(?U)\s+", " "))


def detect_blocked_kind(html: Column, status: Column) -> Column:
    """401 and 403 first; then the kinds in order, each only on a short page or if it never stands on a full one."""
    low, short = F.lower(F.coalesce(html, F.lit(""))), F.length(visible_text(html)) < 1500
    out = F.when(status == 401, "login_wall").when(status == 403, "bot_challenge")
    for kind, markers in BLOCK_MARKERS.items():
        hit = F.exists(lit_array(markers), lambda m: F.contains(low, m))
        out = out.when(hit if kind in ("bot_challenge", "captcha") else hit & short, kind)
    return out


def framework_markers(html: Column) -> Column:
    return F.filter(lit_array(SPA_MARKERS), lambda m: F.contains(F.coalesce(html, F.lit("")), m))


def empty_mount(html: Column, with_data: bool = False) -> Column:
    """The first known mount element without content, by id (or, if asked, by data attribute)."""
    x = F.coalesce(html, F.lit(""))
    cases = None
    for name in SPA_MOUNTS:
        key = "(?:id|data-[\\w-]+)" if with_data else "id"
        hit = x.rlike(rf"(?is)<(\w+)[^>]*\b{key}\s*=\s*[\"']?{name}[\"']?[^>]*>\s*</\1\s*>")
        cases = F.when(hit, f"#{name}") if cases is None else cases.when(hit, f"#{name}")
    return cases


def script_bytes(html: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)(<script\b[^>]*>.*?</script>)"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda s, x: s + F.length(x))


def spa_signals(html: Column) -> Column:
    """Struct of what suggests that a page is rendered by the client."""
    text, size = F.length(visible_text(html)).cast("long"), script_bytes(html)
    ratio = F.when(text > 0, size / text)
    markers, mount = framework_markers(html), empty_mount(html, True)
    over = F.when(text > 0, ratio > SCRIPT_TO_TEXT).otherwise(size > 0)
    noscript = F.lower(html).rlike(r"(?s)<noscript[^>]*>.{0,400}javascript")
    return F.struct(
        text.alias("visible_text_chars"), size.alias("script_bytes"), ratio.alias("script_to_text_ratio"), over.alias("script_to_text_exceeds_threshold"),
        markers.alias("framework_markers"), mount.alias("empty_mount_node"), noscript.alias("has_noscript_warning"),
        (mount.isNotNull() | ((F.size(markers) > 0) & over)).alias("client_rendered_likely"),
    )


def asset_filename(src: Column) -> Column:
    """Last path segment; empty for data: and blob:."""
    s = F.coalesce(F.trim(src), F.lit(""))
    path = F.regexp_replace(F.regexp_replace(s, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*", "")
    return F.when(F.lower(s).rlike("^(data|blob):"), "").otherwise(F.regexp_extract(path, r"([^/]*)$", 1))


def looks_like_data_filename(name: Column) -> Column:
    """A short number beside a word, and no fingerprint."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    encoded, digest, uuid = FINGERPRINTS
    bad = name.rlike(encoded) | (stem == "") | stem.rlike(r"^\d+$") | stem.rlike(digest) | stem.rlike(uuid)
    return ~bad & stem.rlike(SHORT_NUMBER) & stem.rlike(WORDY)


def dimension(value: Column) -> Column:
    """Declared pixels as a whole number, or null; trailing p and x characters do not count."""
    return F.floor(F.regexp_replace(F.trim(value), r"[px]+$", "").try_cast("double")).cast("int")


def declared_smaller(width: Column, height: Column, px: int) -> Column:
    return F.coalesce(dimension(width) < px, F.lit(False)) | F.coalesce(dimension(height) < px, F.lit(False))


def normalise_number(token: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(token, F.lit("")), r"[^\d]", "")
    short = F.regexp_replace(digits, "^0+", "")
    return F.when(short == "", digits).otherwise(short)


def opengraph(metas: Column) -> Column:
    """Open Graph properties of a page; the last of a name wins."""
    rows = F.filter(F.transform(metas, lambda m: F.struct(F.lower(F.coalesce(F.when(m["property"] != "", m["property"]), m["name"], F.lit(""))).alias("k"), F.trim(F.coalesce(m["content"], F.lit(""))).alias("v"), F.coalesce(m["content"], F.lit("")).alias("raw"))), lambda m: m["k"].startswith("og:") & (m["raw"] != ""))
    last = F.filter(rows, lambda m, i: ~F.exists(F.slice(rows, i + 2, F.greatest(F.size(rows) - i - 1, F.lit(0))), lambda n: n["k"] == m["k"]))
    return F.map_from_entries(F.transform(last, lambda m: F.struct(m["k"], m["v"])))


def meta_content(metas: Column, attribute: str, name: str) -> Column:
    """Trimmed content of the first meta element of that name; empty if there is none."""
    hits = F.filter(metas, lambda m: F.lower(m[attribute]) == name)
    return F.coalesce(F.trim(F.get(hits, F.lit(0))["content"]), F.lit(""))


def content_type_matches(value: Column, allowed: list[str]) -> Column:
    return F.coalesce(F.lower(F.trim(F.split_part(value, F.lit(";"), F.lit(1)))).isin([a.lower() for a in allowed]), F.lit(False))


def undecodable_encodings(header: Column, decodable: tuple = ("gzip", "x-gzip", "deflate", "identity")) -> Column:
    parts = F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return F.filter(parts, lambda x: (x != "") & ~x.isin(list(decodable)))


def redact_headers(headers: Column, secret: tuple = ("authorization", "cookie", "set-cookie", "proxy-authorization")) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(list(secret)), "[REDACTED]").otherwise(v))


def fill(template: Column, values: Column) -> Column:
    """A template with {{KEY}} replaced, in one pass, where values has the key; other placeholders stay.

    Pieces between placeholders and the placeholders' values are joined anew, so a
    value that holds a placeholder is not filled again.
    """
    pieces = F.split(template, r"\{\{[A-Z0-9_]+\}\}")
    keys = F.regexp_extract_all(template, F.lit(r"\{\{([A-Z0-9_]+)\}\}"), F.lit(1))
    filled = F.transform(keys, lambda k: F.coalesce(F.when(F.element_at(values, k) != "", F.element_at(values, k)), F.concat(F.lit("{{"), k, F.lit("}}"))))
    out = F.array_join(F.flatten(F.zip_with(pieces, filled, lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")
    return F.when(F.length(out) > 4000, F.concat(F.substr(out, F.lit(1), F.lit(4000)), F.lit("\n<!-- snippet truncated -->"))).otherwise(out)


def placeholders_left(template: Column, values: Column) -> Column:
    keys = F.regexp_extract_all(F.coalesce(template, F.lit("")), F.lit(r"\{\{([A-Z0-9_]+)\}\}"), F.lit(1))
    open_keys = F.filter(keys, lambda k: F.coalesce(F.element_at(values, k), F.lit("")) == "")
    return F.array_distinct(F.transform(open_keys, lambda k: F.concat(F.lit("{{"), k, F.lit("}}"))))


def is_blank_document(html: Column) -> Column:
    """Fewer than 200 characters, or neither text nor a body."""
    x = F.coalesce(html, F.lit(""))
    return (F.length(x) < 200) | ((visible_text(x) == "") & ~F.contains(F.lower(x), F.lit("<body")))


def is_nav_timeout(message: Column) -> Column:
    """An error message of a navigation that ran out of time."""
    return F.coalesce(F.lower(message).rlike("time(d )?out"), F.lit(False))


def utc_stamp(at: Column) -> Column:
    """RFC 3339 text in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def user_agent(base: str, contact: str = "") -> str:
    return f"{base} (+{contact})" if contact else base
