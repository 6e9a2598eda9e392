"""A deterministic overlay that gives plain test pages the signals the checks look for.

One SQL expression over page_id and html, readable by Spark and by other engines.
"""

from __future__ import annotations

_HEAD = {
    0: '<meta name="description" content="A bakery in Leeds that has sold 40 kinds of bread since 1987 and ships across the country."><meta property="og:title" content="Leeds Bakery"><meta property="og:type" content="website"><meta property="og:url" content="https://leeds.example.com/"><meta name="viewport" content="width=device-width">',
    1: '<meta name="description" content="Short."><script type="application/ld+json">{"@context":"https://schema.org","@type":"Organization","name":"Northwind","url":"https://northwind.example.org","sameAs":["https://www.wikidata.org/wiki/Q1","https://facebook.com/northwind"]}</script>',
    2: '<meta name="robots" content="noindex,follow"><meta property="og:title" content="Contoso | Tools"><meta property="og:site_name" content="Contoso">',
    3: '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Dentist","@id":"#d","name":"Bright Smile","telephone":"5550100","address":"1 High Street","sameAs":["https://facebook.com/brightsmile"]},{"@type":"WebPage","name":"Home","author":{"@id":"#p"}},{"@type":"Person","@id":"#p","name":"Ann Writer"}]}</script><meta name="viewport" content="width=device-width, initial-scale=1">',
    4: '<meta name="description" content="Fabrikam rents 120 cargo bicycles by the day in three towns and repairs every brand within two days, with prices on this page."><meta property="og:site_name" content="Fabrikam"><meta property="og:type" content="website">',
    5: '<script type="application/ld+json">{ not json </script><meta name="viewport" content="">',
    6: "",
}
_BODY = {
    0: '<h2>What does delivery cost?</h2><p>Delivery costs $4 within Leeds and $9 elsewhere, and every order over $60 ships free.</p><h2>When are you open?</h2><p>The shop opens at 7 and closes at 18 on all days but Sunday, when it stays closed.</p><ul><li>Rye bread</li><li>Oat bread</li></ul>',
    1: '<img src="/a/revenue-2024.png" alt=""><img src="/a/growth-chart-12.png" alt="Revenue grew 45% to $1,200"><img src="/a/logo.svg" alt="Northwind logo"><p>We serve 4,000 teams and 120 customers in 30 countries.</p><time datetime="2024-01-01">New year</time>',
    2: '<table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table><p>Weight: 12 kg. Height: 30 cm. Power: 40 hz. Range: 90 km.</p>',
    3: '<h3>Skipped level</h3><a rel="me" href="https://mastodon.social/@bright">me</a><a href="https://www.facebook.com/sharer/sharer.php?u=https://x.example">share</a>',
    4: '<main><h2>Rates</h2><dl><dt>Day</dt><dd>20</dd><dt>Week</dt><dd>90</dd></dl></main><p>Rates rose 12% in 2023, to $1,500 for 40 users, and 30% for 25 teams.</p>',
    5: '<img src="/x/9f86d081884c7d659a2feaa0c55ad015.png" alt="x"><img src="data:image/png;base64,AAAA" alt=""><img src="/x/q3-results.png" alt="Q3 results were $2,400 against 18% costs"><img src="/x/plan-7-map.png" alt="Plan for 35% and $9,100">',
    6: "",
}


def _cases(parts: dict[int, str], before: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}{before}'" for k, v in parts.items())
    return f"CASE page_id % 7 {whens} END"


def overlay_sql(html: str = "html") -> str:
    """SQL text of the page with the overlay; contains no single quote or backslash inside its strings."""
    return f"replace(replace({html}, '</head>', {_cases(_HEAD, '</head>')}), '</article>', {_cases(_BODY, '</article>')})"
