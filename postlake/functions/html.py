"""HTML fields by JVM regular expressions."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions import variants as V
from postlake.functions.batches import pieces
from postlake.functions.entities import unescape_sql
from postlake.functions.sqltext import bind, each_sql, keep_sql, let_sql, q
from postlake.functions.text import (
    LINE_BREAK,
    WHITESPACE,
    col,
    squeeze_sql,
    strip_sql,
    title_case_words,
)

# The page shapes that are recognised.
ANCHOR = r"(?is)<a\b([^>]*?)>(.*?)</a>"
JSON_LD = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
HEADING = r"(?is)<h1[^>]*>(.*?)</h1>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
BODY = r"(?is)<body[^>]*>(.*?)</body>"
PARAGRAPH = r"(?is)<p\b[^>]*>(.*?)</p>"
DT_DD = r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>"
LABEL_VALUE_DIVS = (
    r"""(?is)<div\b[^>]*class=["'][^"']*article__content__view__field__label[^"']*["'][^>]*>(.*?)</div>"""
    r"""\s*<div\b[^>]*class=["'][^"']*article__content__view__field__value[^"']*["'][^>]*>(.*?)</div>"""
)
MORE_LOCATIONS = r"(?is)Same job available.*?(?=<section\b|<article\b|</header>|</body>)"
LOCATION_PARAGRAPH = r"""(?is)<p\b[^>]*class=["'][^"']*paragraph[^"']*["'][^>]*>(.*?)</p>"""
ARTICLE_CONTENT = (
    r"""(?is)<div\b[^>]*class=["'][^"']*article__content\b[^"']*["'][^>]*>(.*?)</div>"""
)
DATA_ROW = r"""(?is)<tr\b[^>]*class=["'][^"']*data-row[^"']*["'][^>]*>(.*?)</tr>"""
TITLE_LINK = r"""(?is)<a\b([^>]*class=["'][^"']*jobTitle-link[^"']*["'][^>]*)>(.*?)</a>"""
LOCATION_CELL = r"""(?is)<td\b[^>]*class=["'][^"']*colLocation[^"']*["'][^>]*>(.*?)</td>"""
DESCRIPTION_SPAN = r"""(?is)<span\b[^>]*class=["'][^"']*jobdescription[^"']*["'][^>]*>(.*?)</span>"""
TITLE_SPAN = r"""(?is)<span\b[^>]*itemprop=["']title["'][^>]*>(.*?)</span>"""


_ANCHOR = re.compile(ANCHOR, re.ASCII)


def matched_sql(x: str, pattern: str, group: int = 1) -> str:
    return let_sql(x, lambda t: f"if({t} rlike {q(pattern)}, regexp_extract({t}, {q(pattern)}, {group}), null)")


def matched(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Group of the first match; NULL without a match, "" for an empty group."""
    return bind(c, lambda x: matched_sql(x, pattern, group))


def strip_html_sql(x: str, drop_scripts: bool = False) -> str:
    out = x
    if drop_scripts:
        out = f"regexp_replace({out}, {q(r'(?is)<script\b.*?</script>')}, ' ')"
        out = f"regexp_replace({out}, {q(r'(?is)<style\b.*?</style>')}, ' ')"
    return squeeze_sql(unescape_sql(f"regexp_replace({out}, '<[^>]+>', ' ')"))


def strip_html(c: Column | str, drop_scripts: bool = False) -> Column:
    """Tags removed, references resolved, white space collapsed to single spaces."""
    return bind(c, lambda x: strip_html_sql(x, drop_scripts))


def _lines_sql(x: str) -> str:
    text = f"regexp_replace({x}, {q(r'(?i)<\s*br\s*/?\s*>')}, '\\n')"
    text = f"regexp_replace({text}, {q(r'(?i)</\s*(?:p|div|li|tr)\s*>')}, '\\n')"
    text = f"regexp_replace({text}, '<[^>]+>', ' ')"
    filled = keep_sql(f"split({text}, {q(LINE_BREAK)})", lambda line: f"{strip_sql(line)} <> ''")
    return f"array_join({each_sql(filled, lambda line: squeeze_sql(unescape_sql(line)))}, '\\n')"


def strip_html_lines(c: Column | str) -> Column:
    """Like `strip_html`, but line breaks and closing blocks keep their line; blank lines go."""
    return bind(c, _lines_sql)


def attribute_sql(attrs: str, name: str) -> str:
    pattern = rf"""(?i){name}\s*=\s*["']([^"']+)["']"""
    return strip_sql(unescape_sql(f"nullif(regexp_extract({attrs}, {q(pattern)}, 1), '')"))


def attribute(attrs: Column | str, name: str) -> Column:
    """Attribute value, unescaped and trimmed; NULL when absent."""
    return bind(attrs, lambda a: attribute_sql(a, name))


def quoted_attribute_sql(attrs: str, name: str) -> str:
    return unescape_sql(matched_sql(attrs, rf"""(?is){name}\s*=\s*(["'])(.*?)\1""", 2))


def quoted_attribute(attrs: Column | str, name: str) -> Column:
    """Attribute value between matching quotes, unescaped; NULL when absent."""
    return bind(attrs, lambda a: quoted_attribute_sql(a, name))


def links_sql(html: str) -> str:
    return each_sql(
        f"regexp_extract_all({html}, {q(ANCHOR)}, 0)",
        lambda m: f"named_struct('attrs', regexp_extract({m}, {q(ANCHOR)}, 1),"
        f" 'inner', regexp_extract({m}, {q(ANCHOR)}, 2))",
    )


def links(html: Column | str) -> Column:
    """ARRAY<STRUCT<attrs, inner>> of the anchors in document order, from one pass over the page."""
    return bind(html, links_sql)


_LINK = T.StructType([T.StructField("attrs", T.StringType()), T.StructField("inner", T.StringType()), T.StructField("article", T.IntegerType())])
_LINKED = T.StructType([T.StructField("links", T.ArrayType(_LINK)), T.StructField("articles", T.ArrayType(T.StringType()))])


def _linked(pages: pd.Series) -> pd.DataFrame:
    found: dict[str, list] = {"links": [], "articles": []}
    for page in pages:
        links: list[dict] = []
        articles: dict[tuple[int, int], int] = {}
        if page is not None:
            opens = [m.end() for m in re.finditer("<article", page)]
            closes = [m.start() for m in re.finditer("</article>", page)]
            for m in _ANCHOR.finditer(page):
                o, c = bisect_right(opens, m.start()) - 1, bisect_left(closes, m.end())
                around = o >= 0 and c < len(closes)
                number = articles.setdefault((o, c), len(articles)) if around else -1
                links.append({"attrs": m[1], "inner": m[2], "article": number})
        found["links"].append(links)
        found["articles"].append([page[opens[o] - len("<article") : closes[c] + len("</article>")] for o, c in articles])
    return pd.DataFrame(found)


@F.pandas_udf(_LINKED)
def linked_articles(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The anchors of each page, and the articles around them: a link's `article` is its number, -1 for none.

    A link's article reaches from the last `<article` that begins before it to the first `</article>` after it. All
    places come from one pass over the page and are looked up by bisection; an article is cut out once for all its
    links. The links of a few pages are held at a time, not those of a whole Arrow batch.
    """
    return (_linked(piece) for batch in pages for piece in pieces(batch))


def article_footer_sql(article: str, icon_class: str) -> str:
    marked = keep_sql(
        f"regexp_extract_all({article}, {q(PARAGRAPH)}, 1)", lambda p: f"contains({p}, {q(icon_class)})"
    )
    return strip_html_sql(f"try_element_at({marked}, 1)", drop_scripts=True)


def article_footer(article: Column | str, icon_class: str) -> Column:
    """Text of the first paragraph that carries an icon class."""
    return bind(article, lambda a: article_footer_sql(a, icon_class))


def article_content_sql(article: str) -> str:
    return strip_html_sql(matched_sql(article, ARTICLE_CONTENT), drop_scripts=True)


def article_content(article: Column | str) -> Column:
    return bind(article, article_content_sql)


def meta_content_sql(html: str, name: str) -> str:
    key = rf"""(?:name|property)=["']{re.escape(name)}["']"""
    content = r"""content=["']([^"']+)["']"""
    by_key = q(rf"(?is)<meta[^>]+{key}[^>]+{content}")
    by_content = q(rf"(?is)<meta[^>]+{content}[^>]+{key}")
    found = (
        f"coalesce(nullif(regexp_extract({html}, {by_key}, 1), ''),"
        f" nullif(regexp_extract({html}, {by_content}, 1), ''))"
    )
    return strip_sql(unescape_sql(found))


def meta_content(html: Column | str, name: str) -> Column:
    """Content of a meta tag by name or property, either attribute order."""
    return bind(html, lambda h: meta_content_sql(h, name))


def heading(html: Column | str, drop_scripts: bool = True) -> Column:
    return bind(html, lambda h: strip_html_sql(matched_sql(h, HEADING), drop_scripts))


def page_title(html: Column | str) -> Column:
    return bind(html, lambda h: strip_html_sql(matched_sql(h, TITLE), drop_scripts=True))


def page_description(html: Column | str) -> Column:
    """Meta description, else the text of the whole body."""
    return bind(
        html,
        lambda h: f"coalesce({strip_html_sql(f'''nullif({meta_content_sql(h, 'description')}, '')''', True)},"
        f" {strip_html_sql(matched_sql(h, BODY), True)})",
    )


def expanded_locations(html: Column | str) -> Column:
    """Location paragraphs of a "Same job available" block, joined."""

    def joined(h: str) -> str:
        paragraphs = f"regexp_extract_all({matched_sql(h, MORE_LOCATIONS, 0)}, {q(LOCATION_PARAGRAPH)}, 1)"
        places = each_sql(paragraphs, lambda p: strip_html_sql(p, drop_scripts=True))
        return f"nullif(array_join(filter({places}, x -> x <> ''), '; '), '')"

    return bind(html, joined)


def label_pairs(html: Column | str, pattern: str) -> Column:
    """ARRAY<STRUCT<label, value>> of a two-group pattern; labels lower-case, both as plain text."""

    def part(m: str, group: int) -> str:
        return strip_html_sql(f"regexp_extract({m}, {q(pattern)}, {group})", drop_scripts=True)

    return bind(
        html,
        lambda h: each_sql(
            f"regexp_extract_all({h}, {q(pattern)}, 0)",
            lambda m: f"named_struct('label', lower({part(m, 1)}), 'value', {part(m, 2)})",
        ),
    )


def labelled_field(
    definitions: Column | str, divisions: Column | str, plain: Column | str, labels: list[str]
) -> Column:
    """Value of the first matching label.

    `definitions` and `divisions` are `label_pairs` of the page, `plain` its text. A matching pair
    decides at once, even with a blank value; only pages without one are searched for `Label: value`.
    """
    wanted = ", ".join(q(label) for label in labels)

    def inline(x: str, label: str) -> str:
        pattern = rf"(?iU)\b{re.escape(label)}\b\s*:\s+([^|•]+)"
        return f"nullif(regexp_extract({x}.t, {q(pattern)}, 1), '')"

    def pick(x: str) -> str:
        hits = f"filter(if(exists({x}.d, p -> p.label in ({wanted})), {x}.d, {x}.v), p -> p.label in ({wanted}))"
        written = strip_sql(f"coalesce({', '.join(inline(x, label) for label in labels)})")
        value = let_sql(hits, lambda h: f"if(size({h}) > 0, try_element_at({h}, 1).value, {written})")
        return f"nullif({value}, '')"

    inputs = F.struct(col(definitions).alias("d"), col(divisions).alias("v"), col(plain).alias("t"))
    return bind(inputs, pick)


def line_field(text: Column | str, label: str) -> Column:
    """Value of the first line `Label: value`."""
    pattern = q(rf"^{re.escape(label)}:[{WHITESPACE}]*(.+)$")

    def pick(x: str) -> str:
        lines = each_sql(f"split({x}, {q(LINE_BREAK)})", strip_sql)
        first = f"try_element_at({keep_sql(lines, lambda line: f'{line} rlike {pattern}')}, 1)"
        return f"nullif({strip_sql(f'regexp_extract({first}, {pattern}, 1)')}, '')"

    return bind(text, pick)


def _level_sql(value: str) -> str:
    """A JobPosting as it is, a list or `@graph` as its elements, anything else as nothing."""
    kind = V.sub_sql(value, "@type")
    is_posting = let_sql(
        kind,
        lambda k: f"coalesce(array_contains(try_variant_get({k}, '$', 'array<string>'), 'JobPosting'),"
        f" try_variant_get({k}, '$', 'string') = 'JobPosting', false)",
    )
    none = "cast(array() as array<variant>)"
    nested = f"coalesce({V.items_sql(value)}, {V.items_sql(value, '@graph')}, {none})"
    return f"if({is_posting}, array({value}), {nested})"


def json_ld_posting(html: Column | str) -> Column:
    """First JobPosting object of a page as VARIANT; scripts with broken JSON are passed over.

    Lists are opened level by level, in document order, as often as the script has brackets; so
    postings are found at any depth.
    """

    def opened(script: str) -> str:
        brackets = f"length({script}) - length(replace({script}, '[', ''))"
        parsed = f"try_parse_json({strip_sql(unescape_sql(script))})"
        levels = each_sql("acc", _level_sql)
        return f"aggregate(sequence(0, {brackets}), array({parsed}), (acc, i) -> flatten({levels}))"

    def pick(h: str) -> str:
        scripts = f"regexp_extract_all({h}, {q(JSON_LD)}, 1)"
        return f"try_element_at(flatten({each_sql(scripts, opened)}), 1)"

    return bind(html, pick)


def _country_sql(v: str) -> str:
    return let_sql(
        v, lambda c: f"if(startswith(to_json({c}), '{{'), {V.text_sql(c, 'name')}, {V.text_sql(c)})"
    )


def _place_sql(place: str, street_fallback: bool) -> str:
    def address_text(a: str) -> str:
        composed = (
            f"nullif(concat_ws(', ', {V.text_sql(a, 'addressLocality')}, {V.text_sql(a, 'addressRegion')},"
            f" {_country_sql(V.sub_sql(a, 'addressCountry'))}), '')"
        )
        if street_fallback:
            composed = f"coalesce({composed}, {V.text_sql(a, 'streetAddress')})"
        return f"if(startswith(to_json({a}), '{{'), {composed}, null)"

    address = let_sql(V.sub_sql(place, "address"), address_text)
    return f"if(startswith(to_json({place}), '{{'), {address}, {V.text_sql(place)})"


def json_ld_location(v: Column | str, street_fallback: bool = False) -> Column:
    """Place or list of places as text, places joined by "; "."""

    def pick(x: str) -> str:
        listed = each_sql(V.items_sql(x), lambda place: _place_sql(place, street_fallback))
        joined = f"nullif(array_join(filter({listed}, t -> t <> ''), '; '), '')"
        return f"if(startswith(to_json({x}), '['), {joined}, {_place_sql(x, street_fallback)})"

    return bind(v, pick)


def json_ld_employment(v: Column | str) -> Column:
    """Employment type: list joined by ", ", a single constant in title case."""
    listed = bind(
        v,
        lambda x: f"if(startswith(to_json({x}), '['), array_join(filter({each_sql(V.items_sql(x), V.text_sql)},"
        " t -> t is not null), ', '), null)",
    )
    single = bind(v, lambda x: f"if(startswith(to_json({x}), '['), null, {V.text_sql(x)})")
    return F.coalesce(listed, title_case_words(single))


def json_ld_identifier(v: Column | str) -> Column:
    """Identifier text, or the value, name or @id of an identifier object."""
    return bind(
        v,
        lambda x: f"if(startswith(to_json({x}), '{{'), {V.first_text_sql(x, 'value', 'name', '@id')}, {V.text_sql(x)})",
    )
