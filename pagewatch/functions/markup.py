"""Fields of an HTML page, read with regular expressions that stay in the JVM.

`page_markup` removes comments and raw-text elements in one left-to-right pass;
the other functions take its result, so a job computes it once per page.
Every pattern either cannot backtrack (possessive loops) or falls back to the
end of the text, which keeps matching linear on broken and cut-off pages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewatch.functions.text import (
    decode_each,
    decode_entities,
    let,
    replace_regex,
    utf16_length,
    ws_collapse,
    ws_trim,
)
from pagewatch.functions.urls import is_any_url, is_http_url, normalize_url

# Inside a tag, up to its closing bracket; a quoted value may hold brackets.
TAG_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
TAG_END = r"(?:>|\z)"
NAME_END = r"(?=[\s/>])"
ANY_TAG = rf"<[/!?a-zA-Z]{TAG_REST}{TAG_END}"
COMMENT = r"<!--(?:>|->|.*?(?:-->|--!>|\z))"


def start_tag(name: str) -> str:
    return rf"(?is)<{name}{NAME_END}{TAG_REST}{TAG_END}"


def element(names: str) -> str:
    """An element with all it holds, to its first end tag or the end of the text."""
    return rf"<({names}){NAME_END}{TAG_REST}{TAG_END}.*?(?:</\1{NAME_END}[^>]*+{TAG_END}|\z)"


# A textarea holds text only, so what looks like a comment or a script in it stays, as group 2.
TEXTAREA = rf"<textarea{NAME_END}{TAG_REST}{TAG_END}.*?(?=</textarea{NAME_END}|\z)"
RAW_PARTS = rf"(?is){COMMENT}|{element('script|style|noscript|iframe')}|({TEXTAREA})"
TITLE = rf"{start_tag('title')}(.*?)(?:</title{NAME_END}|\z)"
H1 = rf"{start_tag('h1')}(.*?)(?=</h[1-6]{NAME_END}|<h[1-6]{NAME_END}|\z)"
ATTRIBUTE = r"""(?s)[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""


def page_markup(html: Column) -> Column:
    """The page without comments, scripts, styles, noscript and iframe elements."""
    return replace_regex(F.coalesce(html, F.lit("")), RAW_PARTS, "$2")


def strip_tags(markup: Column) -> Column:
    return replace_regex(markup, rf"(?s){ANY_TAG}")


def _outside(page: Column, name: str, may_close_itself: bool) -> Column:
    """What the outermost elements of the name don't hold, found by counting the depth from tag to tag."""
    def step(state: Column, piece: Column) -> Column:
        tag = F.regexp_extract(piece, f"(?s)^{ANY_TAG}", 0)
        opens = piece.rlike(f"(?i)^<{name}{NAME_END}")
        closes = piece.rlike(f"(?i)^</{name}{NAME_END}")
        if may_close_itself:
            # A slash that ends an unquoted value belongs to the value.
            empty = tag.endswith("/>") & ~tag.rlike(r"""=\s*+[^\s"'>]*/>\z""")
        else:
            empty = F.lit(False)
        depth = (
            F.when(opens & ~empty, state["depth"] + 1)
            .when(closes, F.greatest(state["depth"] - 1, F.lit(0)))
            .otherwise(state["depth"])
        )
        text = F.when(opens | closes, F.substr(piece, F.length(tag) + 1)).otherwise(piece)
        return let(
            depth,
            lambda d: F.struct(
                d.alias("depth"),
                F.when(d == 0, F.concat(state["kept"], F.array(text))).otherwise(state["kept"]).alias("kept"),
            ),
        )

    pieces = F.split(page, f"(?i)(?=</?{name}{NAME_END})")
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))
    return F.aggregate(pieces, start, step, lambda state: F.array_join(state["kept"], ""))


def without_element(page: Column, name: str, may_close_itself: bool = False) -> Column:
    """The page without the elements of a name and all they hold, those of the same name included.

    An element that is never closed reaches to the end. Only pages whose
    elements are nested, unclosed or close themselves have their depth counted.
    """
    def removed(text: Column) -> Column:
        tags = F.lower(F.array_join(F.regexp_extract_all(text, F.lit(f"(?i)</?{name}{NAME_END}"), 0), ""))
        paired = F.replace(tags, F.lit(f"<{name}</{name}"), F.lit("")) == ""
        if may_close_itself:
            paired = paired & ~text.rlike(rf"(?is)<{name}(?:\s[^>]*+)?(?<=/)>|<{name}/")
        flat = replace_regex(text, f"(?is){element(name)}")
        counted = _outside(text, name, may_close_itself)
        return F.when(~text.rlike(f"(?i)<{name}"), text).when(paired, flat).otherwise(counted)

    return let(page, removed)


def _literal_textareas(page: Column) -> Column:
    """Brackets inside a textarea as references, so that they aren't taken for tags."""
    def replaced(text: Column) -> Column:
        areas = F.transform(
            F.regexp_extract_all(text, F.lit(f"(?is){TEXTAREA}"), 0),
            lambda area: F.replace(
                replace_regex(area, rf"(?is)^<textarea{NAME_END}{TAG_REST}{TAG_END}"), F.lit("<"), F.lit("&lt;")
            ),
        )
        around = F.split(text, f"(?is){TEXTAREA}")
        whole = F.zip_with(around, areas, lambda before, area: F.concat(before, F.coalesce(area, F.lit(""))))
        return F.when(text.rlike("(?i)<textarea"), F.array_join(whole, "")).otherwise(text)

    return let(page, replaced)


def raw_attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one start tag as written, null if the tag lacks it.

    The tag is cut into attributes first, so a name inside another
    attribute's value is not taken for one.
    """
    found = F.try_element_at(
        F.filter(
            F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 0),
            lambda a: a.rlike(rf"(?i)^{name}\s*(?:=|\z)"),
        ),
        F.lit(1),
    )
    value = replace_regex(found, r"(?s)^[^=]*(?:=\s*|\z)")
    return replace_regex(value, r"""(?s)^(["'])(.*)\1\z""", "$2")


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of an attribute of one start tag, null if the tag lacks it."""
    return decode_entities(raw_attribute(tag, name), in_attribute=True)


def _first_tag(markup: Column, name: str, wanted) -> Column:
    tags = F.regexp_extract_all(markup, F.lit(start_tag(name)), 0)
    return F.try_element_at(F.filter(tags, wanted), F.lit(1))


def title_of(markup: Column) -> Column:
    """Text of the first title, trimmed; inner spaces stay, and so would markup inside."""
    return ws_trim(decode_entities(F.regexp_extract(markup, TITLE, 1)))


def canonical_of(markup: Column) -> Column:
    """Target of the first canonical link tag, empty if there is none or it has no target."""
    tag = _first_tag(
        markup,
        "link",
        lambda t: t.rlike("(?i)canonical") & (F.lower(raw_attribute(t, "rel")) == "canonical"),
    )
    return F.coalesce(attribute(tag, "href"), F.lit(""))


def meta_description_of(markup: Column) -> Column:
    tag = _first_tag(
        markup,
        "meta",
        lambda t: t.contains("description") & (raw_attribute(t, "name") == "description"),
    )
    return F.coalesce(attribute(tag, "content"), F.lit(""))


def h1_texts_of(markup: Column) -> Column:
    """Texts of all first-level headings in document order, trimmed."""
    headings = F.transform(F.regexp_extract_all(markup, F.lit(H1), 1), strip_tags)
    return F.transform(decode_each(headings), ws_trim)


def visible_text_of(markup: Column) -> Column:
    """Text of the body with whitespace collapsed; text nodes join without a separator.

    Images (svg) and templates are no text, with all they nest; a textarea is.
    """
    def after_head(page: Column) -> Column:
        bodies = F.split(page, start_tag("body"), 2)
        heads = F.split(page, r"(?i)</head\s*>", 2)
        return (
            F.when(F.size(bodies) == 2, F.element_at(bodies, -1))
            .when(F.size(heads) == 2, F.element_at(heads, -1))
            .otherwise(replace_regex(page, rf"(?is){element('title')}"))
        )

    def shown(page: Column) -> Column:
        kept = without_element(without_element(page, "svg", may_close_itself=True), "template")
        # Most pages have none of the three elements; one search finds that out.
        return F.when(page.rlike("(?i)<(?:svg|te(?:mplate|xtarea))"), _literal_textareas(kept)).otherwise(page)

    body = let(let(markup, shown), after_head)
    return ws_collapse(decode_entities(strip_tags(body)))


def page_title(html: Column) -> Column:
    return title_of(page_markup(html))


def canonical(html: Column) -> Column:
    return canonical_of(page_markup(html))


def meta_description(html: Column) -> Column:
    return meta_description_of(page_markup(html))


def h1_texts(html: Column) -> Column:
    return h1_texts_of(page_markup(html))


def visible_text(html: Column) -> Column:
    return visible_text_of(page_markup(html))


def has_title(title: Column, any_scheme: bool = False) -> Column:
    """A title that is not empty and not itself a URL."""
    looks_like_url = is_any_url(title) if any_scheme else is_http_url(title)
    return (title != "") & ~looks_like_url


def canonical_self_ref(canonical_url: Column, url: Column, strip_slash: bool = True) -> Column:
    """Whether both URLs have the same normal form, by default up to one final slash."""
    def href(u: Column) -> Column:
        normal = normalize_url(u)
        return replace_regex(normal, r"/\z") if strip_slash else normal

    return F.coalesce((canonical_url != "") & (href(canonical_url) == href(url)), F.lit(False))


def has_meta_description(description: Column, max_length: int | None = None) -> Column:
    present = description != ""
    return present if max_length is None else present & (utf16_length(description) <= max_length)


def has_h1(h1: Column) -> Column:
    """Exactly one first-level heading."""
    return F.size(h1) == 1


def multiple_h1s(h1: Column) -> Column:
    return F.size(h1) > 1
