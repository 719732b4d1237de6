"""Navigation links of a page and the differences between two link lists.

One page's links come from one row, so everything here works inside that row:
no join and no shuffle. The list functions sort, then look at neighbours,
which keeps them at n log n however long a menu is.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewatch.functions.markup import (
    ANY_TAG,
    NAME_END,
    TAG_END,
    TAG_REST,
    attribute,
    page_markup,
    raw_attribute,
    start_tag,
    strip_tags,
)
from pagewatch.functions.text import decode_entities, let, ws_collapse
from pagewatch.functions.urls import is_home_page, url_host

NavRules = Sequence[tuple[str, str]]

# Rules are (part of the host name, selector); the first that fits a page counts
# and the empty part fits every host.
DEFAULT_NAV_RULES: NavRules = (("", "#navigation"),)

LINK_TYPE = "array<struct<url:string,text:string>>"
LINK_CHANGE_TYPE = "array<struct<url:string,text:string,old_text:string,new_text:string>>"
ANCHOR = rf"{start_tag('a')}(.*?)(?=</a{NAME_END}|<a{NAME_END}|\z)"
SELECTOR = re.compile(r"^([A-Za-z][A-Za-z0-9]*)?(?:([.#])([A-Za-z0-9_-]+))?$")


def _selector_parts(selector: str) -> tuple[str | None, str | None, str | None]:
    match = SELECTOR.match(selector)
    if not selector or match is None:
        raise ValueError(f"selector must be tag, .class, #id or a tag with one of them: {selector!r}")
    return match.group(1), match.group(2), match.group(3)


def _opens_container(tag: Column, kind: str | None, name: str | None) -> Column:
    """Whether a start tag carries the id or class of the selector."""
    if kind is None:
        return F.lit(True)
    if kind == "#":
        return F.coalesce(raw_attribute(tag, "id") == name, F.lit(False))
    return F.coalesce(
        raw_attribute(tag, "class").rlike(rf"(?:^|\s){re.escape(name)}(?:\s|\z)"), F.lit(False)
    )


def _container_tag_name(markup: Column, kind: str | None, name: str | None) -> Column:
    """Element name of the first tag with the selector's id or class."""
    tags = F.regexp_extract_all(markup, F.lit(rf"(?s)<[a-zA-Z]{TAG_REST}{TAG_END}"), 0)
    first = F.try_element_at(
        F.filter(tags, lambda t: t.contains(name) & _opens_container(t, kind, name)), F.lit(1)
    )
    return F.lower(F.regexp_extract(first, r"^<([a-zA-Z][a-zA-Z0-9]*)", 1))


def nav_container(markup: Column, selector: str) -> Column:
    """Inner markup of all elements the selector picks, nested ones of the same name included.

    The markup is cut before each start and end tag of the container's name; a
    running depth over those pieces finds where each container ends. A bare
    class or id selector takes the element name from its first match.
    """
    tag_name, kind, name = _selector_parts(selector)

    def inner(markup: Column, element_name: Column) -> Column:
        cut = F.concat(F.lit("(?i)(?=</?"), element_name, F.lit(r"[\s/>])"))
        return let(F.split(markup, cut), lambda pieces: _inside(pieces, element_name))

    def _inside(pieces: Column, element_name: Column) -> Column:
        def step(state: Column, piece: Column) -> Column:
            head = F.lower(F.substring(piece, 1, 2))
            named = F.lower(piece).startswith(F.concat(F.lit("<"), element_name))
            closes = F.lower(piece).startswith(F.concat(F.lit("</"), element_name))
            opens = named & (head != "</")
            starts = opens & _opens_container(
                F.regexp_extract(piece, rf"(?s)^{ANY_TAG}", 0), kind, name
            )
            depth = (
                F.when(state.depth == 0, F.when(starts, 1).otherwise(0))
                .when(opens, state.depth + 1)
                .when(closes, state.depth - 1)
                .otherwise(state.depth)
            )
            ended = (state.depth == 1) & (depth == 0)
            span = F.struct(
                state.start.alias("start"), (state.i - state.start).alias("length")
            )
            return F.struct(
                (state.i + 1).alias("i"),
                depth.alias("depth"),
                F.when((state.depth == 0) & (depth == 1), state.i)
                .otherwise(state.start)
                .alias("start"),
                F.when(ended, F.concat(state.spans, F.array(span)))
                .otherwise(state.spans)
                .alias("spans"),
            )

        start = F.expr(
            "named_struct('i', 1, 'depth', 0, 'start', 0,"
            " 'spans', cast(array() as array<struct<start:int,length:int>>))"
        )

        def spans(state: Column) -> Column:
            open_span = F.struct(
                state.start.alias("start"), (state.i - state.start).alias("length")
            )
            return F.when(state.depth > 0, F.concat(state.spans, F.array(open_span))).otherwise(
                state.spans
            )

        parts = F.transform(
            F.aggregate(pieces, start, step, spans),
            lambda s: F.array_join(F.slice(pieces, s.start, s.length), ""),
        )
        return F.array_join(parts, "")

    if tag_name is not None:
        return inner(markup, F.lit(tag_name.lower()))
    return let(
        _container_tag_name(markup, kind, name),
        lambda found: F.when(found != "", inner(markup, found)).otherwise(F.lit("")),
    )


def nav_links_of(
    markup: Column,
    url: Column,
    rules: NavRules = DEFAULT_NAV_RULES,
    homepage_only: bool = True,
) -> Column:
    """Same-host links of the navigation, in document order, as url and text."""
    def on_host(host: Column) -> Column:
        container = None
        for host_part, selector in rules:
            picked = nav_container(markup, selector)
            container = (F if container is None else container).when(
                host.contains(host_part), picked
            )
        anchors = F.regexp_extract_all(container, F.lit(ANCHOR), 0)
        wanted = host.isNotNull() & is_home_page(url) if homepage_only else host.isNotNull()
        return F.when(wanted, let(anchors, lambda found: _links_in(found, host)))

    return F.coalesce(let(url_host(url), on_host), F.array().cast(LINK_TYPE))


def _links_in(anchors: Column, host: Column) -> Column:
    hrefs = F.transform(
        anchors,
        lambda a: attribute(F.regexp_extract(a, rf"(?s)^{ANY_TAG}", 0), "href"),
    )
    texts = F.transform(anchors, lambda a: ws_collapse(decode_entities(strip_tags(a))))

    def link(href: Column, text: Column) -> Column:
        absolute = href.startswith("http://") | href.startswith("https://")
        target = F.when(absolute, F.when(url_host(href) == host, href)).when(
            href.startswith("/"), F.concat(F.lit("https://"), host, href)
        )
        return F.struct(target.alias("url"), text.alias("text"))

    linked = F.zip_with(hrefs, texts, link)
    return F.filter(linked, lambda x: x.url.isNotNull() & (x.text != ""))


def nav_links(
    html: Column,
    url: Column,
    rules: NavRules = DEFAULT_NAV_RULES,
    homepage_only: bool = True,
) -> Column:
    return let(page_markup(html), lambda m: nav_links_of(m, url, rules, homepage_only))


def nav_map(links: Column) -> Column:
    """Each address once: at the place of its first link, with the text of its last."""
    def numbered(link: Column, i: Column) -> Column:
        return F.struct(link.url.alias("url"), i.alias("pos"), link.text.alias("text"))

    def unique(entries: Column) -> Column:
        firsts = F.filter(
            entries, lambda e, i: (i == 0) | (F.get(entries, i - 1).url != e.url)
        )
        lasts = F.filter(
            entries,
            lambda e, i: (i == F.size(entries) - 1) | (F.get(entries, i + 1).url != e.url),
        )
        joined = F.zip_with(
            firsts,
            lasts,
            lambda f, l: F.struct(f.pos.alias("pos"), f.url.alias("url"), l.text.alias("text")),
        )
        return F.transform(
            F.sort_array(joined),
            lambda e: F.struct(e.url.alias("url"), e.text.alias("text")),
        )

    return let(F.sort_array(F.transform(links, numbered)), unique)


def _by_address(old: Column, new: Column) -> Column:
    """Links of both sides sorted by address, so that the two sides of an address are neighbours."""
    def numbered(side: int):
        return lambda link, i: F.struct(
            link.url.alias("url"),
            F.lit(side).alias("side"),
            i.alias("pos"),
            link.text.alias("text"),
        )

    return F.sort_array(
        F.concat(
            F.transform(nav_map(old), numbered(0)), F.transform(nav_map(new), numbered(1))
        )
    )


def link_changes(old: Column, new: Column) -> Column:
    """Struct of the removed, added and text_changed links between two link lists."""
    def changed(entries: Column) -> Column:
        def record(text, old_text, new_text):
            def build(e: Column, other: Column) -> Column:
                values = {"own": e.text, "other": other.text, None: F.lit(None).cast("string")}
                return F.struct(
                    e.pos.alias("pos"),
                    e.url.alias("url"),
                    values[text].alias("text"),
                    values[old_text].alias("old_text"),
                    values[new_text].alias("new_text"),
                )

            return build

        def ordered(picked: Column) -> Column:
            kept = F.filter(picked, lambda e: e.isNotNull())
            return F.transform(
                F.sort_array(kept),
                lambda e: F.struct(
                    e.url.alias("url"),
                    e.text.alias("text"),
                    e.old_text.alias("old_text"),
                    e.new_text.alias("new_text"),
                ),
            )

        only = record("own", None, None)
        both = record(None, "other", "own")

        def removed(e: Column, i: Column) -> Column:
            following = F.get(entries, i + 1)
            alone = F.coalesce(following.url != e.url, F.lit(True))
            return F.when((e.side == 0) & alone, only(e, e))

        def added(e: Column, i: Column) -> Column:
            before = F.get(entries, i - 1)
            alone = F.coalesce(before.url != e.url, F.lit(True))
            return F.when((e.side == 1) & alone, only(e, e))

        def retitled(e: Column, i: Column) -> Column:
            before = F.get(entries, i - 1)
            return F.when(
                (e.side == 1) & (before.url == e.url) & (before.text != e.text), both(e, before)
            )

        return F.struct(
            ordered(F.transform(entries, removed)).alias("removed"),
            ordered(F.transform(entries, added)).alias("added"),
            ordered(F.transform(entries, retitled)).alias("text_changed"),
        )

    return let(_by_address(old, new), changed)
