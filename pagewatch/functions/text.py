"""String helpers with the trimming, length and rounding rules web pages are audited under.

All of them are Column expressions that stay in the JVM. Lengths count UTF-16
units and whitespace is the JavaScript set, because the audit thresholds
(60, 160, 1000, 20 %) are defined in those terms.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters JavaScript treats as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS_MEMBERS = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
# Printable ASCII is ruled out by one range test before the members are tried.
WS_CLASS = f"[[^!-~]&&[{WS_MEMBERS}]]"
WS_BUT_SPACE = f"[[^ -~]&&[{WS_MEMBERS}]]"

# Entities that are frequent enough to be replaced before the general pass.
COMMON_ENTITIES = {
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "nbsp": "\u00a0",
    "copy": "©",
    "middot": "·",
}

# HTML reads the numeric references 128-159 as Windows-1252.
C1_CONTROLS = (
    "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e"
    "\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
)
C1_AS_CP1252 = (
    "€‚ƒ„…†‡ˆ‰Š‹ŒŽ"
    "‘’“”•–—˜™š›œžŸ"
)


def replace_regex(col: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(col, F.lit(pattern), F.lit(replacement))


def replace_found(col: Column, search: str, replacement: str) -> Column:
    """`replace` for strings that few texts hold: looking for one compares first bytes, replacing compares whole strings at every place."""
    return let(
        col,
        lambda text: F.when(F.contains(text, F.lit(search)), F.replace(text, F.lit(search), F.lit(replacement))).otherwise(text),
    )


def let(value: Column, body) -> Column:
    """Bind `value` to a lambda variable so that `body` may use it often at the cost of one evaluation."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ws_trim(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def ws_collapse(col: Column) -> Column:
    """Runs of whitespace become one space, ends are trimmed.

    A run that already is one plain space does not match, so that prose, where
    most runs are, is scanned and not rebuilt.
    """
    return F.trim(replace_regex(col, f"{WS_BUT_SPACE}{WS_CLASS}*+| {WS_CLASS}++", " "))


def is_blank(col: Column) -> Column:
    """Null, empty or only whitespace; stops at the first visible character."""
    return ~F.coalesce(col.rlike(f"[^{WS_MEMBERS}]"), F.lit(False))


def utf16_length(col: Column) -> Column:
    """Code points, and once more those beyond the basic plane, which only texts with non-ASCII bytes can hold."""
    points = F.char_length(col)
    beyond = F.regexp_count(col, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.when(F.octet_length(col) == points, points).otherwise(points + beyond).cast("int")


def or_default(col: Column, default: str) -> Column:
    """Replace null and the empty string."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def one_decimal(col: Column) -> Column:
    """Text with one decimal, rounded on the exact binary value, exact ties upwards."""
    value = col.cast("double")
    exact_tie = (value * 4 == F.floor(value * 4)) & (value * 2 != F.floor(value * 2))
    return F.when(
        exact_tie, F.round(value, 1).cast("decimal(38,1)").cast("string")
    ).otherwise(F.call_function("format_number", value, F.lit("0.0")))


def percent_difference(old_length: Column, new_length: Column) -> Column:
    """Length change in percent of the old length; null when the old text is empty."""
    old, new = old_length.cast("double"), new_length.cast("double")
    return F.when(old > 0, F.abs(new - old) / old * 100)


def html_escape(col: Column) -> Column:
    # The five replacements, ampersand first.
    for char, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#039;"),
    ):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def _char_of(code_point: Column) -> Column:
    def decoded(code: Column) -> Column:
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(valid, F.translate(char, C1_CONTROLS, C1_AS_CP1252)).otherwise(
            F.lit("\ufffd")
        )

    return let(code_point, decoded)


def _number(digits: Column, most: int, base: int) -> Column:
    """The number of any count of digits; 0, which is no character, if it is beyond all characters."""
    short = F.ltrim(digits, F.lit("0"))
    return F.when(F.length(short) <= most, F.conv(F.concat(F.lit("0"), short), base, 10).cast("bigint")).otherwise(F.lit(0))


# Names that need no semicolon, the longest of those with one start first.
OPEN_NAMES = "|".join(sorted((name for name in html5 if not name.endswith(";")), reverse=True))


def _entity_table() -> Column:
    """First letter to name to characters, for all HTML 5 names; a map literal whose parts are short to search."""
    letters: dict[str, list[str]] = {}
    for name, text in html5.items():
        letters.setdefault(name[0], []).append(f"{name}\x02{text}")
    tables = [
        (F.lit(letter), F.str_to_map(F.lit("\x01".join(names)), F.lit("\x01"), F.lit("\x02")))
        for letter, names in sorted(letters.items())
    ]
    return F.create_map(*[column for pair in tables for column in pair])


def _decode_piece(piece: Column, names: Column, in_attribute: bool) -> Column:
    """Decode one reference; `piece` is the text after an ampersand.

    A whole name goes before a shorter one without semicolon, which in an
    attribute must not be followed by a letter, a digit or an equals sign.
    """
    def named(token: Column) -> Column:
        return F.try_element_at(F.try_element_at(names, F.left(token, F.lit(1))), token)

    def replaced(token: Column, char: Column) -> Column:
        # An ampersand stays escaped until the last step, or it would be decoded twice.
        kept = let(char, lambda c: F.when(c == "&", F.lit("&amp;")).otherwise(c))
        return F.concat(kept, F.substr(piece, F.length(token) + 1))

    def numeric(token: Column) -> Column:
        body = F.rtrim(token, F.lit(";"))
        char = F.when(
            body.rlike("^#[xX]"), _char_of(_number(F.substring(body, 3, 2147483647), 6, 16))
        ).otherwise(_char_of(_number(F.substring(body, 2, 2147483647), 7, 10)))
        return F.when(token != "", replaced(token, char))

    ahead = "(?![=A-Za-z0-9])" if in_attribute else ""
    number = F.regexp_extract(piece, r"^(#[0-9]++;?|#[xX][0-9A-Fa-f]++;?)", 1)
    whole = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]*+;)", 1)
    short = F.regexp_extract(piece, f"^((?:{OPEN_NAMES})){ahead}", 1)
    decoded = F.when(piece.startswith("#"), let(number, numeric)).otherwise(
        F.coalesce(
            let(whole, lambda t: replaced(t, named(t))), let(short, lambda t: replaced(t, named(t)))
        )
    )
    return F.coalesce(decoded, F.concat(F.lit("&"), piece))


def _decode_rare(col: Column, in_attribute: bool) -> Column:
    """Numeric references and the less common names; skipped for texts without any."""
    def decoded(text: Column) -> Column:
        names = _entity_table()
        pieces = F.transform(
            F.split(text, "&"),
            lambda p, i: F.when(i == 0, p).otherwise(_decode_piece(p, names, in_attribute)),
        )
        rare = text.rlike("&(?:#[xX0-9]|(?!amp;)[A-Za-z][A-Za-z0-9])")
        return F.when(rare, F.array_join(pieces, "")).otherwise(text)

    return let(col, decoded)


def decode_entities(col: Column, in_attribute: bool = False) -> Column:
    """Replace character references: numbers and all HTML 5 names, some of which may lack their semicolon."""
    def decoded(out: Column) -> Column:
        for name, char in COMMON_ENTITIES.items():
            out = replace_found(out, f"&{name};", char)
        return replace_found(_decode_rare(out, in_attribute), "&amp;", "&")

    return let(col, lambda text: F.when(F.contains(text, F.lit("&")), decoded(text)).otherwise(text))


def decode_each(texts: Column) -> Column:
    """`decode_entities` over an array of texts."""
    return F.transform(texts, lambda text: decode_entities(text))
