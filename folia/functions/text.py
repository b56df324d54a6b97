"""Text column functions. Only ASCII white space and digits count as such, as layout text is compared byte by byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "alignment_value", "blank", "bullet_for", "content_text", "escape_xml", "extension_for", "face_for", "float_attr", "flag_on", "font_family", "format_number", "hex4", "hex_component",
    "int_attr", "join_lines", "mask_digits", "mime_for", "normal_color", "part_path", "percent_color", "pdf_name", "run_text", "same_style", "strip_marker", "strip_run_marker", "style_from_id", "style_id", "swap_extension", "unescape_xml", "visible",
]

WS = r"[ \t\n\x0B\f\r]"

# Font families that are written in one word.
FONT_ALIASES = {
    "dejavusans": "DejaVu Sans",
    "dejavuserif": "DejaVu Serif",
    "dejavusansmono": "DejaVu Sans Mono",
    "notosans": "Noto Sans",
    "notoserif": "Noto Serif",
    "timesnewroman": "Times New Roman",
    "couriernew": "Courier New",
    "arialunicodems": "Arial Unicode MS",
}
# Characters that mark a bulleted item, five of them from symbol fonts' private use area.
BULLETS = "\u2022\u25e6\u25aa\u25ac\u2013\u00b7-*\u25cf\u25cb\u25a0\u25a1\u27a2\uf0b7\uf0a7\uf076\uf0d8\uf0fc"


def blank(c) -> Column:
    """Whether a text is empty or ASCII white space only; a no-break space is not blank."""
    return F.col(c).rlike(f"^{WS}*$") if isinstance(c, str) else c.rlike(f"^{WS}*$")


def mask_digits(c: Column) -> Column:
    """Each ASCII digit as #."""
    return F.regexp_replace(c, "[0-9]", "#")


def run_text(runs: Column) -> Column:
    """The text of an array of runs."""
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def visible(runs: Column) -> Column:
    """Whether any run has characters; white space counts."""
    return F.exists(runs, lambda r: r["text"] != "")


def same_style(a: Column, b: Column) -> Column:
    """Whether two runs (structs) differ at most in text."""
    return (a["bold"].eqNullSafe(b["bold"])) & (a["italic"].eqNullSafe(b["italic"])) & (a["color"].eqNullSafe(b["color"])) & (a["font"].eqNullSafe(b["font"]))


def int_attr(c: Column, fallback: int | None) -> Column:
    """The integer that a text begins with, after white space; else the fallback."""
    return F.coalesce(F.regexp_extract(c, f"^{WS}*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(fallback).cast("int"))


def float_attr(c: Column, fallback: float | None) -> Column:
    """The number that a text begins with, after white space; else the fallback."""
    number = r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    return F.coalesce(F.regexp_extract(c, f"^{WS}*{number}", 1).try_cast("double"), F.lit(fallback).cast("double"))


def flag_on(value: Column) -> Column:
    """An on/off attribute: absent means on; 0, false and off mean off."""
    return F.coalesce(~value.isin("0", "false", "off"), F.lit(True))


def normal_color(c: Column) -> Column:
    """Six upper-case hex digits; anything else, and black, is the default colour ''."""
    digits = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Fa-f]", ""))
    return F.when((F.length(digits) == 6) & (digits != "000000"), digits).otherwise("")


def percent_color(c: Column) -> Column:
    """rgb(r%, g%, b%) as six hex digits, by the first three numbers; '' if there are fewer."""
    numbers = F.regexp_extract_all(c, F.lit(r"([0-9.]+)"), F.lit(1))
    part = lambda i: F.lpad(F.hex(F.round(F.get(numbers, F.lit(i)).try_cast("double") * 2.55).cast("long")), 2, "0")
    return F.coalesce(F.when(F.size(numbers) >= 3, F.concat(part(0), part(1), part(2))), F.lit(""))


def hex_component(c: Column, index: int) -> Column:
    """Red, green or blue (0, 1, 2) of six hex digits, from 0 to 1; 0 if there are not six."""
    value = F.conv(F.substring(c, 2 * index + 1, 2), 16, 10).try_cast("double") / 255.0
    return F.when(c.rlike("^[0-9A-Fa-f]{6}$"), value).otherwise(0.0)


def font_family(c: Column) -> Column:
    """A family's usual name: no subset prefix, style suffix or maker's suffix; '' for generic families."""
    name = F.regexp_replace(c, r"^[A-Z]{6}\+(?=.)", "")
    name = F.regexp_replace(name, "(?s)[-,].*$", "")
    for suffix in ("PSMT", "MT", "PS"):
        name = F.when(F.octet_length(name) > len(suffix), F.regexp_replace(name, f"{suffix}$", "")).otherwise(name)
    aliases = F.create_map(*[F.lit(x) for pair in FONT_ALIASES.items() for x in pair])
    alias = F.try_element_at(aliases, F.replace(F.lower(name), F.lit(" ")))
    spaced = F.when(F.instr(name, " ") > 0, name).otherwise(F.regexp_replace(name, "([a-z])(?=[A-Z])", "$1 "))
    return F.when(F.lower(name).isin("", "sans", "serif", "monospace"), "").otherwise(F.coalesce(alias, spaced))


def style_from_id(c: Column) -> Column:
    """A paragraph style by its id, as different writers spell it."""
    key = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    out = F.when(key == "title", "Title").when(key == "subtitle", "Heading2")
    for n in "123":
        out = out.when(key.isin(f"heading{n}", f"heading20{n}"), f"Heading{n}")
    return out.otherwise("Normal")


def style_id(c: Column) -> Column:
    return F.when(c.isin("Title", "Heading1", "Heading2", "Heading3"), c).otherwise("")


def alignment_value(c: Column) -> Column:
    return F.when(c == "Center", "center").when(c == "Right", "right").when(c == "Justify", "both").when(c == "Left", "left").otherwise("")


def extension_for(mime: Column) -> Column:
    return F.when(mime == "image/png", "png").when(mime == "image/jpeg", "jpeg").when(mime == "image/gif", "gif").when(mime == "image/bmp", "bmp").otherwise("")


# Types of pictures by their names' endings; layout dumps know the first three only.
MIMES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff", ".emf": "image/x-emf", ".wmf": "image/x-wmf"}


def mime_for(path: Column, layout: bool = False) -> Column:
    """The type of a picture by its name's ending, in any case."""
    out = F.lit("application/octet-stream")
    for ending, mime in list(MIMES.items())[: 3 if layout else None]:
        out = F.when(F.lower(path).endswith(ending), mime).otherwise(out)
    return out


def face_for(bold: Column, italic: Column) -> Column:
    return F.when(bold & italic, "BoldItalic").when(bold, "Bold").when(italic, "Italic").otherwise("Regular")


def bullet_for(kind: Column, level: Column, ordinal: Column) -> Column:
    """What stands before a list item: its number, or a bullet by level."""
    glyphs = F.array(F.lit("•"), F.lit("◦"), F.lit("▪"))
    return F.when(kind == "Numbered", F.concat(F.greatest(ordinal, F.lit(1)).cast("string"), F.lit("."))).otherwise(F.get(glyphs, F.least(F.greatest(level, F.lit(0)), F.lit(2))))


def part_path(target: Column) -> Column:
    """The name inside a package of a relationship's target."""
    return F.when(target.startswith("../"), F.regexp_replace(target, r"^(\.\./)+", "")).when(target.startswith("/"), F.substring(target, 2, 1 << 30)).otherwise(F.concat(F.lit("word/"), target))


def content_text(tag: Column, text: Column) -> Column:
    """What an element inside a run stands for; null for elements without text."""
    return F.when(tag == "w:t", text).when(tag == "w:tab", "\t").when(tag.isin("w:br", "w:cr", "w:sym"), " ").when(tag == "w:noBreakHyphen", "-")


def escape_xml(c: Column) -> Column:
    """Text for XML: no control characters but tab, line feed and return; invalid UTF-8 and the two non-characters as U+FFFD."""
    out = F.regexp_replace(F.make_valid_utf8(c), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    out = F.replace(F.replace(out, F.lit("\ufffe"), F.lit("\ufffd")), F.lit("\uffff"), F.lit("\ufffd"))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape_xml(c: Column) -> Column:
    """The five named entities; each is replaced once, so &amp;lt; gives &lt;. Numeric ones are the tokenizer's."""
    parts = F.split(c, "&")
    fixed = lambda p: F.coalesce(
        *[F.when(p.startswith(f"{name};"), F.concat(F.lit(char), F.substring(p, len(name) + 2, 1 << 30))) for name, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"))],
        F.concat(F.lit("&"), p),
    )
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(fixed(p))), "")


def format_number(c: Column) -> Column:
    """Three decimals without trailing zeros; next to nothing is 0."""
    text = F.format_string("%.3f", c)
    return F.when(F.abs(c) < 0.0005, "0").otherwise(F.regexp_replace(text, r"\.?0+$", ""))


def hex4(c: Column) -> Column:
    return F.lpad(F.hex(c), 4, "0")


def pdf_name(c: Column) -> Column:
    """Letters, digits, - and + of a font's name."""
    return F.regexp_replace(c, "[^A-Za-z0-9+-]", "")


def swap_extension(path: Column, ending: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(ending))


def strip_marker(text: Column) -> Column:
    """A line's list marker: struct<kind, ordinal, rest>. A bullet before white space, or one to three digits, . or ), white space."""
    rest = F.substring(text, 2, 1 << 30)
    bullet = (text != "") & (F.instr(F.lit(BULLETS), F.substring(text, 1, 1)) > 0) & rest.rlike(f"^{WS}")
    number = rf"^([0-9]{{1,3}})[.)]{WS}+"
    numbered = text.rlike(number) & ~bullet
    return F.struct(
        F.when(bullet, "Bullet").when(numbered, "Numbered").otherwise("None").alias("kind"),
        F.when(numbered, F.regexp_extract(text, number, 1).try_cast("int")).otherwise(0).alias("ordinal"),
        F.when(bullet, F.regexp_replace(rest, f"^{WS}+", "")).when(numbered, F.regexp_replace(text, number, "")).otherwise(text).alias("rest"),
    )


def strip_run_marker(runs: Column) -> Column:
    """A paragraph's list marker and the runs without it: struct<kind, ordinal, runs>. A bullet may be a first run of its own."""
    first = F.get(runs, F.lit(0))
    lone = F.regexp_replace(first["text"], f"^{WS}+|{WS}+$", "")
    alone = (F.size(runs) > 1) & (F.length(lone) == 1) & (F.instr(F.lit(BULLETS), lone) > 0)
    marked = strip_marker(first["text"])
    tail = F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1)))
    trimmed = F.transform(tail, lambda r, i: F.when(i == 0, r.withField("text", F.regexp_replace(r["text"], f"^{WS}+", ""))).otherwise(r))
    own = F.transform(runs, lambda r, i: F.when(i == 0, r.withField("text", marked["rest"])).otherwise(r))
    return F.when(alone, F.struct(F.lit("Bullet").alias("kind"), F.lit(0).alias("ordinal"), trimmed.alias("runs"))).otherwise(
        F.struct(F.coalesce(marked["kind"], F.lit("None")).alias("kind"), F.coalesce(marked["ordinal"], F.lit(0)).alias("ordinal"), own.alias("runs"))
    )


def join_lines(texts: Column) -> Column:
    """Lines of a paragraph as one text: a space between, unless what stands so far is longer than a byte and ends in a hyphen."""
    return F.aggregate(
        texts, F.lit(""), lambda s, t: F.when(s == "", t).when((F.octet_length(s) > 1) & s.endswith("-"), F.concat(s, t)).otherwise(F.concat(s, F.lit(" "), t))
    )
