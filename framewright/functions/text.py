"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def replace_first(c: Column, pattern: str, by: str) -> Column:
    """The first match alone; pattern has no groups, by may name $2."""
    return F.regexp_replace(c, f"(?s)\\A(.*?)({pattern})", f"$1{by}")


def straight_quotes(c: Column) -> Column:
    """The first of each curly quote made straight."""
    for curly, straight in (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'")):
        c = replace_first(c, curly, straight)
    return c


def deindent(c: Column) -> Column:
    """Lines without their common indent; lines without text do not count for it."""
    lines = F.split(c, "\n", -1)
    indent = F.array_min(F.transform(F.filter(lines, lambda x: x.rlike(r"\S")), lambda x: F.length(F.regexp_extract(x, r"^[ \t]*", 0))))
    return F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"\S"), F.substr(x, F.coalesce(indent, F.lit(0)) + 1)).otherwise(x)), "\n")


def slide_notes(c: Column) -> Column:
    """(content, notes) of a slide: split at a notes line, only if that gives two parts."""
    parts = F.split(c, r"(?mi)^notes?:", -1)
    two = F.size(parts) == 2
    return F.struct(F.when(two, F.get(parts, 0)).otherwise(c).alias("content"), F.when(two, F.trim(F.get(parts, 1))).alias("notes"))


def attributes(c: Column) -> Column:
    """Map of key="value" pairs; the last of equal keys wins."""
    keys = F.regexp_extract_all(c, F.lit(r'([^"=\s]+?)="([^"]*?)"'), 1)
    values = F.regexp_extract_all(c, F.lit(r'([^"=\s]+?)="([^"]*?)"'), 2)
    once = F.array_distinct(keys)
    at = F.transform(once, lambda key: F.element_at(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: e["k"] == key), -1)["v"])
    return F.map_from_arrays(once, at)


def kept_attributes(c: Column) -> Column:
    """Attributes without those reserved for markdown slides."""
    reserved = ["data-markdown", "data-separator", "data-separator-vertical", "data-separator-notes", "data-vertical", "data-notes"]  # fixed values
    return F.map_filter(attributes(c), lambda k, v: ~k.isin(reserved))


def typed(c: Column) -> Column:
    """What a text means: 'null', 'bool', 'number' or 'text', and its value where it has one."""
    number = c.try_cast("double")
    kind = F.when(c.isNull() | (c == "null"), "null").when(c.isin("true", "false"), "bool").when(number.isNotNull(), "number").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(c.isin("true", "false"), c == "true").alias("flag"), number.alias("number"))


def query_map(c: Column) -> Column:
    """Map of a query string's parameters, + and %xx decoded; the last of equal names wins."""
    pairs = F.filter(F.split(F.regexp_replace(c, r"^\?", ""), "&"), lambda x: x != "")
    name = lambda x: F.url_decode(F.replace(F.substring_index(x, "=", 1), F.lit("+"), F.lit(" ")))
    value = lambda x: F.when(x.contains("="), F.url_decode(F.replace(F.regexp_replace(x, "^[^=]*=", ""), F.lit("+"), F.lit(" "))))
    entries = F.transform(pairs, lambda x: F.struct(name(x).alias("k"), value(x).alias("v")))
    once = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(once, F.transform(once, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]))


def last_two(c: Column) -> Column:
    """Zero-padded to two digits; of longer numbers the last two."""
    return F.right(F.concat(F.lit("00"), c.cast("string")), F.lit(2))


def lead_int(c: Column, default: int) -> Column:
    """The integer that a text starts with, or a default."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int"), F.lit(default))


def rewrite_comments(c: Column, to: str = "html") -> Column:
    """Marks ==XX text== of a comment by XX, rewritten for a format."""
    forms = {"html": '<span class="comment" data-by="$1">$2</span>', "tex": "\\\\todo[author=$1]{$2}", "none": ""}
    return F.regexp_replace(c, r"==([A-Z]{2}) ([^=]*)==", forms[to])


def clean_file_name(c: Column) -> Column:
    """Blanks become _, then -_, _- and __ become _ once each, then an upper-case extension goes to lower case."""
    name = F.replace(c, F.lit(" "), F.lit("_"))
    for pair in ("-_", "_-", "__"):
        name = F.replace(name, F.lit(pair), F.lit("_"))
    extension = F.regexp_extract(name, r"\.([^./]*)$", 1)
    return F.when(extension != "", F.concat(F.regexp_replace(name, r"\.[^./]*$", ""), F.lit("."), F.lower(extension))).otherwise(name)


def url_display(c: Column) -> Column:
    """Lower case without a leading http://."""
    return F.regexp_replace(F.lower(c), "^http://", "")


def is_format(c: Column) -> Column:
    """Is it pdf, docx or html? Anchored at both ends, where the studied pattern binds each anchor to one word alone."""
    return c.rlike("^(pdf|docx|html)$")


def brightness(c: Column) -> Column:
    """Weighted brightness of a colour #rgb, #rrggbb, rgb(r,g,b) or rgba(r,g,b,a); null if it is none of these."""
    short, long = r"^#?([0-9a-fA-F])([0-9a-fA-F])([0-9a-fA-F])$", r"^#?([0-9a-fA-F]{2})([0-9a-fA-F]{2})([0-9a-fA-F]{2})$"
    plain = r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*(?:,\s*[\d.]+\s*)?\)$"
    part = lambda k: F.when(c.rlike(short), F.conv(F.concat(F.regexp_extract(c, short, k), F.regexp_extract(c, short, k)), 16, 10)).when(c.rlike(long), F.conv(F.regexp_extract(c, long, k), 16, 10)).when(c.rlike(plain), F.regexp_extract(c, plain, k)).try_cast("int")
    return (part(1) * 299 + part(2) * 587 + part(3) * 114) / 1000


def duration(seconds: Column) -> Column:
    """Sign, if negative, and hh:mm:ss; hours grow beyond two digits."""
    s = F.abs(seconds.cast("long"))
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def page_links(count: Column, start: Column, show: int = 10) -> Column:
    """Numbers of the pages to link to: the first three on pages 1 to 3, else from the one before to two after, as far as there are pages."""
    pages = F.ceil(count / show).cast("int")
    page = F.floor(start / show).cast("int")
    low = F.when(page <= 2, 1).otherwise(page)
    high = F.least(F.when(page <= 2, 3).otherwise(page + 2), pages)
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def deindent_slide(c: Column) -> Column:
    """Without the indent of the first line that has text: so many tabs if it starts with any, else so many blanks if there are at least two."""
    first = F.regexp_extract(c, r"(?s)\A(?:[ \t]*\n)*([ \t]*)", 1)
    tabs = F.length(F.regexp_extract(first, r"^(\t*)", 1))
    blanks = F.length(first)
    lines = F.split(c, "\n", -1)
    cut = lambda x, n, kind: F.when(F.substr(x, F.lit(1), n) == F.repeat(F.lit(kind), n), F.substr(x, n + 1)).otherwise(x)
    return F.array_join(F.when(tabs > 0, F.transform(lines, lambda x: cut(x, tabs, "\t"))).when((tabs == 0) & (blanks > 1), F.transform(lines, lambda x: cut(x, blanks, " "))).otherwise(lines), "\n")


#: Fixed value: what stands for the end tag of a script within a slide's markup.
SCRIPT_END = "__SCRIPT_END__"


def hide_script_end(c: Column) -> Column:
    return F.replace(c, F.lit("</script>"), F.lit(SCRIPT_END))


def show_script_end(c: Column) -> Column:
    return F.replace(c, F.lit(SCRIPT_END), F.lit("</script>"))


def typed_query_map(c: Column) -> Column:
    """Map of a query string's parameters to what their values mean; see query_map and typed."""
    return F.transform_values(query_map(c), lambda _, v: typed(v))


def slide_link(c: Column) -> Column:
    """(name, h, v) of a link #/h/v or #/name: a name holds letters, digits, - _ : and . alone; numbers that are missing are 0."""
    parts = F.split(F.regexp_replace(c, "^#/?", ""), "/", -1)
    first = F.get(parts, 0)
    named = (first != "") & ~first.rlike(r"^\d+$")
    number = lambda k: F.when(~named, F.coalesce(F.get(parts, k).try_cast("int"), F.lit(0)))
    return F.struct(F.when(named, F.regexp_replace(first, r"[^a-zA-Z0-9\-_:.]", "")).alias("name"), number(0).alias("h"), number(1).alias("v"))


def png_to_pdf(c: Column) -> Column:
    return F.replace(c, F.lit(".png"), F.lit(".pdf"))


def join_path(*parts: Column) -> Column:
    """Parts of a path with one / between; empty and null parts do not count."""
    return F.regexp_replace(F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in parts]), "/{2,}", "/")


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, "([^/]*)/*$", 1)


def extension(c: Column) -> Column:
    """The last dot of the base name and what follows; nothing if the name has no other dot than its first character."""
    return F.regexp_extract(base_name(c), r"^.+(\.[^.]*)$", 1)


def clock(c: Column) -> Column:
    """Time of day as hh:mm AM or PM."""
    return F.date_format(c, "hh:mm a")


def message(templates: dict[str, str], language: Column, default: str, **values: Column) -> Column:
    """A text by language, with !name replaced by the values; other languages get the default one's."""
    known = F.create_map(*[F.lit(x) for pair in templates.items() for x in pair])
    out = F.coalesce(known[language], F.lit(templates[default]))
    for name, value in values.items():
        out = F.replace(out, F.lit(f"!{name}"), value.cast("string"))
    return out
