"""Text as Column functions: white space, spans, hashes, small parsers.

Offsets count code points, start at 0 and exclude the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, running_starts

# Titles of sections that hold no claims, and the least length of one that does.
SKIP_SECTIONS = r"(?i)^(references|bibliography|acknowledgements?|acknowledgments?|appendix)$"
MIN_SECTION_CHARS = 200
# What the five XML entities stand for; the ampersand comes last.
XML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
# Words that say nothing about what is measured.
STOPWORDS = (
    "the a an of for and or in on at to is are was were "
    "we our with by from this that it as than then both all "
    "used using use set value values has have be been which while"
).split()

# White space as Unicode has it, for engines whose \\s is ASCII.
SPACE = r"[\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


SPACES = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_all(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def one_line(text: Column) -> Column:
    """White-space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def collapse_whitespace(text: Column) -> Column:
    """Line ends as \\n, blanks as one, none beside a line end, at most one empty line, trimmed."""
    end, blanks = r"(?:\r\n?+|\n)", r"(?<![ \t])[ \t]*+"
    out = F.regexp_replace(text, rf"{blanks}{end}[ \t]*+{end}[ \t\r\n]*+", "\n\n")
    out = F.regexp_replace(out, rf"{blanks}{end}[ \t]*+", "\n")
    return trim_all(F.regexp_replace(out, r"[ \t]{2,}+|\t", " "))


def strip_comments(tex: Column) -> Column:
    """Without what follows an unescaped percent sign on a line."""
    return F.regexp_replace(tex, r"(?m)(^|[^\\])%.*$", "$1")


def span(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def embedding_text(subject: Column, text: Column) -> Column:
    return F.concat_ws("\n", subject, text)


def ordered_pair_hash(a: Column, b: Column) -> Column:
    """Identifies a pair of texts in that order."""
    return F.sha2(F.concat(a, F.lit("\x00"), b), 256)


def pair_hash(subject_a: Column, a: Column, subject_b: Column, b: Column) -> Column:
    """Identifies a pair of claims whatever their order, with their subjects."""
    x, y = F.concat_ws("\x01", subject_a, a), F.concat_ws("\x01", subject_b, b)
    return ordered_pair_hash(F.least(x, y), F.greatest(x, y))


def contains_span(haystack: Column, needle: Column) -> Column:
    return one_line(haystack).contains(one_line(needle))


def should_extract(title: Column, length: Column) -> Column:
    return (length >= MIN_SECTION_CHARS) & ~trim_all(title).rlike(SKIP_SECTIONS)


def locate(quote: Column, text: Column) -> Column:
    """STRUCT<start, end> of a quote: verbatim, else with any white space between its words; else null.

    An empty quote is not found. The second search runs only where the first fails.
    """
    at = F.locate(quote, text) if isinstance(quote, str) else F.instr(text, quote)
    words = F.transform(F.split(one_line(quote), " "), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.array_join(words, f"{SPACE}+")
    found = F.regexp_substr(text, pattern)
    start = F.when(at > 0, at - 1).when(found.isNotNull(), F.instr(text, found) - 1)
    length = F.when(at > 0, F.length(quote)).otherwise(F.length(found))
    return F.when((one_line(quote) != "") & start.isNotNull(), F.struct(start.cast("int").alias("start"), (start + length).cast("int").alias("end")))


def unescape_xml(value: Column) -> Column:
    for entity, char in XML_ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def first_tag(xml: Column, tag: str) -> Column:
    """The inside of the first such element, or null."""
    pattern = f"<{tag}[^>]*>([\\s\\S]*?)</{tag}>"
    return F.when(xml.rlike(pattern), F.regexp_extract(xml, pattern, 1))


# A decimal with a fraction that is no part of a longer word or number (ASCII word characters).
DECIMAL = r"(?<![A-Za-z0-9_.])[0-9]{1,4}\.[0-9]{1,3}(?![A-Za-z0-9_.])"
# How far before and after a figure its word may stand.
BEFORE_CHARS, AFTER_CHARS = 40, 30


def signature(before: Column, after: Column) -> Column:
    """The word a figure is stated with: the next one, else the last telling one before it; null if there is none."""
    following = F.lower(F.regexp_extract(after, rf"^(?:{SPACE}|%)*([A-Za-z][A-Za-z-]+)", 1))
    telling = F.filter(F.regexp_extract_all(F.lower(before), F.lit("[a-z][a-z-]+"), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))
    return F.when((following != "") & ~following.isin(*STOPWORDS), following).otherwise(F.try_element_at(telling, F.lit(-1)))


def decimal_sites(text: Column) -> Column:
    """array of (start, end, literal, signature) of all decimals; the gaps between them give the offsets."""
    around = lambda t, start, end: (F.substring(t, F.greatest(start - BEFORE_CHARS, F.lit(0)) + 1, F.least(start, F.lit(BEFORE_CHARS))), F.substring(t, end + 1, F.lit(AFTER_CHARS)))

    def sites(t: Column, literals: Column, gaps: Column) -> Column:
        both = F.zip_with(gaps, literals, lambda g, v: g + F.coalesce(F.length(v), F.lit(0)))
        at = lambda starts, i: (F.get(starts, i) + F.get(gaps, i)).cast("int")
        one = lambda start, v: F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("literal"), signature(*around(t, start, start + F.length(v))).alias("signature"))
        return let(running_starts(both), lambda starts: F.transform(literals, lambda v, i: one(at(starts, i), v)))

    gaps = lambda t: F.transform(F.split(t, DECIMAL, -1), lambda g: F.length(g).cast("long"))
    found = lambda t: let(F.regexp_extract_all(t, F.lit(DECIMAL), F.lit(0)), lambda v: let(gaps(t), lambda g: sites(t, v, g)))
    none = F.array().cast("array<struct<start:int,end:int,literal:string,signature:string>>")
    return F.when(text.rlike(r"[0-9]\.[0-9]"), let(text, found)).otherwise(none)
