"""Text expressions: names, tokens, sentences, redaction, stable keys."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

#: Latin letters with marks and their base letters: the part of Unicode decomposition that SQL can state.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def normalize_latin(name: Column) -> Column:
    """Comparison form of a name: lower case, no marks, no apostrophes, hyphens as spaces."""
    low = F.translate(F.lower(name), MARKED, PLAIN)
    bare = F.replace(F.regexp_replace(low, "['`‘’]", ""), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(F.translate(bare, "-", " "), "[ \\t\\n\\x0B\\f\\r]+", " "))


@F.pandas_udf(StringType())
def normalize_unicode(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As normalize_latin(), over all of Unicode."""
    import unicodedata

    drop = dict.fromkeys(map(ord, "'`‘’")) | {ord("-"): " "}

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
        return " ".join(bare.casefold().translate(drop).split())

    for s in names:
        yield s.map(one)


def strip_article(name: Column) -> Column:
    return F.regexp_replace(name, "^(the|a|an) ", "")


def tokens(text: Column) -> Column:
    r"""Lower-case words; (?U) makes Java's \w know all letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def evidence(text: Column, needle: str, first: int = 2, most: int = 25, chars: int = 2500) -> Column:
    """The first sentences and those that match, in order, cut to a size."""
    all_ = sentences(text)
    kept = F.filter(all_, lambda s, i: (i < first) | F.lower(s).contains(needle))
    return F.substring(F.array_join(F.slice(kept, 1, most), " "), 1, chars)


#: Openings of sentences that address the reader's model instead of describing anything.
INSTRUCTIONS = r"(?i)(ignore|disregard|forget)( all)?( the)?( previous| prior| above)? (instructions|rules|prompts)|you are now |system prompt"


def redact(text: Column) -> tuple[Column, Column]:
    """Sentences that look like instructions are replaced; also their number."""
    parts = sentences(text)
    out = F.array_join(F.transform(parts, lambda s: F.when(s.rlike(INSTRUCTIONS), F.lit("[removed]")).otherwise(s)), " ")
    return out, F.size(F.filter(parts, lambda s: s.rlike(INSTRUCTIONS)))


def clean_wikitext(text: Column, depth: int = 4, least: int = 30) -> Column:
    """References, templates (innermost first, to a bounded depth), links, tags and addresses go."""
    out = F.regexp_replace(text, r"(?s)<ref[^>/]*/>|<ref[^>]*>.*?</ref>", "")
    for _ in range(depth):
        out = F.regexp_replace(out, r"\{\{[^{}]*\}\}", "")
    out = F.regexp_replace(out, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\[?https?://\S+", ""), r"<[^>]*>", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"&[a-z]+;", " "), r"\s+", " "))
    return F.when(F.length(out) >= least, out).otherwise("")


def stable_id(*parts: Column, prefix: str = "obs-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24))


def choose_one(values: Column) -> Column:
    """The value if there is exactly one, else an empty text."""
    unique = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
    return F.when(F.size(unique) == 1, unique[0]).otherwise("")


def label(n: Column) -> Column:
    """0, 1, ... 25, 26 as A, B, ... Z, AA."""
    one = lambda c: F.char((c + 65).cast("int"))
    return F.when(n < 26, one(n)).otherwise(F.concat(one(F.floor(n / 26) - 1), one(n % 26)))


def infobox_field(text: Column, field: str) -> Column:
    """One field of a template, to the next top-level bar."""
    return F.trim(F.regexp_extract(text, rf"(?s)\|\s*{field}\s*=\s*((?:\[\[[^\]]*\]\]|\{{\{{[^}}]*\}}\}}|[^|{{}}])*)", 1))


def years_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b(1[0-9]{3}|20[0-9]{2})\b"), 1)


def coordinates_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(-?\d{1,2}\.\d+),\s*(-?\d{1,3}\.\d+)"), 0)


def safe_url(url: Column) -> Column:
    return F.when(url.rlike(r"^https?://[^\s\"'<>]+$"), url)


#: Titles of sections about a ship's namesake.
NAMESAKE = r"(?:Namesakes?|Name|Naming|Etymology)"


def without_sections(wikitext: Column, titles: str = NAMESAKE) -> Column:
    """Sections of these titles go, each up to the next heading of its level or above. The levels go one
    after the other, the highest first, so that what lies inside a section goes with it."""
    out = wikitext
    for level in range(1, 7):
        head = rf"^={{{level}}}[ \t]*{titles}[ \t]*={{{level}}}[ \t]*$"
        out = F.regexp_replace(out, rf"(?smi){head}.*?(?=^={{1,{level}}}[^=\n]+={{1,{level}}}[ \t]*$|\z)", "")
    return out


def collapse(text: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


@F.pandas_udf(StructType().add("start", IntegerType()).add("end", IntegerType()))
def raw_span(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """The code points of a text that a span [start, end) of its collapsed form stands for; null where the
    span is empty or leaves the text."""

    def one(text: str | None, start: int | None, end: int | None) -> tuple[int | None, int | None]:
        if text is None or pd.isna(start) or pd.isna(end):
            return None, None
        # Each character of the collapsed form is one match: a run of white space, or a character.
        froms = [m.start() for m in re.finditer(r"\s+|\S", text)] + [len(text)]
        if not 0 <= start < end < len(froms):
            return None, None
        return froms[int(start)], froms[int(end)]

    rows = [one(*r) for r in zip(texts, starts, ends)]
    return pd.DataFrame(rows, columns=["start", "end"]).astype("Int32")


def source_url(provider: Column, record_id: Column, page: Column) -> Column:
    """The address of a reference: an item of the knowledge base by its number, or a page by its title."""
    item = F.regexp_extract(record_id, r"^(Q\d+)(?:\$.*)?$", 1)
    title = F.replace(F.url_encode(F.replace(page, F.lit(" "), F.lit("_"))), F.lit("%2F"), F.lit("/"))
    by_item = F.when((provider == "Wikidata") & (item != ""), F.concat(F.lit("https://www.wikidata.org/wiki/"), item))
    by_page = F.when((provider == "Wikipedia") & (page != ""), F.concat(F.lit("https://en.wikipedia.org/wiki/"), title))
    return F.coalesce(by_item, by_page)
