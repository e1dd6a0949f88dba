"""Column expressions over text: cleaning, splitting, language, dates, categories, titles, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default keyword rules (category, part of the url, exact keywords, keywords of lower-cased text), first true one wins.
CATEGORY_RULES = [
    ("tax", "/tax/", ["საგადასახადო"], ["налог"]),
    ("vat", "/vat/", ["დღგ"], ["ндс"]),
    ("corporate", "/corporate/", [], ["корпоратив"]),
]
#: Words that make a link worth following.
LINK_KEYWORDS = ["tax", "налог", "vat", "ндс", "საგადასახადო", "დღგ", "law", "закон", "კანონი"]
TITLE_SUFFIX, STOP_TITLE = " - example portal", "Document statistics"


def strip(c: Column) -> Column:
    """White space (of any script) off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Each line stripped, empty lines dropped."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), "\n")


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def paragraphs(c: Column) -> Column:
    """Parts between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Parts that end with ``.``, ``!`` or ``?`` before white space, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), strip), lambda x: x != "")


def detect_language(c: Column) -> Column:
    """``ka`` if any Georgian letter, else ``ru`` if any Cyrillic one, else ``en``."""
    return F.when(c.rlike(r"[\x{10A0}-\x{10FF}]"), "ka").when(c.rlike(r"[\x{0400}-\x{04FF}]"), "ru").otherwise("en")


def detect_language_binary(c: Column) -> Column:
    return F.when(c.rlike(r"[\x{10A0}-\x{10FF}]"), "ka").otherwise("en")


#: Patterns of a date, the first that is found anywhere wins.
DATE_PATTERNS = [r"(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})", r"(\d{4}[./-]\d{1,2}[./-]\d{1,2})"]


def extract_date(c: Column) -> Column:
    """First day-month-year, else first year-month-day, as it is written; null if there is none."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in DATE_PATTERNS))


def categorize(url: Column, text: Column, rules=CATEGORY_RULES) -> Column:
    """Category of the first rule whose url part or one of whose keywords occurs; null if none does."""
    out = F.lit(None).cast("string")
    for name, part, exact, lowered in reversed(rules):
        hit = url.contains(part)
        for k in exact:
            hit = hit | text.contains(k)
        for k in lowered:
            hit = hit | F.lower(text).contains(k)
        out = F.when(hit, name).otherwise(out)
    return out


def _candidates(c: Column, suffix: str, stop: str) -> Column:
    """Lines that may give a title: (title, ends), ``ends`` if the search of the ingest stops there."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")

    def of(line: Column) -> Column:
        before = strip(F.substring_index(line, suffix, 1))
        heading = strip(F.regexp_replace(line, "^#+", ""))
        plain = (F.length(line) > 10) & ~line.startswith("[") & ~line.startswith("!")
        return (
            F.when(line.contains(suffix), F.struct(before.alias("title"), F.lit(True).alias("ends")))
            .when(line.startswith("#"), F.struct(heading.alias("title"), ((heading != "") & (heading != stop)).alias("ends")))
            .when(plain, F.struct(F.substring(line, 1, 200).alias("title"), F.lit(True).alias("ends")))
        )

    return F.filter(F.transform(lines, of), lambda x: x.isNotNull())


def markdown_title_ingest(c: Column, suffix: str = TITLE_SUFFIX, stop: str = STOP_TITLE) -> Column:
    """Title of a markdown text at ingest: the first candidate that ends the search, else the last heading, else ``Untitled``."""
    found = _candidates(c, suffix, stop)
    ended = F.filter(found, lambda x: x["ends"])
    return F.when(F.size(ended) > 0, ended[0]["title"]).when(F.size(found) > 0, F.element_at(found, -1)["title"]).otherwise("Untitled")


def markdown_title_backfill(c: Column, suffix: str = TITLE_SUFFIX, stop: str = STOP_TITLE) -> Column:
    """Title as it is recomputed later: the first candidate that is neither empty nor the stop title."""
    found = F.filter(_candidates(c, suffix, stop), lambda x: x["ends"] & (x["title"] != ""))
    return F.when(F.size(found) > 0, found[0]["title"]).otherwise("Untitled")


def prefixes(df: DataFrame, column: str, lengths: str, name: str) -> DataFrame:
    """A row for each prefix of ``column`` that has one of the row's ``lengths`` (an array), as ``name``."""
    n = F.filter(lengths, lambda x: x <= F.length(column))
    return df.withColumn(name, F.explode(F.transform(n, lambda x: F.substring(F.col(column), F.lit(1), x)))).drop(lengths)
