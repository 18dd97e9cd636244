"""Names, addresses, statuses and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import blank_to_null

# Fixed value: what marks a name as that of a company (no word boundaries).
CORPORATE = r"(?i)(LLC|L\.L\.C\.|INC|CORP|CO\.|COMPANY|LP|L\.P\.|LTD|TRUST|ASSOC|REALTY|PROPERTIES|MGMT|MANAGEMENT|HOLDINGS)"

# Fixed value: a legal suffix at the end of a name.
LEGAL_SUFFIX = r"(?i),?\s*(LLC|L\.L\.C\.|INC\.?|CORP\.?|LTD\.?|L\.P\.|LLP|PLLC|P\.C\.|LP|PC)\s*$"

# Spellings of the boroughs in questions.
BOROUGH_NAMES = {
    "bronx": "Bronx",
    "the bronx": "Bronx",
    "brooklyn": "Brooklyn",
    "bklyn": "Brooklyn",
    "manhattan": "Manhattan",
    "queens": "Queens",
    "staten island": "Staten Island",
    "si": "Staten Island",
    "richmond": "Staten Island",
}

# The statuses of the sources.
HPD_STATUS = {"Open": "Open", "Close": "Closed"}
ECB_STATUS = {"ACTIVE": "Active", "RESOLVE": "Closed", "Unknown": "Unknown"}
LITIGATION_STATUS = {"PENDING": "Pending", "CLOSED": "Closed"}
DOB_KEYWORDS = {"DISMISSED": "Dismissed", "RESOLVED": "Resolved", "ACTIVE": "Active"}
HEARING_READING = {
    "IN VIOLATION": "Stipulated",
    "DEFAULT": "Stipulated",
    "ADMIT/IN-VIO": "Stipulated",
    "POP/IN-VIO": "Stipulated",
    "STIPULATION/IN-VIO": "Stipulated",
    "CURED/IN-VIO": "Stipulated",
    "DISMISSED": "Observed",
    "WRITTEN OFF": "Observed",
    "PENDING": "Inferred",
}
FINDING_READING = {"After Inquest": "Stipulated", "After Trial": "Stipulated", "No Harassment": "Observed"}
INSTRUMENT_EVENT = {"MTGE": "Mortgage", "ASST": "MortgageAssignment", "SAT": "MortgageSatisfaction"}
INSTRUMENT_ROLE = {
    "MTGE1": "Mortgagor",
    "MTGE2": "Mortgagee",
    "ASST1": "Assignor",
    "ASST2": "Assignee",
    "SAT1": "Mortgagor",
    "SAT2": "Mortgagee",
}


def mapped(value: Column, table: dict[str, str], default: str | None = None) -> Column:
    """A dictionary's entry for the value, else the default."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[value]
    return F.coalesce(found, F.lit(default)) if default is not None else found


def borough_alias(value: Column) -> Column:
    """The borough that a question's spelling means; null, which stands for no filter, if unknown."""
    return mapped(F.lower(F.trim(value)), BOROUGH_NAMES)


def status_by_keyword(text: Column, keywords: dict[str, str]) -> Column:
    """The status of the first keyword that the text contains, whatever its case."""
    out = None
    for word, status in keywords.items():
        hit = F.upper(text).contains(word)
        out = F.when(hit, status) if out is None else out.when(hit, status)
    return out


def name_tokens(name: Column) -> Column:
    """Distinct upper-case words of more than one letter; other characters part words."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.upper(name), r"[^A-Z\s]", " "), r"\s+"), lambda t: F.length(t) > 1))


def looks_corporate(name: Column) -> Column:
    return name.rlike(CORPORATE)


def without_legal_suffix(name: Column) -> Column:
    """Upper case, one legal suffix at the end and blanks and commas around removed."""
    cut = F.regexp_replace(F.upper(F.trim(F.coalesce(name, F.lit("")))), LEGAL_SUFFIX, "")
    return F.trim(cut, F.lit(" ,"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def split_address(address: Column) -> tuple[Column, Column]:
    """(house number: the first word, street: the rest)."""
    house = F.split_part(address, F.lit(" "), F.lit(1))
    return house, F.substring(address, F.length(house) + F.lit(2), F.length(address))


def lookup_address(address: Column) -> Column:
    """Ordinal endings of numbers removed, upper case."""
    return F.upper(F.trim(F.regexp_replace(address, r"(?i)(\d+)(st|nd|rd|th)\b", "$1")))


def joined_address(*parts: Column) -> Column:
    """The parts that aren't blank, joined by a comma; null without any."""
    return F.nullif(F.concat_ws(", ", *(blank_to_null(p) for p in parts)), F.lit(""))


def party_id(*fields: Column) -> Column:
    """An actor's id: a digest of its upper-case trimmed fields."""
    return F.concat(F.lit("ACT-ACRIS-"), F.sha1(F.concat_ws("|", *(F.coalesce(F.upper(F.trim(f)), F.lit("")) for f in fields)).cast("binary")))


# Fixed value: the name space of DNS names for version 5 identifiers.
DNS_SPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The version 5 identifier of a name in the DNS name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS_SPACE)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text's words, each padded by two blanks before and one behind."""
    parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda q: q != "")
    one = lambda q: F.transform(F.sequence(F.lit(1), F.length(q) + 1), lambda i: F.substring(F.concat(F.lit("  "), q, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(parts, one)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; null if a text is null, 0 if neither has any."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(union, F.lit(0)), F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def code_pairs(pairs: list[tuple[Column, Column]]) -> Column:
    """(code, description) structs of the pairs of which one at least is there."""
    all_pairs = F.array(*(F.struct(blank_to_null(c).alias("code"), blank_to_null(d).alias("description")) for c, d in pairs))
    return F.filter(all_pairs, lambda p: p["code"].isNotNull() | p["description"].isNotNull())


def code_text(pairs: list[tuple[Column, Column]], most: int = 120) -> Column:
    """``code description`` of pairs with a code, joined by bars; null without any."""
    coded = F.filter(F.array(*(F.struct(blank_to_null(c).alias("c"), d.alias("d")) for c, d in pairs)), lambda p: p["c"].isNotNull())
    one = lambda p: F.substring(F.trim(F.regexp_replace(F.concat_ws(" ", p["c"], p["d"]), r"\s+", " ")), 1, most)
    return F.nullif(F.array_join(F.transform(coded, one), " | "), F.lit(""))


def edge_counts(text: Column) -> tuple[Column, Column]:
    """(address edges, name edges) out of an evidence text; 0 where it doesn't say."""
    pattern = r"(\d+) address-based and (\d+) name-based"
    return tuple(F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("int"), F.lit(0)) for k in (1, 2))
