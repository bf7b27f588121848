"""Text functions as Columns: words, sentences, cues, snippets, headings, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a word is a run of letters and digits that may keep a dot or apostrophe inside.
WORD = r"[a-z0-9]+(?:[.'][a-z0-9]+)*"
#: Cues that take back what a sentence says.
NEGATION_CUES = (
    r"\bno clinically (?:significant|meaningful|relevant|important)\b",
    r"\bnot clinically (?:significant|meaningful|relevant|important)\b",
    r"\bno (?:significant|meaningful|relevant) (?:effect|interaction|change|increase|prolongation)",
    r"\bno (?:dose|dosage) adjustment(?:s)? (?:is|are|was|were)? ?(?:needed|necessary|required|recommended)",
    r"\bdoes not (?:require|need) (?:a )?(?:dose|dosage) adjustment",
    r"\bno (?:evidence|reports?|cases?) of\b",
    r"\bnot (?:been )?(?:associated|observed|reported|seen|expected)\b",
    r"\bdid not (?:prolong|increase|affect|alter|result in|cause)\b",
    r"\bdoes not (?:prolong|increase|affect|alter|cause)\b",
    r"\bis not (?:a )?(?:controlled|scheduled)\b",
    r"\bnot a controlled substance\b",
    r"\bnot (?:expected|known|likely) to\b",
    r"\bwithout (?:clinically )?(?:significant|meaningful)\b",
    r"\bwas not (?:observed|seen|reported|detected|found)\b",
    r"\bwere not (?:observed|seen|reported|detected|found)\b",
    r"\bunlikely to\b",
    r"\bno interaction",
)
NEGATED = "(?iU)" + "|".join(NEGATION_CUES)
#: Fixed value: characters before a place in which a cue counts for it.
NEAR = 120
#: Abbreviations after which the plain splitter does not cut, in any case and also as the end of a longer word.
PROTECTED = ("e.g.", "i.e.", "vs.", "approx.", "etc.", "mg.", "no.", "dr.", "fig.", "spp.")
_PROTECTED = "(?i)(" + "|".join(a[:-1].replace(".", r"\.") for a in PROTECTED) + r")\."
#: Section headings and reference marks before an evidence sentence.
_MARK = r"^\s*(?:\(\s*\d+(?:\.\d+)*\s*\)\s*)+(?:•\s*)?"
_HEADING = r"^\s*\d*\s*(?:WARNINGS AND PRECAUTIONS|WARNINGS AND CAUTIONS|DRUG INTERACTIONS|CONTRAINDICATIONS|PRECAUTIONS|WARNINGS|BOXED WARNING)\s+"


def tokens(text: Column) -> Column:
    """Words of a text in order, lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def plain_sentences(text: Column) -> Column:
    """Sentences by the plain rule: after . ! or ? and a space, before a capital, digit, bracket or quote; abbreviations are kept whole."""
    t = F.regexp_replace(collapse(text), _PROTECTED, "$1\u0001")
    pieces = F.split(t, r"(?<=[.!?]) (?=[A-Z0-9(\[\"'])")
    return F.filter(F.transform(pieces, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def negated(sentence: Column) -> Column:
    """Whether any cue stands anywhere in a sentence."""
    return sentence.rlike(NEGATED)


def negated_near(sentence: Column, at: Column, window: int = NEAR) -> Column:
    """Whether a cue stands within the window before a place (characters before it)."""
    begin = F.greatest(at - window, F.lit(0))
    return negated(F.substring(sentence, begin + 1, at - begin))


def strip_heading(sentence: Column) -> Column:
    """An evidence sentence without the reference mark or section heading before it."""
    return F.trim(F.regexp_replace(F.regexp_replace(sentence, _MARK, ""), _HEADING, ""))


def section_text(entries: Column) -> Column:
    """Entries of a section joined by spaces, '' for none."""
    return F.trim(F.array_join(F.coalesce(entries, F.array().cast("array<string>")), " "))


def first_or_empty(values: Column) -> Column:
    """The first of some values, '' for none."""
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def searchable(*parts: Column) -> Column:
    """Sections and names of a document as one text, empty ones left out."""
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def clauses(sentence: Column, selfish: str = "") -> Column:
    """The parts of a sentence between bullets, trimmed, without empty ones and those that only speak of the drug itself."""
    parts = F.filter(F.transform(F.split(sentence, "•"), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(parts, lambda x: ~x.rlike(selfish)) if selfish else parts


def whole_word(text: Column, word: Column) -> Column:
    """Whether a text holds a word as a whole, case aside."""
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"(?U)(^|\W)\Q"), F.lower(word), F.lit(r"\E($|\W)")))


def snippet(body: Column, terms: Column, radius: int = 80) -> Column:
    """radius characters on both sides of the earliest place of any term, the head of the text if there is none, trimmed; cut
    edges are marked. '' for no text."""
    low = F.lower(body)
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.position(t, low)), lambda p: p > 0)) - 1
    begin = F.greatest(F.coalesce(at, F.lit(0)) - radius, F.lit(0))
    end = F.least(F.coalesce(at + radius, F.lit(2 * radius)), F.length(body))
    inner = F.regexp_replace(F.substring(body, begin + 1, end - begin), r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.concat(F.when(begin > 0, "…").otherwise(""), inner, F.when(end < F.length(body), "…").otherwise("")), F.lit(""))


def strip_tags(html: Column) -> Column:
    """Markup replaced by spaces, the usual entities decoded, white space collapsed."""
    t = F.regexp_replace(html, r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def first_percent(text: Column) -> Column:
    """The first percentage in a text, as a double."""
    return F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)\s*%", 1).try_cast("double")


def cell_percent(cell: Column) -> Column:
    """The percentage of a table cell: the last number in brackets, else the last one with a percent sign; null without any."""
    last = lambda p: F.try_element_at(F.regexp_extract_all(cell, F.lit(p), F.lit(1)), F.lit(-1))
    return F.coalesce(last(r"\(([0-9]+(?:\.[0-9]+)?)\s*%?\)"), last(r"([0-9]+(?:\.[0-9]+)?)\s*%")).try_cast("double")


def cache_key(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)
