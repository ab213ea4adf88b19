"""Headings, pointers, footnotes and page numbers of filings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions import text as T

#: The items of an annual report.
ITEMS = ("1", "1A", "1B", "1C", "2", "3", "4", "5", "6", "7", "7A", "8", "9", "9A", "9B", "9C", "15", "16")
_NUMBER = "|".join(sorted(ITEMS, key=lambda i: (-len(i), i)))
HEADING = rf"(?is)^\s*(?:part\s+[ivx]+\s*[.,:-]?\s*)?item\s+({_NUMBER})\b\s*[.:)-]?\s*(.{{0,140}}?)\s*$"
#: Items that may only point elsewhere, how many blocks and characters such an item has at most, phrases that
#: point, and what they point to.
POINTING_ITEMS = ("7", "8")
POINTER_BLOCKS, POINTER_CHARACTERS = 3, 450
POINTING_PHRASES = ("refer to", "referred to", "see", "appear on page", "appear on pages", "appears on page", "appears on pages", "included on page", "included on pages", "set forth", "incorporated by reference")
PLACES = ("management's discussion", "financial statement", "financial statements", "note to", "notes to", "annual report", "appendix", "exhibit")
NUMBERED_PLACES = ("page", "pages", "item")
#: The mark that a reference to a footnote leaves in a text, and the least characters of a note.
FOOTNOTE_MARK, LEAST_NOTE = "FNREF", 8
FOLIO = r"(?i)^\s*(?:page\s+(\d{1,4})(?:\s+of\s+\d+)?|-\s*(\d{1,4})\s*-)\s*$"
BOILERPLATE = r"(?i)^\s*(table of contents|back to (top|contents)|index to financial statements|\(continued\)|forward-looking statements? page)\s*$"


def item_heading(text: Column) -> tuple[Column, Column]:
    """Item and title of a heading; nulls where a text is none."""
    item = F.nullif(F.upper(F.regexp_extract(text, HEADING, 1)), F.lit(""))
    return item, F.when(item.isNotNull(), F.regexp_extract(text, HEADING, 2))


def phrase_in(padded: Column, phrases: tuple[str, ...]) -> Column:
    """Whether any phrase is among the words of a text that signs_to_spaces gave."""
    return F.exists(F.array(*[F.lit(f" {signs(p)} ") for p in phrases]), lambda p: F.contains(padded, p))


def signs(phrase: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in phrase.lower()).split())


def signs_to_spaces(text: Column) -> Column:
    """The words of a text in lower case, one space around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))


def is_pointer(item: Column, text: Column, blocks: Column) -> Column:
    """Whether an item says no more than where its content is: it is short, and its first sentence has a pointing phrase
    and a place. The phrases are looked for among the sentence's words."""
    whole = T.squeeze(T.fold_typography(text))
    short = blocks.between(1, POINTER_BLOCKS) & F.length(whole).between(1, POINTER_CHARACTERS)
    first = signs_to_spaces(F.regexp_extract(whole, r"^.*?(?:[.!?](?= )|$)", 0))
    numbered = first.rlike(rf" (?:{'|'.join(NUMBERED_PLACES)}) \d")
    return item.isin(*POINTING_ITEMS) & short & phrase_in(first, POINTING_PHRASES) & (phrase_in(first, PLACES) | numbered)


def footnote(text: Column) -> tuple[Column, Column]:
    """Number and text of a footnote's definition: a marked, bracketed or bare number of up to three digits at the start,
    and a note behind it. A bare number ends at a space or a capital. Nulls for other texts and for short notes."""
    t = T.squeeze(text)
    marked = F.regexp_extract(t, rf"^\[\[{FOOTNOTE_MARK}:(\d{{1,3}})\]\]", 1)
    bracketed = F.regexp_extract(t, r"^[(\[](\d{1,3})[)\]]", 1)
    bare = F.regexp_extract(t, r"^(\d{1,3})(?=[ A-Z])", 1)
    some = lambda c: F.nullif(c, F.lit(""))
    number = F.coalesce(some(marked), some(bracketed), some(bare))
    begin = F.when(marked != "", F.length(marked) + len(FOOTNOTE_MARK) + 5).when(bracketed != "", F.length(bracketed) + 2).otherwise(F.length(bare))
    note = F.trim(F.substr(t, begin + 1))
    fits = number.isNotNull() & (F.length(note) >= LEAST_NOTE)
    return F.when(fits, number.cast("int")), F.when(fits, note)


def footnote_marks(text: Column) -> Column:
    """The numbers of the footnotes that a text refers to."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"\[\[{FOOTNOTE_MARK}:(\d{{1,3}})\]\]"), F.lit(1)), lambda n: n.cast("int"))


def page_number(text: Column) -> Column:
    """The number of a labelled page mark."""
    found = F.coalesce(F.nullif(F.regexp_extract(text, FOLIO, 1), F.lit("")), F.nullif(F.regexp_extract(text, FOLIO, 2), F.lit("")))
    return found.cast("int")


def is_boilerplate(text: Column) -> Column:
    return text.rlike(BOILERPLATE)


def section_key(item: Column, title: Column) -> Column:
    """A title without its note's number, so that renumbered notes stay the same."""
    plain = F.regexp_replace(F.lower(T.squeeze(T.fold_typography(title))), r"^note\s+\d+[a-z]?\s*[.:-]*\s*", "")
    return F.concat_ws(":", F.upper(F.trim(item)), F.regexp_replace(plain, r"[\s.:;-]+$", ""))


def introduces_table(text: Column, sentences: Column) -> Column:
    """A single sentence that ends with a colon."""
    return (sentences == 1) & F.rtrim(text).endswith(":")
