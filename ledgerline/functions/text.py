"""Text normal forms as column expressions: typography, sentences, words, titles, fingerprints."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic characters and what they fold to.
TYPOGRAPHY = (" ‘’“”–—", " ''\"\"--")
#: Abbreviations whose periods end no sentence, wherever they stand.
ABBREVIATIONS = ("Cal. App.", "Co.", "Corp.", "Dr.", "Inc.", "Jr.", "Ltd.", "Mr.", "Mrs.", "Ms.", "No.", "Prof.", "Sr.", "Sup.", "U.S.", "U.K.", "e.g.", "i.e.")
#: Words that a title need not capitalise, and the share of the others that makes a title.
CONNECTORS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "with")
TITLE_SHARE = 0.65
#: Words that carry no topic.
STOP_WORDS = tuple(
    "a an and are as at be been being by can could did do does for from had has have in into is it its may of on or our "
    "should that the their these they this those to was we were which will with would you your".split()
)
_STOP = frozenset(STOP_WORDS)
BULLET = r"(?m)^[^\S\n]*(?:[•◦▪‣⁃∙●][^\S\n]*|[-*][^\S\n]+(?=[A-Za-z]))"


def fold_typography(text: Column) -> Column:
    return F.translate(text, *TYPOGRAPHY)


def squeeze(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _sentence_end() -> str:
    """The white space between two sentences: after a stop and before a capital, digit or opening quote, unless the stop
    belongs to an abbreviation, to a letter by itself that a capital or digit follows, to initials, or to the number of a
    note that opens a quoted title."""
    inner = [a[: a.index(" ")] + r"(?= " + re.escape(a[a.index(" ") + 1 :]) + ")" for a in ABBREVIATIONS if " " in a]
    whole = [re.escape(a) for a in ABBREVIATIONS]
    kept = [f"(?<={x})" for x in whole] + [rf"(?<={re.escape(x.split('(?=')[0])})(?={x.split('(?=')[1][:-1]})" for x in inner]
    kept += [r"(?<=\b[A-Za-z]\.)(?= [A-Z0-9])", r"(?<=\b[A-Z]\.[A-Z]\.)", rf'(?<="[^"]{{0,200}}\b[Nn][Oo][Tt][Ee] \d{{1,3}}\.)(?= [A-Za-z])']
    return rf"(?!{'|'.join(kept)})(?<=[.!?]) (?=[\"'(\[]?[A-Z0-9])"


def sentences(text: Column) -> Column:
    """The sentences of a text, in order. A bullet begins one of its own."""
    t = F.regexp_replace(squeeze(fold_typography(F.coalesce(text, F.lit("")))), " ?• ?", "•")
    parts = F.split(t, rf"(?=•)|{_sentence_end()}")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, "^•", "• "))), lambda p: p != "")


def sentence_key(sentence: Column) -> Column:
    """What makes two sentences the same."""
    return F.lower(squeeze(fold_typography(sentence)))


def full_text_key(text: Column) -> Column:
    """A text without list marks that lead lines, white space squeezed; case and all words stay."""
    return squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), BULLET, ""))


def words(text: Column) -> Column:
    """Lower-case words with their contractions."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w+(?:['’]\w+)*\b"), F.lit(0))


def terms(text: Column) -> Column:
    """Words of two or more ASCII characters that are no stop words, then their bigrams."""
    w = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z][a-z0-9]+"), F.lit(0)), lambda x: ~x.isin(*STOP_WORDS))
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(w, F.slice(pairs, 1, F.greatest(F.size(w) - 1, F.lit(0))))


def term_list(text: str | None) -> Counter[str]:
    """The same terms, counted, for walks in Python."""
    w = [x for x in re.findall("[a-z][a-z0-9]+", (text or "").lower()) if x not in _STOP]
    return Counter(w) + Counter(map(" ".join, zip(w, w[1:])))


def word_overlap(left: Column, right: Column) -> Column:
    """Jaccard similarity of the sets of white-space separated words; 0 where either has none."""
    own = lambda t: F.array_distinct(F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: w != ""))
    a, b = own(left), own(right)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns' JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def title_case_share(text: Column) -> Column:
    """Share of the words, connectors aside, that begin with a capital or have a capital or digit further on; 0 without
    words."""
    w = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9'’&.-]*"), F.lit(0))
    w = F.filter(w, lambda x: ~F.lower(x).isin(*CONNECTORS))
    return F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.filter(w, lambda x: x.rlike("^[A-Z]|^.+[A-Z0-9]"))) / F.size(w))


def looks_like_title(text: Column) -> Column:
    return title_case_share(text) >= TITLE_SHARE


def item_number(item: Column) -> tuple[Column, Column]:
    """Sort key of an item such as 1A: its number (999 without one) and the rest."""
    number = F.try_to_number(F.nullif(F.regexp_extract(item, r"^(\d+)", 1), F.lit("")), F.lit("999")).cast("int")
    return F.coalesce(number, F.lit(999)), F.when(number.isNull(), item).otherwise(F.regexp_extract(item, r"^\d+([A-Z]*)", 1))


def excerpt(text: Column, most: int) -> Column:
    """At most so many characters, cut at the last word boundary."""
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(F.substring(text, 1, most), r"\s+\S*\z", ""))


def safe_cell(text: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula; numbers with a sign stay."""
    formula = text.rlike(r"^\s*[=+@-]") & ~text.rlike(r"^\s*[-+]?[0-9][0-9,.]*%?\s*$")
    return F.when(formula, F.concat(F.lit("'"), text)).otherwise(text)
