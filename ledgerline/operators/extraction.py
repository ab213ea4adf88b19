"""Blocks of filings as records: headings and references in order, footnotes put in, sentences fitted to their paragraphs,
passages found again. Walks that depend on what came before run over one document's rows at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import headings
from ledgerline.functions import text as T

#: Broad items and the narrower ones whose blocks they lose.
NARROWER = {"1": ("1A", "7", "8", "15"), "7": ("8", "15")}
MARK = re.compile(r"\[\[FNREF:(\d{1,3})\]\]")


def item_headings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The lines of texts that are headings of items."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "t"))
    item, title = headings.item_heading(F.col("t"))
    return lines.select(key, "line", item.alias("item"), title.alias("title")).where("item is not null")


def table_references(rows: DataFrame, table: str, row: str, text: str, wanted: list[str]) -> DataFrame:
    """Rows of tables with the item they are under: the last one named, in the row or above it. Rows of one place go by what
    they name, those without an item first, so that the result never depends on the order in which they are read."""
    own = F.nullif(F.upper(F.regexp_extract(text, r"(?i)\bitem\s+(\d{1,2}[A-C]?)\b", 1)), F.lit(""))
    w = Window.partitionBy(table).orderBy(row, own).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("item", F.last(own, ignorenulls=True).over(w)).where(F.col("item").isin(*wanted))


def without_broad_overlaps(sections: DataFrame, document: str, item: str, block: list[str]) -> DataFrame:
    """Sections in which broad items lack the blocks that narrower ones have."""
    pairs = [(b, n) for b, narrow in NARROWER.items() for n in narrow]
    which = F.explode(F.array(*[F.struct(F.lit(b).alias("broad"), F.lit(n).alias("narrow")) for b, n in pairs])).alias("p")
    held = sections.select(document, *block, F.col(item).alias("_i"), which).where(F.col("_i") == F.col("p.narrow")).select(document, *block, F.col("p.broad").alias(item)).distinct()
    return sections.join(held, [document, item, *block], "left_anti")


def followed(references: DataFrame, sections: DataFrame, document: str, title: str) -> DataFrame:
    """References with the section of the referred document that has their title, numbers of notes aside; nulls where none
    or several have it."""
    key = lambda c: headings.section_key(F.lit(""), F.col(c))
    found = sections.withColumn("_k", key(title)).groupBy(document, "_k").agg(F.count("*").alias("_n"), F.min("section").alias("section")).where("_n = 1")
    return references.withColumn("_k", key(title)).join(found, [document, "_k"], "left").drop("_k", "_n")


def joins_next(before: Column, after: Column, heading_before: Column, heading_after: Column) -> Column:
    """Whether a block goes on in the next: neither is a heading, and a list goes on, a mark has its text to come, or the
    first does not end a sentence."""
    bullet = r"^\s*(?:[•◦▪‣●]|[-*]\s)"
    lone = F.trim(before).rlike(r"^[•◦▪‣●*-]$")
    open_end = ~F.rtrim(before).rlike(r"[.!?:;][\"')\]]*$")
    return ~heading_before & ~heading_after & (after.rlike(bullet) | lone | (~before.rlike(bullet) & open_end))


def is_subheader(text: Column, bold: Column, underlined: Column, italic: Column, size: Column, heading_tag: Column) -> Column:
    """Whether a block is a heading below an item: short, no sentence, no list, and set apart by its style or its capitals."""
    words = F.size(F.split(F.trim(text), r"\s+"))
    short = F.length(F.trim(text)).between(1, 140) & (words <= 14) & ~F.trim(text).rlike(r"[.!?]$") & ~text.rlike(r"^\s*[•◦▪‣●]")
    item, _ = headings.item_heading(text)
    introduces = F.trim(text).endswith(":") & (F.contains(text, F.lit(",")) & text.rlike(r"\b[a-z][a-z'-]+\b") | text.rlike(r"(?i)\b(reflecting|driven by|due to|because of|as follows|the following|includes?|consists? of|comprised of)\b.*:\s*$"))
    title = T.looks_like_title(text)
    styled = heading_tag | bold | title | (italic & words.between(2, 8) & text.rlike(r"^\W*[A-Z]")) | ((F.coalesce(size, F.lit(0.0)) >= 10) & title) | (underlined & title)
    small = text.rlike(r"(?i)\b(or|and|the|a|an|of|to|for|with|from|in|on)\b") & ~bold & ~heading_tag & ~title & ~italic
    return short & item.isNull() & ~headings.is_boilerplate(text) & (heading_tag | ~introduces) & styled & ~small


def inlined_footnotes(blocks: DataFrame, document: str, order: str, text: str) -> DataFrame:
    """Blocks with their footnotes in place of the references to them: the first definition after a reference gives the note
    and is no block any more; references that find none say so. ``blocks`` has the definition's number and note
    (``note_no``, ``note``), null in other blocks. A document's blocks are walked in one task."""

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        waiting: dict[int, list[int]] = {}
        for r in part.sort_values(order).itertuples(index=False):
            body, number = getattr(r, text) or "", r.note_no
            if pd.notna(number) and int(number) in waiting:
                for k in waiting.pop(int(number)):
                    out[k][2] = put_in(out[k][2], int(number), f"[footnote {int(number)}: {r.note}]")
                continue
            for n in dict.fromkeys(int(m) for m in MARK.findall(body)):
                waiting.setdefault(n, []).append(len(out))
            out.append([getattr(r, document), getattr(r, order), body])
        for number, places in waiting.items():
            for k in places:
                out[k][2] = put_in(out[k][2], number, f"[footnote {number}]")
        return pd.DataFrame(out, columns=[document, order, text])

    rows = blocks.select(document, order, text, "note_no", "note")
    return rows.groupBy(document).applyInPandas(walk, rows.select(document, order, text).schema)


def put_in(text: str, number: int, note: str) -> str:
    return " ".join(text.replace(f"[[FNREF:{number}]]", f" {note} ").split())


def bullet_levels(items: DataFrame, document: str, order: str, indent: str, tolerance: float = 0.1) -> DataFrame:
    """Levels of list items by their indents: deeper than the open ones is one level more; a lesser indent closes those that
    are deeper; one that fits none in between opens its own."""

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        open_: list[float] = []
        out = []
        for x in part[indent]:
            while open_ and x < open_[-1] - tolerance:
                open_.pop()
            if not open_ or x > open_[-1] + tolerance:
                open_.append(x)
            out.append(len(open_))
        return part.assign(level=pd.Series(out, index=part.index, dtype="int32"))

    rows = items.select(document, order, indent)
    return rows.groupBy(document).applyInPandas(walk, rows.withColumn("level", F.lit(0)).schema)


def repaired_spaces(text: Column) -> Column:
    """A space after a period between a word and a capitalised one, but in addresses and names of hosts."""
    kept = r"(?:https?://|ftp://|www\.)\S+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|\b[\w-]+\.(?i:com|org|net|gov|edu|io|co|ai)\b"
    pieces = F.regexp_extract_all(text, F.lit(rf"({kept}|(?:(?!{kept})[\s\S])+)"), F.lit(1))
    fixed = F.transform(pieces, lambda p: F.when(p.rlike(rf"^(?:{kept})$"), p).otherwise(F.regexp_replace(p, r"([A-Za-z]{2,}\.)([A-Z][a-z])", "$1 $2")))
    return F.array_join(fixed, "")


def tolerant(sentence: str) -> re.Pattern | None:
    """A pattern that finds a sentence whatever its white space, hyphens included, at word boundaries."""
    words = sentence.split()
    if not words:
        return None
    loose = r"\s+".join(r"\s*-\s*".join(re.escape(p) for p in w.split("-")) for w in words)
    loose = loose.replace(r"\s*-\s*\s+", r"\s*-\s*").replace(r"\s+\s*-\s*", r"\s*-\s*")
    head, tail = r"(?<!\w)" if sentence.strip()[0].isalnum() else "", r"(?!\w)" if sentence.strip()[-1].isalnum() else ""
    return re.compile(head + loose + tail)


def fitted_sentence(sentence: str | None, paragraph: str | None) -> str | None:
    """The paragraph's own form of a sentence, if just one place of it fits; an empty sentence is itself."""
    if not sentence or not sentence.strip():
        return sentence
    if re.search(r"(?<!\w)" * sentence[0].isalnum() + re.escape(sentence) + r"(?!\w)" * sentence[-1].isalnum(), paragraph or ""):
        return sentence
    found = tolerant(sentence).findall(paragraph or "")
    return found[0] if len(found) == 1 else None


def reconciled(sentences: Column, paragraph: Column) -> Column:
    """The sentences of a paragraph in its own form; the whole paragraph where any of them is not in it just once."""

    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for units, texts in parts:
            out = []
            for own, text in zip(units, texts, strict=True):
                held = [fitted_sentence(s, text) for s in ([] if own is None else own)]
                out.append(held if held and all(h is not None for h in held) else [text] if text else [])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(of, "array<string>")(sentences, paragraph)


def seams(batches: DataFrame, order: str, section: list[str]) -> DataFrame:
    """Pairs of neighbouring batches of one section, numbered in order."""
    w = Window.partitionBy(*section).orderBy(order)
    pairs = batches.select(*section, F.col(order).alias("left"), F.lead(order).over(w).alias("right")).where(F.col("right") == F.col("left") + 1)
    return pairs.withColumn("seam", F.row_number().over(w.orderBy("left")))


def seam_context(paragraphs: DataFrame, batch: str, position: str, size: str, k: int, most: int) -> DataFrame:
    """Of each batch the last and the first ``k`` paragraphs as context for its neighbours, as far as they fit ``most``
    characters, counted from the seam."""
    out = None
    for side, order in (("before", F.desc(position)), ("after", F.asc(position))):
        w = Window.partitionBy(batch).orderBy(order)
        near = paragraphs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
        held = near.withColumn("_upto", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("_upto") <= most)
        own = held.select(batch, position, F.lit(side).alias("side"))
        out = own if out is None else out.unionByName(own)
    return out


def exact_cover(groups: DataFrame, candidates: DataFrame, candidate: str, group: str, resolved: str) -> DataFrame:
    """What is wrong with an answer that groups candidates: ids that are unknown, left out or in several groups, and groups of
    several that are not resolved."""
    told = groups.groupBy(candidate).agg(F.count("*").alias("n"))
    both = candidates.select(candidate, F.lit(True).alias("_c")).join(told, candidate, "full_outer")
    ids = both.select(F.col(candidate).cast("string").alias("id"), F.when(F.col("_c").isNull(), "unknown").when(F.col("n").isNull(), "omitted").when(F.col("n") > 1, "repeated").alias("problem"))
    open_ = groups.groupBy(group).agg(F.count("*").alias("n"), F.every(resolved).alias("ok")).where("n > 1 and not ok")
    return ids.where("problem is not null").unionByName(open_.select(F.col(group).cast("string").alias("id"), F.lit("unresolved").alias("problem")))


def merged_candidates(members: DataFrame, group: str, section: str, units: str, sources: str) -> DataFrame:
    """Groups of candidates as one: the union of their units, in order, and of their sources; valid if they are of one section
    and share no unit."""
    held = members.groupBy(group).agg(F.flatten(F.collect_list(units)).alias("u"), F.array_sort(F.collect_set(sources)).alias("sources"), F.count_distinct(section).alias("sections"), F.count("*").alias("n"))
    return held.select(group, F.array_sort(F.array_distinct("u")).alias("units"), "sources", ((F.col("sections") == 1) & (F.size(F.array_distinct("u")) == F.size("u"))).alias("valid"), "n")


def relocated(notes: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Notes on old passages with the record that has their text now. The records of the note's item are looked at, if it has
    any, and of those with its title, if any; several that fit give the old id if it is among them, else the first.

    ``notes``: key, text, old_id, item, title; ``records``: id, item, title, position, text."""
    r = records.select("id", F.col("item").alias("r_item"), F.col("title").alias("r_title"), "position", T.sentence_key(F.col("text")).alias("whole"))
    n = notes.withColumn("want", T.sentence_key(F.col("text")))
    # each note's choice of item and title is settled before texts meet
    items, titles = r.select(F.col("r_item").alias("item"), F.lit(True).alias("has_item")).distinct(), r.select(F.col("r_item").alias("item"), F.col("r_title").alias("title"), F.lit(True).alias("has_title")).distinct()
    n = n.join(items, "item", "left").join(titles, ["item", "title"], "left").where("has_item is not null")
    near = n.join(r, (n.item == r.r_item) & (n.has_title.isNull() | (n.title == r.r_title)))
    hit = near.where((F.col("want") != "") & F.contains("whole", "want")).groupBy(key).agg(F.count("*").alias("matches"), F.min(F.struct((F.col("id") != F.col("old_id")).alias("other"), "position", "id")).alias("best"))
    out = notes.join(hit, key, "left")
    status = F.when(F.trim(F.col("text")) == "", "no_text").when(F.col("matches").isNull(), "no_match").when(F.col("matches") == 1, "exact_text_match").when(F.col("best.id") == F.col("old_id"), "multiple_matches_kept_same_id").otherwise("multiple_matches_used_first")
    return out.select(key, F.coalesce("best.id", "old_id").alias("id"), status.alias("status"), F.coalesce("matches", F.lit(0)).alias("matches"))


def spanning_match(records: DataFrame, document: str, position: str, text: str, wanted: Column) -> DataFrame:
    """The records of a document over which a passage runs, if it runs over several that follow each other."""
    norm = T.sentence_key(F.col(text))
    w = Window.partitionBy(document).orderBy(position)
    own = records.select(document, position, norm.alias("t"), wanted.alias("want")).withColumn("end", F.sum(F.length("t") + 1).over(w)).withColumn("begin", F.col("end") - F.length("t") - 1)
    whole = own.groupBy(document).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, "t"))), lambda x: x["t"]), " ").alias("all"), F.first("want").alias("want"))
    at = whole.select(document, (F.expr("locate(want, all)") - 1).alias("at"), F.length("want").alias("n")).where("at >= 0 and n > 0")
    return own.join(at, document).where((F.col("end") - 1 > F.col("at")) & (F.col("begin") < F.col("at") + F.col("n"))).groupBy(document).agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("records"))


def paragraph_context(notes: DataFrame, records: DataFrame, key: str, ids: str) -> DataFrame:
    """Notes with the texts of the paragraphs whose ids they name, in order, and how many of them were found."""
    named = notes.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(ids), F.lit("")), F.lit(r"(P\d+)"), F.lit(1)))).alias("id"))
    told = named.join(records.select("id", "position", "text"), "id", "left").groupBy(key).agg(F.count("*").alias("asked"), F.count("position").alias("found"), F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", "id", "text")))).alias("_told"))
    out = notes.join(told, key, "left")
    kind = F.when(F.col("found") == 1, "single_chunk").otherwise("multi_chunk")
    status = F.when(F.col("asked").isNull(), "no_id").when(F.col("found") == 0, "id_not_found").when(F.col("found") < F.col("asked"), F.concat(kind, F.lit("_partial"))).otherwise(kind)
    return out.select(*notes.columns, F.array_join(F.transform("_told", lambda x: x["id"]), ", ").alias("context_ids"), F.array_join(F.transform("_told", lambda x: x["text"]), "\n").alias("context"), status.alias("status"))


# ---- outlines and records --------------------------------------------------------------------------------------------


def outline(headings_: DataFrame, document: str, order: str, level: str, title: str) -> DataFrame:
    """Headings with where their part ends: before the next one of their level or above (open at the document's end). Headings
    of a document meet each other only."""
    own = headings_.select(document, order, level, title)
    later = own.select(F.col(document).alias("_d"), F.col(order).alias("_o"), F.col(level).alias("_l"))
    both = own.join(later, (F.col(document) == F.col("_d")) & (F.col("_o") > F.col(order)) & (F.col("_l") <= F.col(level)), "left")
    return both.groupBy(document, order, level, title).agg(F.min("_o").alias("end"))


def indexed_sections(index: DataFrame, outline_: DataFrame, blocks: DataFrame, document: str, order: str, title: str, pages: DataFrame) -> DataFrame:
    """Blocks of items by a cross-reference index: its titles name parts of the outline; of these the blocks on the pages that
    the index allows, each once per item, in order."""
    key = lambda c: headings.section_key(F.lit(""), F.col(c))
    parts = outline_.select(document, F.col(order).alias("_begin"), "end", key(title).alias("_k"))
    named = index.select(document, "item", key(title).alias("_k")).join(parts, [document, "_k"])
    inside = blocks.join(named, document).where((F.col(order) >= F.col("_begin")) & (F.col("end").isNull() | (F.col(order) < F.col("end"))))
    return inside.join(pages.select(document, "item", "page").distinct(), [document, "item", "page"], "left_semi").select(document, "item", order, "text").distinct()


#: How much the styles of headings stand out, least first.
STYLE_RANKS = ("plain", "italic", "underlined", "bold", "bold_underlined")


def closes(size: Column, style: Column, caps: Column, open_size: Column, open_style: Column, open_caps: Column, tolerance: float = 0.1) -> Column:
    """Whether a heading ends the part of an open one: a larger one does, of equal size one whose style stands out as much or
    more; an underlined one in capitals outranks others of any size."""
    rank = lambda c: F.array_position(F.array(*[F.lit(s) for s in STYLE_RANKS]), c)
    top = lambda s, c: F.contains(s, F.lit("underlined")) & c
    by_size = F.when(size.isNull(), False).when(open_size.isNull(), True).when(size > open_size + tolerance, True).when(size < open_size - tolerance, False)
    by_style = F.when(rank(style) != rank(open_style), rank(style) > rank(open_style)).otherwise(caps | ~open_caps)
    return F.when(top(open_style, open_caps) & ~top(style, caps), False).when(top(style, caps) & ~F.contains(open_style, F.lit("underlined")) & ~open_caps, True).otherwise(F.coalesce(by_size, by_style))


def records(blocks: DataFrame, document: str, item: str, order: str, year: Column, company: Column) -> DataFrame:
    """Blocks as records: numbered within their item, with ids that name company, year, item and number."""
    w = Window.partitionBy(document, item).orderBy(order)
    number = F.row_number().over(w)
    return blocks.withColumn("index", number).withColumn("id", F.concat_ws("_", F.lower(company), year.cast("string"), item, F.format_string("P%03d", "index")))


def sentence_records(chunks: DataFrame, chunk: str, sentences: Column) -> DataFrame:
    """A record for each sentence of a chunk, numbered from one; a chunk without any has one empty record."""
    cut = chunks.select(chunk, F.posexplode_outer(sentences).alias("_k", "sentence"))
    number = F.format_string("%02d", F.coalesce("_k", F.lit(0)) + 1)
    return cut.select(chunk, F.concat(chunk, F.lit("_S"), number).alias("sentence_id"), F.coalesce("sentence", F.lit("")).alias("sentence"))


def compacted(analysis: Column) -> Column:
    """A change analysis in one shape, whatever wrote it: label, reason and method, from its JSON with the label at the top,
    under its method, or as a bare text."""
    at = lambda *paths: F.coalesce(*[F.nullif(F.trim(F.get_json_object(analysis, p)), F.lit("")) for p in paths])
    bare = F.when(~F.trim(analysis).startswith("{"), F.nullif(F.trim(F.replace(analysis, F.lit('"'), F.lit(""))), F.lit("")))
    method = F.when(F.get_json_object(analysis, "$.llm").isNotNull(), "llm").when(F.get_json_object(analysis, "$.semantic").isNotNull(), "semantic").when(F.get_json_object(analysis, "$.lexical").isNotNull(), "lexical")
    label = F.coalesce(at("$.label", "$.change_type", "$.llm.label", "$.semantic.label", "$.lexical.label", "$.llm", "$.semantic", "$.lexical"), bare)
    return F.struct(F.when(~label.startswith("{"), label).alias("label"), at("$.reason", "$.rationale", "$.llm.reason", "$.semantic.rationale").alias("reason"), F.coalesce(at("$.method"), method).alias("method"))


def enriched(notes: DataFrame, records_: DataFrame, key: str, sides: dict[str, str]) -> DataFrame:
    """Notes with the paragraphs that each side's ids name: ``sides`` maps a side to its column of ids; records have a
    ``side``."""
    out = notes
    for side, ids in sides.items():
        told = paragraph_context(notes.select(key, ids), records_.where(F.col("side") == side), key, ids)
        out = out.join(told.select(key, F.col("context").alias(f"{side}_context"), F.col("status").alias(f"{side}_status")), key, "left")
    return out
