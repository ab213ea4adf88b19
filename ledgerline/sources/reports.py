"""Report files and stores of the pipeline's stages: checked readers, exports by status, embedding caches, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import headings
from ledgerline.functions import text as X
from ledgerline.sources import stores

DISCLOSURE = "disclosure_id string, item string, section string, summary string, content string, sentence_ids array<string>"
ALIGNMENT = "match_id string, status string, previous_ids array<string>, current_ids array<string>, review_reasons array<string>"
FINDING = "title string, text string, evidence array<string>"


def faults(checks: dict[str, Column]) -> Column:
    """The names of the checks that a row fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))


def must(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The rows, if all of them pass; the first that does not fails the job and says what is wrong with it."""
    wrong = faults(checks)
    return rows.where(F.when(F.size(wrong) > 0, F.raise_error(F.concat(F.lit("a record fails: "), F.array_join(wrong, ", "))).cast("boolean")).otherwise(F.lit(True)))


def read_disclosures(spark: SparkSession, folder: str, company: str, year: int) -> DataFrame:
    """A company's disclosures of a year: the finished ones and those for review, with that as their status. Ids must name
    the company and year."""
    out = None
    for name, status in (("disclosures", "finalized"), ("needs_review", "needs_review")):
        own = stores.read_records(spark, f"{folder}/{name}.json", T._parse_datatype_string(DISCLOSURE)).withColumn("status", F.lit(status))
        out = own if out is None else out.unionByName(own)
    pattern = rf"^{company.lower()}_{year}_\w+$"
    return must(out, {"id": F.lower("disclosure_id").rlike(pattern), "item": F.trim("item") != "", "content": F.trim("content") != ""})


def read_alignments(spark: SparkSession, path: str, company: str, previous: int, current: int) -> DataFrame:
    """The rows of an alignment report: known statuses, members of the two years on their sides, reasons where and only
    where a review is asked for."""
    rows = stores.read_records(spark, path, T._parse_datatype_string(ALIGNMENT))
    of = lambda c, year: F.forall(c, lambda x: F.lower(x).startswith(f"{company.lower()}_{year}_"))
    return must(rows, {
        "status": F.col("status").isin("auto_matched", "ai_verified", "unmatched", "needs_review"),
        "previous": of("previous_ids", previous), "current": of("current_ids", current),
        "members": F.size("previous_ids") + F.size("current_ids") > 0,
        "reasons": (F.col("status") == "needs_review") == (F.size("review_reasons") > 0),
    })


def read_synthesis(spark: SparkSession, path: str, company: str) -> DataFrame:
    """The findings of a synthesis report. Evidence must be the company's own."""
    rows = stores.read_records(spark, path, T._parse_datatype_string(FINDING))
    own = F.forall("evidence", lambda e: F.lower(e).startswith(f"{company.lower()}_"))
    return must(rows, {"title": F.trim("title") != "", "text": F.trim("text") != "", "own evidence": own & (F.size("evidence") > 0)})


def read_export(spark: SparkSession, path: str, expected_cik: str | None = None) -> DataFrame:
    """A metric export: amounts as exact decimals, never by way of floats; what is no number fails; the issuer is checked."""
    schema = "cik string, concept string, unit string, period string, value string, status string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("allowNonNumericNumbers", False).json(path)
    exact = F.col("value").try_cast("decimal(38,10)")
    checks = {"value": exact.isNotNull() | ((F.col("status") == "nil") & F.col("value").isNull())}
    if expected_cik is not None:
        checks["cik"] = F.lpad("cik", 10, "0") == expected_cik.zfill(10)
    return must(rows, checks).withColumn("value", exact)


def filtered_export(rows: DataFrame, company: str | None = None, year: int | None = None, extraction: str | None = None) -> DataFrame:
    """An immutable export's rows by any of the three filters."""
    for column, value in (("company", company), ("year", year), ("extraction_id", extraction)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def write_by_status(rows: DataFrame, path: str, status: str = "status") -> None:
    """Rows as JSON, a folder for each status."""
    rows.write.mode("overwrite").partitionBy(status).json(path)


def write_differences(differences: DataFrame, path: str) -> None:
    """A comparison's sentences: all of them, and a folder of JSON and of text for each item."""
    differences.write.mode("overwrite").json(f"{path}/all_items")
    differences.write.mode("overwrite").partitionBy("item").json(f"{path}/by_item")
    lines = differences.select("item", F.concat(F.when(F.col("side") == "new", "+ ").otherwise("- "), X.squeeze(F.col("sentence"))).alias("value"))
    lines.write.mode("overwrite").partitionBy("item").text(f"{path}/text")


def write_chunks(chunks: DataFrame, sentences: DataFrame, path: str) -> int:
    """Chunks and sentences as JSON, and their texts; gives how many sentences are not in their chunk as they stand."""
    chunks.write.mode("overwrite").json(f"{path}/chunks")
    sentences.write.mode("overwrite").json(f"{path}/sentences")
    chunks.select(F.concat_ws("\n", F.concat(F.lit("["), "id", F.lit("]")), "text").alias("value")).write.mode("overwrite").text(f"{path}/text")
    whole = chunks.select(F.col("id").alias("chunk_id"), F.col("text").alias("whole"))
    return sentences.join(whole, "chunk_id").where(~F.contains("whole", "text")).count()


# ---- embeddings ------------------------------------------------------------------------------------------------------


def embedding_key(model: Column | str, text: Column) -> Column:
    """The name under which a text's vector is kept: model and text, parted by a character that neither has."""
    return F.sha2(F.concat(F.lit(model) if isinstance(model, str) else model, F.lit("\u0000"), text), 256)


def cached_vectors(texts: DataFrame, cache: DataFrame, model: str, text: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Texts with their cached vectors, and those that have none (each text once). A vector of another length fails."""
    keyed = texts.withColumn("key", embedding_key(model, F.col(text)))
    found = must(keyed.join(cache.select("key", "vector"), "key"), {"dimension": F.size("vector") == dimension})
    lost = keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"]).select("key", text)
    return found, lost


def changed_texts(rows: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, text) whose text is new or other than the one that was embedded (key, text_sha256)."""
    own = rows.withColumn("text_sha256", F.sha2("text", 256))
    old = stored.select(*key, F.col("text_sha256").alias("_old"))
    return own.join(old, key, "left").where(~F.col("text_sha256").eqNullSafe(F.col("_old"))).drop("_old")


# ---- artifacts -------------------------------------------------------------------------------------------------------


class Artifacts:
    """Small named texts below a folder of any store that Hadoop reaches; a put replaces a name at once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.conf, self.folder = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder.rstrip("/")

    def _path(self, name: str):
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"not a name: {name}")
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _store(self):
        return self._path("x").getFileSystem(self.conf)

    def put(self, name: str, text: str) -> None:
        stream = self._store().create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def get(self, name: str) -> str | None:
        store, path = self._store(), self._path(name)
        if not store.exists(path):
            return None
        stream = store.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self, prefix: str = "") -> list[str]:
        store, root = self._store(), self.jvm.org.apache.hadoop.fs.Path(self.folder)
        if not store.exists(root):
            return []
        top, found, out = store.makeQualified(root).toString(), store.listFiles(root, True), []
        while found.hasNext():
            name = found.next().getPath().toString()[len(top) + 1 :]
            if name.startswith(prefix) and not name.split("/")[-1].startswith("."):
                out.append(name)
        return sorted(out)

    def move(self, old: str, new: str) -> bool:
        store = self._store()
        if not store.exists(self._path(old)):
            return False
        store.mkdirs(self._path(new).getParent())
        return store.rename(self._path(old), self._path(new))


# ---- filings as text -------------------------------------------------------------------------------------------------


def normal_source(source: Column) -> Column:
    """A filing's address without the inline viewer in front of it, query and fragment."""
    viewer = F.regexp_extract(source, r"(?i)[?&]doc=([^&#]+)", 1)
    return F.regexp_replace(F.when(viewer != "", viewer).otherwise(source), r"[?#].*$", "")


def structure_events(blocks: DataFrame, document: str, order: str, tag: str, text: str) -> DataFrame:
    """Headings and tables of a document, in order, with the item that a heading opens."""
    item, title = headings.item_heading(F.col(text))
    kind = F.when(F.col(tag).rlike("^h[1-6]$") | item.isNotNull(), "heading").when(F.col(tag) == "table", "table")
    return blocks.select(document, order, kind.alias("kind"), item.alias("item"), F.coalesce(title, F.col(text)).alias("title")).where("kind is not null")


def clean_text(blocks: DataFrame, document: str, order: str, text: str) -> DataFrame:
    """A document's blocks as one text, a line each; headings of items stand after an empty line. The blocks of a document are
    gathered in order."""
    item, title = headings.item_heading(F.col(text))
    line = F.when(item.isNotNull(), F.concat(F.lit("\nItem "), item, F.lit(". "), title)).otherwise(X.squeeze(F.col(text)))
    held = blocks.select(document, order, line.alias("line")).where("line <> ''").groupBy(document).agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("b"))
    return held.select(document, F.ltrim(F.array_join(F.transform("b", lambda b: b["line"]), "\n")).alias("text"))
