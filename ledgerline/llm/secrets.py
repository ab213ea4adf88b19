"""Secret scan with corpus-wide ownership frequency, by DataFrame functions alone.

Patterns find candidates in whole texts; the hash of each candidate's value is counted over the corpus by distinct
repositories and owners. A value that many owners carry is a copied example, one that a single owner carries is theirs
and, when it looks random, live. Generic high-entropy tokens become findings only when ownership says so.

Defined results. A null text has no findings. A null owner or repository counts as one of its own named ''. Repeated
rows each get their row and count once as owner and repository. Empty tables give empty tables. Extra columns, of any
name, pass through :func:`scan`; its own columns replace columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm._common import checkpoint, table


@dataclass(frozen=True)
class Kind:
    """A pattern whose matches are kept where ``group`` has at least ``least`` characters."""

    name: str
    pattern: str
    group: int
    least: int


#: In the order in which spans that start together are listed.
BASE = (
    Kind("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Tokens of which only ownership tells whether they are credentials.
GENERIC = Kind("owned", "[A-Za-z0-9+/_-]{20,}", 0, 20)
#: A value is copied if at least so many owners carry it, and an owner's own if at most so many do.
COPIED_OWNERS, OWN_OWNERS = 3, 1
#: Distinct characters of a value that looks random.
RANDOM_CHARACTERS = 10
BLOCK = 256


def starts_of(lengths: Column) -> Column:
    """For an array of lengths, the sums of all before each; in blocks, so that the work is not quadratic."""
    n = F.size(lengths)
    blocks = F.when(n > 0, F.sequence(F.lit(0), ((n - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    add = lambda a, x: a + x
    sums = F.transform(blocks, lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, BLOCK), F.lit(0), add))
    before = F.aggregate(
        sums,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["all"], a["at"]).alias("all")),
        lambda a: a["all"],
    )
    inner = lambda b: F.transform(
        F.sequence(F.lit(0), F.least(F.lit(BLOCK), n - b * BLOCK) - 1),
        lambda i: F.get(before, b) + F.when(i > 0, F.aggregate(F.slice(lengths, b * BLOCK + 1, i), F.lit(0), add)).otherwise(F.lit(0)),
    )
    return F.flatten(F.transform(blocks, inner))


def matches(text: Column, kind: Kind, index: int) -> Column:
    """Spans of one kind in a text: array of (start, end, rank, kind, h), in code points, end exclusive; h is the
    SHA-256 of the value."""
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else whole
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)
    found = F.transform(whole, F.length)
    # a match begins after the gaps up to it and the matches before it
    starts = starts_of(F.zip_with(gaps, found, lambda g, m: g + F.coalesce(m, F.lit(0))))
    zipped = F.transform(
        F.arrays_zip(whole.alias("whole"), value.alias("value"), F.slice(starts, 1, F.size(whole)).alias("at"), F.slice(gaps, 1, F.size(whole)).alias("gap")),
        lambda m: F.struct(
            (m["at"] + m["gap"]).alias("start"),
            (m["at"] + m["gap"] + F.length(m["whole"])).alias("end"),
            F.lit(index).alias("rank"),
            F.lit(kind.name).alias("kind"),
            F.sha2(m["value"], 256).alias("h"),
            m["value"].alias("value"),
        ),
    )
    kept = F.filter(zipped, lambda m: F.length(m["value"]) >= kind.least)
    if kind is GENERIC:
        kept = F.filter(kept, lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))
    looks = F.transform(
        kept,
        lambda m: F.struct(m["start"], m["end"], m["rank"], m["kind"], m["h"], (F.size(F.array_distinct(F.split(m["value"], ""))) >= RANDOM_CHARACTERS).alias("random")),
    )
    none = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,h:string,random:boolean>>")
    return F.when(F.coalesce(text.rlike(kind.pattern), F.lit(False)), looks).otherwise(none)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def candidates(documents: DataFrame, text: str, owner: str, repository: list[str], keys: list[str]) -> DataFrame:
    """Narrow rows: the keys, owner, repository, base spans, and tokens that overlap none of them."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    who = F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit(""))
    repo = F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(f"`{r}`").cast("string"), F.lit("")) for r in repository]), 256)
    found = documents.select(
        *[F.col(f"`{k}`") for k in keys],
        who.alias("_owner"),
        repo.alias("_repo"),
        *[matches(t, k, i).alias(f"_{k.name}") for i, k in enumerate(BASE)],
        matches(t, GENERIC, len(BASE)).alias("_generic"),
    )
    base = F.array_sort(F.concat(*[F.col(f"_{k.name}") for k in BASE]))
    apart = F.filter("_generic", lambda g: ~F.exists("_base", lambda b: (b["start"] < g["end"]) & (g["start"] < b["end"])))
    return found.withColumn("_base", base).withColumn("_generic", apart)


def scan(documents: DataFrame, text: str = "text", owner: str = "source", repository: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """One row per row of ``documents`` with ``keys``, counts per kind, ``base`` and ``spans`` (arrays of start, end,
    kind, verdict and the numbers of owners and repositories of the value). Verdicts: ``example`` for values that many
    owners carry, ``live`` for random-looking ones of one owner, else ``shared``."""
    repository, keys = repository or [owner, "doc_id"], keys or ["doc_id"]
    found = checkpoint(candidates(documents, text, owner, repository, keys).withColumn("_row", F.monotonically_increasing_id()))
    found = found.withColumn("_all", F.concat("_base", "_generic"))
    rows = found.where(F.size("_all") > 0).select("_row", "_owner", "_repo", F.explode("_all").alias("_c")).withColumn("_h", F.col("_c.h"))
    # distinct first, so that no value's rows meet in one task before they are few
    owners = rows.groupBy("_h", "_owner").agg(F.lit(1).alias("one")).groupBy("_h").agg(F.count("*").alias("n_owners"))
    repos = rows.groupBy("_h", "_repo").agg(F.count("*").alias("n")).groupBy("_h").agg(F.count("*").alias("n_repos"), F.sum("n").alias("n_copies"))
    judged = rows.join(owners.join(repos, "_h"), "_h").withColumn(
        "_verdict",
        F.when(F.col("n_owners") >= COPIED_OWNERS, "example").when((F.col("n_owners") <= OWN_OWNERS) & F.col("_c.random"), "live").otherwise("shared"),
    )
    judged = judged.where((F.col("_c.kind") != GENERIC.name) | (F.col("_verdict") == "live"))
    span = F.struct("_c.start", "_c.end", "_c.rank", "_c.kind", F.col("_verdict").alias("verdict"), "n_owners", "n_repos", "n_copies")
    spans = judged.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    out = found.join(spans, "_row", "left").withColumn("spans", F.coalesce("spans", empty))
    counts = [F.size(f"_{k.name}").cast("long").alias(f"n_{k.name}") for k in BASE]
    return out.select(*[F.col(f"`{k}`") for k in keys], *counts, F.col("_base").alias("base"), "spans")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    of = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        of("live").alias("n_live"), of("example").alias("n_example"),
    )
