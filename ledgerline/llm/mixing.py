"""Mixing sources to target weights by Poisson replication.

Each source gets a target share of a character budget; the share over what the source has is its mean repetition rate.
A document's number of copies inverts the Poisson distribution with that mean at a point hashed from the seed and the
document, so it does not depend on order, partitions or retries. Copies are exploded and shuffled globally by a hash.

Rates above ``PART`` are drawn as the sum of equal parts, which is again Poisson, and keeps exp() and the table of the
distribution small.

Defined results. A null source is a source of its own; null and empty texts count no characters; a source without
characters has rate 1. Rows that repeat a document repeat its draw. Empty tables give empty tables. Extra columns pass
through; ``n_copies copy rate shuffle_key`` replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm._common import scratch, table

PART = 16.0
#: Beyond this a Poisson number of mean PART does not fall for a point of 52 bits.
LONGEST = 80
SEED = "mix-1"


def rates(documents: DataFrame, source: str = "source", text: str = "text", weights: dict[str, float] | None = None, temperature: float = 0.5, budget: float | None = None) -> DataFrame:
    """One row per source: its rate, the number of parts and the distribution function of a part at 0, 1, 2 ...

    ``weights`` names target weights; a source that it does not name has weight 0. Without it, a source's weight is its
    number of characters to the power ``temperature``. ``budget`` is the number of characters aimed at, all by default.
    """
    sizes = documents.groupBy(F.col(f"`{source}`").cast("string").alias("source")).agg(F.sum(F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long")).alias("chars"))
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(float(temperature)))
    else:
        named = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(named, F.coalesce("source", F.lit(""))), F.lit(0.0))
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("weight").alias("all_weights"), F.sum("chars").alias("all_chars"))
    aim = F.lit(float(budget)) if budget is not None else F.col("all_chars").cast("double")
    rate = F.when((F.col("chars") > 0) & (F.col("all_weights") > 0), F.col("weight") / F.col("all_weights") * aim / F.col("chars")).when(F.col("chars") > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    out = sizes.crossJoin(F.broadcast(total)).select("source", rate.alias("rate"))  # one row of sums
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int"))).withColumn("mean", F.col("rate") / F.col("parts"))
    return out.select("source", "rate", "parts", distribution(F.col("mean")).alias("cdf"))


def distribution(mean: Column) -> Column:
    """Poisson distribution function at 0 .. LONGEST - 1."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.array_append(a["all"], a["c"] + p).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LONGEST - 1)), start, step, lambda a: a["all"])


def point(key: Column) -> Column:
    """A number in [0, 1) of 52 bits from a text."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(documents: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", seed: str = SEED, **options) -> DataFrame:
    """``documents``, each as often as its draw says, in a global random order, with n_copies, copy (from 1), rate and
    shuffle_key."""
    spark = documents.sparkSession
    path = scratch(spark, "rates")
    rates(documents, source, text, **options).write.parquet(path)
    per_source = spark.read.parquet(path)  # its size on disk decides whether Spark broadcasts it or shuffles
    rest = [F.col(f"`{c}`") for c in documents.columns if c not in ("n_copies", "copy", "rate", "shuffle_key")]
    own = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    rows = documents.select(F.struct(*rest).alias("_row"), F.col(f"`{source}`").cast("string").alias("_source"), own.alias("_own"))
    rows = rows.join(per_source, F.col("_source").eqNullSafe(F.col("source")))
    draw = lambda j: F.size(F.filter("cdf", lambda c: c <= point(F.concat_ws("|", F.col("_own"), j.cast("string")))))
    n = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), draw), F.lit(0), lambda a, x: a + x)
    rows = rows.select("_row", "_own", "rate", n.alias("n_copies")).where("n_copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit("order"), "_own", F.col("copy").cast("string"))))
    return rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select("_row.*", "n_copies", "copy", "rate", "shuffle_key")


def copies(documents: DataFrame, **options) -> DataFrame:
    """The copies of :func:`mix` with the documents' own columns only."""
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("own"))
    named = {options.pop(k, d): d for k, d in (("source", "source"), ("text", "text"), ("key", "doc_id"))}
    return mix(whole.select("own", *[F.col("own")[c].alias(d) for c, d in named.items()]), **options).select("own.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "lang", "source", "n_copies", "copy", F.round("rate", 6).alias("rate"), "shuffle_key")


ORACLE = f"""
WITH sizes AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents GROUP BY source),
weighed AS (SELECT source, chars, pow(chars, 0.5) AS weight FROM sizes),
rated AS (
  SELECT source, CASE WHEN chars > 0 THEN weight / (SELECT sum(weight) FROM weighed) * (SELECT sum(chars) FROM weighed) / chars ELSE 1 END AS rate
  FROM weighed
),
split AS (SELECT source, rate, greatest(1, CAST(ceil(rate / 16) AS INT)) AS parts, rate / greatest(1, ceil(rate / 16)) AS mean FROM rated),
terms AS (
  SELECT source, k, sum(CASE WHEN k = 0 THEN 0 ELSE ln(mean) - ln(k) END) OVER (PARTITION BY source ORDER BY k) - mean AS log_p
  FROM split, (SELECT unnest(range(0, {LONGEST})) AS k)
),
cdf AS (SELECT source, list(c ORDER BY k) AS cdf FROM (SELECT source, k, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source),
keyed AS (
  SELECT d.*, rate, parts, cdf, '{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) AS own
  FROM documents d JOIN split s ON d.source IS NOT DISTINCT FROM s.source JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source
),
drawn AS (
  SELECT *, CAST(list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cdf, lambda c: c <= CAST('0x' || substr(md5(own || '|' || CAST(j AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0)))) AS INT) AS n_copies
  FROM keyed
),
copied AS (SELECT *, CAST(unnest(range(1, n_copies + 1)) AS INT) AS copy FROM drawn WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_copies, copy, round(rate, 6) AS rate, md5('order|' || own || '|' || CAST(copy AS VARCHAR)) AS shuffle_key FROM copied
"""
