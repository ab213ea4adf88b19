"""URL filter: prefix rules first, then a logistic regression on hashed character n-grams of host and path.

Defined results. A null url, or one without ``://``, has an empty host and an empty path, fits no rule and gets the
verdict ``allow``. Repeated rows each get their row. Empty tables give empty tables. Other columns pass through; the
columns ``host path rule verdict`` are written last and replace columns of those names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm._common import bound_batches, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

#: Rules that are compiled into one expression; more are joined as a table, with the same results.
COMPILED_RULES = 200

#: The small labelled table: hosts and paths as they are written for each class.
BLOCKED_URLS = """
https://casino-royal.test/slots/bonus https://www.online-casino.test/play http://best-casino-win.test/en/12
https://poker-bets.test/free https://free-bets.test/odds/today http://m.free-betting.test/de/55
https://bet-now.test/sports https://win-jackpot.test/spin http://lottery-win.test/claim
https://cheap-pills.test/buy http://www.cheap-meds.test/viagra https://pills-online.test/order
https://pharma-discount.test/cialis http://buy-viagra.test/now https://rx-pills.test/shop
https://adult-x.test/video https://www.adult-cams.test/live http://xxx-movies.test/watch
https://hot-adult.test/gallery https://sexy-chat.test/room http://porn-x.test/tube
https://ads-track.test/click https://track-ads.test/pixel http://www.adserver.test/banner
https://clicktracker.test/c/1 https://pop-ads.test/serve http://trk-click.test/r
https://spam-farm.test/links https://link-farm.test/seo http://www.seo-spam.test/backlinks
https://spam-mail.test/list https://doorway-farm.test/page https://content-farm.test/en/9
http://malware-load.test/setup.exe https://free-crack.test/keygen http://warez-dl.test/serial
https://phish-login.test/bank http://secure-verify-account.test/login https://payday-loans.test/apply
https://fast-cash-loan.test/now http://get-rich-quick.test/join https://replica-watches.test/rolex
""".split()
ALLOWED_URLS = """
https://www.university.test/en/courses https://library.test/catalog/88 http://museum.test/en/history
https://blog.gardening.test/en/tomatoes https://news.daily.test/2021/05/story http://www.weather.test/today
https://docs.python-guide.test/tutorial https://wiki.open.test/page/physics http://m.recipes.test/de/brot
https://www.cityhall.test/services https://school.test/fr/classe https://hospital.test/en/patients
http://blog.travel.test/es/viaje https://research.test/papers/2020 https://www.theatre.test/tickets
https://music.test/albums/12 http://books.test/en/novels https://forum.coding.test/thread/991
https://www.railways.test/timetable https://maps.test/berlin http://science.test/en/biology
https://journal.test/volume/7 https://www.parliament.test/bills https://opera.test/programme
http://football.test/en/league https://www.bakery.test/menu https://m.cinema.test/fr/films
https://garden.test/en/roses https://history.test/de/mittelalter http://astronomy.test/en/stars
https://www.engineers.test/standards https://painting.test/es/arte https://chess.test/en/openings
http://blog.knitting.test/en/scarf https://www.airport.test/arrivals https://sailing.test/boats
https://cooking.test/en/soup https://www.economics.test/lectures http://radio.test/live
https://rivers.test/en/danube https://zoo.test/animals https://www.language.test/fr/grammaire
""".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table as (url, label); 1 means block."""
    rows = [(u, 1) for u in BLOCKED_URLS] + [(u, 0) for u in ALLOWED_URLS]
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 2)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as :func:`host_of` and :func:`path_of` give them, for the small table on the driver."""
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(str.maketrans(UPPER, LOWER)), m[2]) if m else ("", "")


def rule_column(host: Column, path: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """The text and verdict of the longest rule that fits; nulls where none does. Of equally long ones the longer host,
    then the lesser text wins."""
    rules = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(rules):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def rule_rows(urls: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """(host, path, rule, told) of the distinct hosts and paths that a rule fits, by a join of the host's suffixes with the
    rules' hosts; the choice among rules is that of :func:`rule_column`."""
    known = urls.sparkSession.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "r_host string, r_path string, told string")
    label = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(label)), lambda k: F.array_join(F.slice(label, k, F.size(label)), "."))
    fits = urls.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes)).join(known, F.col("suffix") == F.col("r_host"))
    text = F.concat("r_host", "r_path")
    best = F.min(F.struct((-F.length(text)).alias("a"), (-F.length("r_host")).alias("b"), text.alias("rule"), F.col("told").alias("told")))
    found = fits.where(F.col("path").startswith(F.col("r_path"))).groupBy("host", "path").agg(best.alias("best"))
    return found.select("host", "path", "best.rule", "best.told")


@dataclass(frozen=True)
class NgramModel:
    """weights over 2**bits hashed n-grams, and the intercept."""

    weights: np.ndarray
    bias: float
    low: int
    high: int

    def _sum(self, mark: str, text: str) -> tuple[float, int]:
        slots = ngram_slots(mark, text, self.low, self.high, len(self.weights))
        return float(self.weights[slots].sum()), len(slots)

    def scores(self, hosts: Iterable[str], paths: Iterable[str]) -> np.ndarray:
        """Probability of block; 0 for an empty host, of which nothing is known."""
        of_host = lru_cache(maxsize=50_000)(lambda h: self._sum("h", h))
        out = []
        for host, path in zip(hosts, paths, strict=True):
            if not host:
                out.append(0.0)
                continue
            (a, n), (b, m) = of_host(host), self._sum("p", path)
            out.append(1 / (1 + np.exp(-((a + b) / np.sqrt(n + m) + self.bias))))
        return np.array(out, dtype=float)


def ngram_slots(mark: str, text: str, low: int, high: int, slots: int) -> list[int]:
    """Slots of the character n-grams of the marked text; digits count as one character, so ids do not matter."""
    data = ("^" + re.sub(r"\d", "0", text) + "$").encode()
    seed = zlib.crc32(mark.encode())
    return [zlib.crc32(data[i : i + n], seed) % slots for n in range(low, high + 1) for i in range(len(data) - n + 1)]


def train(labelled: DataFrame, low: int = 3, high: int = 5, bits: int = 15, rounds: int = 400, rate: float = 2.0, l2: float = 1e-4, max_rows: int = 20_000) -> NgramModel:
    """Full-batch logistic regression over the labelled table, of which at most ``max_rows`` rows (in url order) are
    taken; rows with a null url or label teach nothing. An empty table gives a model that allows everything."""
    rows = labelled.where("url is not null and label is not null").select("url", "label").distinct().orderBy("url", "label").limit(max_rows).collect()
    slots = 1 << bits
    weights, bias = np.zeros(slots), 0.0
    if not rows or len({r.label for r in rows}) < 2:
        return NgramModel(weights, 5.0 if rows and rows[0].label else -5.0, low, high)
    at, which, value, y = [], [], [], np.array([float(r.label) for r in rows])
    for k, r in enumerate(rows):
        host, path = split_url(r.url)
        own = ngram_slots("h", host, low, high, slots) + ngram_slots("p", path, low, high, slots)
        at += own
        which += [k] * len(own)
        value += [1 / np.sqrt(max(1, len(own)))] * len(own)
    at, which, value = np.array(at), np.array(which), np.array(value)
    for _ in range(rounds):
        z = np.bincount(which, weights[at] * value, len(y)) + bias
        error = 1 / (1 + np.exp(-z)) - y
        weights -= rate * (np.bincount(at, error[which] * value, slots) / len(y) + l2 * weights)
        bias -= rate * error.mean()
    return NgramModel(weights, float(bias), low, high)


def filter_urls(pages: DataFrame, labelled: DataFrame, url: str = "url", rules: Iterable[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, score (probability of block) and verdict: the rule's, else the model's."""
    spark = pages.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(train(labelled))

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            yield pd.Series(model.value.scores(hosts, paths))

    c = F.col(f"`{url}`")
    rest = [x for x in pages.columns if x not in ("host", "path", "rule", "score", "verdict")]
    out = pages.select(*[F.col(f"`{x}`") for x in rest], host_of(c).alias("host"), path_of(c).alias("path"))
    rules = list(rules)
    if len(rules) > COMPILED_RULES:
        row = out.select(F.struct(*[F.col(f"`{x}`") for x in rest]).alias("row"), "host", "path")
        out = row.join(rule_rows(row, rules), ["host", "path"], "left").select("row.*", "host", "path", "rule", score("host", "path").alias("score"), F.col("told").alias("verdict"))
    else:
        rule, told = rule_column(F.col("host"), F.col("path"), rules)
        out = out.withColumns({"rule": rule, "score": score("host", "path"), "verdict": told})
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict", "score")
