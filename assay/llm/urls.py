"""URL filter: rules first, else a logistic regression on hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from assay.llm.common import LOWER, UPPER, arrow_stage

# The rules of the registered query, (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The labelled table is small; more rows than this are refused, not sampled.
MAX_LABELLED = 100_000
#: Rules are laid out as an expression, so their number is bounded.
MAX_RULES = 2_000

# Words of the labelled table, put into the shapes below. None is
# taken from the hosts of the test tables; "casino" alone is also part of one.
UNWANTED = (
    "casino", "casino-online", "online-casino", "casinos", "royal-casino", "poker", "slots", "jackpot", "roulette", "blackjack", "bingo", "betting",
    "gambling", "sportsbook", "wager", "lottery", "xxx", "escort", "porn", "sexcam", "camgirls", "hookup", "nudes", "erotic", "pharma", "viagra",
    "cialis", "xanax", "tramadol", "steroids", "weight-loss", "miracle-cure", "clicks", "popunder", "popup", "banner", "doubleclick", "affiliate",
    "beacon", "telemetry", "clickbait", "payday-loan", "quick-cash", "get-rich", "bitcoin-doubler", "forex-profit", "replica-watch", "knockoff",
    "counterfeit", "torrent-crack", "keygen", "warez", "serial-key", "nulled", "malware", "spyware", "botnet", "phishing", "sweepstake", "fake-id",
)
WANTED = (
    "news", "weather", "library", "museum", "school", "history", "science", "travel", "kitchen", "garden", "docs", "forum", "journal", "archive",
    "recipes", "football", "music", "health", "energy", "theatre", "nation", "tables", "stories", "station", "tree", "hands", "strand", "stone",
    "instant", "honest", "whale", "white", "where", "when", "winter", "water", "ocean", "reading", "writing", "engine", "ancient", "month", "north",
    "south", "earth", "shelter", "fresh", "ground", "around", "thunder", "north-sea", "old-town", "open-data", "bakery", "cycling", "hospital",
    "university", "gallery", "parliament", "physics", "chess", "bridge", "harbour", "village", "orchestra", "painting", "language", "dictionary",
)
SHAPES = (
    "http://{}.example.com/en/12", "https://www.{}.example.org/de/345/", "https://blog.{}.example.com/fr/67.html", "http://m.{}.example.org/es/8?page=2&ref=x",
    "https://{}.example.net/en/904?utm_source=feed", "https://{}.example.org/fr/51#top",
)


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: ``(url, 1 = block)``."""
    return [(shape.format(word), y) for words, y in ((UNWANTED, 1), (WANTED, 0)) for word in words for shape in SHAPES]


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    rules = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in reversed(rules):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class UrlModel:
    """Weights of hashed character n-grams of host and path."""

    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...]

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        return np.array([self.bias + self.weights[features(h, p, self.sizes, len(self.weights))].sum() for h, p in zip(hosts, paths)])


def features(host: str, path: str, sizes: tuple[int, ...], buckets: int) -> np.ndarray:
    """Distinct buckets of the n-grams; host and path do not share them."""
    grams = set()
    for mark, part in (("h", host), ("p", path)):
        part = f"^{part}$"
        for n in sizes:
            grams.update(mark + part[i : i + n] for i in range(len(part) - n + 1))
    return np.unique(np.array([xxhash.xxh32_intdigest(g.encode("utf-8", "surrogatepass")) % buckets for g in grams], np.int64))


def fit(hosts: list[str], paths: list[str], labels: list[int], sizes: tuple[int, ...] = (3, 4, 5), buckets: int = 1 << 16, l2: float = 0.05, rounds: int = 800) -> UrlModel:
    """Batch gradient steps with momentum on the regularised logistic loss."""
    rows = [features(h, p, sizes, buckets) for h, p in zip(hosts, paths)]
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows) if rows else np.empty(0, np.int64)
    used, column = np.unique(column, return_inverse=True)
    y = np.asarray(labels, float)
    scale = 1 / np.sqrt(max(1, max((len(r) for r in rows), default=1)))
    w, b, vw, vb = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    for _ in range(rounds if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(scale * np.bincount(at, w[column], len(rows)) + b, -40, 40)))
        gap = p - y
        gw = scale * np.bincount(column, gap[at], len(used)) / len(y) + l2 * 1e-3 * w
        vw, vb = 0.9 * vw - 2.0 * gw, 0.9 * vb - 0.5 * gap.mean()
        w, b = w + vw, b + vb
    weights = np.zeros(buckets)
    weights[used] = scale * w
    return UrlModel(weights, float(b), sizes)


def train_url_model(labelled: DataFrame, url: str = "url", label: str = "label", **knobs) -> UrlModel:
    """Fit on a small labelled table (at most ``MAX_LABELLED`` rows). Rows
    without a url or label say nothing."""
    rows = labelled.select(url_host(F.col(url)), url_path(F.col(url)), F.col(label).cast("int")).where(F.col(url).isNotNull() & F.col(label).isNotNull())
    rows = sorted(tuple(r) for r in rows.limit(MAX_LABELLED + 1).collect())
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled urls")
    return fit([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], **knobs)


def judge_urls(pages: DataFrame, model: UrlModel, row_id: str = "page_id", url: str = "url", rules: Iterable[tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """``row_id, host, path, rule, verdict, score`` for every row.

    A rule's verdict stands; else a url is blocked where the model's probability
    reaches ``threshold``. A null url or one without ``://`` has an empty host
    and path and is judged by the model like any other. Repeated rows are judged
    alike, only the two named columns are read, an empty table gives no rows.
    """
    parts = pages.select(F.col(row_id).alias("_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("rule", rule).withColumn("said", said)
    weights = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size: one weight per bucket

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = weights.value.scores(batch.column("host").to_pylist(), batch.column("path").to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], [*batch.schema.names, "score"])

    id_type = pages.schema[row_id].dataType.simpleString()
    judged = arrow_stage(parts, f"_id {id_type}, host string, path string, rule string, said string, score double", step)
    return judged.select(
        F.col("_id").alias(row_id), "host", "path", "rule",
        F.coalesce("said", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score",
    )
