"""URL filters: host and path rules first, a small linear model for the rest.

Method. Logistic regression on hashed character n-grams of host and path, trained in
numpy from a small table of labelled URLs. Rules override it: a rule fits its host
and all subdomains where the path starts with the rule's; the longest rule wins.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is judged
by the model alone. Repeated rows are judged alike. An empty table gives an empty table.
Of fitting rules of equal length the one that comes last in text order wins. Result
columns replace input columns of the same name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import without
from strandlake.session import ship

BUCKETS = 1 << 14
BLOCK_FROM = 0.5

#: (host, path, verdict)
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

#: The labelled table: 1 is unwanted. Hosts made up of what such hosts tend to say, and of what others do.
_UNWANTED = (
    "cheap pills casino bonus spam farm free money xxx adult viagra replica betting bets loan payday seo links warez crack ads track tracker click popup lottery jackpot poker slots win prize escort dating diet "
    "fake promo deals discount"
).split()
_WANTED = (
    "news blog docs wiki library school museum weather recipes science garden history travel music review forum health sports university city radio journal archive gallery study nature theatre maps trains books "
    "river mountain stone field wood bridge"
).split()
_PLAIN = "rivermoon thornfield stationhill anderwell blendish mentoran enterly ouralia kestrel tionary theread handing innerst orwell sherating nderley inghat ereston athion ontheran current tenant northland mount accent patient agent merchant fluent plant thunder earth".split()


def labelled_urls() -> list[tuple[str, int]]:
    """Both kinds of host under the same prefixes, domains and paths, so that only the names tell them apart."""
    prefixes, domains, langs, ends = ("", "www.", "m.", "blog."), ("com", "net", "org"), ("en", "fr", "de", "es"), ("", "/", ".html", "?page=2&ref=x", "#top")
    hosts = [(f"{w}{'-' if i % 3 else ''}{words[(i + k) % len(words)]}", y) for y, words in ((1, _UNWANTED), (0, _WANTED)) for i, w in enumerate(words) for k in (3, 11)]
    hosts += [(w + x, 0) for w in _PLAIN for x in ("", "en")]
    out = []
    for i, (host, y) in enumerate(hosts):
        for k in range(4):
            n = i + 5 * k
            out.append((f"http{'s' * (n % 2)}://{prefixes[(i + k) % 4]}{host}.example.{domains[n % 3]}/{langs[(n // 3) % 4]}/{(37 * n) % 1000}{ends[n % 5]}", y))
    return out


_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = _HOST.match(rest).group()
    return host.translate(_LOWER), _PATH.match(rest, len(host)).group()


def ngrams(host: str, path: str) -> list[int]:
    """Buckets of the character n-grams of host and path."""
    out = set()
    for kind, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        out.update(zlib.crc32(f"{kind}{s[i : i + n]}".encode("utf-8", "surrogatepass")) % BUCKETS for n in (3, 4, 5) for i in range(len(s) - n + 1))
    return sorted(out)


class UrlModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, table: list[tuple[str, int]], steps: int = 400, rate: float = 0.05, ridge: float = 2e-4) -> UrlModel:
        x = [ngrams(*split_url(u)) for u, _ in table]
        row = np.repeat(np.arange(len(x)), [len(v) for v in x])
        col = np.concatenate([np.array(v, np.int64) for v in x])
        scale = 1 / np.sqrt(np.bincount(row, minlength=len(x)))
        y = np.array([b for _, b in table], np.float64)
        w, bias, mean, square = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), np.zeros(BUCKETS)
        for step in range(1, steps + 1):
            z = scale * np.bincount(row, w[col], len(x)) + bias
            pull = y - 1 / (1 + np.exp(-z))
            g = np.bincount(col, (scale * pull)[row], BUCKETS) / len(x) - ridge * w
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            w += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
            bias += 0.5 * pull.mean()
        return cls(w, float(bias))

    def score(self, host: str, path: str) -> float:
        at = ngrams(host, path)
        z = self.weights[at].sum() / np.sqrt(max(1, len(at))) + self.bias
        return float(1 / (1 + np.exp(-z)))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null without any."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None, table: list[tuple[str, int]] | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (of the model)."""
    ship(pages.sparkSession)
    model = UrlModel.fit(table if table is not None else labelled_urls())
    pages = without(pages, "host", "path", "rule", "verdict", "score")
    names, at = pages.columns, pages.columns.index(url)
    inner = pages.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType([*inner.schema.fields, T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([model.score(*x) for x in parts], pa.float64())], names=schema.names)

    out = inner.mapInArrow(run, schema).toDF(*names, "host", "path", "score")
    fit = rule_for(F.col("host"), F.col("path"), RULES if rules is None else rules)
    return out.select(*[F.col(f"`{c}`") for c in names], "host", "path", fit["rule"].alias("rule"), F.coalesce(fit["verdict"], F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")).alias("verdict"), "score")
