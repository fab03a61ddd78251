"""URL filter: listed rules first, else logistic regression on hashed character n-grams of host and path.

The main path is DataFrame functions only.  The model is fitted once, on the
driver, on a small table of labelled URLs (a parameter), by plain gradient
descent; its weights are rounded to whole millionths so that a score is a sum of
integers, the same in any order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules, as verdict, host and path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A small labelled table; 1 is to be blocked.
LABELLED = (
    ("https://www.city-library.example.org/en/opening-hours", 0), ("https://blog.garden.example.org/de/2021/herbst.html", 0),
    ("http://www.physics.example.edu/en/lectures/12/", 0), ("https://docs.compiler.example.org/en/reference", 0),
    ("https://m.museum.example.net/de/ausstellung/44", 0), ("https://news.valley.example.net/en/2020/03/river", 0),
    ("http://recipes.example.org/fr/soupe-du-jour.html", 0), ("https://www.school.example.org/es/calendario", 0),
    ("https://history.example.net/en/1066.html", 0), ("https://blog.birds.example.net/de/zugvogel/", 0),
    ("https://therapy.example.org/en/7539/", 0), ("http://weather.example.net/en/654", 0),
    ("https://archive.example.org/de/5747#top", 0), ("https://www.council.example.org/en/3645/", 0),
    ("https://win-casino-bonus.example.net/en/free-spins?ref=x", 1), ("http://cheap-pills.example.org/de/buy-now", 1),
    ("https://click.ads-track.example.net/de/redirect?utm_source=feed", 1), ("http://xxx-live-cams.example.org/en/join", 1),
    ("https://free-iphone.example.net/en/winner/claim", 1), ("http://m.poker-bonus.example.org/en/deposit", 1),
    ("https://crypto-double.example.net/de/invest-now", 1), ("http://warez-crack.example.org/en/download/keygen", 1),
    ("https://adult-dating.example.net/de/signup", 1), ("http://cheap-loans.example.org/en/apply-now", 1),
    ("https://bet-now.example.net/en/odds/bonus", 1), ("http://replica-watch.example.org/de/sale", 1),
    ("https://spin-slots.example.net/en/casino", 1), ("http://porn-tube.example.org/en/free", 1),
)
GRAMS = (3, 4)
BUCKETS = 1024
STEPS = 300
RATE = 2.0
DECAY = 1e-3
SCALE = 1_000_000


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one URL, as :func:`host_of` and :func:`path_of` have them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    return host, tail[:stop]


def bucket(gram: str) -> int:
    """A polynomial of the code points, in integers below 2**53 so that any engine computes it alike."""
    h = 0
    for c in gram:
        h = (h * 8191 + ord(c)) % 1_000_003
    return h % BUCKETS


def buckets_of(host: str, path: str) -> list[int]:
    text = f"^{host}|{path}$"
    return [bucket(text[i : i + n]) for n in GRAMS for i in range(len(text) - n + 1)]


def fit(labelled: Sequence[tuple[str, int]] = LABELLED) -> tuple[list[int], int]:
    """Weights of the buckets and the bias, in millionths: gradient descent from zero, the same every time."""
    rows = [(buckets_of(*split_url(url)), label) for url, label in labelled]
    weights, bias = [0.0] * BUCKETS, 0.0
    for _ in range(STEPS):
        step, shift = {}, 0.0
        for grams, label in rows:
            z = bias + sum(weights[g] for g in grams) / math.sqrt(len(grams))
            error = (1 / (1 + math.exp(-z)) - label) / len(rows)
            shift += error
            for g in grams:
                step[g] = step.get(g, 0.0) + error / math.sqrt(len(grams))
        weights = [w * (1 - RATE * DECAY) for w in weights]
        for g, x in step.items():
            weights[g] -= RATE * x
        bias -= RATE * shift
    return [round(w * SCALE) for w in weights], round(bias * SCALE)


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _gram_bucket(text: Column, at: Column, n: int) -> Column:
    h = F.lit(0).cast("long")
    for i in range(n):
        h = F.pmod(h * 8191 + F.ascii(F.substring(text, at + i, F.lit(1))).cast("long"), F.lit(1_000_003).cast("long"))
    return F.pmod(h, F.lit(BUCKETS).cast("long")).cast("int")


def _gram_buckets(text: Column, n: int) -> Column:
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda at: _gram_bucket(text, at, n))


def score_of(host: Column, path: Column, model: tuple[list[int], int]) -> Column:
    """The sum of the n-grams' weights, in millionths, over the root of their number, plus the bias: positive means block."""
    weights, bias = model
    table = F.array(*(F.lit(w) for w in weights))
    text = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))
    grams = F.flatten(F.array(*(_gram_buckets(text, n) for n in GRAMS)))
    total = F.aggregate(grams, F.lit(0).cast("long"), lambda s, g: s + F.element_at(table, g + 1))
    return F.floor(total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))) + bias


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as host and path joined; else null."""
    out = F.when(F.lit(False), F.lit(""))
    for _, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = out.when(fits, F.lit(h + p))
    return out


def judge_urls(pages: DataFrame, model: tuple[list[int], int] | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every row of ``pages(page_id, url)``.

    A null or malformed URL has an empty host and path, and the model judges it
    like any other.  Rows are judged one by one: repeats repeat, no rows give
    none, other columns are ignored.  URLs of any length are judged whole; reaching a
    place in a string counts from its start, so a URL costs the square of its length
    (8,000 characters: well under a second).
    """
    model = model or fit()
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    listed = F.lit(None).cast("string")
    for verdict, h, p in rules:
        listed = F.when(F.col("rule") == h + p, F.lit(verdict)).otherwise(listed)
    guess = F.when(score_of(F.col("host"), F.col("path"), model) > 0, "block").otherwise("allow")
    return parts.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNull(), guess).otherwise(listed).alias("verdict"))


def judge_sql(model: tuple[list[int], int] | None = None) -> str:
    """The same in DuckDB's SQL."""
    weights, bias = model or fit()
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for _, h, p in rules
    )
    listed = " ".join(f"WHEN rule = '{h + p}' THEN '{v}'" for v, h, p in rules)
    grams = []
    for n in GRAMS:
        h = "0::BIGINT"
        for i in range(n):
            h = f"(({h} * 8191 + unicode(substr(t, i + {i}, 1))) % 1000003)"
        grams.append(f"list_transform(range(1, length(t) - {n} + 2), lambda i: {h} % {BUCKETS})")
    total = "list_sum(list_transform(g, lambda b: w[b + 1]))"
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH model AS (SELECT {weights}::BIGINT[] AS w),
    cut AS (SELECT page_id,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{low}'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    ruled AS (SELECT *, CASE {fits} END AS rule, '^' || host || '|' || path || '$' AS t FROM cut),
    gram AS (SELECT *, list_concat({grams[0]}, {grams[1]}) AS g FROM ruled)
    SELECT page_id, host, path, rule, CASE {listed}
        WHEN CAST(floor(coalesce({total}, 0)::DOUBLE / sqrt(greatest(len(g), 1)::DOUBLE)) AS BIGINT) + {bias} > 0 THEN 'block'
        ELSE 'allow' END AS verdict
    FROM gram, model"""
