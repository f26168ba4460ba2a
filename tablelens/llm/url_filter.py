"""URL filter: rules, and a character language-model ratio, with DataFrame functions only.

Rules are (action, host, path) texts such as ``allow org/``; a rule fits its
host and all subdomains if the URL's path starts with the rule's path, and the
longest fitting rule wins (ties: the greater text).  URLs that no rule fits
are judged by two variable-order Markov models over characters, one of accepted
and one of rejected URLs (those that rules decide, outside fold 0).  A model of
order ``ORDER`` predicts a character from the longest context it has seen,
smoothed down to shorter contexts (Witten-Bell) and to the uniform over the
corpus's characters.  A URL's ratio is the mean over its characters of the log
probability differences; the cut is calibrated on the held-out fold, where the
means of both kinds meet in proportion to their spreads.  At or above the cut
is ``allow``.

Counts are sums with map-side combining; the models are tables of n-grams, of
which every distinct one is scored once; URLs then join their n-grams with
those scores (broadcast only up to ``BROADCAST_ROWS`` rows, otherwise shuffled).

A null URL, and one without ``://``, has an empty host and path, fits no rule
with a host, and is judged by its characters (null: none).  Without characters,
or where one kind of examples is missing, the verdict is ``allow``.  Null ids
and repeated rows stay; other columns never matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.llm.common import stored

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ORDER = 4
FOLDS = 5
BROADCAST_ROWS = 100_000
KINDS = ("allow", "block")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_START, _END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, action) of the longest fitting rule, or nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # later ones win
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule, action = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def _padded(url: str) -> Column:
    return F.concat(F.lit(_START * ORDER), F.col(url), F.lit(_END))


def _ngrams(url: str) -> Column:
    """All character (ORDER + 1)-grams, one per character and one for the end."""
    text = _padded(url)
    return F.transform(F.sequence(F.lit(1), F.length(url) + 1), lambda i: F.substring(text, i, F.lit(ORDER + 1)))


def _log_ratios(grams: DataFrame, examples: DataFrame, symbols: int) -> DataFrame:
    """Log p(accepted) - log p(rejected) of the last character of every distinct n-gram (Witten-Bell)."""
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
    counts = examples.groupBy("gram").agg(*[count(k) for k in KINDS])
    out = grams.select("gram", *[F.lit(1.0 / symbols).alias(f"p_{k}") for k in KINDS])
    for order in range(ORDER + 1):
        # a context of `order` characters and the character after it
        tail = F.expr(f"right(gram, {order + 1})")
        seen = counts.groupBy(tail.alias("tail")).agg(*[F.sum(k).alias(k) for k in KINDS])
        context = F.expr("left(tail, length(tail) - 1)")
        sums = [f(k) for k in KINDS for f in (lambda k: F.sum(k).alias(f"total_{k}"), lambda k: F.count_if(F.col(k) > 0).alias(f"kinds_{k}"))]
        totals = seen.groupBy(context.alias("context")).agg(*sums)
        met = out.withColumn("tail", tail).withColumn("context", F.expr(f"left(tail, {order})")).join(seen, "tail", "left").join(totals, "context", "left")
        smooth = lambda k: (F.coalesce(F.col(k), F.lit(0)) + F.col(f"kinds_{k}") * F.col(f"p_{k}")) / (F.col(f"total_{k}") + F.col(f"kinds_{k}"))
        out = met.select("gram", *[F.when(F.col(f"total_{k}") > 0, smooth(k)).otherwise(F.col(f"p_{k}")).alias(f"p_{k}") for k in KINDS])
    return out.select("gram", (F.ln("p_allow") - F.ln("p_block")).alias("ratio"))


def judge(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """Append ``host``, ``path``, ``rule``, ``action``, ``ratio`` and ``verdict`` to the columns of ``pages``."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.withColumns({"host": host, "path": path, "__url": F.coalesce(F.col(url_col).cast("string"), F.lit(""))})
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    fold = F.pmod(F.xxhash64("__url"), F.lit(FOLDS))
    rows = rows.withColumns({"rule": rule, "action": action, "__row": F.monotonically_increasing_id(), "__fold": fold})
    rows = stored(rows, "urls")
    # repeated n-grams of a kind and fold collapse in the tasks that read them
    exploded = rows.filter("__url <> ''").select("action", (F.col("__fold") == 0).alias("held"), F.explode(_ngrams("__url")).alias("gram"))
    counts = stored(exploded.groupBy("action", "held", "gram").agg(F.count("*").alias("n")), "grams")
    examples = counts.filter("action IS NOT NULL AND NOT held").select(F.col("action").alias("kind"), "gram", "n")
    symbols = counts.select(F.substring("gram", -1, 1).alias("c")).distinct().count()
    grams = counts.select("gram").distinct()
    scores = stored(_log_ratios(grams, examples, max(1, symbols)), "ratios")
    if scores.count() <= BROADCAST_ROWS:
        scores = F.broadcast(scores)
    each = rows.filter("__url <> ''").select("__row", F.explode(_ngrams("__url")).alias("gram")).join(scores, "gram")
    ratios = stored(each.groupBy("__row").agg(F.avg("ratio").alias("ratio")), "ratios")
    met = rows.drop("ratio", "verdict").join(ratios, "__row", "left")
    cut = _calibrated(met, examples)
    own = F.when(F.col("ratio") < F.lit(cut), "block").otherwise("allow") if cut is not None else F.lit("allow")
    return met.withColumn("verdict", F.coalesce("action", own)).drop("__row", "__url", "__fold")


def _calibrated(met: DataFrame, examples: DataFrame) -> float | None:
    """The ratio at which accepted and rejected held-out URLs are equally many spreads away."""
    kinds = {r["kind"] for r in examples.select("kind").distinct().collect()}
    if kinds != {"allow", "block"}:
        return None
    moments = {}
    for held in (True, False):  # without held-out examples of a kind, its training examples serve
        rows = met.filter("action IS NOT NULL AND ratio IS NOT NULL").filter((F.col("__fold") == 0) == held)
        for r in rows.groupBy("action").agg(F.avg("ratio").alias("mean"), F.coalesce(F.stddev_pop("ratio"), F.lit(0.0)).alias("spread")).collect():
            moments.setdefault(r["action"], (r["mean"], r["spread"]))
    (good, wide), (bad, narrow) = moments["allow"], moments["block"]
    share = narrow / (wide + narrow) if wide + narrow > 0 else 0.5
    cut = bad + (good - bad) * share
    return cut if math.isfinite(cut) else None


def url_table(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
