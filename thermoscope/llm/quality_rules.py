"""Document quality by weak supervision, in DataFrame functions only.

Each rule looks at one property of the whole text and votes good (1), bad (0)
or abstains (null); detectors of junk only ever vote bad.  A latent-class model
with one prior and, per rule, the rates of its votes on good and on bad
documents (so its accuracy) is fitted by expectation maximisation without
labels.  Rules cast at most 3**9 vote patterns, so the fit runs on a table of
pattern counts whatever the corpus, and a document's posterior is a sum of log
odds over its votes.  A document is kept when its
posterior reaches ``KEEP`` and it passes the base limits.

Edge cases: a null or empty text has no words: all counts are 0, every rule
abstains and the base limits fail; a null id is passed through; repeated rows
are counted and judged alike; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

KEEP = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ROUNDS = 100          # upper bound; the fit ends when no parameter moves by TOLERANCE
TOLERANCE = 1e-4
# Rates of the votes good and bad before the first round, on good and on bad documents;
# they also stand for SMOOTH documents in every round.
START = {"good": (0.6, 0.02), "bad": (0.2, 0.4)}
SMOOTH = 5.0
LEAST = 1e-3          # no rate is smaller, so no single vote is ever certain

BLANKS = r"[\x20\x09-\x0D]+"
INK = r"[^\x20\x09-\x0D]"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text; array work stays inside the row, nothing is shuffled."""
    text = F.col("text")
    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select(
        id_col,
        F.array_remove(F.split(text, BLANKS), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(INK)).alias("lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).alias("n_upper"),
        F.length(F.regexp_replace(text, r"\P{L}+", "")).alias("n_letters"))
    words = F.col("words")
    threes = F.transform(
        F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    d = d.select(
        "*", F.size(words).alias("n_words"), threes.alias("threes"),
        F.length(F.array_join(words, "")).alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:;\"')]\s*$"))).alias("n_closed"),
        F.size(F.array_distinct(words)).alias("n_distinct"))
    # windows found twice: neighbours in the sorted list of (hash, place); sorted only where some hash repeats
    repeats = F.size(F.array_distinct("threes")) < F.size("threes")
    d = d.withColumn("s", F.when(repeats, F.array_sort(F.transform(
        "threes", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("s")
    twice = F.filter(s, lambda e, i: (F.get(s, i + 1)["h"] == e["h"])
                     | ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == e["h"])))
    spread = F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))
    n_repeat = F.when(s.isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(spread)))
    return d.select(id_col, *[F.col(c).cast("long") for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines")], n_repeat.cast("long").alias("n_repeat_words"),
        *[F.col(c).cast("long") for c in ("n_lines", "n_closed", "n_distinct", "n_upper", "n_letters")])


def _vote(good: Column | None, bad: Column | None) -> Column:
    vote = F.when(bad, F.lit(0)) if bad is not None else F.when(F.lit(False), F.lit(0))
    return (vote if good is None else vote.when(good, F.lit(1))).cast("tinyint")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.nullif(F.col(whole), F.lit(0))


def _rules() -> dict[str, Column]:
    symbols = _share("n_symbols", "word_chars")
    doubled = _share("n_dup_lines", "n_lines")
    again = _share("n_repeat_words", "n_words")
    length = _share("word_chars", "n_words")
    upper = _share("n_upper", "n_letters")
    letters = _share("n_letters", "word_chars")
    closed = _share("n_closed", "n_lines")
    variety = _share("n_distinct", "n_words")
    return {
        "v_symbols": _vote(None, symbols > 0.05),
        "v_lines": _vote(None, doubled > 0.3),
        "v_repeats": _vote(None, again > 0.3),
        "v_upper": _vote(None, upper > 0.4),
        "v_letters": _vote(None, letters < 0.7),
        "v_length": _vote(None, (length < 2) | (length > 15)),
        "v_few_words": _vote(None, (variety < 0.15) & (F.col("n_words") > 100)),
        "v_closed": _vote(closed > 0.8, closed < 0.3),
        "v_clean": _vote((symbols < 0.02) & (letters > 0.85) & (again < 0.3), None),
    }


def votes(measured: DataFrame) -> DataFrame:
    return measured.withColumns(_rules())


def _three(rates: tuple[float, float]) -> dict:
    return {1: rates[0], 0: rates[1], None: 1 - rates[0] - rates[1]}


def _log_odds(model: dict) -> Column:
    """Log odds of good given the votes."""
    total = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for j, (good, bad) in model["rates"].items():
        g, b = _three(good), _three(bad)
        total = total + F.when(F.col(j) == 1, F.lit(math.log(g[1] / b[1]))) \
            .when(F.col(j) == 0, F.lit(math.log(g[0] / b[0]))).otherwise(F.lit(math.log(g[None] / b[None])))
    return total


def posterior(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def fit(patterns: DataFrame, names: list[str]) -> dict:
    """Prior and vote rates by expectation maximisation over (votes, n) rows.

    One aggregate per round; the driver sees four sums of each rule.  A rule
    stays better than chance: it votes bad on bad documents, and good on good
    ones, at least as often as on the others.
    """
    model = {"prior": 0.7, "rates": {j: (START["good"], START["bad"]) for j in names}}
    for _ in range(ROUNDS):
        p, n = F.col("p"), F.col("n")
        sums = [F.sum(n).alias("n"), F.sum(n * p).alias("g")]
        for j in names:
            for v in (1, 0):
                sums += [F.coalesce(F.sum(F.when(F.col(j) == v, n * p)), F.lit(0.0)).alias(f"g{v}_{j}"),
                         F.coalesce(F.sum(F.when(F.col(j) == v, n * (1 - p))), F.lit(0.0)).alias(f"b{v}_{j}")]
        r = patterns.withColumn("p", posterior(_log_odds(model))).agg(*sums).first()
        if not r["n"]:
            break
        new = {"prior": min(max(r["g"] / r["n"], 0.02), 0.98), "rates": {}}
        for j in names:
            rate = {}
            for k, size in (("good", r["g"]), ("bad", r["n"] - r["g"])):
                rate[k] = [max((r[f"{k[0]}{v}_{j}"] + SMOOTH * s) / (size + SMOOTH), LEAST)
                           for v, s in zip((1, 0), START[k])]
                room = (1 - LEAST) / max(sum(rate[k]), 1 - LEAST)
                rate[k] = [x * room for x in rate[k]]
            rate["bad"][0] = min(rate["bad"][0], rate["good"][0])
            rate["good"][1] = min(rate["good"][1], rate["bad"][1])
            new["rates"][j] = (tuple(rate["good"]), tuple(rate["bad"]))
        flat = lambda m: [m["prior"], *(x for a in m["rates"].values() for b in a for x in b)]
        moved = max(abs(a - b) for a, b in zip(flat(model), flat(new)))
        model = new
        if moved < TOLERANCE:
            break
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the base counts, base_failed, quality (posterior), kept, of every row."""
    scratch = Scratch(docs.sparkSession)
    voted = scratch.write(votes(measures(docs, id_col, text_col)), "votes")
    names = list(_rules())
    patterns = scratch.write(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    model = fit(patterns, names)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    p = posterior(_log_odds(model))
    return voted.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), p.alias("quality"), (~failed & (p >= KEEP)).alias("kept"), *names)
