"""Quality by weak supervision: rules vote or abstain, and their accuracies are estimated.

Each rule calls a text good (1) or bad (-1), or abstains (0). A text's quality is hidden; each rule
has its own accuracy on good and on bad texts. Expectation maximisation over the counts of
vote patterns, of which there are at most 3 ** rules whatever the size of the corpus, estimates the
accuracies and the share of good texts. A text is kept if its posterior probability of being good
reaches a threshold, so that one failed rule is outvoted by reliable ones.

All of it is built-in expressions; texts aren't shuffled. Repeated windows within a text are found
by sorting the hashes of its five-word windows, and only where some hash occurs twice.

Null and empty texts have no words and fail the base rules. Repeated rows and ties are judged
alike, and an empty table gives no rows. Columns named like an output column are replaced; all
others are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import kept

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
ROUNDS = 20
THRESHOLD = 0.3
VOTES = (-1, 0, 1)
Rates = tuple[tuple[float, ...], tuple[float, ...]]
START: Rates = ((0.02, 0.18, 0.80), (0.25, 0.10, 0.65))
"""Starting rates of the votes -1, 0 and 1 about good texts and about bad texts."""
START_PRIOR = 0.85
STRENGTH = 0.5
"""Weight of the starting rates, as a share of the texts."""



def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules are about."""
    bare = F.btrim("__text", F.lit(" \t\n\x0b\f\r"))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.length(F.regexp_replace("__text", pattern, "")).cast("long")
    out = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns(
        {
            "__words": F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)),
            "__lines": lines,
            "n_symbols": count(r"[^#*$%&|<>]+"),
            "n_letters": count(r"\P{L}+"),
            "n_capitals": count(r"\P{Lu}+"),
            "n_stops": count(r"[^.!?]+"),
            "n_bare": F.regexp_count("__text", F.lit(r" [^\p{L}\p{N}\s]+(?= |$)")).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__hashes": F.transform("__words", lambda w: F.xxhash64(w)),
        }
    )
    last = F.size("__words") - WINDOW
    window = lambda i: F.xxhash64(*(F.get("__hashes", i + n) for n in range(WINDOW)))
    hashes = F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), window))
    out = out.withColumn("__windows", hashes)
    twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__placed", F.when(twice, placed))
    again = lambda x, i: F.when(
        (F.get("__placed", i + 1)["h"] == x["h"]) | ((i > 0) & (F.get("__placed", i - 1)["h"] == x["h"])), x["i"]
    )
    starts = F.array_sort(F.array_compact(F.transform("__placed", again)))
    out = out.withColumn("__starts", starts)
    reach = lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__starts", i + 1) - x, F.lit(WINDOW)))
    covered = F.aggregate(F.transform("__starts", reach), F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    own = ["__text", "__words", "__lines", "__hashes", "__windows", "__placed", "__starts"]
    return out.drop(*own)


def rules() -> dict[str, tuple[Column, Column]]:
    """For each rule, when it calls a text bad and when it calls it good."""
    words, chars = F.col("n_words"), F.col("word_chars")
    part = lambda x, y: F.col(x) / F.greatest(F.col(y), F.lit(1))
    mean = chars / F.greatest(words, F.lit(1))
    return {
        "length": (words < 10, words >= 30),
        "repeats": (100 * F.col("n_repeat_words") > 20 * words, 100 * F.col("n_repeat_words") <= 5 * words),
        "symbols": (part("n_symbols", "n_words") > 0.2, part("n_symbols", "n_words") <= 0.05),
        "lines": (part("n_dup_lines", "n_lines") > 0.3, (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1)),
        "word_size": ((mean < 2.5) | (mean > 15), (mean >= 3) & (mean <= 11)),
        "letters": (part("n_letters", "word_chars") < 0.7, part("n_letters", "word_chars") >= 0.85),
        "separators": (part("n_bare", "n_words") > 0.15, part("n_bare", "n_words") <= 0.03),
        "capitals": (part("n_capitals", "n_letters") > 0.4, part("n_capitals", "n_letters") <= 0.2),
        "sentences": ((F.col("n_stops") == 0) & (words >= 30), (F.col("n_stops") > 0) & (words >= 30)),
    }


def vote_columns(names: list[str]) -> dict[str, Column]:
    """One column per rule: -1, 0 or 1. A rule that says both is taken to say bad."""
    given = rules()
    return {
        f"vote_{n}": F.when(given[n][0], -1).when(given[n][1], 1).otherwise(0).cast("int") for n in names
    }


def posterior(names: list[str], rates: dict[str, Rates], prior: float) -> Column:
    """Probability that a text is good, given its votes."""
    logit = F.lit(math.log(prior / (1 - prior)))
    for n in names:
        good, bad = rates[n]
        weight = [math.log(g / b) for g, b in zip(good, bad)]
        logit = logit + F.get(F.array(*map(F.lit, weight)), F.col(f"vote_{n}") + 1)
    return 1 / (1 + F.exp(-logit))


def fit(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[dict[str, Rates], float]:
    """How often each rule says bad, nothing or good about good and about bad texts, and the
    share of good texts, by expectation maximisation.

    The starting rates count as much as half of the texts. That keeps the two hidden classes in
    their sense, and a rule that never votes where it began.
    """
    columns = [f"vote_{n}" for n in names]
    patterns = kept(votes.groupBy(*columns).agg(F.count(F.lit(1)).alias("texts")).coalesce(1))
    rates, prior = {n: START for n in names}, START_PRIOR
    for _ in range(rounds):
        good = F.col("texts") * posterior(names, rates, prior)
        sums = [F.sum("texts").alias("all"), F.sum(good).alias("good")]
        for n in names:
            for v in VOTES:
                said = F.col(f"vote_{n}") == v
                sums.append(F.sum(F.when(said, good).otherwise(0.0)).alias(f"good_{n}_{v}"))
                sums.append(F.sum(F.when(said, F.col("texts")).otherwise(0)).alias(f"all_{n}_{v}"))
        got = patterns.agg(*sums).first()
        if not got["all"]:
            break
        held = STRENGTH * got["all"] + 1
        for n in names:
            of_good = [got[f"good_{n}_{v}"] for v in VOTES]
            of_bad = [got[f"all_{n}_{v}"] - got[f"good_{n}_{v}"] for v in VOTES]
            rates[n] = tuple(
                tuple((x + held * p) / (sum(seen) + held) for x, p in zip(seen, start))
                for seen, start in zip((of_good, of_bad), START)
            )
        prior = (got["good"] + held * START_PRIOR) / (got["all"] + held)
    return rates, prior


def judge(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the text, with signals, votes, p_good, base_failed and kept."""
    names = list(rules())
    found = with_signals(docs, text).drop(text).withColumns(vote_columns(names))
    found = kept(found)
    rates, prior = fit(found, names)
    short, repeated = F.col("n_words") < 10, 100 * F.col("n_repeat_words") > 20 * F.col("n_words")
    found = found.withColumn("p_good", posterior(names, rates, prior))
    found = found.withColumn("base_failed", short | repeated)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
