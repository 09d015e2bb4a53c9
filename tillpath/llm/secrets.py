"""Secrets in texts: patterns find candidates, a random forest removes the false ones.

A candidate is a run of at least 16 letters, digits and ``+/_-`` with a digit in it; a key with a known prefix, digits or not;
what is assigned to a guarded name such as ``password``, of any length and alphabet, in the same word or the next ones; or the password
of a user in a URL. One that is part of another in the same word isn't reported apart. The forest
judges it by its length, its characters and the transitions between their classes, the share of it
that common words of the corpus cover, the path of its file, and the words beside it. It is trained
on labelled findings: equal ones (features and label) are summed to a weight, and at most ``TRAINING`` of the sums are used, a priority sample
in which heavy ones are sure to be and the others stand for those left out. Common words
are counted over all texts and are common by their share of all words.

All steps are DataFrame and SQL functions and Spark's own forest. A text is split into words only where it
holds a candidate. Words are counted per task before they are shuffled, so frequent ones cost no more
than rare ones, and candidates meet the counts by an equi-join on their letter runs.

Null and empty texts have no candidates. A candidate that occurs several times is reported each time;
ties and repeated rows are judged alike. Without findings of both kinds there is nothing to learn: every
candidate then gets the share of true ones among the labelled, or 0.5 where none is labelled. An
empty table gives no rows. Other columns of the input don't matter.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import kept
from tillpath.llm.quality import SPACE

CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"

#: Prefixes of keys, and names to which secrets are assigned.
PREFIXED = r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{16,}|xox[abps]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"
NAMED = r"(?i)(?:token|secret|passw|pwd|passphrase|api[_.-]?key|access[_.-]?key|credential|private[_.-]?key)[A-Za-z0-9_-]*"

ASSIGNS = r"[\"'\]]*\s*(?:=>|:=|={1,2}|:)"
VALUE = r"[\"'(\[{]*([^\"',;]*[^\"',;.)\]}>])"
ASSIGNED = NAMED + ASSIGNS + VALUE
IN_URL = r"://[^\s/:@]*:([^\s/@]+)@"
HELD = f"{CANDIDATE}|{PREFIXED}|{IN_URL}|(?:{NAMED}{ASSIGNS})"

TRAINING = 20_000
COMMON, COMMON_SHARE = 5, 1e-6
"""A word is common if the corpus holds it at least ``COMMON`` times and it is that share of the words held so often."""
TREES, DEPTH, SEED = 30, 6, 7

#: Words that tend to stand before a secret, or before something that only looks like one.
GUARDED = r"(?i)token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private"
HARMLESS = r"(?i)sha|commit|md5|hash|checksum|uuid|guid|isbn|version|http|www|card|phone|order|example"
TEST_PATH = r"(?i)test|example|sample|mock|fixture|doc"
SETTINGS_PATH = r"(?i)config|settings|deploy|\.env|\.ya?ml|\.ini|\.properties"


def candidates(docs: DataFrame, text: str = "text", row_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """(row_id, path, position, candidate, lead, before, after) of every candidate.

    ``position`` is the word in which it stands, ``lead`` what stands before it in that word, and
    ``before`` and ``after`` are the words beside.
    """
    where = F.col(path).cast("string") if path else F.lit("")
    bare = F.btrim(F.col(text), F.lit(" \t\n\x0b\f\r"))
    held = docs.where(F.col(text).rlike(HELD)).select(
        F.col(row_id), F.coalesce(where, F.lit("")).alias("path"), F.split(bare, SPACE).alias("__words")
    )
    near = lambda i: F.coalesce(F.get("__words", i), F.lit(""))
    beside = lambda i: F.concat_ws(" ", near(i - 2), near(i - 1))
    given = f"{NAMED}{ASSIGNS}$"
    found = F.transform(
        "__words",
        lambda w, i: F.when(
            w.rlike(f"{CANDIDATE}|{PREFIXED}|{IN_URL}|{ASSIGNED}") | beside(i).rlike(given),
            F.struct(
                i.cast("long").alias("position"),
                w.alias("word"),
                beside(i).alias("before"),
                near(i + 1).alias("after"),
            ),
        ),
    )
    words = held.select(row_id, "path", F.explode(F.array_compact(found)).alias("at"))
    all_of = lambda pattern, group: F.regexp_extract_all("at.word", F.lit(pattern), F.lit(group))
    value = F.regexp_extract("at.word", f"^{VALUE}", 1)
    next_to = F.when(F.col("at.before").rlike(given) & (value != ""), F.array(value)).otherwise(F.array().cast("array<string>"))
    others = F.array_distinct(F.concat(all_of(PREFIXED, 0), all_of(IN_URL, 1), all_of(ASSIGNED, 1), next_to))
    runs = words.select(row_id, "path", "at.*", all_of(CANDIDATE, 0).alias("__runs"), others.alias("__others"))
    every = F.concat("__runs", F.array_except("__others", "__runs"))
    whole = F.filter("__every", lambda c: ~F.exists("__every", lambda d: (d != c) & F.contains(d, c)))
    each = runs.select("*", every.alias("__every")).select(
        row_id, "path", "position", "word", "before", "after", F.explode(whole).alias("candidate")
    )
    lead = F.call_function("substring_index", F.col("word"), F.col("candidate"), F.lit(1))
    return each.select(row_id, "path", "position", "candidate", lead.alias("lead"), "before", "after")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(run, n) of the common words of three letters and more, over all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^a-z]+")).alias("run"))
    counts = words.where(F.length("run").between(3, 40)).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    counts = kept(counts.where(F.col("n") >= COMMON))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= total * COMMON_SHARE)


def coverage(found: DataFrame, common: DataFrame) -> DataFrame:
    """(candidate, covered): the share of each distinct candidate's characters in common words."""
    distinct = found.select("candidate").distinct()
    runs = F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0))
    pieces = distinct.select("candidate", F.explode(runs).alias("run"))
    hits = pieces.join(common, "run").groupBy("candidate").agg(F.sum(F.length("run")).alias("hit"))
    return hits.select("candidate", (F.col("hit") / F.length("candidate")).alias("covered"))


def features() -> dict[str, Column]:
    """The forest's inputs, from the columns of ``candidates`` and ``covered``."""
    size = F.length("candidate")
    share = lambda pattern: F.regexp_count("candidate", F.lit(pattern)) / size
    beside = F.concat_ws(" ", "before", "lead")
    says = lambda column, pattern: column.rlike(pattern).cast("double")
    return {
        "f_length": size.cast("double"),
        "f_digits": share("[0-9]"),
        "f_upper": share("[A-Z]"),
        "f_signs": share("[+/_-]"),
        "f_hex": share("[0-9a-fA-F]"),
        "f_digit_letter": share("[0-9](?=[A-Za-z])"),
        "f_letter_digit": share("[A-Za-z](?=[0-9])"),
        "f_case_change": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "f_vowel_change": share("[aeiouAEIOU](?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])"),
        "f_repeats": share(r"(.)(?=\1)"),
        "f_covered": F.coalesce("covered", F.lit(0.0)),
        "f_test_path": says(F.col("path"), TEST_PATH),
        "f_settings_path": says(F.col("path"), SETTINGS_PATH),
        "f_guarded": says(beside, GUARDED),
        "f_harmless": says(beside, HARMLESS),
        "f_assigned": says(beside, "[=:]['\"]?$"),
        "f_quoted": says(F.col("lead"), "['\"]$"),
        "f_address": says(F.concat("lead", "after"), "@|://"),
    }


def with_features(docs: DataFrame, text: str = "text", row_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """Every candidate with its features."""
    found = kept(candidates(docs, text, row_id, path))
    covered = coverage(found, word_counts(docs, text))
    return kept(found.join(covered, "candidate", "left").withColumns(features()))


def sample(rows: DataFrame, size: int) -> DataFrame:
    """The distinct rows with their number as ``weight``, or ``size`` of them that stand for all: a priority sample.

    A row's priority is its weight by a hash in (0, 1]. Those first by priority are taken, with the priority of the next one as their
    least weight, so the weights of any kind of rows are expected to add up to what they were.
    """
    uniform = (F.shiftrightunsigned(F.xxhash64(*rows.columns), 11) + 1) / F.lit(float(1 << 53))
    summed = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    order = [F.desc("__priority"), *rows.columns]
    # At most size + 1 rows, so one partition; in an order of their own, so that trees don't vary.
    first = kept(summed.withColumn("__priority", F.col("weight") / uniform).orderBy(*order).limit(size + 1).coalesce(1))
    count, least = first.agg(F.count(F.lit(1)), F.min("__priority")).first()
    if count > size:
        first = first.where(F.col("__priority") > least).withColumn("weight", F.greatest("weight", F.lit(least)))
    return first.drop("__priority")


def judge_findings(found: DataFrame, labelled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``found`` with p_secret and is_secret, by a forest trained on ``labelled``.

    Both have the features; ``labelled`` also has ``label``, 1.0 for a secret and 0.0 for a false finding.
    """
    names = list(features())
    bounded = labelled.where(F.col("label").isin(0.0, 1.0)).select(*names, F.col("label").cast("double"))
    known = bounded.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("true")).first()
    if not known["n"] or known["true"] in (0.0, float(known["n"])):
        sure = known["true"] / known["n"] if known["n"] else 0.5
        judged = found.withColumn("p_secret", F.lit(float(sure)))
    else:
        training = sample(bounded, TRAINING)
        assemble = VectorAssembler(inputCols=names, outputCol="__features")
        forest = RandomForestClassifier(
            featuresCol="__features", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED
        )
        model = forest.fit(assemble.transform(training))
        model.setProbabilityCol("__p").setRawPredictionCol("__raw").setPredictionCol("__said")
        judged = model.transform(assemble.transform(found))
        judged = judged.withColumn("p_secret", vector_to_array("__p")[1]).drop("__features", "__p", "__raw", "__said")
    return judged.withColumn("is_secret", F.col("p_secret") >= threshold)


def weak_labels(found: DataFrame) -> DataFrame:
    """Findings labelled by what is plain to see, for want of labels by hand.

    True: assigned to a guarded name. False: nothing but digits, mostly common words, or part of
    an address. The rest stay unlabelled and are left to the forest.
    """
    true = (F.col("f_guarded") > 0) & ((F.col("f_assigned") > 0) | (F.col("f_quoted") > 0))
    false = (F.col("f_guarded") == 0) & (
        (F.col("f_digits") == 1) | (F.col("f_covered") > 0.5) | (F.col("f_address") > 0)
    )
    return found.withColumn("label", F.when(true, 1.0).when(false, 0.0))
