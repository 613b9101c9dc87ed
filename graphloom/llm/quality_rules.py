"""Quality rules as weak supervision. DataFrame functions only.

Each rule votes good (1), bad (0) or abstains (-1) on a document. Documents are
counted by vote pattern, which leaves at most 3 ** rules rows whatever the
corpus, and expectation-maximisation over these rows estimates each rule's accuracy on
good and on bad documents (Dawid and Skene 1979; an abstaining rule says nothing)
and how common good documents are. A document's posterior
probability of being good replaces all-must-pass filtering. All rounds are one
expression over one row that holds the patterns. Prior beliefs weigh a fixed
number of documents, so any corpus of some size outweighs them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WHITESPACE, count_of, pick, words
from graphloom.storage import materialize

SYMBOLS = "#*$%&|<>"  # of a regular-expression class
WINDOW = 8
#: Prior beliefs, as (weight in documents, share): a rule is right on good documents, on bad ones (rules look at
#: different faults, so most say nothing of a bad document's fault), and documents are good.
GOOD_PRIOR, BAD_PRIOR, SHARE_PRIOR = (50.0, 0.999), (1.0, 1 / 3), (10.0, 0.9)


def _repeated(n_words: Column, hashes: Column) -> Column:
    """Words that lie in windows of ``WINDOW`` words that occur twice or more in the text."""
    windows = F.when(n_words >= WINDOW, F.transform(F.sequence(F.lit(1), n_words - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))))
    return windows


def _covered(windows: Column) -> Column:
    """Given window hashes by position: the words under windows that aren't alone."""
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        at = lambda j: F.get(s, j)
        twin = lambda j: (at(j)["h"].eqNullSafe(at(j - 1)["h"])) | (at(j)["h"].eqNullSafe(at(j + 1)["h"]))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twin), lambda j: at(j)["i"]))

    step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.element_at(F.transform(F.array(ranked), lambda s: F.aggregate(places(s), zero, step)["n"]), 1)


def features(docs: DataFrame) -> DataFrame:
    """What the rules look at, one row per input row, over whole texts; null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = pick(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    d = d.withColumn("_w", words(F.col("text"))).withColumn("n_words", F.size("_w"))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    d = d.withColumn("_windows", _repeated(F.col("n_words"), F.col("_h")))
    d = d.withColumn("_twins", F.coalesce(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.lit(False)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(WHITESPACE)) != "")
    d = d.withColumn("_lines", lines)
    count = lambda chars: count_of(F.col("text"), chars)
    return d.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_twins"), _covered(F.col("_windows"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        count("!?").cast("long").alias("n_cries"),
    )


def rules() -> dict[str, tuple[Column, Column]]:
    """Name -> (votes good, votes bad) over the columns of ``features``; neither: abstains."""
    w = F.greatest(F.col("n_words"), F.lit(1))
    per_word = lambda c: F.col(c) / w
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    letters = F.col("n_letters") / F.greatest(F.col("word_chars"), F.lit(1))
    capitals = F.col("n_capitals") / F.greatest(F.col("n_letters"), F.lit(1))
    mean = F.col("word_chars") / w
    return {
        "symbols": (per_word("n_symbols") < 0.02, per_word("n_symbols") > 0.05),
        "word_length": ((mean >= 3) & (mean <= 10), (mean < 2) | (mean > 14)),
        "repeated_words": (per_word("n_repeat_words") < 0.05, per_word("n_repeat_words") > 0.3),
        "repeated_lines": ((F.col("n_lines") >= 3) & (lines < 0.1), (F.col("n_lines") >= 4) & (lines > 0.4)),
        "letters": (letters > 0.85, letters < 0.65),
        "capitals": (capitals < 0.15, capitals > 0.5),
        "cries": (per_word("n_cries") < 0.1, per_word("n_cries") > 0.4),
    }


def _posterior(votes: list[str], prior: float, good: list[float], bad: list[float]) -> Column:
    """P(good | votes) as an expression; good and bad: each rule's accuracy on good and on bad documents."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, g, b in zip(votes, good, bad):
        odds = odds + F.when(F.col(name) == 1, math.log(g / (1 - b))).when(F.col(name) == 0, math.log((1 - g) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, votes: list[str], *, rounds: int = 1000, tolerance: float = 1e-6) -> tuple[float, list[float], list[float]]:
    """The share of good documents and each rule's accuracy on good and on bad ones.

    ``patterns``: a row per vote pattern and its number of documents ``n``. It
    begins with documents that some rule calls bad as likely bad and goes on
    until no estimate moves by ``tolerance``, or for ``rounds`` rounds. The
    beliefs of ``GOOD_PRIOR``, ``BAD_PRIOR`` and ``SHARE_PRIOR`` are added to what is seen.
    """
    rules_ = range(len(votes))
    let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731 - value is worked out once

    def maximised(counted: Column, before: Column | None) -> Column:
        """Estimates from items (n, q, votes); q: the posterior of the pattern."""
        fields = ["g", "b", *[f"{s}{j}_{vote}" for s in "gb" for j in rules_ for vote in (0, 1)]]
        zero = F.struct(*[F.lit(0.0).alias(f) for f in fields])

        def add(acc: Column, x: Column) -> Column:
            own = {"g": x["q"] * x["n"], "b": (1 - x["q"]) * x["n"]}
            parts = [(acc[s] + own[s]).alias(s) for s in "gb"]
            parts += [(acc[f"{s}{j}_{vote}"] + F.when(x[f"v{j}"] == vote, own[s]).otherwise(0.0)).alias(f"{s}{j}_{vote}") for s in "gb" for j in rules_ for vote in (0, 1)]
            return F.struct(*parts)

        def made(z: Column) -> Column:
            share = (z["g"] + SHARE_PRIOR[0] * SHARE_PRIOR[1]) / (z["g"] + z["b"] + SHARE_PRIOR[0])
            good = [(z[f"g{j}_1"] + GOOD_PRIOR[0] * GOOD_PRIOR[1]) / (z[f"g{j}_0"] + z[f"g{j}_1"] + GOOD_PRIOR[0]) for j in rules_]
            bad = [(z[f"b{j}_0"] + BAD_PRIOR[0] * BAD_PRIOR[1]) / (z[f"b{j}_0"] + z[f"b{j}_1"] + BAD_PRIOR[0]) for j in rules_]
            named = {"share": share} | {f"g{j}": good[j] for j in rules_} | {f"b{j}": bad[j] for j in rules_}
            moved = F.greatest(*[F.abs(x - before[k]) for k, x in named.items()]) if before is not None else F.lit(1.0)
            return F.struct(*[x.alias(k) for k, x in named.items()], moved.alias("moved"))

        return let(F.aggregate(counted, zero, add), made)

    def judged(state: Column, items: Column) -> Column:
        """The items with their posteriors under the estimates."""
        odds = F.struct(
            F.log(state["share"] / (1 - state["share"])).alias("base"),
            *[F.log(state[f"g{j}"] / (1 - state[f"b{j}"])).alias(f"yes{j}") for j in rules_],
            *[F.log((1 - state[f"g{j}"]) / state[f"b{j}"]).alias(f"no{j}") for j in rules_],
        )

        def one(w: Column, x: Column) -> Column:
            logit = w["base"]
            for j in rules_:
                logit = logit + F.when(x[f"v{j}"] == 1, w[f"yes{j}"]).when(x[f"v{j}"] == 0, w[f"no{j}"]).otherwise(0.0)
            return F.struct(x["n"].alias("n"), (1 / (1 + F.exp(-logit))).alias("q"), *[x[f"v{j}"].alias(f"v{j}") for j in rules_])

        return let(odds, lambda w: F.transform(items, lambda x: one(w, x)))

    any_bad = F.lit(False)
    for v in votes:
        any_bad = any_bad | (F.col(v) == 0)
    item = F.struct(F.col("n").cast("double").alias("n"), F.when(any_bad, 0.1).otherwise(0.98).alias("q"), *[F.col(v).alias(f"v{j}") for j, v in enumerate(votes)])
    row = patterns.agg(F.sort_array(F.collect_list(item)).alias("items"))
    first = row.select("items", maximised(F.col("items"), None).alias("start"))
    step = lambda state, _: F.when(state["moved"] < tolerance, state).otherwise(maximised(judged(state, F.col("items")), state))
    found = first.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("start"), step).alias("s")).first()["s"]
    return found["share"], [found[f"g{j}"] for j in rules_], [found[f"b{j}"] for j in rules_]


def quality(docs: DataFrame, *, threshold: float = 0.5, min_words: int = 20, max_repeat_pct: int = 30) -> DataFrame:
    """One row per input row: the base counts, every rule's vote, quality (the posterior),
    base_failed and kept (quality >= threshold and not base_failed).

    The estimate is made over the documents that pass the base rule: the others
    go anyway, and the rules on repeats would agree with that rule rather than
    with the rest. Null and empty texts have no words and fail the base rule.
    Repeated rows and null doc_ids are judged like others; an empty table gives
    an empty result; other columns are ignored.
    """
    seen = features(docs)
    made = rules()
    for name, (yes, no) in made.items():
        seen = seen.withColumn(f"vote_{name}", F.when(F.col("n_words") == 0, -1).when(no, 0).when(yes, 1).otherwise(-1))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    seen = materialize(seen.withColumn("base_failed", failed), "quality-votes")
    votes = [f"vote_{name}" for name in made]
    patterns = seen.filter("not base_failed").groupBy(*votes).agg(F.count(F.lit(1)).alias("n"))
    prior, good, bad = estimate(patterns, votes)
    judged = seen.withColumn("quality", _posterior(votes, prior, good, bad))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
