"""Weak supervision: rules vote good, bad or abstain; EM estimates how far each can be trusted; the posterior decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import words
from eventlens.operators.ordering import checkpointed

SYMBOLS = "[#*$%&|<>]"
HAS_WORD = "[^\\x20\\x09-\\x0D]"
GOOD, BAD, ABSTAIN = 1, -1, 0


@dataclass(frozen=True)
class Rule:
    """Votes bad at or above `bad`, good at or below `good`, abstains in between and where the measure is null."""

    name: str
    measure: str
    good: float
    bad: float


#: Measures are shares of the words, lines or characters of a whole text; see `measures`.
#: Each kind of junk is seen by two rules or more, as agreement is all that EM can learn from.
RULES = (
    Rule("symbols", "symbol_share", 0.05, 0.2),
    Rule("other_chars", "other_char_share", 0.06, 0.1),
    Rule("bare_marks", "bare_mark_share", 0.05, 0.2),
    Rule("exclamation", "exclamation_share", 0.1, 0.4),
    Rule("capitals", "capital_share", 0.15, 0.3),
    Rule("repeated_windows", "repeat_share", 0.15, 0.35),
    Rule("repeated_lines", "dup_line_share", 0.15, 0.4),
    Rule("same_word_runs", "run_share", 0.02, 0.15),
    Rule("vocabulary", "few_words_share", 0.5, 0.75),
)
ITERATIONS = 40
#: Where EM starts, counted as so many votes of each rule in the estimates: this keeps them from 0 and 1.
START_PRIOR, PRIOR_VOTES = 0.8, 10.0
START = {"good_if_good": 0.85, "bad_if_good": 0.02, "good_if_bad": 0.5, "bad_if_bad": 0.4}


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id with the counts of each whole text and the measures that the rules use. Null texts have no words.

    All of it is computed within the row, so nothing is shuffled. Windows are compared by a 64-bit hash: within one text
    of a million words, two different windows share one with a chance of 1 in 10 million.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(HAS_WORD))
    hashed = split.select(
        "doc_id", "text", "words", F.size("words").cast("bigint").alias("n_words"), lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    h = F.col("hashes")
    windows = F.when(
        F.col("n_words") >= 3,
        F.transform(F.slice(h, 1, F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")),
                    lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = hashed.select(
        "doc_id", "n_words",
        F.char_length(F.concat_ws("", "words")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.char_length(F.regexp_replace("text", "[\\p{L}\\p{N}\\x20\\x09-\\x0D]+", "")).cast("bigint").alias("n_other_chars"),
        F.size(F.filter("words", lambda w: ~w.rlike("[\\p{L}\\p{N}]"))).cast("bigint").alias("n_without_letters"),
        F.regexp_count("text", F.lit("!")).cast("bigint").alias("n_exclamations"),
        F.regexp_count("text", F.lit("\\p{Lu}")).cast("bigint").alias("n_capitals"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct("hashes")).cast("bigint").alias("n_distinct"),
        F.size(F.filter(h, lambda x, i: (i > 0) & (x == F.get(h, i - 1)))).cast("bigint").alias("n_runs"),
        windows.alias("windows"),
    )
    distinct = F.size(F.array_distinct("windows"))
    flagged = counted.withColumn(
        "ordered",
        F.when(distinct < F.size("windows"), F.array_sort(
            F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    )
    o = F.col("ordered")
    repeated = F.array_sort(F.transform(
        F.filter(o, lambda x, i: ((i > 0) & (x.h == F.get(o, i - 1).h)) | F.coalesce(x.h == F.get(o, i + 1).h, F.lit(False))),
        lambda x: x.i,
    ))
    placed = flagged.withColumn("starts", F.when(o.isNotNull(), repeated)).drop("ordered", "windows")
    s = F.col("starts")
    covered = F.aggregate(
        F.transform(s, lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get(s, i - 1)))),
        F.lit(0).cast("bigint"), lambda total, x: total + x,
    )
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("starts")


def measures(counts: DataFrame) -> DataFrame:
    """Shares that do not depend on the length of a text; null where there is nothing to divide by."""
    per_word = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words"))
    return counts.withColumns({
        "symbol_share": per_word("n_symbols"),
        "other_char_share": F.when(F.col("word_chars") > 0, F.col("n_other_chars") / F.col("word_chars")),
        "bare_mark_share": per_word("n_without_letters"),
        "exclamation_share": per_word("n_exclamations"),
        "capital_share": F.when(F.col("word_chars") > 0, F.col("n_capitals") / F.col("word_chars")),
        "repeat_share": per_word("n_repeat_words"),
        "dup_line_share": F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")),
        "run_share": per_word("n_runs"),
        # a text of n words needs fewer different ones the longer it is; short ones abstain
        "few_words_share": F.when(F.col("n_words") >= 50, 1 - F.col("n_distinct") / F.col("n_words")),
    })


def votes(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    def vote(rule: Rule) -> Column:
        m = F.col(rule.measure)
        return F.when(m >= rule.bad, BAD).when(m <= rule.good, GOOD).otherwise(ABSTAIN)

    return measured.withColumn("votes", F.array(*[vote(r) for r in rules]))


def _posterior(pattern: Column, model: Column) -> Column:
    """Probability of good from all votes of a row; abstaining counts as far as it tells the classes apart."""
    def log_odds(vote: Column, rule: Column) -> Column:
        odds = F.when(vote == GOOD, rule.good_if_good / rule.good_if_bad).when(vote == BAD, rule.bad_if_good / rule.bad_if_bad)
        return F.log(odds.otherwise(
            (1 - rule.good_if_good - rule.bad_if_good) / (1 - rule.good_if_bad - rule.bad_if_bad)))

    prior = F.log(model.prior / (1 - model.prior))
    return 1 / (1 + F.exp(-F.aggregate(F.zip_with(pattern, model.rules, log_odds), prior, lambda total, x: total + x)))


def fit(voted: DataFrame, n_rules: int, iterations: int = ITERATIONS) -> DataFrame:
    """One row, `model`: the share of good rows, and for each rule how it votes on good and on bad ones, by
    expectation-maximisation over the votes of all rows.

    Rows are first counted by their pattern of votes, on the map side too. There are at most 3 ** n_rules patterns
    (19,683 for the nine rules here) whatever the size of the table, so that one row holds them all and the iterations
    are one fold over it. Without rows the model is the one that EM starts from.
    """
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns")
    )
    p = F.col("patterns")
    start = F.struct(F.lit(START_PRIOR).alias("prior"), F.array_repeat(
        F.struct(*[F.lit(v).alias(k) for k, v in START.items()]), n_rules).alias("rules"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    def expect(state: Column) -> Column:
        return F.transform(p, lambda x: F.struct(
            x.votes.alias("votes"), (x.n * _posterior(x.votes, state)).alias("good"),
            (x.n * (1 - _posterior(x.votes, state))).alias("bad")))

    def maximise(rows: Column) -> Column:
        good, bad = total(F.transform(rows, lambda x: x.good)), total(F.transform(rows, lambda x: x.bad))
        return F.transform(F.array(F.struct(good.alias("good"), bad.alias("bad"))), lambda n: F.struct(
            ((n.good + PRIOR_VOTES * START_PRIOR) / (n.good + n.bad + PRIOR_VOTES)).alias("prior"),
            F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), lambda j: F.struct(*[
                ((total(F.transform(rows, lambda x: F.when(F.get(x.votes, j) == vote, x[of]).otherwise(0.0)))
                  + PRIOR_VOTES * START[name]) / (n[of] + PRIOR_VOTES)).alias(name)
                for name, vote, of in (("good_if_good", GOOD, "good"), ("bad_if_good", BAD, "good"),
                                       ("good_if_bad", GOOD, "bad"), ("bad_if_bad", BAD, "bad"))
            ])).alias("rules")))[0]

    step = lambda state, _: F.transform(F.array(expect(state)), maximise)[0]
    return patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step).alias("model"))


def rule_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Counts of every document, whether the base rules fail it, its probability of being good, and the verdict.

    Null and empty texts have no words and fail the base rules. Equal texts get equal results; ids may be null or
    repeat. Columns other than doc_id and text are not read. An empty table gives no rows.
    """
    # Counting costs most, and both the fit and the verdict need the votes; the narrow rows are written once.
    rows = checkpointed(votes(measures(base_counts(docs)), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = rows.withColumn("model", fit(rows, len(rules)).scalar()).withColumn(
        "quality_probability", _posterior(F.col("votes"), F.col("model")))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("quality_probability") >= threshold)).alias("kept"), "quality_probability", "votes",
    )
