"""Quality rules under weak supervision: rules vote or abstain, EM estimates how each votes on
good and on bad documents, and the posterior probability of good quality decides, instead of all rules having to pass.

One pass over the texts makes a narrow table of counts, written to the shared folder. The label
model needs only how often each vector of votes occurs: at most 3 ** N_RULES rows, whatever the
corpus. EM is one SQL expression over that table, and its 6 * N_RULES + 1 numbers come back as
literals. The model is fitted on all documents that it has to judge: those the base rules leave. No shuffle carries text, and no group holds documents.

Cases: null text has no words and fails the base rules; a document on which all rules abstain gets
the prior; ties at the threshold are kept; repeated rows are judged alike and count as often as they
occur; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, id_text, let

# Symbols counted, and frequent function words of English, German, French and Spanish.
SYMBOLS = "#*$%&|<>"
FUNCTION_WORDS = (
    "the of and to in a is that it for on with as was at by an be this are from or "
    "der die und das ist ein eine nicht von zu den sich mit auf im "
    "le la les et un une des que pour dans est pas qui au du "
    "el los las y en del se por con una su al lo de"
).split()
KEEP = 0.5
ROUNDS = 30


def _repeat_words(hashes: Column) -> Column:
    """Words covered by 3-word windows whose hash occurs twice or more; hashes by position."""

    def covered(pos: Column) -> Column:
        steps = F.transform(pos, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(pos, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def twice(pairs: Column) -> Column:
        same = F.filter(pairs, lambda p, i: (p["h"] == F.get(pairs, i - 1)["h"]) | (p["h"] == F.get(pairs, i + 1)["h"]))
        return let(F.sort_array(F.transform(same, lambda p: p["i"])), covered)

    paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(paired, twice))


def count_features(docs: DataFrame) -> DataFrame:
    """Per document, whole counts over its whole text."""
    text = F.col("text")
    rows = id_text(docs).select(
        "doc_id", "text",
        F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE_CLASS}]"))).alias("lines"),
    )
    n = F.size("words")
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.rlike(x, F.lit(r'[.!?:;"”»)]\s*$')))).cast("long").alias("n_closed"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_bangs"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
        F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).alias("windows"),
    )
    return rows.withColumn("n_repeat_words", _repeat_words(F.col("windows"))).drop("windows")


def _rules() -> list[Column]:
    """Votes: 1 good, -1 bad, 0 abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    mean = F.col("word_chars") / words
    share = lambda c, of: F.col(c) / of
    return [
        vote(F.col("n_words") < 50, F.col("n_words") >= 100),
        vote((mean < 2.5) | (mean > 12), mean.between(3.5, 9)),
        vote(share("n_symbols", words) > 0.1, share("n_symbols", words) <= 0.01),
        vote(share("n_dup_lines", lines) > 0.3, (share("n_dup_lines", lines) <= 0.05) & (F.col("n_lines") >= 3)),
        vote(share("n_repeat_words", words) > 0.3, share("n_repeat_words", words) < 0.15),
        vote(share("n_function", words) < 0.02, share("n_function", words) >= 0.06),
        vote(share("n_upper", F.greatest(F.col("word_chars"), F.lit(1))) > 0.3, share("n_upper", F.greatest(F.col("word_chars"), F.lit(1))) < 0.15),
        vote(share("n_bangs", words) > 0.1, F.lit(False)),
        vote(share("n_closed", lines) < 0.1, share("n_closed", lines) >= 0.5),
    ]


N_RULES = 9


#: Where EM starts: P(vote) of a good document for votes -1, 0, 1; a bad one's is the mirror image.
START = (0.1, 0.3, 0.6)


def _posterior(votes: Column, prior: Column, good: Column, bad: Column) -> Column:
    """P(good | votes); good and bad hold P(vote | class), three numbers a rule, in one array."""

    def log_ratio(v: Column, j: Column) -> Column:
        at = j * 3 + v + 1
        return F.log(F.get(good, at) / F.get(bad, at))

    odds = F.aggregate(F.transform(votes, log_ratio), F.log(prior / (1 - prior)), lambda acc, x: acc + x)
    return 1 / (1 + F.exp(-odds))


def fit_label_model(patterns: DataFrame) -> DataFrame:
    """One row (prior, good, bad) from (votes, n): EM as one fold over ROUNDS rounds.

    A rule's accuracy is the pair of its vote distributions, one for each class: a rule that votes
    alike on all documents so weighs nothing, however often it is right."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    listed = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("ps"))

    def again(acc: Column, ps: Column) -> Column:
        scored = F.transform(ps, lambda p: F.struct(
            p["votes"].alias("votes"), p["n"].alias("n"), (p["n"] * _posterior(p["votes"], acc["prior"], acc["good"], acc["bad"])).alias("good")))

        def estimate(s: Column) -> Column:
            n, n_good = total(F.transform(s, lambda p: p["n"])), total(F.transform(s, lambda p: p["good"]))
            prior = F.greatest(F.lit(0.05), F.least(F.lit(0.95), (n_good + 4) / (n + 5)))

            def share(k: Column, good: bool) -> Column:
                j, v = F.floor(k / 3).cast("int"), (k % 3) - 1
                cast = F.filter(s, lambda p: F.get(p["votes"], j) == v)
                mass = total(F.transform(cast, lambda p: p["good"] if good else p["n"] - p["good"]))
                start = F.get(F.array(*[F.lit(x) for x in (START if good else START[::-1])]), k % 3)
                return (mass + 3 * start) / ((n_good if good else n - n_good) + 3)

            cells = F.sequence(F.lit(0), F.lit(3 * N_RULES - 1))
            return F.struct(
                prior.alias("prior"), F.transform(cells, lambda k: share(k, True)).alias("good"), F.transform(cells, lambda k: share(k, False)).alias("bad"))

        return let(scored, estimate)

    cells = lambda xs: F.array(*[F.lit(x) for x in xs * N_RULES])
    start = F.struct(F.lit(0.8).alias("prior"), cells(START).alias("good"), cells(START[::-1]).alias("bad"))
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    fitted = listed.select(let(F.col("ps"), lambda ps: F.aggregate(rounds, start, lambda acc, _: again(acc, ps))).alias("m"))
    return fitted.select("m.prior", "m.good", "m.bad")


def judge_quality(docs: DataFrame) -> DataFrame:
    """The counts of count_features() with base_failed, p_good and kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    votes = F.array(*[v.cast("int") for v in _rules()])
    rows = scratch.save(count_features(docs).withColumn("votes", votes))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    model = fit_label_model(rows.where(~failed).groupBy("votes").agg(F.count("*").alias("n"))).first()
    held = lambda k: F.array(*[F.lit(x) for x in model[k]])
    p_good = _posterior(F.col("votes"), F.lit(model["prior"]), held("good"), held("bad"))
    return rows.withColumn("base_failed", failed).withColumn("p_good", p_good).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP))


def op6_quality_rules(docs: DataFrame) -> DataFrame:
    return judge_quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", "votes")
