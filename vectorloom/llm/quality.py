"""Quality rules whose cutoffs limit the share of good documents they reject.

Each rule rejects a document whose measure lies above a cutoff. The candidates of a rule are a
fixed grid, chosen before any data is seen, so all labelled documents are holdout. For every
stratum (a language), rule and candidate the good holdout documents that it would reject are
counted. The candidate is safe when an exact binomial test refutes "its rejection rate among
good documents is above ``risk / rules``" at level ``error / (rules x candidates x strata)``
(Bonferroni over all tests). The strictest safe candidate becomes the cutoff; where none is
safe, as with few labels, the rule rejects nothing there. So with probability ``1 - error``
all rules together reject at most the share ``risk`` of the good documents of every stratum.
This is :func:`select_cutoffs`. It needs about 2,070 good labels in each of four strata before a rule
rejects anything there.

:func:`joint_cutoffs`, which :func:`keep_good` and ``op3_quality_rules`` use, spends the same risk and error better. It goes
through the rules in the order of ``SEQUENCE`` and through each grid from lenient to strict, and
tests what all cutoffs chosen so far and the next one reject together against ``risk`` itself;
at the first failure a rule keeps the cutoff before it. Until a rule has stopped, the steps
form one fixed sequence, which needs no factor for their number; after ``k`` stops there is one
sequence for each choice of ``k`` rules and places, and the rest of the error is shared by
them. The promise is the same, from about 220 good labels in each of four strata (170 in a
single one). Strata with fewer are filtered by the base rules alone.

Everything is built-in column functions: per-text measures stay inside the row, counts are
aggregated before they are shuffled, and the cutoffs reach the documents as one map value of
a scalar subquery; it has an entry only for strata with a safe cutoff, each of which needs
hundreds of labels.

Defined cases: a null or empty text has no words and fails the base rules; a null stratum is a
stratum of its own; a document labelled good and bad counts as bad, repeated labels count once;
repeated documents are judged each and counted each; an empty label table rejects nothing
beyond the base rules; an empty table gives no rows; further columns are kept untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.columns import col, fresh, positions_to, words_of
from vectorloom.session import materialize

#: Fixed values of the base rules.
SYMBOLS = r"[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

#: Rules of the method: a measure and its candidate cutoffs, most lenient first.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01),
    "duplicate_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05),
    "repeated_word_share": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05),
    "mean_word_length": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
}
RISK = 0.02
ERROR = 0.05

#: Order of the joint tests: repetition, which good texts have as well, comes last.
SEQUENCE = ("symbol_share", "mean_word_length", "upper_share", "duplicate_line_share", "repeated_word_share")
#: Share of the error for the sequence in which no rule has stopped.
UNSTOPPED = 0.9


def measure(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct of measures; returns its name as well.

    Steps are separate projections, so that Catalyst computes each costly array once. Write the
    result down before filtering by it: a filter pushed below them would compute them again.
    """
    kept = docs.columns
    words, grams, places, name = (fresh(docs, n) for n in ("words", "grams", "places", "measures"))
    text = F.coalesce(col(text_col), F.lit(""))
    w, g, p = col(words), col(grams), col(places)

    step = docs.withColumn(words, words_of(col(text_col)))
    last = F.size(w) - 3
    step = step.withColumn(
        grams, F.transform(positions_to(last), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    )
    # Distinct hashes prove distinct windows; only other texts compare the windows themselves.
    windows = F.transform(
        positions_to(last),
        lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("g"), i.alias("i")),
    )
    repeats = F.size(F.array_distinct(g)) < F.size(g)
    step = step.withColumn(places, F.when(repeats, F.sort_array(windows)))
    twice = F.filter(
        p,
        lambda x, k: ((k > 0) & (F.get(p, k - 1)["g"] == x["g"]))
        | F.coalesce(F.get(p, k + 1)["g"] == x["g"], F.lit(False)),
    )
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda acc, at: F.struct(
            at.alias("at"), (acc["n"] + F.least(F.lit(3), at - acc["at"])).alias("n")
        ),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(HAS_WORD))
    spelled = F.array_join(w, "")
    measures = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(spelled).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(lines)).cast("long").alias("n_distinct_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    return step.select(*map(col, kept), measures.alias(name)), name


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (
        100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"]
    )


def rule_values(m: Column) -> dict[str, Column]:
    """The measure of each rule; 0 where its denominator is 0."""

    def share(part, whole):
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    return {
        "symbol_share": share(m["n_symbols"], m["word_chars"]),
        "duplicate_line_share": share(m["n_lines"] - m["n_distinct_lines"], m["n_lines"]),
        "repeated_word_share": share(m["n_repeat_words"], m["n_words"]),
        "mean_word_length": share(m["word_chars"], m["n_words"]),
        "upper_share": share(m["n_upper"], m["word_chars"]),
    }


def allowed_rejections(n: Column, rate: float, level: Column) -> Column:
    """Most rejections ``k`` among ``n`` for which P(Binomial(n, rate) <= k) <= level; else -1.

    Terms are kept as logarithms, so none underflows before the sum needs it.
    """
    odds = math.log(rate / (1 - rate))
    start = F.struct(
        (n * math.log1p(-rate)).alias("term"), F.lit(0.0).alias("sum"), F.lit(-1).alias("k")
    )

    def add(acc, i):
        total = acc["sum"] + F.exp(acc["term"])
        term = acc["term"] + F.log((n - i) / (i + 1.0)) + odds
        # Beyond the mean the sum is above any level in use, so i stays below n.
        return F.struct(
            term.alias("term"), total.alias("sum"), F.when(total <= level, i).otherwise(acc["k"]).alias("k")
        )

    steps = positions_to(F.floor(n * rate).cast("int"))
    return F.aggregate(steps, start, add, lambda acc: acc["k"])


def exceeded(value: Column, grid: tuple[float, ...]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, grid)), lambda cutoff: value > cutoff))


def select_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    name: str,
    stratum_col: str = "lang",
    id_col: str = "doc_id",
    risk: float = RISK,
    error: float = ERROR,
) -> DataFrame:
    """``(stratum, rule, cutoff, good, allowed, rejected)`` of every safe rule and stratum."""
    judged = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    good_ids = judged.agg(F.min("quality").alias("q")).where(F.col("q") == 1).select("id")
    values = rule_values(col(name))
    stratum = F.coalesce(col(stratum_col).cast("string"), F.lit(""))
    good = (
        measured.select(
            col(id_col).cast("long").alias("id"),
            F.struct(stratum.alias("s"), col(stratum_col).isNull().alias("is_null")).alias("stratum"),
            *[
                # How many candidates the document lies above (grids fall, so a prefix of them
                # never rejects it).
                exceeded(v, RULES[r]).alias(r)
                for r, v in values.items()
            ],
        )
        .join(good_ids, "id")
        .drop("id")
    )
    # Histogram per stratum and rule: a few dozen rows, whatever the number of labels.
    histogram = (
        good.unpivot(["stratum"], list(RULES), "rule", "above")
        .groupBy("stratum", "rule", "above")
        .agg(F.count("*").alias("n"))
    )
    everyone = Window.partitionBy("stratum", "rule")
    stricter = everyone.orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, 0)
    counted = histogram.select(
        "stratum", "rule", "above",
        F.sum("n").over(everyone).alias("good"),
        F.sum("n").over(stricter).alias("at_least"),
    )
    # Candidate g (of m, strictest last) rejects what lies above at least m - g of them.
    grid = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(len(c) - g).cast("int").alias("needed"), F.lit(x).alias("cutoff"))
        for r, c in RULES.items()
        for g, x in enumerate(c)
    ])
    totals = counted.groupBy("stratum").agg(F.max("good").alias("good"))
    strata = totals.agg(F.count("*").alias("n"))
    tests = len(RULES) * max(map(len, RULES.values()))
    level = F.lit(error / tests) / F.greatest(strata.scalar(), F.lit(1))
    limits = totals.withColumn("level", level).withColumn(
        "allowed", allowed_rejections(F.col("good").cast("double"), risk / len(RULES), F.col("level"))
    )
    candidates = limits.select("*", F.explode(grid).alias("c")).select("stratum", "good", "allowed", "c.*")
    rejected = (
        candidates.alias("c")
        .join(counted.alias("h"), ["stratum", "rule"], "left")
        .groupBy("stratum", "rule", "cutoff", F.col("c.good").alias("good"), "allowed")
        .agg(F.coalesce(F.max(F.when(F.col("above") >= F.col("needed"), F.col("at_least"))), F.lit(0)).alias("rejected"))
    )
    safe = rejected.where(F.col("rejected") <= F.col("allowed"))
    return safe.groupBy("stratum", "rule").agg(
        F.min("cutoff").alias("cutoff"),
        F.first("good").alias("good"),
        F.first("allowed").alias("allowed"),
        F.min_by("rejected", "cutoff").alias("rejected"),
    )


def error_share(stops: int) -> float:
    """Share of the error for each sequence of tests in which so many rules have stopped."""
    if stops == 0:
        return UNSTOPPED
    ways = math.comb(len(SEQUENCE), stops) * max(map(len, RULES.values())) ** stops
    return (1 - UNSTOPPED) / (len(SEQUENCE) - 1) / ways


def joint_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    name: str,
    stratum_col: str = "lang",
    id_col: str = "doc_id",
    risk: float = RISK,
    error: float = ERROR,
) -> DataFrame:
    """``(stratum, rule, cutoff, good, rejected)``; ``rejected`` counts what all cutoffs reject."""
    judged = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    good_ids = judged.agg(F.min("quality").alias("q")).where(F.col("q") == 1).select("id")
    values = rule_values(col(name))
    stratum = F.coalesce(col(stratum_col).cast("string"), F.lit(""))
    good = measured.select(
        col(id_col).cast("long").alias("id"),
        F.struct(stratum.alias("s"), col(stratum_col).isNull().alias("is_null")).alias("stratum"),
        F.array(*[exceeded(values[r], RULES[r]) for r in SEQUENCE]).alias("above"),
    ).join(good_ids, "id")
    # One row per stratum; its cells are at most the product of the grids, whatever the labels.
    cells = (
        good.groupBy("stratum", "above")
        .agg(F.count("*").alias("n"))
        .groupBy("stratum")
        .agg(F.sum("n").alias("good"), F.collect_list(F.struct("above", "n")).alias("cells"))
    )
    strata = cells.agg(F.count("*").alias("n")).scalar()

    def limit(stops):
        return allowed_rejections(F.col("good").cast("double"), risk, F.col("level") * error_share(stops))

    cells = cells.withColumn("level", F.lit(error) / F.greatest(strata, F.lit(1)))
    cells = cells.withColumn("allowed", F.array(*map(limit, range(len(SEQUENCE)))))
    # Candidate g (of m, strictest last) rejects what lies above at least m - g of them.
    steps = F.array(*[
        F.struct(F.lit(i).alias("rule"), F.lit(len(RULES[r]) - g).alias("needed"))
        for i, r in enumerate(SEQUENCE)
        for g in range(len(RULES[r]))
    ])

    def state(needed, rejected, stops, stopped):
        return F.struct(
            needed.alias("needed"), rejected.alias("rejected"), stops.alias("stops"), stopped.alias("stopped")
        )

    def test(acc, step):
        def tried(i):
            return F.when(step["rule"] == i, step["needed"]).otherwise(acc["needed"][i])

        def hit(cell):
            out = F.lit(False)
            for i in range(len(SEQUENCE)):
                out = out | (cell["above"][i] >= tried(i))
            return out

        rejected = F.aggregate("cells", F.lit(0).cast("long"), lambda n, cell: n + F.when(hit(cell), cell["n"]).otherwise(0))
        passed = state(F.array(*map(tried, range(len(SEQUENCE)))), rejected, acc["stops"], acc["stopped"])
        failed = state(acc["needed"], acc["rejected"], acc["stops"] + 1, step["rule"])
        most = F.get(F.col("allowed"), acc["stops"])
        return (
            F.when(acc["stopped"] == step["rule"], acc)
            .when((most >= 0) & (rejected <= most), passed)
            .otherwise(failed)
        )

    off = F.array(*[F.lit(len(RULES[r]) + 1) for r in SEQUENCE])
    begin = state(off, F.lit(0).cast("long"), F.lit(0), F.lit(-1))
    ended = cells.select("stratum", "good", F.aggregate(steps, begin, test).alias("end"))
    chosen = F.array(*[
        F.struct(
            F.lit(r).alias("rule"),
            F.get(F.array(*map(F.lit, RULES[r])), len(RULES[r]) - F.col("end")["needed"][i]).alias("cutoff"),
        )
        for i, r in enumerate(SEQUENCE)
    ])
    found = ended.select("stratum", "good", F.col("end")["rejected"].alias("rejected"), F.explode(chosen).alias("c"))
    return found.select("stratum", "c.*", "good", "rejected").where(F.col("cutoff").isNotNull())


def verdicts(measured: DataFrame, cutoffs: DataFrame, name: str, stratum_col: str = "lang") -> Column:
    """Whether a document passes the base rules and every cutoff of its stratum."""
    entries = cutoffs.select(
        F.struct(F.struct("stratum", "rule").alias("key"), F.col("cutoff").alias("value")).alias("e")
    )
    table = entries.agg(F.map_from_entries(F.collect_list("e"))).scalar()
    stratum = F.struct(
        F.coalesce(col(stratum_col).cast("string"), F.lit("")).alias("s"), col(stratum_col).isNull().alias("is_null")
    )
    passes = ~base_failed(col(name))
    for rule, value in rule_values(col(name)).items():
        cutoff = F.try_element_at(table, F.struct(stratum.alias("stratum"), F.lit(rule).alias("rule")))
        passes = passes & F.coalesce(value <= cutoff, F.lit(True))
    return passes


def keep_good(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the cutoffs of their stratum."""
    measured, name = measure(docs)
    measured = materialize(measured, "measured")
    cutoffs = joint_cutoffs(measured, labels, name, stratum_col, **options)
    return measured.where(verdicts(measured, cutoffs, name, stratum_col)).select(*map(col, docs.columns))
