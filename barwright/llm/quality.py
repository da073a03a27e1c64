"""Quality rules under weak supervision, with DataFrame functions only.

Each rule votes good, votes bad or abstains. Expectation-maximisation over the table of vote patterns (at most three to
the power of the rules, whatever the input) estimates how often each rule is right on good and on bad documents; the
posterior probability of being good replaces the demand that all rules pass. A rule is held to be no worse than
chance, so good votes never count against a document, and abstaining counts for nothing.

Nulls: a null text is an empty one; documents without words fail the base. Columns other than the text may hold
anything. Repeated rows get the same verdict. An empty table gives an empty result.
"""

import math

from pyspark.sql import functions as F

from barwright.llm.common import let, settle, text_of, windows_of, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
ROUNDS = 12
#: A rule is right on at least so many of the good documents that it votes on.
LEAST_RIGHT = 0.97


def covered(ws):
    """Words inside windows that occur twice or more in the array of words.

    Windows are compared by 64-bit hashes. Only documents whose windows repeat pay for the sort that finds where.
    """
    def count(hashes):
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(p):
            n = F.size(p)
            same = F.filter(p, lambda x, i: ((i > 0) & (F.get(p, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(p, i + 1)["h"] == x["h"])))
            starts = F.array_sort(F.transform(same, lambda x: x["i"]))
            return let(starts, lambda s: F.aggregate(
                F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1), x + WINDOW) - x)), F.lit(0), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, repeated))
    return F.when(F.size(ws) < WINDOW, F.lit(0)).otherwise(let(windows_of(ws, WINDOW), count))


def measures(docs):
    """``docs`` with _quality and _lines, the measures that the rules look at; each text is split into words once."""
    t = text_of()
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit("\t\x0b\x0c\r ")) != "")

    def of_words(ws):
        joined = F.array_join(ws, "")
        return let(joined, lambda j: F.struct(
            F.size(ws).cast("long").alias("words"), F.char_length(j).cast("long").alias("chars"),
            (F.char_length(j) - F.char_length(F.regexp_replace(j, r"[#*$%&|<>]", ""))).cast("long").alias("symbols"),
            covered(ws).cast("long").alias("repeated"),
            F.size(F.array_distinct(ws)).cast("long").alias("distinct"),
            F.char_length(F.regexp_replace(j, r"[^\p{L}\p{M}]+", "")).cast("long").alias("letter_chars"),
            F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("lettered"),
            F.size(F.filter(ws, lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.char_length(w) > 2))).cast("long").alias("upper"),
            (F.char_length(j) - F.char_length(F.replace(j, F.lit("!"), F.lit("")))).cast("long").alias("shouts")))

    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return docs.withColumn("_quality", let(words(t), of_words)).withColumn("_lines", of_lines)


def base_failed():
    return (F.col("_quality.words") < 10) | (100 * F.col("_quality.repeated") > 20 * F.col("_quality.words"))


def rules():
    """name -> (bad when, good when); a rule abstains where neither holds."""
    n = F.greatest(F.col("_quality.words"), F.lit(1))
    long_enough = F.col("_quality.words") >= 30
    share = lambda c: F.col(f"_quality.{c}") / n
    lines = F.col("_lines.dup") / F.greatest(F.col("_lines.all"), F.lit(1))
    return {
        "length": (F.col("_quality.words") < 10, F.col("_quality.words") >= 50),
        "word_length": ((share("chars") < 2.5) | (share("chars") > 9), share("chars").between(3.5, 7)),
        "symbols": (share("symbols") > 0.1, share("symbols") <= 0.02),
        "dup_lines": ((lines > 0.4) & (F.col("_lines.all") >= 4), (lines <= 0.05) & (F.col("_lines.all") >= 3)),
        "repeats": (share("repeated") > 0.2, share("repeated") <= 0.05),
        "upper": (share("upper") > 0.2, share("upper") <= 0.1),
        "letters": (long_enough & (share("lettered") < 0.8), share("lettered") >= 0.95),
        "letter_chars": (long_enough & (F.col("_quality.letter_chars") < 0.75 * F.col("_quality.chars")), F.col("_quality.letter_chars") >= 0.85 * F.col("_quality.chars")),
        "shouts": (share("shouts") > 0.2, share("shouts") <= 0.05),
        "variety": (share("distinct") < 0.1, (share("distinct") > 0.4) & (F.col("_quality.words") >= 50)),
    }


def votes():
    """One column per rule: 1 good, -1 bad, 0 abstains."""
    return {name: F.when(bad, -1).when(good, 1).otherwise(0).cast("int") for name, (bad, good) in rules().items()}


def posterior_log_odds(vote, names, prior, right_good, right_bad):
    """Log odds that a document is good, given its votes (a column by name of the rule)."""
    out = F.lit(math.log(prior / (1 - prior)))
    for r in names:
        good = math.log(right_good[r] / (1 - right_bad[r]))
        bad = math.log((1 - right_good[r]) / right_bad[r])
        out = out + F.when(vote(r) == 1, good).when(vote(r) == -1, bad).otherwise(0.0)
    return out


def fit(patterns, names, rounds=ROUNDS):
    """Prior and rule accuracies (right on good documents, right on bad ones) from patterns(names..., n).

    Each round is one aggregate over the pattern table and returns one row. The rules are written to spare good
    documents, each after one kind of bad ones: the start says so (a bad vote is rare on good documents, a
    good vote common on either), and LEAST_RIGHT holds it.
    """
    prior, right_good, right_bad = 0.8, dict.fromkeys(names, 0.995), dict.fromkeys(names, 0.2)
    for _ in range(rounds):
        p = F.lit(1.0) / (1 + F.exp(-posterior_log_odds(F.col, names, prior, right_good, right_bad)))
        q = patterns.withColumn("_g", p * F.col("n")).withColumn("_b", (1 - p) * F.col("n"))
        pick = lambda who, r, v: F.sum(F.when(F.col(r) == v, F.col(who)).otherwise(0.0)).alias(f"{who}{r}{v}")
        row = q.agg(F.sum("n").alias("n"), F.sum("_g").alias("g"), *[pick(w, r, v) for w in ("_g", "_b") for r in names for v in (1, -1)]).first()
        if not row["n"]:
            break
        prior = min(max((row["g"] + 1) / (row["n"] + 2), 0.5), 0.999)
        for r in names:
            good = (row[f"_g{r}1"] + 10) / (row[f"_g{r}1"] + row[f"_g{r}-1"] + 10.05)
            bad = (row[f"_b{r}-1"] + 2) / (row[f"_b{r}1"] + row[f"_b{r}-1"] + 10)
            right_good[r] = min(max(good, LEAST_RIGHT), 0.999)
            right_bad[r] = min(max(bad, 1 - right_good[r]), 0.999)
    return prior, right_good, right_bad


def judge(measured):
    """``measured`` (_quality, _lines) with _failed, _score (posterior of being good) and _kept."""
    vote = votes()
    names = list(vote)
    patterns = settle(measured.select(*[c.alias(r) for r, c in vote.items()]).groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    odds = posterior_log_odds(vote.get, names, *fit(patterns, names))
    out = measured.withColumn("_failed", base_failed()).withColumn("_score", F.lit(1.0) / (1 + F.exp(-odds)))
    return out.withColumn("_kept", ~F.col("_failed") & (F.col("_score") >= 0.5))


def stage(spark, docs, sf_dir):
    """Pipeline stage: the documents that the verdict keeps, with the columns they came with."""
    return judge(measures(docs)).where("_kept").select(*docs.columns)


def query(spark, sf_dir):
    """Measures, base and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge(settle(measures(docs).select("doc_id", "_quality", "_lines")))
    return out.select("doc_id", F.col("_quality.words").alias("n_words"), F.col("_quality.chars").alias("word_chars"), F.col("_quality.symbols").alias("n_symbols"),
                      F.col("_lines.dup").alias("n_dup_lines"), F.col("_quality.repeated").alias("n_repeat_words"),
                      F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_score").alias("score"))
