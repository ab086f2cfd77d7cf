"""Rules on whole documents, and verdicts on the hosts they come from. DataFrame functions only.

Failures of the document rules are added up by host. A host with few documents says little about
itself, so its rate is shrunk towards the others': a beta prior is fitted to the rates of all hosts
by moments, and the posterior mean decides. Hosts over the limit lose all their documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, letters, picked, stored

# What separates words, and what counts as a symbol.
SPACES = " \t\n\x0b\f\r"
SPLIT_WORDS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """A document fails with fewer than ``min_words`` words, or with more than ``max_repeat_pct``
    percent of its words in repeated windows; a host, with a shrunk rate of failures over
    ``max_host_rate``. ``weak_prior`` is the weight, in documents, of the mean rate of hosts when
    their rates do not differ, so that moments give no prior."""

    min_words: int = 50
    max_repeat_pct: int = 50
    max_host_rate: float = 0.5
    weak_prior: float = 2.0


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row, inside lambdas too."""
    return F.transform(F.array(value), use)[0]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPLIT_WORDS), "")


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a window of three words which the text has twice or more."""

    def hashes(w: Column) -> Column:
        three = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])
        )
        return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(three)

    def positions(s: Column) -> Column:
        """Positions of windows that stand next to an equal one in the order of hashes."""
        same = F.transform(
            s,
            lambda x, k: F.when(
                x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"]),
                x["i"],
            ),
        )
        return F.sort_array(F.filter(same, lambda p: p.isNotNull()))

    def covered(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        found = let(F.sort_array(pairs), positions)
        start = F.struct(F.lit(-3).alias("p"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(
            found,
            start,
            lambda a, p: F.struct(
                p.alias("p"), (a["n"] + F.least(F.lit(3), p - a["p"])).cast("bigint").alias("n")
            ),
            lambda a: a["n"],
        )

    def count(h: Column) -> Column:
        none = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(none, F.lit(0).cast("bigint")).otherwise(covered(h))

    return let(words, lambda w: let(hashes(w), count))


def document_counts(
    docs: DataFrame,
    rules: Rules = Rules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null text counts as empty, and fails. Rows are judged one by one, so repeated rows get the same
    counts. Other columns are not carried.
    """
    rows = picked(docs, doc_id=id_col, text=text_col, host=host_col)
    rows = rows.withColumn("text", letters(F.col("text")))
    text = F.col("text")
    with_words = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", "host", "text", _words(text).alias("words"), with_words.alias("lines")
    )
    counts = rows.select(
        "doc_id",
        "host",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, "")))
        .cast("bigint")
        .alias("n_symbols"),
        let(F.col("lines"), lambda x: F.size(x) - F.size(F.array_distinct(x)))
        .cast("bigint")
        .alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < rules.min_words) | (100 * repeated > rules.max_repeat_pct * n)
    return counts.withColumn("base_failed", failed)


def _fails(words: Column, rules: Rules) -> Column:
    n = F.size(words)
    return (n < rules.min_words) | (100 * repeated_words(words) > rules.max_repeat_pct * n)


def accepted(
    docs: DataFrame,
    rules: Rules = Rules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """The rows that ``judged`` keeps, with all their columns.

    Rejected hosts come from the counts of all rows; the document rules are then applied where the
    row is, so texts are not shuffled by id and rows need no id.
    """
    counts = stored(document_counts(docs, rules, id_col, text_col, host_col), "rule-counts")
    rejected = host_verdicts(counts, rules).where("rejected")
    rejected = stored(rejected.select(F.col("host").alias("bad")), "rejected-hosts")
    words = _words(letters(F.col(f"`{text_col}`")))
    sound = boxed(docs.where(~let(words, lambda w: _fails(w, rules))), host=host_col)
    return sound.join(rejected, F.col("host") == F.col("bad"), "left_anti").select("row.*")


def host_verdicts(counts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), rejected. Rows without a host are left out."""
    hosts = (
        counts.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    )
    rate = F.col("n_failed") / F.col("n_docs")
    # One row, whatever the number of hosts.
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var")).first()
    mean, var = prior["mean"] or 0.0, prior["var"] or 0.0
    weight = mean * (1 - mean) / var - 1 if var > 0 else 0.0
    weight = weight if weight > 0 else rules.weak_prior
    shrunk = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.withColumn("rate", shrunk).withColumn(
        "rejected", F.col("rate") > rules.max_host_rate
    )


def judged(
    docs: DataFrame,
    rules: Rules = Rules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """The columns of ``document_counts`` and kept: false if the document fails a rule or its host
    is rejected. Rows without a host have no host verdict. No rows give no rows.

    The texts are read once: counts are stored, added up by host, and joined with rejected hosts.
    """
    counts = stored(document_counts(docs, rules, id_col, text_col, host_col), "rule-counts")
    rejected = host_verdicts(counts, rules).where("rejected").select("host", "rejected")
    kept = ~F.col("base_failed") & F.col("rejected").isNull()
    return counts.join(rejected, "host", "left").withColumn("kept", kept).drop("rejected")
