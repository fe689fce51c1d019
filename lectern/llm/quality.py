"""Quality rules with host-level verdicts (DataFrame functions only).

Words are runs of characters other than space and \\t..\\r. For each text: n_words; word_chars (code points in words);
n_symbols (characters of #*$%&|<>); n_dup_lines (lines that hold a word and equal an earlier line); n_repeat_words (words in
three-word windows that occur twice or more, first occurrences included). A text fails its own rules with fewer than
min_words words, or if more than max_repeat percent of its words repeat.

Failures are then aggregated by host. A host's rate is shrunk towards the mean of all hosts by a beta prior fitted to the
hosts' rates by moments, so that a host with few documents isn't judged by chance; a host above max_host_rate takes its
remaining documents with it.

Defined cases: a null or blank text has no words and fails; a null host is a host of its own; equal rows are judged alike
and each counts; an empty table gives an empty result; other columns of the input are ignored (features) or kept (filter).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BLANKS, join_shuffled, let, words_of, written

MIN_WORDS = 50
MAX_REPEAT = 50
MAX_HOST_RATE = 0.5
#: Hosts that fail: up to so many are broadcast, more are joined by a salted shuffle.
BROADCAST_HOSTS = 100_000
SALTS = 32

_POSITION_BITS = 30
_POSITION = (1 << _POSITION_BITS) - 1


def _window(words: Column, i: Column) -> tuple[Column, Column, Column]:
    return F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)


def _suspects(words: Column) -> Column:
    """Starts of the windows whose hash prefix occurs twice: all repeated windows and, seldom, others."""
    packed = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(*_window(words, i)).bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("long")),
    )
    above = lambda x: F.shiftright(x, _POSITION_BITS)
    twins = let(
        F.sort_array(packed),
        lambda s: F.filter(
            s,
            lambda x, i: F.coalesce(above(x) == above(F.get(s, i + 1)), F.lit(False))
            | F.coalesce(above(x) == above(F.get(s, i - 1)), F.lit(False)),
        ),
    )
    return F.transform(twins, lambda x: x.bitwiseAND(F.lit(_POSITION)).cast("int"))


def _covered(starts: Column) -> Column:
    """Words in windows of three words at the given ascending starts."""
    gap = lambda i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - F.get(starts, i), F.lit(3)))
    return F.aggregate(F.transform(starts, lambda _, i: gap(i)), F.lit(0), lambda a, x: a + x)


def repeated_words(words: Column) -> Column:
    """Exact number of words in repeated three-word windows; sorts only what hashes point to."""

    def exact(at: Column) -> Column:
        keyed = F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", *_window(words, i)).alias("g"), i.alias("i"))))
        same = let(
            keyed,
            lambda s: F.filter(
                s,
                lambda x, k: F.coalesce(x["g"] == F.get(s, k + 1)["g"], F.lit(False))
                | F.coalesce(x["g"] == F.get(s, k - 1)["g"], F.lit(False)),
            ),
        )
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), _covered)

    found = let(_suspects(words), lambda at: F.when(F.size(at) > 0, exact(at)).otherwise(0))
    return F.when(F.size(words) >= 4, found).otherwise(0)


def features(docs: DataFrame, keep: list[str], text: str = "text", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The columns keep, then the counts and base_failed of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    from_words = let(
        words_of(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(rf"[^{BLANKS}]"))
    row = docs.select(
        *keep,
        from_words.alias("_w"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("_dup"),
    )
    n, again = F.col("_w.n_words"), F.col("_w.n_repeat_words")
    return row.select(
        *keep,
        n.alias("n_words"),
        F.col("_w.word_chars").alias("word_chars"),
        F.col("_symbols").alias("n_symbols"),
        F.col("_dup").alias("n_dup_lines"),
        again.alias("n_repeat_words"),
        ((n < min_words) | (100 * again > max_repeat * n)).alias("base_failed"),
    )


def host_rates(judged: DataFrame, host: str) -> DataFrame:
    """For each host: n, failed, and rate, the failure rate shrunk by an empirical beta prior.

    The prior's mean is the mean m of the hosts' raw rates; its weight is m(1-m)/v - 1, v being their variance less the part
    that sampling explains, held within 1 and 10,000. Only the prior's two sums reach the driver.
    """
    hosts = judged.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("_n"), F.count_if("base_failed").alias("_k"))
    r = F.col("_k") / F.col("_n")
    m, v = hosts.agg(F.avg(r), F.var_pop(r) - F.avg(r * (1 - r) / F.col("_n"))).first()
    weight = 10_000.0 if not m or m >= 1 or v <= 0 else min(10_000.0, max(1.0, m * (1 - m) / v - 1))
    return hosts.withColumn("_rate", (F.col("_k") + F.lit(weight * (m or 0.0))) / (F.col("_n") + F.lit(weight)))


def with_verdicts(judged: DataFrame, host: str, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """judged plus host_failed. judged is read twice: pass a table."""
    bad = host_rates(judged, host).where(F.col("_rate") > max_host_rate).select("_host", F.lit(True).alias("host_failed"))
    mine = judged.withColumn("_mine", F.col(host))
    if bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        out = mine.join(F.broadcast(bad), F.col("_mine").eqNullSafe(F.col("_host")), "left")
    else:  # a host may hold a third of all rows
        salted = mine.withColumn("_salt", (F.rand(7) * SALTS).cast("int"))
        wide = bad.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = join_shuffled(salted, wide, F.col("_mine").eqNullSafe(F.col("_host")) & (F.col("_salt") == F.col("_to")), "left").drop("_salt", "_to")
    return out.withColumn("host_failed", F.coalesce("host_failed", F.lit(False))).drop("_mine", "_host")


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """id, host, counts, base_failed, host_failed and kept of every row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    judged = with_verdicts(written(features(own, ["doc_id", "host"]), "quality"), "host")
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that pass their own rules and whose host passes, with all their columns."""
    own = docs.select(F.struct("*").alias("_doc"), F.col(text).alias("_text"), F.col(host).alias("_of"))
    judged = features(own, ["_doc", "_of"], text="_text").select("_doc", "_of", "base_failed")
    table = written(judged, "quality-docs")
    good = with_verdicts(table, "_of").where(~F.col("base_failed") & ~F.col("host_failed"))
    return good.select("_doc.*")
