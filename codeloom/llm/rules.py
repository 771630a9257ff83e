"""Quality rules by weak supervision.

Each rule looks at one trait of a text and votes to keep it, to reject it, or abstains. The votes
of all documents are counted by pattern (at most 3^rules patterns, whatever the input), and
expectation-maximisation over these counts estimates how each rule votes on good and on bad
documents. A document is kept when its posterior probability of being good is at least a half.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import WHITE_SPACE
from codeloom.sources.scratch import materialize
from codeloom.sources.tables import read_table

# The commonest function words of the languages that the rules know.
STOP_WORDS = frozenset(
    """the and of to in is that it for on with as by this be are was a
    der die und den von das nicht mit ist im ein eine sich auf dem zu des
    le la les de et des un une du en que est pour qui dans par sur au
    el los las y del se por con no para su al una lo""".encode().split()
)
# Characters that count as symbols, and ASCII capitals.
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

TRAITS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_capitals long, n_bangs long, n_stop long, n_distinct long, n_marks long"
)


def traits(text: str | None) -> tuple[int, ...]:
    """The counts that rules look at, in the order of TRAITS; a null text counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE_SPACE)]
    distinct: dict[bytes, int] = {}
    ids = [distinct.setdefault(w, len(distinct)) for w in words]
    repeated = 0
    if len(words) > 3:
        x = np.array(ids, np.int64)
        n = len(distinct)
        pairs = x[:-1] * n + x[1:]
        # Pairs are numbered anew, so that the code of a triple fits 64 bits in any text.
        pairs = np.unique(pairs, return_inverse=True)[1] if n > 1_000_000 else pairs
        _, number, times = np.unique(pairs[:-1] * n + x[2:], return_inverse=True, return_counts=True)
        again = times[number] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        repeated = int(covered.sum())
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words),
        len(text) - gone(WHITE_SPACE),
        gone(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        gone(CAPITALS),
        gone(b"!"),
        sum(w in STOP_WORDS for w in map(bytes.lower, words)),
        len(distinct),
        sum(not w.isalnum() and len(w.strip(b"|#*$%&<>!=-_~.,;:")) == 0 for w in words if len(w) < 4),
    )


def traits_of(text: Column) -> Column:
    names = [x.split()[0] for x in TRAITS.split(", ")]

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([traits(t) for t in texts], columns=names)

    return F.pandas_udf(run, TRAITS)(text.cast("string"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(2)).otherwise(F.lit(1))


def votes(t: Column) -> dict[str, Column]:
    """The rules: 0 rejects, 1 abstains, 2 keeps."""
    words = F.greatest(t["n_words"], F.lit(1))
    share = lambda a: t[a] / words
    length = t["word_chars"] / words
    return {
        "symbols": _vote(share("n_symbols") > 0.25, share("n_symbols") < 0.03),
        "capitals": _vote(t["n_capitals"] > 0.4 * t["word_chars"], t["n_capitals"] < 0.1 * t["word_chars"]),
        "repeats": _vote(share("n_repeat_words") > 0.3, share("n_repeat_words") < 0.1),
        "lines": _vote((t["n_dup_lines"] > 0.3 * t["n_lines"]) & (t["n_dup_lines"] > 3), (t["n_dup_lines"] == 0) & (t["n_lines"] > 2)),
        "function_words": _vote(share("n_stop") < 0.06, share("n_stop") > 0.12),
        "variety": _vote((share("n_distinct") < 0.15) & (t["n_words"] < 2000), share("n_distinct") > 0.35),
        "word_length": _vote((length < 2) | (length > 14), (length > 3) & (length < 9)),
        "shouting": _vote(share("n_bangs") > 0.2, share("n_bangs") < 0.03),
        "loose_marks": _vote(share("n_marks") > 0.15, share("n_marks") < 0.02),
    }


def fit(patterns: np.ndarray, weight: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> tuple[float, np.ndarray]:
    """The share of good documents and P(vote | bad, good) for each rule, by expectation-maximisation.

    ``patterns`` has a row for each pattern of votes and ``weight`` how many documents show it. It
    starts from the view that one rejection is a doubt and several are near certain.
    """
    good = np.array([0.98, 0.4, 0.05])[np.minimum((patterns == 0).sum(1), 2)]
    table = np.zeros((2, patterns.shape[1], 3))
    share = 0.9
    for _ in range(rounds):
        for y, p in enumerate((1 - good, good)):
            for v in range(3):
                table[y, :, v] = ((patterns == v) * (p * weight)[:, None]).sum(0) + smooth
        table /= table.sum(2, keepdims=True)
        total = weight.sum() + 2
        share = ((good * weight).sum() + 1) / total
        logs = [np.log(table[y])[np.arange(patterns.shape[1]), patterns].sum(1) for y in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - share) - logs[1] - np.log(share), -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return float(share), table


def learn(measured: DataFrame) -> tuple[float, np.ndarray]:
    """Fit the rules' accuracies on all rows of a table that has the texts' traits in column t."""
    v = measured.select(*[x.alias(k) for k, x in votes(F.col("t")).items()])
    seen = v.groupBy(*v.columns).count().collect()
    names = v.columns
    if not seen:
        return 0.5, np.full((2, len(names), 3), 1 / 3)
    seen.sort()
    return fit(np.array([[r[k] for k in names] for r in seen]), np.array([r["count"] for r in seen], float))


def _judged(df: DataFrame, text: str, kept_columns: list[str], min_words: int, threshold: float) -> DataFrame:
    """(row: the columns asked for, t: traits, base_failed, posterior, kept). Texts are read once: their traits go to a table, with what has to go on beside them."""
    row = F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("row")
    measured = materialize(df.select(row, traits_of(F.col(f"`{text}`")).alias("t")), "traits")
    share, table = learn(measured)
    t = F.col("t")
    odds = F.lit(float(np.log(share / (1 - share))))
    for i, v in enumerate(votes(t).values()):
        worth = np.log(table[1, i] / table[0, i])
        odds = odds + F.when(v == 0, F.lit(float(worth[0]))).when(v == 1, F.lit(float(worth[1]))).otherwise(F.lit(float(worth[2])))
    failed = (t["n_words"] < min_words) | (100 * t["n_repeat_words"] > 50 * t["n_words"])
    out = measured.withColumns({"base_failed": failed, "posterior": 1 / (1 + F.exp(-odds))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def judge(df: DataFrame, text: str = "text", min_words: int = 50, threshold: float = 0.5) -> DataFrame:
    """Add the traits that the base rules look at, base_failed, posterior and kept to every row.

    A text with under ``min_words`` words, or over half of whose words stand in repeated windows of
    three, fails outright; one whose posterior is just the threshold is kept. Null and empty texts
    have no words and so fail. Repeated rows are judged alike and each counts. An empty table gives
    no rows. Columns that have one of the added names are replaced; all others keep their values.
    """
    traits_added = [x.split()[0] for x in TRAITS.split(", ")[:5]]
    added = [*[F.col("t")[c].alias(c) for c in traits_added], "base_failed", "posterior", "kept"]
    others = [c for c in df.columns if c not in (*traits_added, "base_failed", "posterior", "kept")]
    return _judged(df, text, df.columns, min_words, threshold).select(*[F.col("row")[c].alias(c) for c in others], *added)


def keep_good(df: DataFrame, text: str = "text", min_words: int = 50, threshold: float = 0.5) -> DataFrame:
    """The rows that the rules keep, with all their columns as they were, whatever their names.

    Null and empty texts go, repeated rows stay or go together, a posterior at the threshold stays,
    and an empty table gives no rows.
    """
    return _judged(df, text, df.columns, min_words, threshold).where("kept").select("row.*")


def op5_weak_supervision(spark, sf_dir: str) -> DataFrame:
    """The verdict on every document, from rules whose accuracy is estimated on all of them."""
    found = _judged(read_table(spark, sf_dir, "documents"), "text", ["doc_id"], 50, 0.5)
    names = [x.split()[0] for x in TRAITS.split(", ")[:5]]
    return found.select("row.doc_id", *[F.col("t")[c].alias(c) for c in names], "base_failed", "kept", "posterior")
