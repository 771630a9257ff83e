"""Search requests over document spaces, lowered to one DataFrame plan.

The order of work: unite the spaces, filter, score texts, rank vectors among what the filters and
the text let through, fuse the scores, add rank features; then count, aggregate, sort, cut a page,
highlight and project.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from math import floor, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators import vectors
from codeloom.operators.vector_index import VectorIndex, nearest


@dataclass(frozen=True)
class MatchText:
    """Words sought in fields, which may carry a boost as in ``title^2``; ``min_should_match`` is a share of the words."""

    fields: tuple[str, ...]
    text: str
    min_should_match: float = 0.0

    def words(self) -> list[str]:
        return list(dict.fromkeys(self.text.lower().split()))

    def needed(self) -> int:
        return max(1, floor(self.min_should_match * len(self.words())))


@dataclass(frozen=True)
class MatchDense:
    """The ``topn`` nearest rows. With an index, of the field and by the request's id, only ``num_candidates`` (twice topn, if not given) of ``probes`` cells get exact scores."""

    field: str
    vector: tuple[float, ...]
    topn: int = 10
    similarity: float = 0.0
    index: VectorIndex | None = None
    num_candidates: int | None = None
    probes: int | None = None


@dataclass(frozen=True)
class MatchSparse:
    field: str
    query: dict


@dataclass(frozen=True)
class MatchTensor:
    field: str
    queries: tuple[tuple[float, ...], ...]


@dataclass(frozen=True)
class Fusion:
    """Weights of the text and of the vectors. With ``compat`` the vector score keeps its full weight."""

    text_weight: float = 0.5
    vector_weight: float = 0.5
    compat: bool = False


@dataclass(frozen=True)
class SortField:
    """Rows without the field come last; a field that no space has sorts as null. ``mode`` reduces arrays."""

    name: str
    ascending: bool = True
    mode: str | None = None


@dataclass(frozen=True)
class RankFeature:
    """Adds weight times the feature, from a MAP column; missing features count 0."""

    field: str
    weights: dict[str, float]


@dataclass(frozen=True)
class SearchRequest:
    select: tuple[str, ...] = ()
    highlight: tuple[str, ...] = ()
    condition: dict = field(default_factory=dict)
    match: tuple = ()
    order_by: tuple[SortField, ...] = ()
    offset: int = 0
    limit: int = 10
    aggs: tuple[str, ...] = ()
    rank: RankFeature | None = None
    id_field: str = "id"
    fill: bool = False  # rows that pass the filters but are not near follow with score 0


@dataclass
class SearchResult:
    hits: DataFrame
    matched: DataFrame
    aggs: dict[str, DataFrame]

    def total(self) -> int:
        return self.matched.count()


def unite(spaces: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), spaces)


def condition(df: DataFrame, wanted: dict) -> Column:
    """All of: a list means any of its values, a scalar equality; values that are false are no filter.

    ``available_int`` 0 means below 1, else not below 1 (null passes). ``exists`` and ``must_not``
    name a field. On arrays a value has to occur.
    """
    kinds = dict(df.dtypes)
    parts = [F.lit(True)]
    for name, value in wanted.items():
        if name == "available_int":
            below = F.coalesce(F.col(name) < 1, F.lit(False))
            parts.append(below if value == 0 else ~below)
        elif name == "exists":
            parts.append(present(df, value))
        elif name == "must_not":
            parts.append(~present(df, value["exists"] if isinstance(value, dict) else value))
        elif not value:
            continue
        elif isinstance(value, list | tuple):
            parts.append(F.arrays_overlap(F.col(name), F.array(*map(F.lit, value))) if kinds[name].startswith("array") else F.col(name).isin(*value))
        elif isinstance(value, str | int):
            parts.append(F.array_contains(F.col(name), value) if kinds[name].startswith("array") else F.col(name) == value)
        else:
            raise TypeError(f"{name}: a condition is a list, a string or an integer")
    return reduce(lambda a, b: a & b, parts)


def present(df: DataFrame, name: str) -> Column:
    there = F.col(name).isNotNull()
    return there & (F.size(name) > 0) if dict(df.dtypes)[name].startswith(("array", "map")) else there


def tokens(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def boosts(match: MatchText) -> list[tuple[str, float]]:
    """(field, boost) of every field."""
    return [(f.partition("^")[0], float(f.partition("^")[2] or 1)) for f in match.fields]


def idf(n: int, docs: int) -> float:
    """A word's weight, 0 to 1, where ``docs`` of n documents have it."""
    n = max(n, 1)
    return log(1 + (n - docs + 0.5) / (docs + 0.5)) / log(1 + (n - 0.5) / 1.5)


def text_score(df: DataFrame, match: MatchText) -> DataFrame:
    """Rows that hold enough of the words, with column text_score.

    A word counts once in a field, by its inverse document frequency brought to 0 to 1 over the
    rows of ``df``; the best field counts. The frequencies of the few words asked for come from one
    aggregate, one row, and are constants of the plan: nothing else moves. That aggregate is run when
    this is called, and reads the texts once more; ``text_index`` has the same scores without them.
    """
    words, fields = match.words(), boosts(match)
    wanted = F.array(*map(F.lit, words)).cast("array<string>")
    rows = df
    for i, (f, _) in enumerate(fields):
        # As a generated column the words found are computed once: a filter on them is not pushed down as another split of the text.
        rows = rows.select("*", F.explode(F.array(F.array_intersect(wanted, tokens(F.coalesce(F.col(f), F.lit("")))))).alias(f"__hits_{i}"))
    has = lambda i, j: F.array_contains(f"__hits_{i}", words[j])
    names = [(i, j) for i in range(len(fields)) for j in range(len(words))]
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(has(i, j)).alias(f"df_{i}_{j}") for i, j in names]).first()
    weight = lambda i, j: idf(counts["n"], counts[f"df_{i}_{j}"])
    score = F.greatest(F.lit(float("-inf")), *[
        sum((F.when(has(i, j), weight(i, j)).otherwise(0.0) for j in range(len(words))), F.lit(0.0)) * boost for i, (_, boost) in enumerate(fields)
    ])
    found = F.size(reduce(F.array_union, [F.col(f"__hits_{i}") for i in range(len(fields))]))
    out = rows.withColumns({"matched_terms": found, "text_score": score}).where(F.col("matched_terms") >= match.needed())
    return out.drop(*[f"__hits_{i}" for i in range(len(fields))])


def only_words(df: DataFrame, match: MatchText) -> DataFrame:
    """The rows with the fields of a match cut to those of its words that they hold: scores stay the same, and a join that comes before them moves no texts."""
    wanted = F.array(*map(F.lit, match.words())).cast("array<string>")
    return df.withColumns({f: F.array_join(F.array_intersect(wanted, tokens(F.coalesce(F.col(f), F.lit("")))), " ") for f, _ in boosts(match)})


def reduced(c: Column, mode: str) -> Column:
    """A multi-valued field as one number for sorting: min, max, avg, sum or median of what is not null; null where there is nothing."""
    c = F.filter(c, lambda x: x.isNotNull())
    c = F.when(F.size(c) > 0, c)
    if mode in ("min", "max"):
        return (F.array_min if mode == "min" else F.array_max)(c)
    total = F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))
    if mode == "sum":
        return total
    if mode == "avg":
        return F.try_divide(total, F.size(c))
    s, n = F.sort_array(c), F.size(c)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")).cast("double") + F.get(s, F.floor(n / 2).cast("int")).cast("double")) / 2


def terms_agg(df: DataFrame, name: str) -> DataFrame:
    """(key, doc_count): most frequent first; values of an array count once a row; nulls do not count."""
    kind = dict(df.dtypes)[name]
    keys = df.select(F.explode(F.array_distinct(name)).alias("key")) if kind.startswith("array") else df.select(F.col(name).alias("key"))
    return keys.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("doc_count")).orderBy(F.desc("doc_count"), "key")


# Where sentences end, and the characters that may stand beside a word that is marked.
SENTENCE_END = r"[.?!;\n]"
BESIDE = r"[ .?/'\"\(\)!,:;-]"


def highlighted(text: Column, words: list[str], end: str = "...") -> Column:
    """The sentences that hold a word, with it marked, joined."""
    wanted = rf"(?i)(^|{BESIDE})({'|'.join(map(re.escape, words))})($|{BESIDE})"
    marked = F.transform(F.split(text, SENTENCE_END), lambda s: F.regexp_replace(s, wanted, "$1<em>$2</em>$3"))
    return F.array_join(F.filter(marked, lambda s: s.contains("<em>")), end)


def search(spaces: list[DataFrame], request: SearchRequest) -> SearchResult:
    base = unite(spaces)
    rows = base.where(condition(base, request.condition))
    text = next((m for m in request.match if isinstance(m, MatchText)), None)
    dense = next((m for m in request.match if isinstance(m, MatchDense)), None)
    fusion = next((m for m in request.match if isinstance(m, Fusion)), Fusion(1.0, 1.0))
    key = request.id_field
    score = F.lit(0.0)
    if text:
        scored = text_score(base, text)
        rows = scored.where(condition(scored, request.condition))
        score = score + F.col("text_score") * fusion.text_weight
    for m in request.match:
        if isinstance(m, MatchSparse):
            score = score + vectors.sparse_score(F.col(m.field), m.query)
        elif isinstance(m, MatchTensor):
            score = score + vectors.max_sim(F.col(m.field), [list(q) for q in m.queries])
    if dense:
        if dense.index:
            among = rows.select(key) if text or request.condition else None
            near = nearest(dense.index, list(dense.vector), dense.topn, key, dense.similarity, dense.num_candidates, dense.probes, among)
        else:
            near = vectors.knn(rows.select(key, dense.field), dense.field, vectors.vector_literal(dense.vector), dense.topn, key, dense.similarity)
        near = near.select(key, F.col("score").alias("knn_score"))
        rows = rows.join(near, key, "left" if text or request.fill else "inner")
        score = score + F.coalesce("knn_score", F.lit(0.0)) * (1.0 if fusion.compat else fusion.vector_weight)
    if request.rank:
        for name, weight in request.rank.weights.items():
            score = score + weight * F.coalesce(F.try_element_at(F.col(request.rank.field), F.lit(name)).cast("double"), F.lit(0.0))
    matched = rows.withColumn("score", score)
    aggs = {name: terms_agg(matched, name) for name in request.aggs}
    keys = []
    for s in request.order_by:
        c = F.col(s.name) if s.name in matched.columns else F.lit(None).cast("string")
        c = reduced(c, s.mode) if s.mode else c
        keys.append(c.asc_nulls_last() if s.ascending else c.desc_nulls_last())
    hits = matched.orderBy(*keys, F.desc("score"), F.col(key)).offset(request.offset).limit(request.limit if request.limit > 0 else 10)
    if request.highlight and text:
        words = text.text.split()
        hits = hits.withColumns({f"{f}_highlight": highlighted(F.col(f), words) for f in request.highlight})
    if request.select:
        hits = hits.select(*dict.fromkeys([key, *request.select, "score", *[f"{f}_highlight" for f in request.highlight if text]]))
    return SearchResult(hits, matched, aggs)


def sources(hits: DataFrame, id_field: str = "id") -> DataFrame:
    """Hits as records: their own fields, then id and _score."""
    rest = [F.col(f"`{c}`") for c in hits.columns if c not in (id_field, "score", "id")]
    return hits.select(*rest, F.col(f"`{id_field}`").alias("id"), F.col("score").alias("_score"))


def shaped_fields(hits: DataFrame, names: list[str], id_field: str = "id") -> DataFrame:
    """(id, fields as JSON): what is null is left out, arrays and ``available_int`` stay, all else becomes a string; hits without any field are left out."""
    kinds = dict(hits.dtypes)
    as_is = lambda n: kinds[n].startswith("array") or n == "available_int" or kinds[n] == "string"
    present_ = [n for n in names if n in kinds]
    if not present_:
        return hits.select(F.col(f"`{id_field}`").alias("id"), F.lit("").alias("fields")).where("false")
    any_ = reduce(lambda a, b: a | b, [F.col(f"`{n}`").isNotNull() for n in present_])
    fields = F.struct(*[(F.col(f"`{n}`") if as_is(n) else F.col(f"`{n}`").cast("string")).alias(n) for n in present_])
    return hits.where(any_).select(F.col(f"`{id_field}`").alias("id"), F.to_json(fields, {"ignoreNullFields": "true"}).alias("fields"))


def rewrite_sql(sql: str, tokenize: Callable[[str], str] | None = None, refine: Callable[[str], str] | None = None) -> str:
    """Runs of blanks and backticks become one blank, percent signs go, and ``x_tks = 'v'`` or ``like 'v'`` becomes match_tks; where both tokenizers are given, the value goes through them."""
    both = tokenize and refine

    def match(m: re.Match) -> str:
        value = refine(tokenize(m[3])).replace("'", "''") if both else m[3]
        return f"match_tks({m[1]}, '{value}', 0.3)"

    sql = re.sub(r"[ `]+", " ", sql).replace("%", "")
    return re.sub(r"([a-z_]*_l?tks)( like | ?= ?)'([^']+)'", match, sql)


def match_tks(text: Column, words: list[str], share: float = 0.3) -> Column:
    """Whether enough of the words occur."""
    have = tokens(text)
    found = sum((F.array_contains(have, w.lower()).cast("int") for w in words), F.lit(0))
    return found >= max(1, floor(share * len(words)))


def run_sql(spark, sql: str, tokenize: Callable[[str], str] | None = None, refine: Callable[[str], str] | None = None) -> DataFrame:
    """A query in Spark SQL after the rewrite; match_tks is a SQL function of the session."""
    spark.sql(
        """create or replace temporary function match_tks(t string, q string, share double) returns boolean return
        size(array_intersect(split(lower(t), '\\\\s+'), array_distinct(split(lower(q), '\\\\s+'))))
          >= greatest(1, floor(share * size(array_distinct(split(lower(q), '\\\\s+')))))"""
    )
    return spark.sql(rewrite_sql(sql, tokenize, refine))
