"""Source divergence audit: which sources of a language use words unlike each other, and which words stand out.

Terms are counted by source in Arrow batches, and only partial counts are exchanged. Terms whose
counts are the same in every source form one class: pairs of sources are compared once for each
class, and the result is multiplied by the number of its terms. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import in_slices, text_bytes
from codeloom.sources.scratch import discard, materialize
from codeloom.sources.tables import read_table

#: Bytes of terms: ASCII letters in lower case, and all bytes of other characters; the rest separates terms.
FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
TERM = re.compile(rb"[^ ]+")
SCALE = 1_000_000_000


def _runs(text: bytes, piece: int) -> Iterator[list[bytes]]:
    """The terms of a text, in lists: a list of all, or of some thousands each where the text is longer than ``piece``."""
    folded = text.translate(FOLD)
    if len(folded) <= piece:
        yield folded.split()
        return
    out: list[bytes] = []
    for m in TERM.finditer(folded):
        out.append(m.group())
        if len(out) == 65536:
            yield out
            out = []
    yield out


def count_terms(docs: DataFrame, text: str, lang: str, source: str, entries: int = 400_000, size: int = 32 << 20) -> DataFrame:
    """Partial counts (lang, source, term, n, docs) of every task; a task hands over what it has after so many terms or bytes of text."""

    def flush(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (own_lang, own_source), (n, docs_of) in counts.items():
            terms = list(n)
            for first in range(0, len(terms), 50_000):
                part = terms[first : first + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([own_lang] * len(part), pa.string()),
                        pa.array([own_source] * len(part), pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([n[t] for t in part], pa.int64()),
                        pa.array([docs_of[t] for t in part], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = read = 0
        for batch in in_slices(batches):
            for own_lang, own_source, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, docs_of = counts.setdefault((own_lang, own_source), (Counter(), Counter()))
                before = len(n)
                distinct: set[bytes] = set()
                for words in _runs(content, 4 << 20):
                    n.update(words)
                    distinct.update(words)
                docs_of.update(distinct)
                held, read = held + len(n) - before, read + len(content)
                if held >= entries or read >= size:
                    yield from flush(counts)
                    held = read = 0
        yield from flush(counts)

    own = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")), text_bytes(F.col(f"`{text}`")))
    return own.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def term_vectors(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10) -> DataFrame:
    """(lang, term, vec) of the terms in at least ``min_docs`` documents of a language; vec lists (source, n) by source, where n > 0.

    One exchange, by language and term, serves both sums. There are as many partitions as the table
    is read in, or as the session sets if that is more.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    cells = count_terms(docs, text, lang, source).repartition(parts, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec"))
    return vectors.where(F.col("docs") >= min_docs).select("lang", "term", "vec")


def classes_of(vectors: DataFrame, top: int) -> DataFrame:
    """(lang, vec, m, terms): how many terms have just this vector, and the first ``top`` of them.

    A class may hold very many terms: they are counted before they are exchanged, and each task hands
    over no more than its first ones.
    """
    many = vectors.groupBy("lang", "vec").agg(F.count(F.lit(1)).alias("m"))
    first = vectors.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "vec").orderBy("term"))).where(F.col("nth") <= top)
    return many.join(first.groupBy("lang", "vec").agg(F.array_sort(F.collect_list("term")).alias("terms")), ["lang", "vec"])


def share(count: np.ndarray, whole) -> np.ndarray:
    """1 + floor(SCALE * count / whole), in steps of a thousand, so that nothing exceeds 64 bits while ``whole`` is under 9e15."""
    out, rest = np.divmod(count, whole)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + step
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))"""
    return (p - q) ** 2 // (p + q)


def _compare(top: int, cells: int = 1 << 20) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a piece of a language's classes adds to each pair of its sources (the lesser name first), and each source's first terms."""

    def run(own: pa.Table, about: pa.Table) -> pa.Table:
        lang, names = about["own_lang"][0].as_py(), about["groups"][0].as_py()
        sources = [g["source"] for g in names]
        kept = about["kept"][0].as_py()
        whole = np.array([g["n"] for g in names], np.int64) + 2 * kept
        whole_lang = sum(g["n"] for g in names) + 2 * kept
        s = len(sources)
        sums = np.zeros((s, s), np.int64)
        best: list[list[tuple[int, bytes, str]]] = [[] for _ in sources]
        value_set = pa.array(sources, pa.string())
        step = max(1, cells // s)
        for first in range(0, len(own), step):
            part = own.slice(first, step).combine_chunks()
            vec = part["vec"].combine_chunks()
            flat = vec.flatten()
            row = np.asarray(pc.list_parent_indices(vec), np.int64)
            column = np.asarray(pc.index_in(flat.field("source"), value_set=value_set), np.int64)
            n = np.zeros((len(part), s), np.int64)
            n[row, column] = np.asarray(flat.field("n"), np.int64)
            m = np.asarray(part["m"], np.int64)
            p = share(n + 2, whole)
            for i in range(s - 1):
                sums[i, i + 1 :] += (m[:, None] * gap(p[:, i : i + 1], p[:, i + 1 :])).sum(0)
            q = share(n.sum(1) + 2, whole_lang)
            value = np.where((n > 0) & (p > q[:, None]), gap(p, q[:, None]), -1)
            terms = part["terms"].to_pylist()
            place = np.empty(len(terms), np.int64)
            place[sorted(range(len(terms)), key=lambda k: terms[k][0].encode())] = np.arange(len(terms))
            for i in range(s):
                # Of classes in this order no term after the first ``top`` classes can be among the first ``top`` terms.
                high = np.flatnonzero(value[:, i] >= 0)
                for k in high[np.lexsort((place[high], -value[high, i]))[:top]]:
                    best[i] += [(-int(value[k, i]), t.encode(), t) for t in terms[k]]
                best[i] = sorted(best[i])[:top]
        i, j = np.triu_indices(s, 1)
        out = [("pair", sources[a], sources[b], int(x)) for a, b, x in zip(i.tolist(), j.tolist(), sums[i, j], strict=True)]
        out += [("term", sources[a], t, -v) for a in range(s) for v, _, t in best[a]]
        part, source, item, value = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "part": pa.array(part, pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    return run


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top: int = 10, piece: int = 4096) -> DataFrame:
    """(lang, source, part, item, value, rank) by the divergence of word shares.

    Part ``pair``: for every other source of the language the sum over all kept terms, all ranks.
    Part ``term``: the ``top`` terms that the source uses more than its language does. Shares are
    smoothed by two occurrences. Null texts, languages and sources count as ''; a text without terms
    adds its source only; a language without kept terms gives pairs of value 0, one with one source
    no pairs. Repeated rows count as often as they are there; ties are ranked by item, as bytes.
    Other columns do not matter, and an empty table gives no rows.

    Classes are compared in pieces of about ``piece`` of them, numbered by hash; each piece meets one
    row about its language. That row, a piece's sums and a term's vector grow with the number of
    sources in the language, of whose pairs the result has every one anyway.
    """
    vectors = materialize(term_vectors(docs, text, lang, source, min_docs), "vectors")
    classes = materialize(classes_of(vectors, top), "classes")
    kept = vectors.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    sizes = vectors.select("lang", F.explode("vec").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    groups = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source")).distinct()
    about = (
        groups.join(sizes, ["lang", "source"], "left")
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("groups"))
        .join(kept, "lang", "left").select("lang", "groups", F.coalesce("kept", F.lit(0)).alias("kept"))
    )
    pieces = max(1, -(-classes.count() // piece))
    numbered = classes.withColumn("piece", F.pmod(F.xxhash64("vec"), F.lit(pieces)).cast("int"))
    # Languages without classes have piece 0, so that their sources are compared too.
    used = numbered.select("lang", "piece").union(groups.select("lang", F.lit(0))).distinct()
    described = used.join(about, "lang").select(F.col("lang").alias("own_lang"), F.col("piece").alias("own_piece"), "groups", "kept")
    sums = materialize(
        numbered.groupBy("lang", "piece").cogroup(described.groupBy("own_lang", "own_piece")).applyInArrow(_compare(top), "lang string, part string, source string, item string, value long"),
        "sums",
    )
    discard(vectors, classes)
    both = sums.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = both.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.*", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.withColumn("rank", F.row_number().over(order))
    terms = sums.where("part = 'term'").drop("part").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", F.col("rank").cast("int"))


def op11_count_columns(spark, sf_dir: str) -> DataFrame:
    """Divergence of all sources of all documents, by language."""
    return audit(read_table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE_OP11 = r"""
with d as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (
  select row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kept as (select lang, term from words group by lang, term having count(distinct row) >= 10),
counts as (select w.lang, w.source, w.term, count(*) as n from words w join kept k on k.lang = w.lang and k.term = w.term group by all),
groups as (select distinct lang, source from d),
v as (select lang, count(*) as v from kept group by lang),
sizes as (
  select g.lang, g.source, coalesce((select sum(n) from counts c where c.lang = g.lang and c.source = g.source), 0) as n from groups g),
cells as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.n::hugeint + 2 * v.v) as p
  from sizes g join v on v.lang = g.lang join kept k on k.lang = g.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
langs as (
  select c.lang, c.term, 1 + (1000000000::hugeint * (sum(c.n) + 2)) // (any_value(t.n)::hugeint + 2 * any_value(v.v)) as q
  from cells c join v on v.lang = c.lang join (select lang, sum(n) as n from sizes group by lang) t on t.lang = c.lang group by c.lang, c.term),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(x.value, 0) as value
  from groups a join groups b on b.lang = a.lang and b.source <> a.source
  left join (
    select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
    from cells a join cells b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by all) x
  on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (
  select c.lang, c.source, c.term as item, ((c.p - l.q) * (c.p - l.q)) // (c.p + l.q) as value
  from cells c join langs l on l.lang = c.lang and l.term = c.term where c.n > 0 and c.p > l.q),
ranked as (
  select *, 'pair' as part, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select *, 'term' as part, row_number() over (partition by lang, source order by value desc, item) as rank from terms)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 10
"""
