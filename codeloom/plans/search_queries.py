"""Search queries on the test tables, with the SQL that gives the same rows."""

import numpy as np
from pyspark.sql import functions as F

from codeloom.functions.embedding import register_model
from codeloom.operators import code_search
from codeloom.operators import search as s
from codeloom.operators import text_index, vector_index
from codeloom.operators import vectors as v
from codeloom.operators.meta import list_repositories
from codeloom.schema import AnalysisType
from codeloom.sources.scratch import scratch_folder
from codeloom.sources.tables import read_table

TEXT_QUERY = "the and ention nicht"
HYBRID_QUERY = "the of thereation"


def _emb(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def _vec_of(spark, sf_dir, n):
    """The vector of one row, by id: a query vector."""
    row = _emb(spark, sf_dir).where(F.col("vec_id") == n).select("embedding").first()
    return v.vector_literal(row[0])


def knn_cosine_topk(spark, sf_dir):
    out = v.knn(_emb(spark, sf_dir), "embedding", _vec_of(spark, sf_dir, 0), 10, "vec_id")
    return out.select("vec_id", "label", F.round("score", 6).alias("score"))


def knn_centroid_topk(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    c = v.centroid(emb.where(F.col("vec_id").isin(1, 2, 3)), "embedding")
    query = v.vector_literal(c.first()[0])
    return v.knn(emb, "embedding", query, 10, "vec_id", condition=F.col("label") < 8).select("vec_id", "label", F.round("score", 6).alias("score"))


def knn_filtered(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    out = v.knn(emb, "embedding", _vec_of(spark, sf_dir, 0), 10, "vec_id", condition=s.condition(emb, {"label": [1, 3, 5]}))
    return out.select("vec_id", "label", F.round("score", 6).alias("score"))


def knn_multi_query(spark, sf_dir):
    emb = _emb(spark, sf_dir).select("vec_id", "embedding")
    queries = emb.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    out = v.knn_blocks(emb, "embedding", "vec_id", queries, "embedding", "query_id", 5)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def knn_index_exact(spark, sf_dir):
    """All cells of an inverted file, candidates by the bounds of their codes, exact scores."""
    emb = _emb(spark, sf_dir).select("vec_id", "embedding")
    index = vector_index.build(emb, "embedding", "vec_id", scratch_folder(spark))
    queries = emb.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    out = vector_index.search(index, queries, "embedding", "query_id", 10, "vec_id", exact=True)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def knn_index_recall(spark, sf_dir):
    """Whether the search through some cells finds nine of ten of the true nearest rows, over all queries, by the exact search."""
    emb = _emb(spark, sf_dir).select("vec_id", "embedding")
    index = vector_index.build(emb, "embedding", "vec_id", scratch_folder(spark))
    queries = emb.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    true = v.knn_blocks(emb, "embedding", "vec_id", queries, "embedding", "query_id", 10)
    found = vector_index.search(index, queries, "embedding", "query_id", 10, "vec_id").select("query_id", "vec_id", F.lit(1).alias("hit"))
    pairs = true.select("query_id", "vec_id").join(found, ["query_id", "vec_id"], "left")
    return pairs.agg(F.count(F.lit(1)).alias("true_pairs"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))


def related_union_dedupe(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    lists = []
    for n, labels in ((0, (0, 1, 2, 3, 4)), (1, (3, 4, 5, 6, 7))):
        top = v.knn(emb, "embedding", _vec_of(spark, sf_dir, n), 10, "vec_id", condition=F.col("label").isin(*labels))
        lists.append(top.select("vec_id", "label", F.round("score", 6).alias("score")))
    return v.related(lists, ["vec_id"], ["score"]).select("vec_id", "label", "score", "src")


def _text_scores(spark, sf_dir, share=0.0):
    return s.text_score(_docs(spark, sf_dir), s.MatchText(("text",), TEXT_QUERY, share))


def text_idf_score(spark, sf_dir):
    return _text_scores(spark, sf_dir).select("doc_id", "matched_terms", F.round("text_score", 6).alias("score"))


def text_min_should_match(spark, sf_dir):
    return _text_scores(spark, sf_dir, 0.75).select("doc_id", "matched_terms")


def _text_index(spark, sf_dir):
    return text_index.build(_docs(spark, sf_dir).select("doc_id", "text"), ["text"], "doc_id", scratch_folder(spark))


def text_index_score(spark, sf_dir):
    """The scores of text_idf_score from postings of the words asked for."""
    found = text_index.scores(_text_index(spark, sf_dir), s.MatchText(("text",), TEXT_QUERY))
    return found.select(F.col("id").alias("doc_id"), "matched_terms", F.round("text_score", 6).alias("score"))


def text_index_top(spark, sf_dir):
    """The best fifty of text_min_should_match, from the blocks whose bounds reach them."""
    found = text_index.scores(_text_index(spark, sf_dir), s.MatchText(("text",), TEXT_QUERY, 0.5), top=50)
    return found.select(F.col("id").alias("doc_id"), "matched_terms", F.round("text_score", 6).alias("score"))


def hybrid_weighted_fusion(spark, sf_dir):
    match = s.MatchText(("text",), HYBRID_QUERY, 0.3)
    docs = s.only_words(_docs(spark, sf_dir).select("doc_id", "text", "lang"), match).join(_emb(spark, sf_dir), F.col("doc_id") == F.col("vec_id")).select("doc_id", "text", "lang", "embedding")
    vector = _emb(spark, sf_dir).where("vec_id = 0").select("embedding").first()[0]
    request = s.SearchRequest(
        select=("doc_id", "lang"), match=(match, s.Fusion(0.3, 0.7), s.MatchDense("embedding", tuple(vector), 20)),
        limit=20, id_field="doc_id",
    )
    return s.search([docs], request).hits.select("doc_id", "lang", F.round("score", 6).alias("score"))


def rank_feature_boost(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.create_map(F.lit("quality"), F.col("quality").cast("float"), F.lit("toxic"), F.col("toxic").cast("float")).alias("feas"))
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang").join(labels, "doc_id", "left")
    request = s.SearchRequest(select=("doc_id",), condition={"lang": "en"}, rank=s.RankFeature("feas", {"quality": 2.5, "toxic": -1.0}), limit=50, id_field="doc_id")
    return s.search([docs], request).hits.select("doc_id", F.round("score", 6).alias("score"))


def _labelled(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars").join(read_table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("available_int", F.col("quality"))


def filter_condition_map(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    return df.where(s.condition(df, {"lang": ["en", "de"], "source": "src3", "quality": 0, "toxic": ""})).select("doc_id", "lang", "n_chars")


def filter_available_int(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    return df.where(s.condition(df, {"available_int": 1})).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def filter_exists(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    have, lack = (df.where(s.condition(df, {k: "quality"})) for k in ("exists", "must_not"))
    one = lambda d, kind: d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
    return one(have, "exists").unionByName(one(lack, "missing"))


def terms_agg(spark, sf_dir):
    return s.terms_agg(_docs(spark, sf_dir), "source").select(F.col("key"), "doc_count")


def terms_agg_array(spark, sf_dir):
    words = _docs(spark, sf_dir).select(s.tokens(F.col("text")).alias("words"))
    return s.terms_agg(words, "words").where("key <> ''")


def status_summary(spark, sf_dir):
    from codeloom.operators.meta import status_summary as summary

    kinds = {"view": "pending", "click": "running", "purchase": "completed", "search": "failed"}
    status = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.lit("skipped"))
    return summary(read_table(spark, sf_dir, "events").withColumn("status", status))


def total_hits(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    result = s.search([orders], s.SearchRequest(condition={"o_orderstatus": ["F", "P"]}, id_field="o_orderkey"))
    return result.matched.agg(F.count(F.lit(1)).alias("total"))


def page_offset_limit(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    request = s.SearchRequest(condition={"o_orderstatus": "O"}, order_by=(s.SortField("o_orderdate", ascending=False),), offset=40, limit=20, id_field="o_orderkey")
    return s.search([orders], request).hits.select("o_orderkey", "o_custkey")


def sort_multi_mode(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    modes = [F.round(s.reduced(F.col("embedding").cast("array<double>"), m), 6).alias(f"by_{m}") for m in ("min", "max", "avg", "sum", "median")]
    return emb.select("vec_id", *modes).orderBy(F.desc("by_median"), "vec_id").limit(25)


def highlight_sentences(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    marked = docs.select("doc_id", s.highlighted(F.col("text"), ["the", "nicht"]).alias("highlight"))
    return marked.where("highlight <> ''").select("doc_id", F.md5("highlight").alias("highlight_md5"))


def keyword_or_contains(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("repository_name"), F.col("p_brand").alias("description"), F.col("p_type").alias("organization"), F.lit(None).cast("timestamp").alias("created_at")
    )
    return list_repositories(part, "An", 1, 10)[0].select("id", "repository_name", "description", "organization")


def result_fields(spark, sf_dir):
    hits = _labelled(spark, sf_dir)
    return s.shaped_fields(hits, ["lang", "n_chars", "toxic", "available_int", "absent"], "doc_id")


def _code_space(spark, sf_dir, kind, other=0):
    """Vectors as a code space; ``other`` shifts the lines, so that two spaces share some places."""
    n = F.col("vec_id")
    return _emb(spark, sf_dir).select(
        F.concat(F.lit("c"), F.lpad(n.cast("string"), 6, "0")).alias("id"), F.concat(F.lit("r"), F.col("label") % 2).alias("repo_id"), F.lit(kind.value).alias("analysis_type"),
        F.concat(F.lit("f"), (n % 90).cast("string")).alias("file_path"), (n + F.when(n % 3 == 0, other).otherwise(0)).alias("start_line"), (n + 4).alias("end_line"), F.col("embedding").alias("vec"),
    )


def _row_model(spark, sf_dir):
    """A model for which a text is the number of a vector of the table."""
    rows = {r.vec_id: r.embedding for r in _emb(spark, sf_dir).where("vec_id in (3, 5, 8)").select("vec_id", "embedding").collect()}
    register_model("table_rows", lambda texts, dim: np.array([rows[int(x)] for x in texts]))


def similar_code(spark, sf_dir):
    _row_model(spark, sf_dir)
    out = code_search.similar_code(_code_space(spark, sf_dir, AnalysisType.LINE_CHUNK), "r1", " 3 ", 15, 64, "table_rows")
    return out.select("id", "file_path", "start_line", "end_line", F.round("score", 6).alias("score"))


def related_files(spark, sf_dir):
    _row_model(spark, sf_dir)
    spaces = _code_space(spark, sf_dir, AnalysisType.SYMBOL_SUMMARY), _code_space(spark, sf_dir, AnalysisType.LINE_CHUNK, 7)
    out = code_search.related_files(*spaces, "r0", ["3", " ", "5", "8"], 20, 64, "table_rows")
    return out.select("file_path", "start_line", "end_line", F.round("score", 6).alias("score"), "src")


def sql_match_tokenized(spark, sf_dir):
    _docs(spark, sf_dir).withColumn("content_tks", F.col("text")).createOrReplaceTempView("codeloom_docs")
    parts = lambda value: value.replace("+", " ")
    return s.run_sql(spark, "select doc_id, lang from codeloom_docs where content_tks = 'THE+and+ention+NICHT'", parts, str.lower)


def sql_match_rewrite(spark, sf_dir):
    _docs(spark, sf_dir).withColumn("content_tks", F.col("text")).createOrReplaceTempView("codeloom_docs")
    return s.run_sql(spark, f"select  doc_id, `lang` from codeloom_docs where content_tks like '%{TEXT_QUERY}%'")


def sparse_and_tensor(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    sparse = v.sparse_score(F.map_from_arrays(F.sequence(F.lit(0), F.size("embedding") - 1), "embedding"), {0: 1.0, 5: -2.0, 63: 0.5})
    halves = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    tensor = v.max_sim(halves, [[1.0] * 32, [1.0, -1.0] * 16])
    return emb.select("vec_id", F.round(sparse, 6).alias("sparse"), F.round(tensor, 6).alias("tensor"))


NAMES = [
    knn_cosine_topk, knn_centroid_topk, knn_filtered, knn_multi_query, knn_index_exact, knn_index_recall, related_union_dedupe, text_idf_score, text_min_should_match, text_index_score, text_index_top, hybrid_weighted_fusion,
    rank_feature_boost, filter_condition_map, filter_available_int, filter_exists, terms_agg, terms_agg_array, status_summary, total_hits,
    page_offset_limit, sort_multi_mode, highlight_sentences, keyword_or_contains, sql_match_rewrite, sql_match_tokenized, result_fields, similar_code, related_files, sparse_and_tensor,
]
QUERIES = {f.__name__: f for f in NAMES}

COS = "(list_cosine_similarity(e.embedding::double[], {q}) + 1) / 2"
VEC = "(select embedding::double[] from embeddings where vec_id = {n})"


def _knn_sql(query: str, where: str = "true", k: int = 10) -> str:
    score = COS.format(q=query)
    return f"select vec_id, label, round(score, 6) as score from (select e.vec_id, e.label, {score} as score from embeddings e where {where} order by score desc, vec_id limit {k})"


def _idf(n: str, d: str) -> str:
    return f"ln(1 + ({n} - {d} + 0.5) / ({d} + 0.5)) / ln(1 + ({n} - 0.5) / 1.5)"


def _text_sql(query: str, tables: str = "documents d") -> str:
    words = ", ".join(f"('{w}')" for w in query.split())
    return f"""
    words as (select * from (values {words}) t(word)),
    toks as (select d.doc_id, list_distinct(string_split_regex(lower(d.text), '\\s+')) as tok from {tables}),
    hits as (select t.doc_id, w.word from toks t join words w on list_contains(t.tok, w.word)),
    freq as (select w.word, count(h.doc_id)::double as df, (select count(*) from toks)::double as n from words w left join hits h on h.word = w.word group by w.word),
    scored as (select h.doc_id, count(*)::int as matched_terms, sum({_idf('f.n', 'f.df')}) as score from hits h join freq f on h.word = f.word group by h.doc_id)"""


_MARK = r"""list_transform(string_split_regex(text, '[.?!;\n]'), lambda s: regexp_replace(s, '(^|[ .?/''"\(\)!,:;-])(the|nicht)($|[ .?/''"\(\)!,:;-])', '\1<em>\2</em>\3', 'gi'))"""

ORACLES = {
    "knn_cosine_topk": _knn_sql(VEC.format(n=0)),
    "knn_centroid_topk": "with c as (select list(v order by pos) as q from (select pos, avg(v) as v from (select unnest(embedding::double[]) as v, generate_subscripts(embedding, 1) as pos from embeddings where vec_id in (1, 2, 3)) group by pos)) "
    + _knn_sql("(select q from c)", "e.label < 8"),
    "knn_filtered": _knn_sql(VEC.format(n=0), "e.label in (1, 3, 5)"),
    "knn_multi_query": f"""select query_id, vec_id, round(score, 6) as score, rank from (
        select q.vec_id as query_id, e.vec_id, {COS.format(q='q.embedding::double[]')} as score,
          row_number() over (partition by q.vec_id order by round({COS.format(q='q.embedding::double[]')}, 12) desc, e.vec_id) as rank
        from embeddings q, embeddings e where q.vec_id % 20 = 0) where rank <= 5""",
    "knn_index_exact": f"""select query_id, vec_id, round(score, 6) as score, rank from (
        select q.vec_id as query_id, e.vec_id, {COS.format(q='q.embedding::double[]')} as score,
          row_number() over (partition by q.vec_id order by round({COS.format(q='q.embedding::double[]')}, 12) desc, e.vec_id) as rank
        from embeddings q, embeddings e where q.vec_id % 20 = 0) where rank <= 10""",
    "knn_index_recall": "select sum(least(10, n))::bigint as true_pairs, true as recall_reached from (select count(*) as n from embeddings) a, embeddings q where q.vec_id % 20 = 0",
    "related_union_dedupe": f"""with u as (
        select *, 0 as src from ({_knn_sql(VEC.format(n=0), 'e.label in (0,1,2,3,4)')}) union all
        select *, 1 as src from ({_knn_sql(VEC.format(n=1), 'e.label in (3,4,5,6,7)')}))
        select vec_id, label, score, src from (select *, row_number() over (partition by vec_id order by src) as n from u) where n = 1""",
    "text_idf_score": f"with {_text_sql(TEXT_QUERY)} select doc_id, matched_terms, round(score, 6) as score from scored",
    "text_min_should_match": f"with {_text_sql(TEXT_QUERY)} select doc_id, matched_terms from scored where matched_terms >= 3",
    "text_index_score": f"with {_text_sql(TEXT_QUERY)} select doc_id, matched_terms, round(score, 6) as score from scored",
    "text_index_top": f"with {_text_sql(TEXT_QUERY)} select doc_id, matched_terms, round(score, 6) as score from scored where matched_terms >= 2 order by round(scored.score, 12) desc, doc_id limit 50",
    "hybrid_weighted_fusion": f"""with {_text_sql(HYBRID_QUERY, 'documents d join embeddings x on x.vec_id = d.doc_id')},
        near as (select e.vec_id as doc_id, {COS.format(q=VEC.format(n=0))} as knn from embeddings e join scored s on s.doc_id = e.vec_id order by knn desc, doc_id limit 20)
        select s.doc_id, d.lang, round(0.3 * s.score + 0.7 * coalesce(n.knn, 0), 6) as score
        from scored s join documents d on d.doc_id = s.doc_id left join near n on n.doc_id = s.doc_id order by 0.3 * s.score + 0.7 * coalesce(n.knn, 0) desc, s.doc_id limit 20""",
    "rank_feature_boost": """select d.doc_id, round(2.5 * coalesce(l.quality, 0) - 1.0 * coalesce(l.toxic, 0), 6)::double as score
        from documents d left join labels l on l.doc_id = d.doc_id where d.lang = 'en' order by score desc, d.doc_id limit 50""",
    "filter_condition_map": "select doc_id, lang, n_chars from documents where lang in ('en', 'de') and source = 'src3'",
    "filter_available_int": "select lang, count(*) as n from documents d left join labels l on l.doc_id = d.doc_id where not coalesce(l.quality < 1, false) group by lang",
    "filter_exists": """select lang, count(*) as n, case when l.quality is not null then 'exists' else 'missing' end as kind
        from documents d left join labels l on l.doc_id = d.doc_id group by lang, kind""",
    "terms_agg": "select source as key, count(*) as doc_count from documents group by source",
    "terms_agg_array": """select key, count(*) as doc_count from (select doc_id, unnest(list_distinct(string_split_regex(lower(text), '\\s+'))) as key from documents)
        where key <> '' group by key""",
    "status_summary": """select count(*) filter (where event_type = 'view') as pending, count(*) filter (where event_type = 'click') as running,
        count(*) filter (where event_type = 'purchase') as completed, count(*) filter (where event_type = 'search') as failed,
        count(*) filter (where event_type not in ('view', 'click', 'purchase', 'search')) as skipped, count(*) as total from events""",
    "total_hits": "select count(*) as total from orders where o_orderstatus in ('F', 'P')",
    "page_offset_limit": "select o_orderkey, o_custkey from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey limit 20 offset 40",
    "sort_multi_mode": """select vec_id, round(list_min(v), 6) as by_min, round(list_max(v), 6) as by_max, round(list_avg(v), 6) as by_avg, round(list_sum(v), 6) as by_sum,
        round(list_median(v), 6) as by_median from (select vec_id, embedding::double[] as v from embeddings) order by by_median desc, vec_id limit 25""",
    "highlight_sentences": f"""select doc_id, md5(h) as highlight_md5 from (select doc_id, array_to_string(list_filter({_MARK}, lambda s: contains(s, '<em>')), '...') as h from documents) where h <> ''""",
    "keyword_or_contains": """select p_partkey as id, p_name as repository_name, p_brand as description, p_type as organization from part
        where contains(lower(p_name), 'an') or contains(lower(p_brand), 'an') or contains(lower(p_type), 'an')""",
    "result_fields": """select d.doc_id as id, '{"lang":"' || lang || '","n_chars":"' || n_chars || '"' || coalesce(',"toxic":"' || toxic || '"', '') || coalesce(',"available_int":' || quality, '') || '}' as fields
        from documents d left join labels l on l.doc_id = d.doc_id""",
    "similar_code": f"""select 'c' || lpad(vec_id::varchar, 6, '0') as id, 'f' || vec_id % 90 as file_path, vec_id as start_line, vec_id + 4 as end_line, round(score, 6) as score from (
        select e.vec_id, {COS.format(q=VEC.format(n=3))} as score from embeddings e where label % 2 = 1 order by score desc, vec_id limit 15)""",
    "related_files": f"""with c as (select list(v order by pos) as q from (select pos, avg(v) as v from (select unnest(embedding::double[]) as v, generate_subscripts(embedding, 1) as pos from embeddings where vec_id in (3, 5, 8)) group by pos)),
        near as (select e.vec_id, {COS.format(q='(select q from c)')} as score from embeddings e where label % 2 = 0 order by score desc, vec_id limit 20),
        both_ as (select 'f' || vec_id % 90 as file_path, vec_id as start_line, vec_id + 4 as end_line, score, 0 as src from near union all
          select 'f' || vec_id % 90, vec_id + case when vec_id % 3 = 0 then 7 else 0 end, vec_id + 4, score, 1 from near)
        select file_path, start_line, end_line, round(score, 6) as score, src from (select *, row_number() over (partition by file_path, start_line, end_line order by src, score desc) as n from both_) where n = 1""",
    "sql_match_tokenized": "select doc_id, lang from documents where len(list_intersect(string_split_regex(lower(text), '\\s+'), ['the', 'and', 'ention', 'nicht'])) >= 1",
    "sql_match_rewrite": "select doc_id, lang from documents where len(list_intersect(string_split_regex(lower(text), '\\s+'), ['the', 'and', 'ention', 'nicht'])) >= 1",
    "sparse_and_tensor": """select vec_id, round(v[1] - 2 * v[6] + 0.5 * v[64], 6) as sparse,
        round(greatest(list_sum(v[1:32]), list_sum(v[33:64])) + greatest(
          list_sum(list_transform(v[1:32], lambda x, i: case when i % 2 = 1 then x else -x end)),
          list_sum(list_transform(v[33:64], lambda x, i: case when i % 2 = 1 then x else -x end))), 6) as tensor
        from (select vec_id, embedding::double[] as v from embeddings)""",
}
