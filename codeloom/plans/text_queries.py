"""Queries with text, path and code functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.functions import text as t
from codeloom.operators import tree
from codeloom.sources.tables import read_table

def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def stable_id_sha1(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.stable_id(F.col("source"), F.col("doc_id"), F.lit("line_chunk_vector"), F.col("n_chars")).alias("id"))


def text_dedupe(spark, sf_dir):
    return t.copies(_docs(spark, sf_dir), "text", "doc_id")


def path_normalize(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", t.normalize_path(F.concat(F.lit("C:\\work\\"), F.replace("url", F.lit("//"), F.lit("/\\")))).alias("path"))


def uri_paths(spark, sf_dir):
    uri = F.concat(F.lit("file:///a%20b/./c/../"), F.regexp_replace("url", r"^[a-z]+://", ""))
    return read_table(spark, sf_dir, "pages").select("page_id", t.uri_path(uri).alias("path"), t.editor_language(F.concat("url", F.lit(".TSX"))).alias("language"))


def url_parts(spark, sf_dir):
    url = F.regexp_replace("url", r"[?#].*$", "")
    parts = t.git_parts(F.concat(url, F.lit(".git")))
    return read_table(spark, sf_dir, "pages").select("page_id", parts["organization"].alias("organization"), parts["name"].alias("name"))


def lang_detect(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ["a.py", "b.JAVA", "c.go", "d.cpp", "e.c", "f.mjs", "g.txt", "noext"])), (F.col("page_id") % 8 + 1).cast("int"))
    return read_table(spark, sf_dir, "pages").groupBy(t.language(names).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def token_estimate(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(t.cheap_tokens(F.col("text")) + 4).alias("tokens"))
    return conv.select("conv_id", F.col("tokens").cast("long").alias("tokens"), t.context_size(F.col("tokens")).alias("context"))


def history_roles(spark, sf_dir):
    """Every third user turn stands for a tool's result, which the assistant's turn before asked for if that has an even number."""
    conv = read_table(spark, sf_dir, "conversations")
    tool = (F.col("role") == "user") & (F.col("turn") % 3 == 2)
    turns = conv.select(
        "conv_id", "turn", F.when(tool, "tool").when(F.col("turn") % 11 == 10, "narrator").otherwise(F.col("role")).alias("role"), "text",
        F.when((F.col("role") == "assistant") & (F.col("turn") % 2 == 0), F.array((F.col("turn") + 1).cast("string"), F.lit("never"))).alias("call_ids"), F.when(tool, F.col("turn").cast("string")).alias("call_id"),
    )
    return t.sanitized(turns).select("conv_id", "turn", "role", F.array_join("call_ids", ",").alias("calls"), "call_id")


def catalogue_tree(spark, sf_dir):
    url = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    nodes = tree.nodes(read_table(spark, sf_dir, "pages").select(F.trim(url, F.lit("/")).alias("path")))
    children = nodes.groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(children, "path", "left").select("path", "parent", F.col("depth").cast("long").alias("depth"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


def english_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(t.english_share(F.col("text")), 6).alias("share"))


def is_chinese(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count_if(t.has_chinese(F.col("text"))).alias("chinese"), F.count_if(t.is_ascii_letters(F.col("text"))).alias("ascii_only"))


def markdown_shift(spark, sf_dir):
    marked = F.regexp_replace("text", r"(?m)^([A-Z])", "## $1")
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.shift_headings(marked, 5)).alias("shifted_md5"))


def fallback_summary(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.fallback_summary(F.lit("file: "), F.col("text")).alias("summary"))


def token_usage_sum(spark, sf_dir):
    n = F.length("text")
    usage = read_table(spark, sf_dir, "conversations").select(
        "role", n.alias("total_tokens"), F.when(F.col("role") == "user", n).alias("input_tokens"), F.when(F.col("turn") % 2 == 1, n % 7).otherwise(0).alias("cache_read_tokens")
    )
    return t.usage_total(usage, ["role"])


NAMES = [
    stable_id_sha1, text_dedupe, path_normalize, uri_paths, url_parts, lang_detect, token_estimate, history_roles, catalogue_tree,
    english_ratio, is_chinese, markdown_shift, fallback_summary, token_usage_sum,
]
QUERIES = {f.__name__: f for f in NAMES}

ORACLES = {
    "stable_id_sha1": "select doc_id, sha1(concat_ws('|', source, doc_id::varchar, 'line_chunk_vector', n_chars::varchar)) as id from documents",
    "text_dedupe": "select min(doc_id) as first_id, count(*) as n from documents group by text",
    "path_normalize": "select page_id, 'C:/work/' || url as path from pages",
    "uri_paths": r"""select page_id, '/a b/' || regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') as path,
        'typescriptreact' as language from pages""",
    "url_parts": r"""select page_id, nullif(p[1], '') as organization, nullif(p[2], '') as name from (
        select page_id, list_filter(string_split(replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*(.*)$', 1), '.git', ''), '/'), lambda x: x <> '') as p from pages)""",
    "lang_detect": "select case page_id % 8 when 0 then 'python' when 1 then 'java' when 2 then 'go' when 3 then 'cpp' when 4 then 'c' when 5 then 'javascript' else 'unknown' end as language, count(*) as n from pages group by language",
    "token_estimate": r"""select conv_id, tokens, (ceil(tokens * 12 / 10.0 / 8192) * 8192)::bigint as context from (
        select conv_id, sum(2 * length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) + 4)::bigint as tokens from conversations group by conv_id)""",
    "history_roles": """with k as (select conv_id, turn, case when role = 'user' and turn % 3 = 2 then 'tool' when turn % 11 = 10 then 'narrator' else role end as role, role as was from conversations),
        calls as (select conv_id, turn, turn + 1 as call from k where role = 'assistant' and turn % 2 = 0),
        tools as (select k.conv_id, k.turn from k where role = 'tool' and exists (select 1 from calls c where c.conv_id = k.conv_id and c.call = k.turn and c.turn < k.turn))
        select conv_id, turn, role, case when role = 'assistant' and turn % 2 = 0 and exists (select 1 from tools t where t.conv_id = k.conv_id and t.turn = k.turn + 1) then (turn + 1)::varchar else '' end as calls,
          null::varchar as call_id from k where role in ('system', 'user', 'assistant') union all
        select conv_id, turn, 'tool', '', turn::varchar from tools""",
    "catalogue_tree": r"""with p as (select string_split(trim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), '/') as x from pages),
        n as (select distinct array_to_string(x[1:i], '/') as path, array_to_string(x[1:i-1], '/') as parent, i - 1 as depth from (select x, unnest(generate_series(1, len(x))) as i from p))
        select n.path, n.parent, n.depth, coalesce(c.n_children, 0) as n_children from n left join (select parent as path, count(*) as n_children from n group by parent) c on c.path = n.path""",
    "english_ratio": r"""select doc_id, round(len(list_filter(w, lambda x: regexp_full_match(x, '[a-zA-Z0-9 .,'':;/"?<>!()\-]+')))::double / len(w), 6) as share
        from (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from documents)""",
    "is_chinese": r"""select lang, count(*) filter (where regexp_matches(text, '[\x{4e00}-\x{9fff}]')) as chinese, count(*) filter (where regexp_full_match(text, '[A-Za-z \n\t]*')) as ascii_only from documents group by lang""",
    "markdown_shift": r"""select doc_id, md5(array_to_string(list_transform(string_split(regexp_replace(text, '(?m)^([A-Z])', '## \1', 'g'), chr(10)),
        lambda x: case when regexp_matches(x, '^#{1,6} ') then '######' || x[length(regexp_extract(x, '^(#+) ', 1)) + 1 :] else x end), chr(10))) as shifted_md5 from documents""",
    "fallback_summary": "select doc_id, 'file: ' || substring(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:4], ' '), 1, 280) as summary from documents",
    "token_usage_sum": """select *, case when input_tokens + cache_read_tokens > 0 then input_tokens + cache_read_tokens else total_tokens end as basis from (
        select role, sum(length(text))::bigint as total_tokens, coalesce(sum(length(text)) filter (where role = 'user'), 0)::bigint as input_tokens,
          coalesce(sum(length(text) % 7) filter (where turn % 2 = 1), 0)::bigint as cache_read_tokens from conversations group by role)""",
}
