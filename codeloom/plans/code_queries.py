"""Queries with functions on source code, on whole texts and on modules that are made of the rows of ``part``."""

from pyspark.sql import functions as F

from codeloom.functions import chunks, python_code
from codeloom.sources.tables import read_table

#: A module for each row of ``part``: brackets and quotes over lines, a continued line, blocks, imports of the next module and of a name that a package passes on.
MODULE = '''"""@NAME@: (this is no bracket"""
import os
import pkg@A@.m@NEXT@
from pkg@B@ import C@B@

SIZES = [
    @SIZE@,
    "[@BRAND@", (1,
    2),
]


class C@K@(C@B@):
    kind = '@NAME@'

    def get_kind(self, x: int) -> str:
        total = x + \\
            @SIZE@

        # the sum
        return make(total, "x")


def helper(n, *rest):
    if n:
        return len(str(n))

    return C@B@(n,
        @SIZE@)
'''
PACKAGE = "from .m@K@ import C@K@\n"


def _code(spark, sf_dir):
    """Files (path, content): the modules in seven packages, each of which passes one class on."""
    k = F.col("p_partkey")
    values = {"@NAME@": F.col("p_name"), "@BRAND@": F.col("p_brand"), "@SIZE@": F.col("p_size"), "@NEXT@": k + 1, "@A@": (k + 1) % 7, "@B@": (k + 2) % 7, "@K@": k}

    def filled(template):
        out = F.lit(template)
        for mark, value in values.items():
            out = F.replace(out, F.lit(mark), value.cast("string"))
        return out

    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    packages = part.where("p_partkey < 7").select(F.concat(F.lit("pkg"), k, F.lit("/__init__.py")).alias("path"), filled(PACKAGE).alias("content"))
    # The table is one small file, but making its modules and reading them is work for all cores.
    spread = part.repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")
    return spread.select(F.concat(F.lit("pkg"), k % 7, F.lit("/m"), k, F.lit(".py")).alias("path"), filled(MODULE).alias("content")).union(packages)


def _chunk_rows(rows):
    return rows.select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("content").alias("content_md5"))


def line_window_chunks(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return _chunk_rows(chunks.chunked(docs)).withColumn("doc_id", F.split_part("path", F.lit("."), F.lit(1)).cast("long")).drop("path")


def chunk_source(spark, sf_dir):
    return _chunk_rows(chunks.chunked(_code(spark, sf_dir)))


def lowvalue_chunk_filter(spark, sf_dir):
    marked = F.regexp_replace("text", "^[A-Z]", "return x")
    return read_table(spark, sf_dir, "documents").where(~chunks.of_low_value(marked, ".java")).select("doc_id")


def python_symbols(spark, sf_dir):
    out = python_code.symbols(_code(spark, sf_dir))
    joined = [F.array_join(c, ",").alias(c) for c in ("params", "returns", "bases", "attributes")]
    return out.select("path", "kind", "full_name", "signature", *joined, "start_line", "end_line", F.array_join(F.col("calls.full_name"), ",").alias("calls"))


def python_deps(spark, sf_dir):
    return python_code.file_dependencies(_code(spark, sf_dir))


NAMES = [line_window_chunks, chunk_source, lowvalue_chunk_filter, python_symbols, python_deps]
QUERIES = {f.__name__: f for f in NAMES}

_PATTERN = {name: getattr(chunks, name).pattern.replace("'", "''") for name in ("HEADER", "RETURN", "PY_GETTER", "PY_ACCESSOR", "BRACED_ACCESSOR")}
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_QUOTE = "chr(39)"


def _lines(text: str) -> str:
    return f"string_split_regex(regexp_replace({text}, '({_LINE_END})$', ''), '{_LINE_END}')"


def _after(state: str, lines: str) -> str:
    """What is open after more lines: the state's first character is a quote, an escape in one (D, S), X for broken or -, then come the open brackets."""
    step = rf"""case when s[1] = 'X' then s when s[1] = 'D' then '"' || s[2:] when s[1] = 'S' then {_QUOTE} || s[2:]
        when s[1] <> '-' then case when c = '\' then case when s[1] = '"' then 'D' else 'S' end || s[2:] when c = s[1] then '-' || s[2:] else s end
        when c in ('"', {_QUOTE}) then c || s[2:] when c in ('(', '[', '{{') then s || c
        when c in (')', ']', '}}') then case when len(s) > 1 and (s[-1] || c) in ('()', '[]', '{{}}') then s[1:len(s) - 1] else 'X' end else s end"""
    return f"list_reduce(list_prepend({state}, string_split(array_to_string({lines}, chr(10)) || chr(10), '')), lambda s, c: {step})"


def _chunks_sql(files: str, python: bool) -> str:
    """Table c (path, start_line, end_line, content, n lines that are not blank): the windows of files (path, x), one step of growth or one new window a round."""
    indent = lambda x: f"len({x}) - len(ltrim({x}, ' ' || chr(9)))"
    end = f"""coalesce(list_min(list_filter(generate_series(last + 1, most), lambda i: trim(l[i]) <> '' and not starts_with(ltrim(l[i]), '#') and {indent('l[i]')} <= {indent('l[last]')})) - 1, most)"""
    block = f"ends_with(rtrim(l[last]), ':') and {end} > last" if python else "false"
    return rf"""files as ({files}), d as (select path, {_lines('x')} as l from files where trim(x) <> ''),
        w as (
          select path, 1::bigint as start, least(5, len(l))::bigint as last, least(200, len(l))::bigint as most, {_after("'-'", 'l[1:least(5, len(l))]')} as st from d
          union all
          select path, start, last, least(start + 199, len(l)), case when grow then {_after('st', 'l[was + 1:last]')} else {_after("'-'", 'l[start:last]')} end from (
            select path, l, st, grow, last as was, case when grow then start else greatest(last, start + 1) end as start,
              case when open then last + 1 when block then {end} else least(greatest(last, start + 1) + 4, len(l)) end as last from (
              select *, open or block as grow from (
                select w.*, d.l, last < most and (ends_with(l[last], '\') and not starts_with(ltrim(l[last]), '#') or st[1] <> 'X' and len(st) > 1) as open,
                  last < most and {block} as block from w join d on d.path = w.path) where open or block or last < len(l)))),
        ends as (select w.path, start, max(last) as last from w group by w.path, start),
        c as (select *, len(list_filter({_lines('content')}, lambda y: trim(y) <> '')) as n from (
          select e.path, start as start_line, last as end_line, regexp_replace(array_to_string(l[start:last], chr(10)), '^\s+|\s+$', '', 'g') as content from ends e join d on d.path = e.path) where content <> '')"""


def _filled(template: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for mark, value in {"@NAME@": "p_name", "@BRAND@": "p_brand", "@SIZE@": "p_size", "@NEXT@": "p_partkey + 1", "@A@": "(p_partkey + 1) % 7", "@B@": "(p_partkey + 2) % 7", "@K@": "p_partkey"}.items():
        out = f"replace({out}, '{mark}', ({value})::varchar)"
    return out


_MODULE_PATH = "'pkg' || p_partkey % 7 || '/m' || p_partkey || '.py'"
_CODE_SQL = f"select {_MODULE_PATH} as path, {_filled(MODULE)} as x from part union all select 'pkg' || p_partkey || '/__init__.py', {_filled(PACKAGE)} from part where p_partkey < 7"

ORACLES = {
    "line_window_chunks": f"""with recursive {_chunks_sql("select doc_id as path, coalesce(text, '') as x from documents", False)}
        select path as doc_id, start_line, end_line, md5(content) as content_md5 from c where not (n <= 5 and regexp_matches(content, '{_PATTERN['HEADER']}'))""",
    "chunk_source": f"""with recursive {_chunks_sql(_CODE_SQL, True)}
        select path, start_line, end_line, md5(content) as content_md5 from c where not (n <= 5 and regexp_matches(content, '{_PATTERN['HEADER']}') or n <= 4 and regexp_matches(content, '{_PATTERN['PY_GETTER']}')
          or n <= 8 and regexp_matches(content, '{_PATTERN['PY_ACCESSOR']}') or n <= 3 and regexp_matches(content, '{_PATTERN['RETURN']}'))""",
    "lowvalue_chunk_filter": rf"""select doc_id from (select doc_id, x, list_filter({_lines('x')}, lambda y: trim(y) <> '') as l from (select doc_id, regexp_replace(coalesce(text, ''), '^[A-Z]', 'return x') as x from documents))
        where not (len(l) = 0 or len(l) <= 5 and regexp_matches(x, '{_PATTERN['HEADER']}') or len(l) <= 7 and regexp_matches(x, '{_PATTERN['BRACED_ACCESSOR']}')
          or len(l) <= 3 and (regexp_matches(x, '{_PATTERN['RETURN']}') or len(list_filter(l, lambda y: trim(y) not in ('{{', '}}', '}};'))) = 0))""",
    "python_symbols": f"""with m as (select {_MODULE_PATH} as path, 'pkg' || p_partkey % 7 || '.m' || p_partkey as module, p_partkey as k, (p_partkey + 2) % 7 as b from part)
        select path, 'class' as kind, module || '.C' || k as full_name, 'C' || k as signature, '' as params, '' as returns, 'pkg' || b || '.C' || b as bases, 'kind' as attributes,
          13 as start_line, 21 as end_line, '' as calls from m union all
        select path, 'method', module || '.C' || k || '.get_kind', 'get_kind(Any, int) -> str', 'self,x', 'make,str', '', '', 16, 21, module || '.make' from m union all
        select path, 'function', module || '.helper', 'helper(Any, Any) -> Any', 'n,*rest', 'C' || b || ',len', '', '', 24, 29, 'pkg' || b || '.C' || b from m""",
    "python_deps": f"""with m as (select {_MODULE_PATH} as path, p_partkey as k, (p_partkey + 1) % 7 as a, (p_partkey + 2) % 7 as b, max(p_partkey) over () as most from part),
        e as (
          select path as src, 'pkg' || a || '/m' || (k + 1) || '.py' as dst from m where k < most union
          select path, 'pkg' || a || '/__init__.py' from m union select path, 'pkg' || a || '/m' || a || '.py' from m union
          select path, 'pkg' || b || '/__init__.py' from m union select path, 'pkg' || b || '/m' || b || '.py' from m union
          select 'pkg' || k || '/__init__.py', 'pkg' || k || '/m' || k || '.py' from m where k < 7)
        select distinct src, dst from e where src <> dst""",
}
