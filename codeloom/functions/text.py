"""Scalar functions on texts, paths and URLs, as column expressions."""

from __future__ import annotations

import json
import posixpath
import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.json_repair import repair
from codeloom.schema import LANGUAGES

#: Parts of messages of errors that may pass when tried again, and of those for texts that are too long.
RETRYABLE = (
    "rate limit", "429", "server", "502", "503", "504", "500", "connection", "timeout", "timed out", "network", "temporary", "busy", "overload",
    "service unavailable", "internal server error", "bad gateway", "gateway timeout", "too many requests",
)
TOO_LONG = (
    "context length", "maximum context", "max context", "context window", "exceeds the context", "exceed context", "too many tokens",
    "prompt is too long", "input is too long", "context_limit",
)


def normalize_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def fold_path(path: Column) -> Column:
    """``.`` and ``..`` resolved, as posixpath.normpath does."""
    fold = lambda s: s.map(lambda p: posixpath.normpath(p) if p is not None else None)
    return F.pandas_udf(fold, "string")(path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown"))


def directory(path: Column) -> Column:
    """Empty for a path without a slash."""
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


def has_chinese(text: Column) -> Column:
    return text.rlike("[\\u4e00-\\u9fff]")


def is_ascii_letters(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z \n\t]*$")


def english_share(text: Column) -> Column:
    """The share of words made of ASCII letters, digits and common punctuation."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    plain = F.regexp_count(text, F.lit(r"(?<!\S)[a-zA-Z0-9.,':;/\"?<>!()\-]++(?!\S)"))
    return F.when(words > 0, plain / words).otherwise(0.0)


def shift_headings(text: Column, by: int) -> Column:
    """Markdown headings go down by some levels, to the sixth at most."""
    def shift(line: Column) -> Column:
        marks = F.regexp_extract(line, r"^(#{1,6}) ", 1)
        deep = F.length(marks)
        return F.when(deep > 0, F.concat(F.repeat(F.lit("#"), F.least(deep + by, F.lit(6))), line.substr(deep + 1, F.length(line)))).otherwise(line)

    return F.array_join(F.transform(F.split(text, "\n"), shift), "\n")


def to_float(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(float("-inf")))


def git_parts(url: Column) -> dict[str, Column]:
    """provider, organization and name of a repository; ``git@host:org/name`` is read like a URL. Null where a part is missing."""
    path = F.regexp_extract(F.regexp_replace(url, r"^git@([^:/]+):", "ssh://$1/"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/*([^?#]*)", 1)
    parts = F.filter(F.split(F.replace(path, F.lit(".git"), F.lit("")), "/"), lambda p: p != "")
    small = F.lower(url)
    provider = F.when(small.contains("github"), "github").when(small.contains("gitee"), "gitee").when(small.contains("gitlab"), "gitlab")
    return {"provider": provider, "organization": F.get(parts, F.lit(0)), "name": F.get(parts, F.lit(1))}


def ignored(name: Column, is_dir: Column, patterns: list[str]) -> Column:
    """Whether a base name meets a pattern: a trailing slash is for directories, ``*`` for anything, case does not count."""
    out = F.lit(False)
    for p in patterns:
        for_dir, p = p.endswith("/"), p.strip().rstrip("/").lower()
        if not p or p.startswith("#"):
            continue
        regex = "^" + ".*".join(re.escape(x) for x in p.split("*")) + "$"
        hit = F.lower(name).rlike(regex)
        out = out | (hit & is_dir if for_dir else hit)
    return out


def stable_id(*parts: Column) -> Column:
    """SHA-1 of the parts with bars between."""
    return F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts]))


def fallback_summary(prefix: Column, source: Column) -> Column:
    """The first four lines that are not blank, in 280 characters."""
    lines = F.filter(F.transform(F.split(source, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.concat(prefix, F.substring(F.array_join(F.slice(lines, 1, 4), " "), 1, 280))


def strip_thoughts(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?is)<\s*think\s*>.*?<\s*/\s*think\s*>", ""))


def cheap_tokens(text: Column) -> Column:
    """One for an ASCII character, two for another."""
    return 2 * F.length(text) - F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))


def context_size(tokens: Column) -> Column:
    """With a fifth more, up to the next multiple of 8192."""
    return (F.ceil(tokens * 12 / 10 / 8192) * 8192).cast("long")


def mentions(message: Column, words: tuple[str, ...]) -> Column:
    small = F.lower(message)
    return F.exists(F.array(*map(F.lit, words)), lambda w: small.contains(w))


def retryable(message: Column) -> Column:
    """A text that is too long stays so."""
    return mentions(message, RETRYABLE) & ~mentions(message, TOO_LONG)


def backoff(attempt: int, rng: random.Random | None = None) -> float:
    """Seconds to wait: doubling, spread by half, 30 at most."""
    return min(2**attempt * (rng or random).uniform(0.5, 1.5), 30.0)


def parse_arguments(text: str | None) -> dict:
    """Tool arguments from a model's text: fences and outer quotes go, JSON in JSON is read, small faults are mended.

    An end that is open is an error of its own, told apart from text that holds no object; it comes
    with where the text ended and the object so far, closed.
    """
    s = re.sub(r"^```\w*\n?|```$", "", (text or "").strip()).strip()
    if not s:
        return {}
    inner = s[1:-1].strip() if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"" else s
    found = [repair(t) for t in dict.fromkeys((s, inner))]
    found += [repair(r.value) for r in found if isinstance(r.value, str) and r.status != "truncated" and "{" in r.value]
    for status in ("valid", "repaired"):
        for r in found:
            if r.status == status and isinstance(r.value, dict):
                return r.value
    open_ = next((r for r in found if r.status == "truncated" and isinstance(r.value, dict)), None)
    if open_:
        return {"error": "truncated", "raw": s, "at": open_.at, "partial": open_.value}
    return {"error": "truncated" if any(r.status == "truncated" for r in found) else "failed", "raw": s}


def arguments(text: Column) -> Column:
    """parse_arguments of a column, as JSON."""
    return F.pandas_udf(lambda s: s.map(lambda t: json.dumps(parse_arguments(t))), "string")(text)


ROLES = ("system", "user", "assistant", "tool")


def sanitized(turns: DataFrame) -> DataFrame:
    """Conversations without unknown roles, and without tool results that no call before them asked for.

    Columns: conv_id, turn, role, text, call_ids (of an assistant's calls) and call_id (of a tool's
    result). Calls that get no result are taken off the assistant's turn. Calls and results meet by
    a join, so a long conversation is no single task's work.
    """
    key = ["conv_id", "call_id"]
    known = turns.where(F.col("role").isin(*ROLES)).withColumn("call_ids", F.coalesce("call_ids", F.array().cast("array<string>")))
    calls = known.where("role = 'assistant'").select("conv_id", "turn", F.posexplode("call_ids").alias("pos", "call_id"))
    first = calls.groupBy(*key).agg(F.min("turn").alias("asked"))
    results = known.where("role = 'tool'").join(first, key).where("turn > asked").select(*turns.columns)
    answered = results.select(*key).distinct()
    kept = calls.join(answered, key, "left_semi").groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "call_id"))), lambda c: c["call_id"]).alias("kept"))
    said = known.where("role <> 'tool'").join(kept, ["conv_id", "turn"], "left")
    own = F.when(F.col("role") == "assistant", F.coalesce("kept", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return said.withColumn("call_ids", own).select(*turns.columns).unionByName(results)


def tool_calls(calls: Column) -> Column:
    """An array of calls (id, name, arguments) in tags, each as JSON on lines of its own; arguments that are JSON are set in as such. Empty for no calls."""

    def one(call) -> str:
        try:
            args = json.loads(call["arguments"]) if call["arguments"] else {}
        except ValueError:
            args = call["arguments"]
        return "<tool>\n" + json.dumps({"id": call["id"], "name": call["name"], "args": args}, ensure_ascii=False, indent=2) + "\n</tool>\n"

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(["<tool_calls>\n" + "".join(map(one, c)) + "</tool_calls>" if c is not None and len(c) else "" for c in rows])

    return F.pandas_udf(run, "string")(calls)


#: What editors call the languages of file extensions.
EDITOR_LANGUAGES = {
    ".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescriptreact", ".js": "javascript", ".jsx": "javascriptreact",
    ".mjs": "javascript", ".cjs": "javascript", ".mts": "typescript", ".cts": "typescript",
}


def editor_language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EDITOR_LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("plaintext"))


def absolute_path(path: Column, base: str = "/") -> Column:
    """Slashes forward, below ``base`` unless it is absolute, ``.`` and ``..`` resolved."""
    plain = normalize_path(path)
    return fold_path(F.when(plain.startswith("/"), plain).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), plain)))


def uri_path(uri: Column, base: str = "/") -> Column:
    """The path of a ``file:`` address with its escapes read, those that are none left as they are; anything else is taken as a path."""
    address = F.regexp_replace(F.regexp_replace(uri, r"^file:(//[^/?#]*)?", ""), r"[?#].*$", "")
    address = F.regexp_replace(address, "%(?![0-9A-Fa-f]{2})", "%25")
    return absolute_path(F.when(uri.startswith("file:"), F.url_decode(F.replace(address, F.lit("+"), F.lit("%2B")))).otherwise(uri), base)


def content_length(header: Column) -> Column:
    """Of a message's header lines; 0 where it is missing or no number."""
    value = F.regexp_extract(header, r"(?i)(?:^|\r\n)content-length:[ \t]*([^\r\n]*)", 1)
    return F.coalesce(F.trim(value).try_cast("long"), F.lit(0).cast("long"))


def usage_total(usage: DataFrame, by: list[str]) -> DataFrame:
    """Sums of all token counts, nulls as 0, and ``basis``: what fills the context, input and cached tokens, or else the total."""
    counts = [c for c, _ in usage.dtypes if c.endswith("_tokens")]
    sums = usage.groupBy(*by).agg(*[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in counts])
    part = lambda c: F.col(c) if c in counts else F.lit(0)
    filled = part("input_tokens") + part("cache_read_tokens") + part("cache_write_tokens")
    return sums.withColumn("basis", F.when(filled > 0, filled).otherwise(part("total_tokens")).cast("long"))


def copies(df: DataFrame, text: str, id_: str) -> DataFrame:
    """(first_id, n) of each distinct text."""
    return df.groupBy(F.sha2(text, 256).alias("digest")).agg(F.min(id_).alias("first_id"), F.count(F.lit(1)).alias("n")).select("first_id", "n")
