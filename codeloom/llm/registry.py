"""The queries of these operators, and their SQL where SQL can express them."""

from codeloom.llm import chat, clustering, decontamination, divergence, html_main, language, neardup, packing, quality, rules, secrets, sharding, substrings

QUERIES = {
    "op1_nb_svm": quality.op1_nb_svm,
    "op2_token_efficiency": secrets.op2_token_efficiency,
    "op3_histogram_sort": sharding.op3_histogram_sort,
    "op4_golay_simhash": neardup.op4_golay_simhash,
    "op5_weak_supervision": rules.op5_weak_supervision,
    "op6_variable_best_fit": packing.op6_variable_best_fit,
    "op7_latent_retrieval": decontamination.op7_latent_retrieval,
    "op8_fm_index": substrings.op8_fm_index,
    "op9_block_lstm": html_main.op9_block_lstm,
    "op10_snapshot_collapse": chat.op10_snapshot_collapse,
    "op11_count_columns": divergence.op11_count_columns,
    "op12_hamerly": clustering.op12_hamerly,
    "op13_viterbi_spans": language.op13_viterbi_spans,
}

ORACLE_OP8 = r"""
with d as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') as w from documents),
windows as (
  select doc_id, i, array_to_string(w[i : i + 12], ' ') as g
  from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as i from d where len(w) >= 13)),
firsts as (select g, min(doc_id) as least from windows group by g),
gone as (
  select distinct x.doc_id, x.i + k.k as pos
  from windows x join firsts f on f.g = x.g, (select unnest(generate_series(0, 12)) as k) k where f.least < x.doc_id),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
kept as (
  select w.doc_id, string_agg(w.word, ' ' order by w.pos) as text
  from words w left join gone g on g.doc_id = w.doc_id and g.pos = w.pos where g.pos is null group by w.doc_id),
counts as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n, 0)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from d left join kept k on k.doc_id = d.doc_id left join counts c on c.doc_id = d.doc_id
"""

ORACLES = {
    "op8_fm_index": ORACLE_OP8,
    "op10_snapshot_collapse": chat.ORACLE_OP10,
    "op11_count_columns": divergence.ORACLE_OP11,
    "op12_hamerly": clustering.ORACLE_OP12,
}
