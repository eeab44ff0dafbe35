"""DuckDB twins of the training-data queries that SQL can state."""

from __future__ import annotations

from canopyframe.llm.quality import RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_WORD = r"'[^\x20\x09-\x0D]+'"


def _terms(text: str = "text") -> str:
    return f"coalesce(regexp_extract_all({_LOWER.format(text)}, {_TERM}), [])"


DECONTAMINATION = f"""
with d as (select doc_id, {_terms()} as ws from documents),
  b as (select item_id, {_terms()} as ws from benchmark),
  w as (select item_id, least(10, len(ws)) as l, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as k from b where len(ws) > 0),
  win as (select distinct item_id, l, array_to_string(ws[k:k + l - 1], ' ') as p from w),
  pos as (select doc_id, l, ws, unnest(range(1, len(ws) - l + 2)) as k from d cross join (select distinct l from win)),
  hit as (select doc_id, k, win.l as l, item_id from (select doc_id, k, l, array_to_string(ws[k:k + l - 1], ' ') as p from pos) q join win using (l, p)),
  words as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(k, k + l)) as i from hit) group by 1),
  items as (select doc_id, count(*) as n, string_agg(i, ',' order by i) as ids from (select distinct doc_id, cast(item_id as varchar) as i from hit where item_id is not null) group by 1)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(words.n, 0) as n_hit, coalesce(items.n, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
from d left join words on words.doc_id = d.doc_id left join items on items.doc_id = d.doc_id"""

RANKED_SEARCH = f"""
with tf as (select doc_id, t, count(*) as tf from (select doc_id, unnest({_terms()}) as t from documents) group by 1, 2),
  n as (select doc_id, cast(sum(tf) as bigint) as n from tf group by 1),
  g as (select count(*) as nn, cast(sum(n) as bigint) as ll from n),
  m as (select doc_id, 10 + (90 * n * nn) // ll as m from n cross join g),
  it as (select distinct item_id, unnest({_terms()}) as t from benchmark),
  w as (select t, cast(floor(1000 * ln((2 * any_value(nn) + 2) / cast(2 * count(*) + 1 as double))) as bigint) as w from tf cross join g where t in (select t from it) group by 1),
  s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
    from it join tf using (t) join w using (t) join m using (doc_id) group by 1, 2),
  r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from r where rank <= 10"""

_FAILED = " + ".join(f"case when {rule} then {1 << i} else 0 end" for i, (_, rule) in enumerate(RULES))


def quality_sql(base_bits: int, hard: int, soft: int, votes: int) -> str:
    """Measures, failure bits and verdicts of the default policy."""
    return f"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_WORD}) as ws from documents),
  pos as (select doc_id, ws, unnest(range(1, len(ws) - 6)) as k from d where len(ws) >= 8),
  win as (select doc_id, k, array_to_string(ws[k:k + 7], ' ') as p from pos),
  again as (select doc_id, k from (select *, count(*) over (partition by doc_id, p) as c from win) where c > 1),
  rep as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(k, k + 8)) as i from again) group by 1),
  lines as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
  ln as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1),
  tops as (select doc_id, max(c) as top_word from (select doc_id, w, count(*) as c from (select doc_id, unnest(ws) as w from d) group by 1, 2) group by 1),
  me as (select d.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
      cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
      coalesce(n_lines, 0) as n_lines, len(list_filter(ws, lambda x: regexp_full_match(x, '[!-/:-@\\[-`{{-~\\x00-\\x08\\x0E-\\x1F\\x7F]'))) as n_short_words,
      len(list_filter(ws, lambda x: regexp_matches(x, '^\\pL'))) as n_alpha_words, coalesce(top_word, 0) as top_word,
      len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) as n_stammer
    from d left join rep on rep.doc_id = d.doc_id left join ln on ln.doc_id = d.doc_id left join tops on tops.doc_id = d.doc_id),
  f as (select *, cast({_FAILED} as bigint) as failed from me)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {base_bits} <> 0 as base_failed,
  not (failed & {base_bits} <> 0 or failed & {hard} <> 0 or bit_count(failed & {soft}) >= {votes}) as kept, failed from f"""
