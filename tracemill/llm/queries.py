"""The registered queries of this package and their SQL."""

from __future__ import annotations

from tracemill.llm.bpe import op2_bpe_merge_replay
from tracemill.llm.chat import op5_chat_formatting
from tracemill.llm.ctw import op8_context_tree_weighting
from tracemill.llm.decontaminate import op3_fm_decontamination
from tracemill.llm.lines import op9_line_dedup
from tracemill.llm.near import op6_order_minhash
from tracemill.llm.quality import op10_quality_rules
from tracemill.llm.shards import op4_label_propagation_shards
from tracemill.llm.tokens import op7_token_counts
from tracemill.llm.toxicity import op1_crf_toxicity

QUERIES = {f.__name__: f for f in (op1_crf_toxicity, op2_bpe_merge_replay, op3_fm_decontamination, op4_label_propagation_shards, op5_chat_formatting, op6_order_minhash, op7_token_counts, op8_context_tree_weighting, op9_line_dedup, op10_quality_rules)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS3 = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
with d as (select doc_id, coalesce({_WORDS3}, []) as w from documents),
b as (select item_id, coalesce({_WORDS3}, []) as w from benchmark),
win as (select distinct item_id, list_aggregate(w[s:least(s + 9, len(w))], 'string_agg', ' ') as phrase, least(10, len(w)) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from b where len(w) > 0)),
sizes as (select distinct n from win),
dw as (select doc_id, s, n, list_aggregate(w[s:s + n - 1], 'string_agg', ' ') as phrase
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)),
occ as (select doc_id, s, dw.n as n, item_id from dw join win on dw.phrase = win.phrase and dw.n = win.n),
hit as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(s, s + n)) as p from occ) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids
  from (select distinct doc_id, cast(item_id as varchar) as i from occ where item_id is not null) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join its using (doc_id)
"""

_WS = r"[^\x20\x09-\x0D]"


def _op10() -> str:
    from tracemill.llm.quality import GUARD, LEAST_DOCS, MARKS, REACH

    guard = " ".join(f"when '{k}' then {v}" for k, v in GUARD.items())

    def fences(name: str, keys: str) -> str:
        by = f"{keys}, rate" if keys else "rate"
        pick = ", ".join(f"max(fence) filter (where rate = '{r}') as most_{r}" for r in GUARD)
        return f"""{name} as (select {keys + ',' if keys else ''} max(docs) as docs, {pick} from (
  select {by}, docs, min(bucket) filter (where 100 * below >= 50 * docs) as q50, min(bucket) filter (where 100 * below >= 75 * docs) as q75,
    q50 + greatest({REACH} * (q75 - q50), case rate {guard} end) as fence from (
    select {by}, bucket, sum(n) over (partition by {by} order by bucket) as below, sum(n) over (partition by {by}) as docs
    from (select {by}, bucket, count(*) as n from sk group by {by}, bucket)) group by {by}, docs){' group by ' + keys if keys else ''})"""

    held = " and ".join(f"coalesce({r} <= case when a.docs >= {LEAST_DOCS} then a.most_{r} when l.docs >= {LEAST_DOCS} then l.most_{r} else g.most_{r} end, true)" for r in GUARD)
    long = " union all ".join(f"select lang, source, '{r}' as rate, {r} as v from r" for r in GUARD)
    return rf"""
with t as (select doc_id, lang, source, coalesce(text, '') as text from documents),
f as (select *, regexp_extract_all(text, '{_WS}+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WS}')) as ln from t),
win as (select doc_id, s, list_aggregate(w[s:s + 7], 'string_agg', ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 6)) as s from f where len(w) >= 8)),
rep as (select doc_id, count(*) as k from (select distinct doc_id, unnest(range(s, s + 8)) from
  (select doc_id, s, count(*) over (partition by doc_id, x) as c from win) where c > 1) group by doc_id),
c as (select doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(ln) - len(list_distinct(ln)) as n_dup_lines, coalesce(k, 0) as n_repeat_words, len(ln) as n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_capitals,
  length(text) - length(translate(text, '{MARKS.replace("'", "''")}', '')) as n_marks
  from f left join rep using (doc_id)),
r as (select *, case when word_chars > 0 then 10000 * n_marks // word_chars end as mark_rate, case when n_lines > 0 then 10000 * n_dup_lines // n_lines end as dup_line_rate,
  case when word_chars > 0 then 10000 * n_capitals // word_chars end as capital_rate, case when n_words > 0 then 100 * word_chars // n_words end as word_length,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c),
sk as (select lang, source, rate, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) as bucket from ({long}) where v is not null),
{fences('a', 'lang, source')}, {fences('l', 'lang')}, {fences('g', '')}
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  base_failed, not base_failed and {held} as kept
from r left join a on r.lang is not distinct from a.lang and r.source is not distinct from a.source left join l on r.lang is not distinct from l.lang cross join g
"""


#: By brute force: the shortest runs from and up to each line, as texts; all copies but the first go.
OP9 = rf"""
with t as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as l from documents),
f as (select doc_id, unnest(range(1, len(l) + 1)) as k, l from t),
w as (select doc_id, k - 1 as line, l[k] as x, len(regexp_extract_all(l[k], '{_WS}+')) as n from f),
s as (select doc_id, row_number() over (partition by doc_id order by line) as i, line, trim(x, ' ') as x, n,
  sum(n) over (partition by doc_id order by line) as upto from w where n > 0),
a as (select doc_id, list(x order by i) as xs, list(upto order by i) as u, list(line order by i) as ls, list(n order by i) as ns from s group by doc_id),
b as (select doc_id, xs, u, ns, ls, unnest(range(1, len(xs) + 1)) as p from a),
r as (select doc_id, xs, p as i, list_position(list_transform(u[p:], lambda v: v - u[p] + ns[p] >= 50), true) as n from b
  union select doc_id, xs, p - n + 1 as i, n from (select doc_id, xs, p, list_position(list_transform(list_reverse(u[:p]), lambda v: u[p] - v >= 50), true) - 1 as n0,
    case when u[p] < 50 then null else coalesce(n0, p) end as n from b)),
g as (select doc_id, i, n, first_value((doc_id, i)) over (partition by n, list_aggregate(xs[i:i + n - 1], 'string_agg', chr(10)) order by doc_id, i) as first from r where n is not null),
gone as (select distinct doc_id, unnest(range(i, i + n)) as i from g where (doc_id, i) <> first),
rm as (select doc_id, list(line order by line) as removed from gone join s using (doc_id, i) group by doc_id)
select t.doc_id, case when removed is null then text else array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda k: case when list_contains(removed, k - 1) then null else l[k] end), lambda x: x is not null), chr(10)) end as text,
  len(l)::bigint as n_lines, coalesce(removed, [])::integer[] as removed_lines
from t left join rm using (doc_id)
"""

OP5 = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))),
e as (select *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) as n from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(role) + n + 24)::bigint as formatted_chars, true as stable
from e group by conv_id
"""

ORACLE = {"op5_chat_formatting": OP5, "op3_fm_decontamination": OP3, "op9_line_dedup": OP9, "op10_quality_rules": _op10()}
