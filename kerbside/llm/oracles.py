"""DuckDB SQL of the opN queries that SQL can express, over whole tables."""

from __future__ import annotations

from kerbside.llm import chat

#: Words: runs of what is no ASCII white space.
_W = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
 i as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark),
 iw as (select distinct item_id, least(13, len(w)) n, array_to_string(w[k:k+least(13, len(w))-1], ' ') s from (select item_id, w, unnest(generate_series(1, greatest(len(w)-12, 1))) k from i where len(w) > 0)),
 ns as (select distinct n from iw),
 dw as (select doc_id, n, k, array_to_string(w[k:k+n-1], ' ') s from (select doc_id, w, n, unnest(generate_series(1, len(w)-n+1)) k from d, ns where len(w) >= n)),
 hit as (select distinct doc_id, item_id, k, dw.n from dw join iw using (n, s)),
 pos as (select doc_id, count(distinct p) h from (select doc_id, unnest(generate_series(k, k+n-1)) p from hit) group by 1),
 its as (select doc_id, count(*) c, string_agg(x, ',' order by x) s from (select distinct doc_id, cast(item_id as varchar) x from hit) group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(h, 0) n_hit, coalesce(c, 0) n_items, sha256(coalesce(its.s, '')) items_sha256, coalesce(h, 0) > 0 and 20*coalesce(h, 0) >= len(w) contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""

OP4 = f"""
with d as (select doc_id, {_W} w from documents),
 win as (select doc_id, k, array_to_string(w[k:k+19], ' ') s from (select doc_id, w, unnest(generate_series(1, len(w)-19)) k from d where len(w) >= 20)),
 rep as (select doc_id, k from (select *, row_number() over (partition by s order by doc_id, k) r from win) where r > 1),
 gone as (select distinct doc_id, unnest(generate_series(k, k+19)) p from rep),
 kept as (select doc_id, p, x from (select doc_id, unnest(w) x, unnest(generate_series(1, len(w))) p from d) anti join gone using (doc_id, p)),
 txt as (select doc_id, count(*) n, string_agg(x, ' ' order by p) t from kept group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(len(w)-coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join txt using (doc_id)
"""

OP9 = f"""
with d as (select doc_id, source, coalesce(text, '') t, {_W} w from documents),
 win as (select doc_id, k, array_to_string(w[k:k+7], ' ') s from (select doc_id, w, unnest(generate_series(1, len(w)-7)) k from d where len(w) >= 8)),
 rep as (select doc_id, count(distinct p) c from (select doc_id, unnest(generate_series(k, k+7)) p from (select *, count(*) over (partition by doc_id, s) m from win) where m > 1) group by 1),
 ln as (select doc_id, count(*)-count(distinct l) c from (select doc_id, unnest(string_split(t, chr(10))) l from d) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by 1),
 m as (select doc_id, source, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars, cast(length(t)-length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
  coalesce(ln.c, 0) n_dup_lines, coalesce(rep.c, 0) n_repeat_words from d left join rep using (doc_id) left join ln using (doc_id)),
 b as (select *, n_words < 20 or 100*n_repeat_words > 30*n_words base_failed from m),
 h as (select source, count(*) n, count(*) filter (base_failed) f from b group by 1),
 g as (select sum(f)/sum(n) mean, var_samp(f/n) spread, avg(1/n) noise from h),
 p as (select mean, case when mean*(1-mean) > 0 and spread-mean*(1-mean)*noise > 0 then least(greatest(mean*(1-mean)/(spread-mean*(1-mean)*noise)-1, 1), 1e6) when mean*(1-mean) > 0 then 1e6 else 1 end strength from g)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and (f+mean*strength)/(n+strength) <= 0.6 kept
from b join h on b.source is not distinct from h.source cross join p
"""

OP10 = r"""
with d as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) ls from documents),
 l as (select doc_id, unnest(generate_series(1, len(ls))) i, unnest(ls) x from d),
 st as (select doc_id, i, list_sort(list_distinct(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> ''))) s from l),
 big as (select *, row_number() over (partition by s order by doc_id, i) r from st where len(s) >= 1),
 cls as (select s, len(s) n, row_number() over (order by doc_id, i) c from big where r = 1),
 tok as (select c, n, unnest(s) t from cls),
 ord as (select c, n, t, row_number() over (partition by c order by f, t) p from tok join (select t, count(*) f from tok group by 1) using (t)),
 pre as (select * from ord where p <= n - (4*n + 4)//5 + 1),
 cand as (select distinct a.c x, b.c y from pre a join pre b using (t) where a.c < b.c and 5*least(a.n, b.n) >= 4*greatest(a.n, b.n)),
 later as (select distinct y c from cand join cls a on a.c = x join cls b on b.c = y where 9*len(list_intersect(a.s, b.s)) >= 4*(a.n + b.n)),
 gone as (select doc_id, i from big left join cls using (s) where r > 1 or c in (select c from later)),
 k as (select doc_id, string_agg(x, chr(10) order by i) t from l anti join gone using (doc_id, i) group by 1),
 g as (select doc_id, count(*) n from gone group by 1)
select d.doc_id, cast(len(ls) as bigint) n_lines, coalesce(g.n, 0) n_removed, case when text is not null then sha256(coalesce(k.t, '')) end kept_sha256
from d left join k using (doc_id) left join g using (doc_id)
"""

OP11 = """
select doc_id, max(doc_id) over g keep_id, count(*) over g group_size, doc_id = max(doc_id) over g kept, sha256(t) text_sha256
from (select doc_id, coalesce(text, '') t from documents) window g as (partition by t)
"""

OP12 = r"""
with d as (select row_number() over () k, coalesce(lang, '') lang, coalesce(source, '') source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
 w as (select k, lang, source, unnest(list_filter(regexp_split_to_array(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) term from d),
 kept as (select lang, term from w group by 1, 2 having count(distinct k) >= 10),
 v as (select lang, count(*) v from kept group by 1),
 grp as (select distinct lang, source, false whole from d union all select distinct lang, '', true from d),
 n as (select lang, source, false whole, term, count(*) n from w join kept using (lang, term) group by 1, 2, 4 union all select lang, '', true, term, count(*) from w join kept using (lang, term) group by 1, 4),
 tot as (select lang, source, whole, sum(n) total from n group by 1, 2, 3),
 p as (select lang, g.source, g.whole, term, coalesce(n.n, 0) n, 1 + (1000000000::hugeint * (coalesce(n.n, 0) + 2)) // (coalesce(total, 0)::hugeint + 2 * v) p
  from grp g join v using (lang) join kept using (lang) left join tot using (lang, source, whole) left join n using (lang, source, whole, term)),
 pr as (select a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) s from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source where not a.whole and not b.whole group by 1, 2, 3),
 pairs as (select a.lang, a.source, 'pair' part, b.source item, cast(coalesce(s, 0) as bigint) as value from grp a join grp b on a.lang = b.lang and a.source <> b.source and not a.whole and not b.whole left join pr on pr.lang = a.lang and pr.source = a.source and pr.item = b.source),
 terms as (select a.lang, a.source, 'term' part, a.term item, cast(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p) as bigint) as value from p a join p b on a.lang = b.lang and a.term = b.term and b.whole where not a.whole and a.n > 0 and a.p > b.p)
select lang, source, part, item, value, cast(r as int) as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) r from (select * from pairs union all select * from terms)) where part = 'pair' or r <= 10
"""

ORACLE_SQL = {"op1_decontaminate": OP1, "op2_chat": chat.ORACLE, "op4_substring": OP4, "op9_quality": OP9, "op10_line_dedup": OP10, "op11_exact_dedup": OP11, "op12_divergence": OP12}
