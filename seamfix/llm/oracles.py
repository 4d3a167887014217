"""DuckDB SQL of the queries that SQL can express, written from the contracts and the
quality rules' definitions, with exact strings where the operators hash."""

from __future__ import annotations

from .quality import BANDS, MAX_CHAR_DISTANCE, MAX_WORD_SHARE, MIN_CHARS, MIN_REFERENCE, MIN_WORDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = f"""
with w as (select doc_id, regexp_extract_all({_LOWER}, {_WORDS}) w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end s from w),
x as (select doc_id, unnest(s) g from s),
m as (select a.doc_id a, b.doc_id b, count(*) m from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from m join s p on p.doc_id = a join s q on q.doc_id = b where 100 * m >= 80 * (len(p.s) + len(q.s) - m)),
e as (select a, b from l union all select b, a from l),
r as (with recursive r(a, b) as (select doc_id, doc_id from s union select r.a, e.b from r join e on r.b = e.a)
      select a, min(b) c from r group by a)
select doc_id, len(s)::bigint n_shingles, c component_id from s join r on a = doc_id
"""

OP6 = f"""
with i as (select item_id, regexp_extract_all({_LOWER}, {_PLAIN}) w from benchmark),
iw as (select distinct item_id::varchar id, least(10, len(w)) t, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') k
       from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) p from i where len(w) > 0)),
d as (select doc_id, regexp_extract_all({_LOWER}, {_PLAIN}) w from documents),
t as (select distinct t from iw),
dw as (select doc_id, t, p, array_to_string(w[p:p + t - 1], ' ') k
       from (select doc_id, w, t, unnest(range(1, len(w) - t + 2)) p from d, t)),
h as (select doc_id, dw.t, p, id from dw join iw on dw.t = iw.t and dw.k = iw.k),
n as (select doc_id, count(distinct q) n from (select doc_id, unnest(range(p, p + t)) q from (select distinct doc_id, p, t from h)) group by 1),
s as (select doc_id, count(distinct id) c, string_agg(distinct id, ',' order by id) ids from h group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_hit, coalesce(c, 0)::bigint n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n, 0) > 0 contaminated
from d left join n on n.doc_id = d.doc_id left join s on s.doc_id = d.doc_id
"""

_CLASSES = ["length(t) - length(r1)", "length(r1) - length(r2)", "length(r2) - length(r3)", "length(r3) - length(r4)",
            "length(r4) - length(r5)", "length(r5) - length(r6)", "length(r6)"]


def _js(p: str, q: str) -> str:
    half = lambda x: f"(case when {x} > 0 then {x} * log2({x} / (({p} + {q}) / 2)) else 0 end)"
    return f"({half(p)} + {half(q)}) / 2"


OP7 = rf"""
with d as (select doc_id, coalesce(text, '') t, coalesce(lang, '') lang from documents),
m as (select *, regexp_extract_all(t, {_WORDS}) w, regexp_replace(t, '[a-z]+', '', 'g') r1, regexp_replace(r1, '[\x20\x09-\x0D]+', '', 'g') r2,
        regexp_replace(r2, '[^\x00-\x7F]+', '', 'g') r3, regexp_replace(r3, '[A-Z]+', '', 'g') r4,
        regexp_replace(r4, '[.,;:''"()?\-]+', '', 'g') r5, regexp_replace(r5, '[0-9]+', '', 'g') r6,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from d),
win as (select doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] k
        from (select doc_id, w, unnest(range(1, len(w) - 1)) i from m where len(w) >= 3)),
twice as (select doc_id, k from win group by all having count(*) > 1),
pos as (select distinct doc_id, unnest([i, i + 1, i + 2]) p from win semi join twice using (doc_id, k)),
rep as (select doc_id, count(*) n from pos group by 1),
b as (select m.*, len(w) n_words, length(t) - (length(r1) - length(r2)) word_chars,
        length(r4) - length(regexp_replace(r4, '[#*$%&|<>]+', '', 'g')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines,
        coalesce(rep.n, 0) n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed
      from m left join rep on rep.doc_id = m.doc_id),
one as (select doc_id, lang, base_failed, lower(unnest(w)) x from b),
top as (select lang, x, case {' '.join(f'when k <= {b} then {i}' for i, b in enumerate(BANDS, 1))} end r
        from (select lang, x, row_number() over (partition by lang order by count(*) desc, x) k from one group by lang, x) where k <= {BANDS[-1]}),
wc as (select one.doc_id, one.lang, base_failed, coalesce(r, 0) r, count(*) n from one left join top on top.lang = one.lang and top.x = one.x group by all),
wr as (select lang, r, sum(n) n from wc where not base_failed group by all),
wt as (select lang, sum(n) n from wr group by all),
slots as (select distinct lang, unnest(range(0, {len(BANDS) + 1})) r from d),
none as (select s.lang, sqrt(greatest(sum({_js("p", "q")}), 0)) dist from (select s.lang, case when s.r = 0 then 1.0::double else 0 end p, coalesce(wr.n, 0) / wt.n q
         from slots s join wt on wt.lang = s.lang left join wr on wr.lang = s.lang and wr.r = s.r) s group by all),
wd as (select b.doc_id, sqrt(greatest(sum({_js('p', 'q')}), 0)) dist from (
         select b.doc_id, coalesce(wc.n, 0) / b.n_words p, coalesce(wr.n, 0) / wt.n q
         from b join slots s on s.lang = b.lang join wt on wt.lang = b.lang left join wc on wc.doc_id = b.doc_id and wc.r = s.r
         left join wr on wr.lang = b.lang and wr.r = s.r where b.n_words > 0) b group by all),
cc as (select doc_id, lang, base_failed, length(t) total, unnest([{', '.join(_CLASSES)}]) n, unnest(range(0, 7)) r from b),
cr as (select lang, r, sum(n) n from cc where not base_failed group by all),
ct as (select lang, sum(n) n from cr group by all),
cd as (select doc_id, sqrt(greatest(sum({_js('p', 'q')}), 0)) dist from (
         select cc.doc_id, cc.n / total p, cr.n / ct.n q from cc join cr on cr.lang = cc.lang and cr.r = cc.r join ct on ct.lang = cc.lang
         where total > 0) group by all)
select b.doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines,
       n_repeat_words::bigint n_repeat_words, base_failed,
       not base_failed and not (length(t) >= {MIN_CHARS} and n_words >= {MIN_WORDS} and coalesce(wt.n, 0) >= {MIN_REFERENCE}
         and (coalesce(cd.dist, 0) > {MAX_CHAR_DISTANCE} or coalesce(wd.dist > {MAX_WORD_SHARE} * none.dist, false))) kept
from b left join wt on wt.lang = b.lang left join none on none.lang = b.lang left join cd on cd.doc_id = b.doc_id left join wd on wd.doc_id = b.doc_id
"""

OP8 = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') k from (select doc_id, w, unnest(range(1, len(w) - 48)) i from w where len(w) >= 50)),
low as (select k, min(doc_id) m from win group by k having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, p from (select win.doc_id, unnest(range(i, i + 50)) p from win join low on win.k = low.k where m < win.doc_id)),
one as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p from w),
kept as (select doc_id, string_agg(x, ' ' order by p) t, count(*) n from one anti join gone using (doc_id, p) group by 1)
select w.doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
from w left join kept on kept.doc_id = w.doc_id
"""

OP11 = """
with d as (select doc_id, coalesce(text, '') t, length(t) n, sha256('1:' || coalesce(doc_id::varchar, '')) k from documents),
h as (select *, ('0x' || k[1:8])::ubigint h1, ('0x' || k[9:16])::ubigint h2, ('0x' || k[17:24])::ubigint h3, ('0x' || k[25:32])::ubigint h4 from d),
c as (select *, (least(h1 % (n + 1), h2 % (n + 1)))::bigint a, (greatest(h1 % (n + 1), h2 % (n + 1)))::bigint b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
             when h4 % 100 < 20 then 'spm' else 'psm' end form from h),
p as (select *, '<P>' || substring(t, 1, a) p, '<M>' || substring(t, a + 1, b - a) m, '<S>' || substring(t, b + 1) s from c)
select doc_id, n::bigint n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars,
       sha256(case form when 'plain' then t when 'psm' then p || s || m else s || p || m end) output_sha256, sha256(t) restored_sha256
from p
"""

_TERMS = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"

OP12 = f"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all({_LOWER}, {_TERMS}) w from documents),
x as (select r, lang, source, unnest(w) term from d),
k as (select lang, term from x group by all having count(distinct r) >= 30),
n as (select lang, source, term, count(*) n from x semi join k using (lang, term) group by all),
v as (select lang, count(*) v from k group by 1),
g as (select distinct lang, source from d),
gt as (select g.lang, g.source, coalesce(sum(n), 0)::hugeint total, coalesce(any_value(v), 0)::hugeint v
       from g left join n on n.lang = g.lang and n.source = g.source left join v on v.lang = g.lang group by all),
p as (select gt.lang, gt.source, k.term, coalesce(n, 0) n, 1 + 1000000000 * (coalesce(n, 0) + 5)::hugeint // (total + 5 * v) p
      from gt join k on k.lang = gt.lang left join n on n.lang = gt.lang and n.source = gt.source and n.term = k.term),
lt as (select lang, sum(total) t from gt group by 1),
q as (select n.lang, term, 1 + 1000000000 * (sum(n) + 5)::hugeint // (any_value(t) + 5 * any_value(v)) q
      from n join v on v.lang = n.lang join lt on lt.lang = n.lang group by n.lang, term),
pairs as (select a.lang, a.source, b.source item, coalesce(sum(abs(x.p - y.p)), 0) f
          from g a join g b on a.lang = b.lang and a.source <> b.source left join p x on x.lang = a.lang and x.source = a.source
          left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
terms as (select p.lang, source, p.term item, p - q f from p join q on p.lang = q.lang and p.term = q.term where n > 0 and p > q),
r as (select lang, source, 'pair' part, item, f, row_number() over (partition by lang, source order by f desc, encode(item)) k from pairs
      union all
      select lang, source, 'term' part, item, f, row_number() over (partition by lang, source order by f desc, encode(item)) k from terms)
select lang, source, part, item, f::bigint "value", k::int "rank" from r where part = 'pair' or k <= 50
"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1,
    "op6_benchmark_decontamination": OP6,
    "op7_quality_rules": OP7,
    "op8_substring_dedup": OP8,
    "op11_fill_in_middle": OP11,
    "op12_source_divergence": OP12,
}
