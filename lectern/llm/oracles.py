"""DuckDB SQL for the operators that SQL can express over whole tables."""

_WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"

OP2 = """
with d as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
 y as (select doc_id, i, substr(h, 2 * i + 1, 2) not in ('09', '0A', '0B', '0C', '0D', '20') as inside from (select doc_id, h, unnest(range(0, strlen(text))) as i from d where strlen(text) >= 250) a),
 f as (select *, inside and not coalesce(lag(inside) over (partition by doc_id order by i), false) as first from y),
 n as (select *, sum(first::int) over (partition by doc_id order by i rows unbounded preceding) as k from f),
 o as (select doc_id, k, min(i) as at, max(i) as last from n where inside group by doc_id, k),
 q as (select n.doc_id, n.i, greatest(n.i + 250, o.at + 1) as e from n join o on o.doc_id = n.doc_id and o.k = n.k + case when n.inside then 50 else 51 end
   union select n.doc_id, least(n.i - 249, o.last), n.i + 1 from n join o on o.doc_id = n.doc_id and o.k = n.k - 50),
 z as (select q.doc_id, i, e, md5(substr(h, 2 * i + 1, 2 * (e - i))) as m from q join d on d.doc_id = q.doc_id where i >= 0 and e - i <= 400 and e <= strlen(text)),
 p as (select doc_id, i, md5(substr(h, 2 * i + 1, 800)) as m from (select doc_id, h, unnest(range(0, greatest(0, strlen(text) - 399))) as i from d) a),
 r as (select doc_id, i as s, i + 400 as e from (select doc_id, i, count(*) over (partition by m) as n from p) b where n > 1),
 g as (select doc_id, s, e, sum(case when s <= prev then 0 else 1 end) over (partition by doc_id order by s) as k from (select *, coalesce(lag(e) over (partition by doc_id order by s), -1) as prev from r) c),
 u as (select doc_id, min(s) as s, max(e) as e from g group by doc_id, k),
 t as (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as prev, lead(s) over (partition by doc_id order by s) as following from u),
 c as (select t.doc_id, sum(e - s) as removed, count(*) as spans, string_agg(concat(substr(h, 2 * prev + 1, 2 * (s - prev)), case when following is null then substr(h, 2 * e + 1) else '' end), '' order by s) as kept from t join d on t.doc_id = d.doc_id group by t.doc_id),
 w as (select doc_id, i as s, e from (select doc_id, i, e, count(*) over (partition by m) as n from z) b where n > 1 union all select doc_id, s, e from r),
 x as (select doc_id, sum(greatest(0, e - greatest(s, prev))) as told from (select *, coalesce(max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding), 0) as prev from w) b group by doc_id)
select d.doc_id, cast(strlen(text) as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(case when removed is null then encode(text) else unhex(kept) end) as kept_sha256, cast(coalesce(told, 0) as bigint) as n_passage
from d left join c on d.doc_id = c.doc_id left join x on d.doc_id = x.doc_id"""

OP8 = rf"""
with d as (select row_number() over () as row, doc_id, source, coalesce(text, '') as text from documents),
 w as (select row, doc_id, source, text, {_WORDS.format(x="text")} as w from d),
 g as (select row, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) as g from (select row, w, unnest(range(1, len(w) - 1)) as i from w) a),
 r as (select distinct row, i + k as i from (select row, i, count(*) over (partition by row, g) as n from g) b, (select unnest([0, 1, 2]) as k) z where n > 1),
 c as (select row, count(*) as n from r group by row),
 l as (select row, count(*) - count(distinct line) as n from (select row, unnest(string_split(text, chr(10))) as line from d) e where regexp_matches(line, '[^\x20\x09-\x0D]') group by row),
 f as (select w.doc_id, w.source, len(w) as n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
   from w left join c on w.row = c.row left join l on w.row = l.row),
 j as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
 h as (select source, count(*) as n, count(*) filter (base_failed) as k from j group by source),
 m as (select avg(k / n) as m, var_pop(k / n) - avg(k / n * (1 - k / n) / n) as v from h),
 q as (select m, case when m = 0 or m >= 1 or v <= 0 then 10000.0::double else least(10000.0::double, greatest(1.0::double, m * (1 - m) / v - 1)) end as s from m),
 b as (select source, (k + s * m) / (n + s) > 0.5::double as host_failed from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, not base_failed and not host_failed as kept from j join b on j.source is not distinct from b.source"""

OP9 = rf"""
with recursive d as (select doc_id, {_WORDS.format(x="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
 s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] end) as s from d),
 n as (select doc_id, len(s) as n from s),
 x as (select doc_id, md5(unnest(s)) as g from s),
 c as (select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
 e as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
 y as (select a, b from e union all select b, a from e),
 r as (select doc_id as root, doc_id as node from n union select root, b from r join y on y.a = node),
 k as (select node, min(root) as root from r group by node)
select n.doc_id, n.n as n_shingles, k.root as component_id, n.doc_id = k.root as kept from n join k on k.node = n.doc_id"""

def _more(key: str, cost: str, letter: str) -> str:
    """A key of a path (its cost in 12 digits, then its audit) with one more edit."""
    return f"lpad(((left({key}, 12))::bigint + {cost})::varchar, 12, '0') || substr({key}, 13) || '{letter}'"


_GOES = "coalesce(fault in ('blank', 'duplicate'), false)"
_EXTRA = "case when fault = 'truncated' then 3 else 0 end"
# Paths after the rows that may be inserted: q2, then q3.
_CLOSED = f"select *, least(s3, {_more('q2', '3', 'I')}) as q3 from (select *, least(s2, {_more('least(s0, s1, s3)', '3', 'I')}) as q2 from {{0}}) y"

OP11 = rf"""
with recursive ids as (select conv_id, row_number() over () as c from (select distinct conv_id from conversations)),
 raw as (select c, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, concat(coalesce(r.conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) as k from conversations r join ids on r.conv_id is not distinct from ids.conv_id),
 e as (select *, xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten([[((ascii(substr(k, i::int, 1)) >> j) & 1)::bigint for j in range(0, 8)] for i in range(1, length(k) + 1)])), lambda a, b: xor(a >> 1, case when xor(a & 1, b) = 1 then 3988292384 else 0 end))) % 20 as kind from raw),
 m as (select c, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when kind = 0 then [] when kind = 3 then [0, 1] else [0] end) as copy from e),
 o as (select *, row_number() over (partition by c order by turn nulls first, role, text, copy) as pos, left(role, 1) as head, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as core from m),
 p as (select *, row_number() over (partition by c, role, text order by pos) > 1 as again, lag(head) over (partition by c order by pos) as prev from o),
 f as (select *, case when core = '' then 'blank' when again then 'duplicate' when right(core, 1) not in ('.', '!', '?') then 'truncated' end as fault from p),
 s as (select c, 0::bigint as pos, '000000000000' as s0, null::varchar as s1, null::varchar as s2, null::varchar as s3 from ids
   union all select c, n as pos,
     {_more("s0", "4", "D")},
     least({_more("s1", "4", "D")}, case when not {_GOES} and head = 's' then {_more("s0", _EXTRA, "K")} end),
     least({_more("q2", "4", "D")}, case when not {_GOES} and head = 'u' then {_more("before", _EXTRA, "K")} end, case when not {_GOES} then {_more("before", "3 + " + _EXTRA, "R")} end),
     least({_more("q3", "4", "D")}, case when not {_GOES} and head = 'a' then {_more("q2", _EXTRA, "K")} end, case when not {_GOES} then {_more("q2", "3 + " + _EXTRA, "R")} end)
   from (select *, least(s0, s1, q3) as before from ({_CLOSED.format("(select s.*, f.pos as n, head, fault from s join f on f.c = s.c and f.pos = s.pos + 1) x")}) z) w),
 b as (select c, least(s0, q3) as best from ({_CLOSED.format("(select * from s where not exists (select 1 from f where f.c = s.c and f.pos > s.pos)) x")}) z),
 l as (select c, i, letter, count(*) filter (letter <> 'I') over (partition by c order by i) as pos, count(*) filter (letter <> 'D') over (partition by c order by i) as j from (select c, substr(best, 12 + i::int, 1) as letter, i from (select c, best, unnest(range(1, length(best) - 11)) as i from b) a) a2),
 v as (select l.c, i, letter, j, head, text, role, coalesce(first_value(head) over (partition by l.c order by letter = 'D', i), '') = 's' and first_value(letter) over (partition by l.c order by letter = 'D', i) = 'K' as system from l left join f on f.c = l.c and f.pos = l.pos and letter <> 'I' where letter <> 'D'),
 t as (select c, string_agg(concat(case when letter = 'K' then role when (j - system::int) % 2 = 1 then 'user' else 'assistant' end, ':', coalesce(text, '')), chr(10) order by i) as repaired from v group by c),
 g as (select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (prev || head not in ('su', 'ua', 'au')) as illegal from f group by c)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, left(best, 12)::bigint as cost, substr(best, 13) as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from ids join b on b.c = ids.c left join g on g.c = ids.c left join t on t.c = ids.c"""

OP12 = r"""
with d as (select row_number() over () as row, coalesce(lang, 'und') as lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]') as pieces from documents),
 p as (select lang, regexp_extract_all(piece, '[^\x20\t]+') as w from (select lang, unnest(pieces) as piece from d) a),
 n as (select lang, sum(len(w))::bigint as n from p group by lang),
 g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from p, (select unnest([1, 2, 3, 4, 5]) as k) z) b),
 f as (select lang, k, phrase, count(*) as a from g group by lang, k, phrase having count(*) >= 100),
 c as (select *, string_split(phrase, ' ') as w from f where k > 1),
 u as (select lang, w, k, phrase, a, unnest(range(1, k)) as cut from c),
 s as (select u.lang, u.phrase, u.k, u.a, cut, x.a as l, y.a as r, n.n, (1000::hugeint * u.a * n.n) // (x.a::hugeint * y.a) as score
   from u join n on n.lang = u.lang join f x on x.lang = u.lang and x.phrase = array_to_string(w[1 : cut], ' ') join f y on y.lang = u.lang and y.phrase = array_to_string(w[cut + 1 : u.k], ' ')),
 m as (select *, row_number() over (partition by lang, phrase order by score, cut) as best from s),
 o as (select distinct b.lang, b.phrase from (select lang, k, a, w, unnest(range(2, k)) as size from c) l, lateral (select unnest([array_to_string(l.w[i : i + l.size - 1], ' ') for i in range(1, l.k - l.size + 2)]) as part) t join f b on b.lang = l.lang and b.phrase = t.part where 100 * l.a >= 100 * b.a),
 r as (select m.*, row_number() over (partition by m.lang order by score desc, a desc, m.phrase) as rank from m left join o on o.lang = m.lang and o.phrase = m.phrase where best = 1 and o.phrase is null)
select lang, rank, phrase, a, l, r, n, score::bigint as score from r where rank <= 2000"""

ORACLES: dict[str, str] = {"op2_suffix_repeats": OP2, "op8_quality_rules": OP8, "op9_minhash_near_dedup": OP9, "op11_conversation_repair": OP11, "op12_phrase_mining": OP12}
