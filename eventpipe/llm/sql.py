"""DuckDB SQL for the rows of the operators that SQL can express.

No entry: 1 and 9 (tokenizers), 5 and 7 (trained models), 8 (the compressor's
findings); tests compare those with brute force.
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRINGS = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
win as (select doc_id, s, list_slice(w, s, s + 12) as k from (select doc_id, w, unnest(range(1, len(w) - 11)) as s from d)),
first as (select k, min(doc_id) as least from win group by k),
gone as (select distinct doc_id, s + j as p from win join first using (k), range(13) r(j) where doc_id > least),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
kept as (select word.doc_id, string_agg(x, ' ' order by word.p) as t from word anti join gone on word.doc_id = gone.doc_id and word.p = gone.p group by 1),
n as (select doc_id, count(*) as n from gone group by 1)
select d.doc_id, len(w) as n_words, coalesce(n.n, 0) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from d left join n on n.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id
"""

NEAR_DUPLICATES = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda s: list_slice(w, s, s + 3)) when len(w) > 0 then [w] else [] end) as k from d),
shingle as (select distinct doc_id, k from sets),
n as (select doc_id, count(*) as n from shingle group by 1),
common as (select a.doc_id as x, b.doc_id as y, count(*) as i from shingle a join shingle b on a.k = b.k and a.doc_id != b.doc_id group by 1, 2),
link as (select x, y from common join n p on p.doc_id = x join n q on q.doc_id = y where 100 * i >= 80 * (p.n + q.n - i)),
reach as (select doc_id, doc_id as c from d union select reach.doc_id, link.y from reach join link on link.x = reach.c)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(c) as component_id, min(c) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id join reach on reach.doc_id = d.doc_id group by d.doc_id, n.n
"""

QUALITY_RULES = rf"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
tri as (select doc_id, s, list_slice(w, s, s + 2) as k from (select doc_id, w, unnest(range(1, len(w) - 1)) as s from d)),
twice as (select doc_id, k from tri group by 1, 2 having count(*) > 1),
rep as (select doc_id, count(distinct s + j) as n from tri join twice using (doc_id, k), range(3) r(j) group by 1),
line as (select doc_id, unnest(string_split(text, chr(10))) as l from d),
lines as (select doc_id, count(*) as n, count(*) - count(distinct l) as again from line where regexp_matches(l, '[^\x20\x09-\x0D]') group by 1),
c as (
  select d.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(lines.again, 0) as n_dup_lines, coalesce(lines.n, 0) as n_lines,
    coalesce(rep.n, 0) as n_repeat_words, len(regexp_extract_all(text, '[A-Z]')) as upper, len(regexp_extract_all(text, '[a-z]')) as lower,
    len(regexp_extract_all(text, '!')) as shouts, len(list_distinct(w)) as n_distinct
  from d left join rep on rep.doc_id = d.doc_id left join lines on lines.doc_id = d.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (10 * n_symbols > n_words or 4 * shouts > n_words or 2 * upper > upper + lower or word_chars < 2 * n_words
    or word_chars > 15 * n_words or 10 * n_dup_lines > 6 * n_lines or 20 * n_distinct < n_words) as kept
from b
"""

_CONTROL = r"(?:/?INST\]|/?s>|</?SYS>>|ROLE=|/ROLE\])"
CHAT = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, n, case n when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) r(n)),
p as (
  select *, length(regexp_replace(text, '([\[<])(\\*{_CONTROL})', '\1\\\2', 'g')) + case role when 'user' then 13 when 'assistant' then 7 when 'system' then 15
    else 14 + length(url_encode(role)) end as size from t),
o as (
  select *, sum(size) over w as chars, row_number() over w as k, count(*) over (partition by conv_id) as n from p
  window w as (partition by conv_id order by turn nulls first, role, text rows between unbounded preceding and current row))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars) filter (role = 'assistant' or k = n)::bigint as formatted_chars
from o group by conv_id
"""

DECONTAMINATE = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, list_slice(w, s, s + 12) as k from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as s from b where len(w) > 0)),
sizes as (select distinct len(k) as n from win),
part as (select doc_id, s, n, list_slice(w, s, s + n - 1) as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes)),
hit as (select doc_id, s, n, item_id from part join win using (k)),
words as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(s, s + n)) as p from hit) group by 1),
items as (select doc_id, count(distinct item_id) as n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by 1)
select d.doc_id, len(w) as n_words, coalesce(words.n, 0) as n_hit, coalesce(items.n, 0) as n_items, sha256(coalesce(items.ids, '')) as items_sha256,
  coalesce(words.n, 0) > 0 and 20 * coalesce(words.n, 0) >= len(w) as contaminated
from d left join words on words.doc_id = d.doc_id left join items on items.doc_id = d.doc_id
"""

def _crc32(text: str) -> str:
    """The crc32 of a string of ASCII characters, bit by bit."""
    bits = "list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda i: i::ubigint)), lambda x, i: xor(x >> 1, 3988292384::ubigint * (x & 1)))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::ubigint)"
    return f"xor(list_reduce(list_concat([4294967295::ubigint], {codes}), lambda a, b: {bits}), 4294967295::ubigint)"


PREFIX_TRIE = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
    substr(sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) as tid
  from conversations where conv_id is not null),
own as (select conv_id, list({{'role': role, 'text': text}} order by turn nulls first, tid) as w, conv_id::varchar as spelled from t group by conv_id),
h as (select conv_id, w, ({_crc32('spelled')} % 9)::bigint as h, conv_id - conv_id % 5 as base from own),
c as (select h.conv_id, list_concat(coalesce(list_slice(b.w, 1, h), []), list_slice(h.w, h + 1, len(h.w))) as w from h left join own b on b.conv_id = h.base),
p as (select conv_id, len(w) as n, unnest(range(len(w) + 1)) as depth, w from c),
m as (select conv_id, n, depth, list_slice(w, 1, depth) as k from p),
node as (
  select k, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '') as ends,
    case depth when 0 then 0 else (count(*) - 1) * strlen(k[depth].text) end as saved
  from m group by k, depth),
kid as (select list_slice(k, 1, depth - 1) as k, depth - 1 as depth, count(*) as n from node where depth > 0 group by 1, 2),
f as (select node.*, coalesce(kid.n, 0) as n_children from node left join kid on kid.k = node.k and kid.depth = node.depth),
up as (select list_slice(k, 1, a) as k, a as depth, saved, n_children from (select *, unnest(range(depth + 1)) as a from f)),
s as (select k, depth, sum(saved)::bigint as saved_tokens, count(*) filter (n_children = 0) as n_leaves from up group by k, depth)
select f.conv_id, f.depth::bigint as depth, q.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ends) as ends_sha256
from f join s on s.k = f.k and s.depth = f.depth left join node q on f.depth > 0 and q.depth = f.depth - 1 and q.k = list_slice(f.k, 1, f.depth - 1)
"""

_WINDOW = 50
SUFFIXES = rf"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, ''))::bigint as n from documents),
win as (select doc_id, s, substr(x, 2 * s + 1, {2 * _WINDOW}) as k from (select doc_id, x, unnest(range(n - {_WINDOW - 1})) as s from d)),
least as (select md5_number(k) as k, min(doc_id) as first from win group by 1),
hit as (select doc_id, s from win join least on md5_number(win.k) = least.k where doc_id > first),
edge as (select doc_id, s, lag(s) over (partition by doc_id order by s) as before from hit),
run as (select doc_id, s, sum(case when before is null or s > before + {_WINDOW} then 1 else 0 end) over (partition by doc_id order by s) as r from edge),
span as (select doc_id, r, min(s) as a, max(s) + {_WINDOW} as b from run group by doc_id, r),
cut as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as z from span),
kept as (select cut.doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' order by a) || substr(any_value(x), 2 * max(b) + 1) as k
  from cut join d using (doc_id) group by cut.doc_id)
select d.doc_id, d.n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, x))) as kept_sha256
from d left join kept using (doc_id)
"""

ORACLES = {
    "op11_prefix_trie": PREFIX_TRIE,
    "op12_suffix_dedup": SUFFIXES,
    "op2_substring_dedup": SUBSTRINGS,
    "op3_near_dedup": NEAR_DUPLICATES,
    "op4_quality_rules": QUALITY_RULES,
    "op6_chat_format": CHAT,
    "op10_decontaminate": DECONTAMINATE,
}
