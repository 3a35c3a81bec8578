r"""SQL that states the results of the corpus queries where SQL can, for DuckDB over the same tables.

Operators without SQL (byte-level BPE, personal data with terms, trained scores, cube sampling, nearest neighbours, the
pipeline) are held against brute force in the tests.
"""

from __future__ import annotations

from .chat_windows import BUDGET, HISTORY_TOKENS, HISTORY_TURNS, TURN_TOKENS
from .quality_rules import BUCKETS, PAIR, PRIOR, SCALE, THRESHOLD

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1 = f"""
with recursive step(n, k, c) as (
  select n, 0, n::ubigint from range(256) t(n)
  union all select n, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from step where k < 8),
tab as (select list(c order by n) as tab from step where k = 8),
d as (select doc_id, coalesce(text, '') as t, {_WORDS.format("coalesce(text, '')")} as w from documents),
dw as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
vocabulary as (select distinct word, list_transform(range(1, octet_length(encode(word)) + 1), lambda j: ('0x' || substr(hex(encode(word)), 2 * j - 1, 2))::ubigint) as bytes from dw),
crc as (select word, xor(list_reduce(list_prepend(4294967295::ubigint, bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::bigint + 1])), 4294967295::ubigint)::bigint as h from vocabulary, tab),
hashed as (select doc_id, i, dw.word, h, lead(h) over (partition by doc_id order by i) as h2, lead(dw.word) over (partition by doc_id order by i) as w2, lead(dw.word, 2) over (partition by doc_id order by i) as w3 from dw join crc on dw.word = crc.word),
features as (select doc_id, h % {BUCKETS} as bucket from hashed union all select doc_id, (h * {PAIR} + h2) % {BUCKETS} from hashed where h2 is not null),
trusted as (select distinct doc_id from labels where quality = 1 and doc_id is not null),
counts as (select bucket, count(*) as raw, count(t.doc_id) as target from features f left join trusted t on f.doc_id = t.doc_id group by bucket),
totals as (select sum(raw)::double as raw_all, sum(target)::double as target_all from counts),
weights as (select bucket, round(ln((target + {PRIOR}::double) / (raw * target_all / raw_all + {PRIOR}::double)) * {SCALE})::bigint as weight from counts, totals),
llr as (select doc_id, sum(weight)::bigint as llr from features f join weights w on f.bucket = w.bucket group by doc_id),
grams as (select doc_id, i, count(*) over (partition by doc_id, word, w2, w3) as n from hashed where w3 is not null),
places as (select distinct doc_id, i + k as i from grams, range(3) r(k) where n > 1),
repeats as (select doc_id, count(*) as n from places group by doc_id),
base as (select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
  coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(l.llr, 0)::bigint as llr_millionths from d left join repeats r on d.doc_id = r.doc_id left join llr l on d.doc_id = l.doc_id),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, case when n_words > 0 then 2 * n_words - 1 else 0 end as n_features from base)
select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words, base_failed, llr_millionths, n_features::bigint as n_features,
  not base_failed and llr_millionths >= {round(THRESHOLD * SCALE)} * n_features as kept from judged"""

OP2 = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) when len(w) = 1 then [w[1]] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
-- a pair that reaches 0.8 shares one of the rarest fifth of either set
f as (select g, count(*) as df from s group by g),
r as (select s.doc_id, s.g, row_number() over (partition by s.doc_id order by df, s.g) as k from s join f on s.g = f.g),
p as (select r.doc_id, g from r join n on r.doc_id = n.doc_id where k <= n.n - ceil(0.8 * n.n) + 1),
c as (select distinct a.doc_id as a, b.doc_id as b from p a join p b on a.g = b.g and a.doc_id < b.doc_id),
e as (select c.a, c.b from c join s x on x.doc_id = c.a join s y on y.doc_id = c.b and x.g = y.g join n na on na.doc_id = c.a join n nb on nb.doc_id = c.b group by c.a, c.b, na.n, nb.n having 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
both as (select a, b from e union all select b, a from e),
reach(node, label) as (select doc_id, doc_id from d union select both.b, reach.label from reach join both on both.a = reach.node where reach.label < both.b),
best as (select node, min(label) as label from reach group by node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, best.label as component_id, d.doc_id = best.label as kept from d left join n on d.doc_id = n.doc_id join best on best.node = d.doc_id""".replace(
    "both as (", "around as ("
).replace("both.", "around.").replace("join both", "join around")

OP6 = rf"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
x as (select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as win from d, unnest(range(1, greatest(len(w) - 11, 1))) t(i)),
y as (select doc_id, i, min(doc_id) over (partition by win) as first from x),
gone as (select distinct doc_id, i + k as i from y, range(13) r(k) where first < doc_id),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
kept as (select words.doc_id, count(gone.i) as n_removed, coalesce(string_agg(word, ' ' order by words.i) filter (gone.i is null), '') as text from words left join gone on words.doc_id = gone.doc_id and words.i = gone.i group by words.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from d left join kept on d.doc_id = kept.doc_id"""

_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"
OP10 = rf"""
with recursive every as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as i, len({_WORDS.format('text')}) + {TURN_TOKENS} as tokens,
  12 + length(replace({_ESCAPED.format('role')}, chr(10), '\' || chr(10))) + 1 + length({_ESCAPED.format('text')}) + 11 as chars from every),
s as (select *, coalesce(sum(tokens) over w, 0) as before, coalesce(sum(chars) over w, 0) as q, case when first(role) over (partition by conv_id order by i) = 'system' then 1 else 0 end as sys, first(chars) over (partition by conv_id order by i) as first_chars
  from t window w as (partition by conv_id order by i rows between unbounded preceding and 1 preceding)),
system_tokens as (select conv_id, sum(tokens) filter (i < sys) as st from s group by conv_id),
-- how many turns before a turn its window would repeat, and where these begin
h as (select a.conv_id, a.i, max(k.k) as back, arg_max(b.before, k.k) as from_tokens, arg_max(b.q, k.k) as from_chars from s a, range({HISTORY_TURNS + 1}) k(k) join s b on true where b.conv_id = a.conv_id and b.i = a.i - k.k and a.i - k.k >= a.sys and a.before - b.before <= {HISTORY_TOKENS} group by a.conv_id, a.i),
fold(conv_id, i, base, opened) as (select conv_id, i, 0::hugeint, false from s where i = 0
  union all select s.conv_id, s.i, case when s.before + s.tokens - fold.base <= {BUDGET} then fold.base else coalesce(h.from_tokens, s.before) - coalesce(y.st, 0) end, s.before + s.tokens - fold.base > {BUDGET}
  from fold join s on s.conv_id = fold.conv_id and s.i = fold.i + 1 left join h on h.conv_id = s.conv_id and h.i = s.i join system_tokens y on y.conv_id = s.conv_id),
repeated as (select s.conv_id, sum(case when opened then s.sys * s.first_chars + s.q - coalesce(h.from_chars, s.q) else 0 end) as chars from fold join s on s.conv_id = fold.conv_id and s.i = fold.i left join h on h.conv_id = s.conv_id and h.i = s.i group by s.conv_id),
whole as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by i) as turns, coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '') as loss, sum(chars) as chars from t group by conv_id)
select w.conv_id, n_turns::bigint as n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, (w.chars + r.chars)::bigint as formatted_chars from whole w join repeated r on w.conv_id = r.conv_id"""
