"""Corpus queries that SQL can restate, over the same tables."""

from __future__ import annotations

from . import chat

_SPACE = r"[\x20\x09-\x0D]"
_WORDS = rf"""
texts as (select doc_id, coalesce(text, '') as t from documents),
words as (select doc_id, t, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from texts)"""

QUALITY = rf"""
with {_WORDS},
grams as (select doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') as gram from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from words)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from grams) where n > 1),
hit as (select doc_id, count(distinct i + k) as n from again, range(0, 5) r(k) group by doc_id),
m as (
  select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    coalesce(h.n, 0) as n_repeat_words, length(regexp_replace(t, '[^A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g')) as n_letters,
    len(list_filter(lines, lambda x: regexp_matches(x, '^{_SPACE}*([-*]|•)'))) as bullets, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…){_SPACE}*$'))) as ellipses
  from words left join hit h using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 10 * n_symbols > n_words or not word_chars between 2 * n_words and 15 * n_words or 100 * n_letters < 60 * word_chars
    or (n_lines >= 4 and (10 * n_dup_lines > 3 * n_lines or 10 * bullets > 9 * n_lines or 10 * ellipses > 3 * n_lines))) as kept
from m"""

JACCARD = f"""
with recursive {_WORDS},
sets as (
  select distinct doc_id, array_to_string(list_slice(ws, i, i + least(5, len(ws)) - 1), ' ') as gram
  from (select doc_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) as i from words where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from sets group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from sets a join sets b on a.gram = b.gram and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared s join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 9 * s.n >= 4 * (x.n + y.n)),
reach as (select doc_id as a, doc_id as b from texts union select r.a, l.b from reach r join links l on r.b = l.a),
classes as (select a as doc_id, min(b) as class_id from reach group by 1)
select doc_id, class_id, (select count(*) from links where a = doc_id) as n_links from classes"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for s in chat.CONTROL:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


_MARKS = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
_ORDER = "order by turn, role, text"
CHAT = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (
  select *, sum({_MARKS} + length({_escaped('role')}) + length({_escaped('text')})) over (partition by conv_id {_ORDER}) as upto,
    row_number() over (partition by conv_id {_ORDER}) = count(*) over (partition by conv_id) as last
  from turns),
read as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' {_ORDER}) as turns, coalesce(string_agg(text, '' {_ORDER}) filter (role = 'assistant'), '') as loss,
    cast(sum(upto) filter (role = 'assistant' or last) as bigint) as formatted_chars
  from sized group by 1)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from read"""

COPIES = """
with texts as (select doc_id, coalesce(text, '') as t from documents),
groups as (select t, max(doc_id) as keep_id, count(*) as group_size from texts group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from texts join groups using (t)"""


def _codes(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """The codebooks round by round: a table of components, one of entries, and the nearest entry of each part."""
    steps = [
        """
kept as materialized (select vec_id, label, embedding as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
comps as materialized (select vec_id, (i - 1) // w as p, (i - 1) % w as j, cast(floor(4096 * cast(x[i] as double)) as bigint) as v
  from (select vec_id, x, len(x) // {parts} as w, unnest(range(1, len(x) + 1)) as i from kept)),
vecs as materialized (select vec_id, p, list(v order by j) as q from comps group by all),
book0 as materialized (select p, e, q from vecs join (select vec_id, row_number() over (order by vec_id) - 1 as e from kept qualify e < {entries}) using (vec_id))""".format(parts=parts, entries=entries)
    ]
    for r in range(rounds + 1):
        steps.append(f"""
near{r} as materialized (select vec_id, p, min({{'d': d, 'e': e}}) as n from (
  select vec_id, p, e, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from vecs a join book{r} b using (p)) group by all)""")
        if r < rounds:
            steps.append(f"""
book{r + 1} as materialized (select p, e, coalesce(m.q, b.q) as q from book{r} b left join (
  select p, e, list((s - ((s % n) + n) % n) // n order by j) as q from (select p, n.e as e, j, sum(v)::bigint as s, count(*) as n from comps join near{r} using (vec_id, p) group by all) group by all) m using (p, e))""")
    return f"""with {",".join(steps)},
coded as (select vec_id, string_agg(printf('%02x', n.e), '' order by p) as code, cast(sum(n.d) as bigint) as error from near{rounds} group by all),
sha as (select sha256(string_agg(array_to_string(q, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded join kept using (vec_id), sha"""


CODES = _codes()
