"""SQL for DuckDB that gives the same rows as the queries of this package.

The others have none: models and tests (op3, op6, op7, op13), pieces of a file (op1), and hashes
that DuckDB lacks (op8, op9, op10).  Tests compare those with plain versions.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op2_substring_dedup"] = r"""
with listed as (
    select row_number() over () as n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), windows as (
    select n, i, array_to_string(words[i:i + 34], ' ') as seen
    from (select n, words, unnest(range(1, len(words) - 33)) as i from listed)
), repeated as (
    select n, list(i) as starts from (select n, i, count(*) over (partition by seen) as times from windows)
    where times > 1 group by n
), covered as (
    select n, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 35)))) as gone from repeated
), kept as (
    select doc_id, words, gone, case when gone is null then words else list_where(words,
        list_transform(range(1, len(words) + 1), lambda i: not list_contains(gone, i))) end as stay
    from listed left join covered using (n)
)
select doc_id, len(words) as n_words, coalesce(len(gone), 0) as n_removed, sha256(array_to_string(stay, ' ')) as kept_sha256
from kept
"""

ORACLES["op4_chat_format"] = r"""
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values
        (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
        (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), written as (
    select *, replace(replace(text, '\', '\\'), '<|', '<\|') as safe_text,
        replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n') as safe_role,
        lag(role) over (partition by conv_id order by turn nulls first, role, text) as before
    from rows
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(length('<|im_start|>') + length(safe_role) + 1 + length(safe_text) + length('<|im_end|>') + 1)::bigint as formatted_chars,
    bool_and(case when before is null then role in ('system', 'user') when before = 'system' then role = 'user'
        when before = 'user' then role = 'assistant' when before = 'assistant' then role = 'user' else false end)
        and arg_max(role, (turn is not null, turn, role, text)) in ('user', 'assistant') as valid
from written group by conv_id
"""

ORACLES["op5_mtree_search"] = """
with scaled as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
    from scaled q join scaled c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, rank::int as rank, vec_id, score from (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
) where rank <= 5
"""

ORACLES["op11_phrase_mining"] = r"""
with pieces as (
    select lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from (select coalesce(lang, 'und') as lang, coalesce(text, '') as text from documents)
), listed as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces
), totals as (
    select lang, sum(len(words))::bigint as n from listed group by lang
), grams as (
    select lang, k, array_to_string(words[i:i + k - 1], ' ') as phrase
    from listed, unnest(range(1, 6)) as t(k), unnest(range(1, len(words) - k + 2)) as u(i)
), counts as (
    select lang, k, phrase, count(*) as f from grams group by lang, k, phrase having count(*) >= 100
), candidates as (
    select lang, k, phrase, f, string_split(phrase, ' ') as words from counts where k > 1
), cuts as (
    select c.lang, c.phrase, c.f as a, t.j, l.f as l, r.f as r, (1000::hugeint * c.f * n) // (l.f::hugeint * r.f) as score
    from candidates c join totals using (lang), unnest(range(1, c.k)) as t(j)
    join counts l on l.lang = c.lang and l.phrase = array_to_string(c.words[1:t.j], ' ')
    join counts r on r.lang = c.lang and r.phrase = array_to_string(c.words[t.j + 1:], ' ')
), inside as (
    select distinct c.lang, array_to_string(c.words[i:i + m - 1], ' ') as phrase, c.f
    from candidates c, unnest(range(2, c.k)) as t(m), unnest(range(1, c.k - m + 2)) as u(i)
), kept as (
    select c.* from candidates c where not exists (
        select 1 from inside i where i.lang = c.lang and i.phrase = c.phrase and 100 * i.f >= 100 * c.f)
), worst as (
    select * from (select *, row_number() over (partition by lang, phrase order by score, j) as pick from cuts) where pick = 1
), placed as (
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
    from worst join kept using (lang, phrase) join totals using (lang)
)
select * from placed where rank <= 2000
"""

#: crc32 of an id's digits: each byte is taken in, then eight steps of one bit (-1) follow.
ORACLES["op12_prefix_trie"] = r"""
with ids as (
    select conv_id, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(
        string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, b: case when b >= 0 then xor(a, b) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end) as state
    from (select distinct conv_id from conversations where conv_id is not null)
), turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
    from conversations where conv_id is not null
), marked as (
    select conv_id, pos, sha256(length(role) || ':' || role || text) as mark, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words
    from turns
), listed as (
    select conv_id, list(mark order by pos) as marks, list(words order by pos) as words from marked group by conv_id
), rebuilt as (
    select c.conv_id, list_concat(coalesce(b.marks[1:h], []), c.marks[h + 1:]) as marks, list_concat(coalesce(b.words[1:h], []), c.words[h + 1:]) as words
    from (select *, (xor(state, 4294967295) % 4)::int as h from ids join listed using (conv_id)) c
    left join listed b on b.conv_id = c.conv_id - c.conv_id % 20
), steps as (
    select conv_id, d, len(marks) as n, array_to_string(marks[1:d], ',') as path, array_to_string(marks[1:d - 1], ',') as before,
        case when d > 0 then words[d] else 0 end as w
    from rebuilt, unnest(range(0, len(marks) + 1)) as t(d)
), nodes as (
    select path, d, min(conv_id) as conv_id, any_value(before) as before, count(*) as n_convs, any_value(w) as w,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) as ends_sha256
    from steps group by path, d
), counted as (
    select a.*, p.conv_id as parent_conv_id,
        (select count(*) from nodes c where c.d = a.d + 1 and c.before = a.path) as n_children
    from nodes a left join nodes p on p.d = a.d - 1 and p.path = a.before and a.d > 0
), summed as (
    select a.path, a.d, sum((c.n_convs - 1) * c.w)::bigint as saved_tokens, count(*) filter (c.n_children = 0) as n_leaves
    from counted a join (select c.d, c.n_convs, c.w, c.n_children, s.path as above, s.d as above_d
        from counted c join steps s on s.conv_id = c.conv_id and s.d <= c.d) c on c.above = a.path and c.above_d = a.d
    group by a.path, a.d
)
select conv_id, d as depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
from counted join summed using (path, d)
"""
