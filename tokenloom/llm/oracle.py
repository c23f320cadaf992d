"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from tokenloom.llm.sharding import MULTIPLY_A, MULTIPLY_B, PRIME, round_keys

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

TOP_K = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id as vec_id,
        coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::bigint
            as score
    from v q join v c on q.vec_id <> c.vec_id
    where q.vec_id % 100 = 0
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as r
    from scored
)
select query_id, r::integer as rank, vec_id, score from ranked where r <= 10
"""

JACCARD_JOIN = f"""
with recursive words as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') as w
    from documents
), sets as materialized (
    select doc_id, case
        when len(w) >= 5 then list_distinct(list_transform(
            range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
    from words
), tokens as materialized (
    select doc_id, len(s) as n, unnest(s) as token from sets
), links as materialized (
    select a.doc_id as a, b.doc_id as b
    from tokens a join tokens b on a.token = b.token and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n
    having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach as (
    select doc_id as node, doc_id as found from documents
    union
    select r.node, l.b from reach r join links l on r.found = l.a
)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.found) as component_id
from sets s join reach r on s.doc_id = r.node
group by s.doc_id, len(s.s)
"""

SUBSTRING_DEDUP = """
with bytes as materialized (
    select doc_id, hex(encode(coalesce(text, ''))) as h,
        (length(hex(encode(coalesce(text, '')))) // 2)::bigint as n
    from documents
), windows as (
    select doc_id, unnest(range(0, n - 49)) as pos, h from bytes where n >= 50
), strings as materialized (
    select doc_id, pos, substring(h, 2 * pos + 1, 100) as string from windows
), firsts as (
    select string, min(doc_id) as first from strings
    group by string having min(doc_id) < max(doc_id)
), starts as (
    select doc_id, pos, coalesce(pos > lag(pos) over w + 50, true) as fresh
    from strings join firsts using (string) where first < doc_id
    window w as (partition by doc_id order by pos)
), runs as (
    select doc_id, min(pos) as low, max(pos) + 50 as high from (
        select doc_id, pos, sum(fresh::int) over (partition by doc_id order by pos) as run from starts
    ) group by doc_id, run
), gaps as (
    select doc_id, low, high,
        coalesce(lag(high) over (partition by doc_id order by low), 0) as before
    from runs
), kept as (
    select g.doc_id, sum(high - low)::bigint as n_removed, count(*) as n_spans,
        string_agg(substring(b.h, (2 * before + 1)::bigint, (2 * (low - before))::bigint), ''
            order by low)
            || substring(any_value(b.h), (2 * max(high) + 1)::bigint) as h
    from gaps g join bytes b using (doc_id) group by g.doc_id
)
select b.doc_id, b.n as n_bytes, coalesce(k.n_removed, 0) as n_removed,
    coalesce(k.n_spans, 0) as n_spans, sha256(unhex(coalesce(k.h, b.h))) as kept_sha256
from bytes b left join kept k using (doc_id)
"""


def _permuted(rows: str, number: str) -> str:
    """``number`` of every row of ``rows`` through the Feistel rounds, as ``place``."""
    sql = f"select *, {number} // c as l, {number} % c as r from ({rows}), sides"
    for index, (first, second, _) in enumerate(round_keys(42, 1)):
        side = "a" if index % 2 == 0 else "c"
        hashed = f"(((r * {MULTIPLY_A} + {first}) % {PRIME}) * {MULTIPLY_B} + {second})"
        sql = (
            f"select * exclude (l, r), r as l, (l + ({hashed} >> 16)) % {side} as r from ({sql})"
        )
    return f"select * exclude (l, r, a, c, n), (l * c + r) as place from ({sql})"


def _sharding(walks: int = 24) -> str:
    """Rows whose place lies outside are permuted again, as often as any row of a small table
    could need; the places are gapless or the rows would be too few.
    """
    crc = "range(0, 256)"
    for _ in range(8):
        crc = (
            f"list_transform({crc}, "
            "lambda c: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
        )
    numbered = "select doc_id, row_number() over (order by doc_id) - 1 as x from documents"
    steps = [f"walk0 as materialized (select doc_id, place from ({_permuted(numbered, 'x')}))"]
    for step in range(1, walks):
        outside = f"select doc_id, place as x from walk{step - 1}, sides where place >= n"
        steps.append(
            f"walk{step} as materialized (select doc_id, place from ({_permuted(outside, 'x')}))"
        )
    inside = " union all ".join(
        f"select doc_id, place from walk{step}, sides where place < n" for step in range(walks)
    )
    return f"""
with n as (select count(*) as n from documents), half as (
    select n, greatest(1, ceil(sqrt(n))::bigint) as a from n
), sides as (
    select a, ((n + a - 1) // a)::bigint as c, n from half
), {", ".join(steps)}, placed as ({inside}), crc as (select {crc} as t), texts as (
    select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), digests as (
    select doc_id, length(h) // 2 + 1 as size, xor(4294967295, list_reduce(list_prepend(
        4294967295::bigint,
        list_transform(range(0, length(h) // 2), lambda i: ('0x' || substring(h, 2 * i + 1, 2))::bigint)),
        lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1]))) as text_crc32
    from texts, crc
)
select d.doc_id, d.size::bigint as size, d.text_crc32::bigint as text_crc32, 'rows' as law,
    (p.place % 8)::integer as shard, (p.place // 8)::bigint as slot, null::integer as grown_shard
from digests d join placed p using (doc_id)
"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of a short text's bytes, bit by bit."""
    step = "xor(x, b)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda c: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)[1]"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii({text}[i])::bigint)"
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {codes}), "
        f"lambda x, b: {step}))"
    )


def _leaf(n_chars: str) -> str:
    parts = [
        f"coalesce(strlen(({v})::varchar) || ':' || ({v})::varchar, '-')"
        for v in ("doc_id", "source", "lang", n_chars, "text")
    ]
    return f"sha256({' || '.join(parts)})"


_UP = """list_transform(range(0, (len(nodes) + 1) // 2),
        lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"""

MERKLE = f"""
with recursive hashed as materialized (
    select doc_id, lang, {_leaf('n_chars')} as leaf,
        case when {_crc32('(doc_id::varchar)')} % 7 = 0 then {_leaf('n_chars + 1')}
            else {_leaf('n_chars')} end as changed
    from documents
), leaves as materialized (
    select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i,
        row_number() over () as row
    from hashed
), levels as (
    select lang, 0 as level, list(leaf order by i) as nodes from leaves group by lang
    union all
    select lang, level + 1, {_UP} from levels where len(nodes) > 1
), tops as materialized (
    select lang, level as height, nodes[1] as subroot,
        row_number() over (order by lang nulls first) - 1 as i
    from levels where len(nodes) = 1
), roots as (
    select 0 as level, list(subroot order by i) as nodes from tops
    union all
    select level + 1, {_UP} from roots where len(nodes) > 1
), path as materialized (
    select row, l.level as step, (i >> l.level) & 1 as side,
        coalesce(nodes[xor(i >> l.level, 1) + 1], '') as sibling
    from leaves join levels l on leaves.lang is not distinct from l.lang where len(nodes) > 1
    union all
    select row, t.height + r.level, (t.i >> r.level) & 1,
        coalesce(nodes[xor(t.i >> r.level, 1) + 1], '')
    from leaves join tops t on leaves.lang is not distinct from t.lang, roots r
    where len(r.nodes) > 1
), folds as (
    select row, 0 as step, changed as node from leaves
    union all
    select f.row, f.step + 1,
        sha256(case side when 1 then sibling || node else node || sibling end)
    from folds f join path p on f.row = p.row and f.step = p.step
), ends as (
    select row, arg_max(node, step) as folded_root from folds group by row
), proofs as (
    select row, sha256(coalesce(string_agg(sibling, '' order by step), '')) as proof_sha256
    from leaves left join path using (row) group by row
)
select doc_id, leaf, subroot, (select nodes[1] from roots where len(nodes) = 1) as root,
    proof_sha256, folded_root,
    folded_root = (select nodes[1] from roots where len(nodes) = 1) as verified
from leaves l join tops t on l.lang is not distinct from t.lang
    join proofs using (row) join ends using (row)
"""


WORD_DEDUP = """
with words as materialized (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
    from documents
), starts as (
    select doc_id, w, unnest(range(0, len(w) - 12)) as pos from words where len(w) >= 13
), windows as materialized (
    select doc_id, pos, array_to_string(w[pos + 1 : pos + 13], ' ') as string from starts
), firsts as (
    select string, min(doc_id) as first from windows
    group by string having min(doc_id) < max(doc_id)
), covered as (
    select distinct doc_id, unnest(range(pos, pos + 13)) as i
    from windows join firsts using (string) where first < doc_id
), kept as (
    select doc_id, count(c.i) as n_removed,
        string_agg(word, ' ' order by i) filter (c.i is null) as text
    from (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as i from words) a
        left join covered c using (doc_id, i)
    group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
    sha256(coalesce(text, '')) as kept_sha256
from words left join kept using (doc_id)
"""


COLLOCATIONS = f"""
with pieces as (
    select coalesce(lang, 'und') as lang, row_number() over () as row,
        unnest(regexp_split_to_array(
            translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) as piece
    from documents where text is not null
), words as materialized (
    select lang, row_number() over () as piece, regexp_extract_all(piece, '[^\\x20\\x09]+') as w
    from pieces
), sizes as (
    select lang, sum(len(w))::bigint as n from words group by lang
), phrases as (
    select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i
          from words, (select unnest(range(1, 5)) as k) where len(w) >= k)
), found as materialized (
    select lang, k as size, phrase, count(*) as f from phrases group by all having count(*) >= 30
), cuts as (
    select lang, size, phrase, f as a, k,
        array_to_string(string_split(phrase, ' ')[: k], ' ') as head,
        array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') as tail
    from (select *, unnest(range(1, size)) as k from found where size > 1)
), scored as (
    select c.lang, c.size, c.phrase, c.a, k, h.f as l, t.f as r,
        ((2000000::hugeint * a) // (h.f + t.f))::bigint as score
    from cuts c join found h on h.lang = c.lang and h.phrase = c.head
        join found t on t.lang = c.lang and t.phrase = c.tail
), best as materialized (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), parts as (
    select lang, array_to_string(string_split(phrase, ' ')[i : i + k - 1], ' ') as phrase, a
    from (select *, unnest(range(1, size - k + 2)) as i
          from (select lang, phrase, size, a, unnest(range(2, size)) as k from best where size > 2))
), most as (
    select lang, phrase, max(a) as most from parts group by all
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank,
    phrase, a, l, r, n, score
from best left join most using (lang, phrase) join sizes using (lang)
where not coalesce(100::hugeint * most >= 80::hugeint * a, false)
qualify rank <= 2000
"""


ORACLE_SQL: dict[str, str] = {
    "op1_top_k": TOP_K,
    "op4_jaccard_join": JACCARD_JOIN,
    "op5_substring_dedup": SUBSTRING_DEDUP,
    "op6_sharding": _sharding(),
    "op11_word_dedup": WORD_DEDUP,
    "op12_collocations": COLLOCATIONS,
    "op13_merkle_manifest": MERKLE,
}
