"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

from markscale.llm.queries import SHARDS, URL_RULES

URL_FILTER = rf"""
with parts as (
    select page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
    from pages
), rules(verdict, rule_host, rule_path) as (
    values {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}
)
select page_id, host, path,
    (select arg_max(rule_host || rule_path, length(rule_host || rule_path)) from rules
     where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as rule,
    coalesce((select arg_max(verdict, length(rule_host || rule_path)) from rules
     where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)), 'allow') as verdict
from parts
"""

LINE_SPREAD = """
with numbered as (
    select row_number() over () as r, doc_id, text, source, string_split(text, chr(10)) as lines from documents
), shown as (
    select r, source, unnest(lines) as line, unnest(range(len(lines))) as i from numbered
), boilerplate as (
    select line from shown where regexp_matches(line, '\\S') group by line having count(distinct source) >= 5
), kept as (
    select r, string_agg(line, chr(10) order by i) as text, count(*) as n from shown
    where line not in (select line from boilerplate) group by r
)
select doc_id, coalesce(len(lines), 0) as n_lines, coalesce(len(lines), 0) - coalesce(n, 0) as n_removed,
    case when numbered.text is null then null else coalesce(kept.text, '') end as text
from numbered left join kept using (r)
"""

DECONTAMINATION = r"""
with doc_words as (
    select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
), items as (
    select distinct item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark
), windows as (
    select distinct item_id, size, array_to_string(words[w + 1 : w + size], ' ') as phrase
    from (select item_id, words, least(13, len(words)) as size, unnest(range(len(words) - least(13, len(words)) + 1)) as w
          from items where len(words) > 0)
), spots as (
    select r, size, p, array_to_string(words[p + 1 : p + size], ' ') as phrase
    from (select r, words, size, unnest(range(greatest(0, len(words) - size + 1))) as p
          from doc_words, (select distinct size from windows))
), found as (
    select r, p, size, item_id from spots join windows using (size, phrase)
), hits as (
    select r, count(distinct h) as n_hit from (select r, unnest(range(p, p + size)) as h from found) group by r
), named as (
    select r, count(*) as n_items, string_agg(id, ',' order by encode(id)) as ids
    from (select distinct r, item_id::varchar as id from found) group by r
)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from doc_words left join hits using (r) left join named using (r)
"""

STREAM_DEDUP = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
    doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""

WARC = """
with digests as (
    select page_id, sha1(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, ''))) as payload_bytes,
        case when octet_length(encode(coalesce(html, ''))) >= 1000
            then max(page_id) over (partition by coalesce(html, '')) else page_id end as response
    from pages
)
select page_id, payload_bytes, payload_digest,
    case when response = page_id then 'response' else 'revisit' end as record_type,
    case when response <> page_id then response end as refers_to
from digests
"""

CRC_STEP = "xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)"

SHARDING = f"""
with recursive steps(n, c, round) as (
    select n, n, 0 from range(256) t(n)
    union all
    select n, {CRC_STEP}, round + 1 from steps where round < 8
), crc_table as (
    select list(c order by n) as crcs from steps where round = 8
), rows as (
    select doc_id, coalesce(octet_length(encode(text)), 0) + 1 as size,
        xor(list_reduce(
            list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::bigint),
            lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) as text_crc32,
        coalesce(doc_id::varchar, '') as key
    from documents, crc_table
), draws as (
    select *, list_transform(range({SHARDS + 1}), lambda i: ('0x' || substr(md5(key || ':' || i), 1, 13))::bigint) as draw
    from rows
), placed as (
    select *, list_position(draw[:{SHARDS}], list_max(draw[:{SHARDS}])) - 1 as shard,
        list_position(draw, list_max(draw)) - 1 as grown_shard,
        ('0x' || substr(md5(key || ':' || size || ':' || text_crc32), 1, 13))::bigint % 1024 as block
    from draws
)
select doc_id, size, text_crc32, 'key' as law, shard::int as shard, grown_shard::int as grown_shard,
    row_number() over (partition by shard order by block, doc_id nulls first, size, text_crc32) - 1 as slot
from placed
"""

SOURCE_MIX = r"""
with rows as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents
), sizes as (
    select source, sum(size)::bigint as source_size,
        ((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::bigint as weight
    from rows group by source
), capped as (
    select *, sum(source_size) over () as total, 3 * source_size as cap,
        3 * source_size / weight <= (sum(source_size) over () - coalesce(sum(3 * source_size) over earlier, 0))
            / (sum(weight) over () - coalesce(sum(weight) over earlier, 0)) as is_capped
    from sizes
    window earlier as (order by 3 * source_size / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding)
), levels as (
    select *, (total - sum(case when is_capped then cap else 0 end) over ()) / sum(case when not is_capped then weight end) over () as level
    from capped
), targets as (
    select source, source_size, case when is_capped then cap::double else least(weight * level, cap) end as target from levels
), places as (
    select doc_id, size, source_size, target,
        least(floor(target + 0.5), 3 * source_size)::bigint as quota,
        coalesce(sum(size) over (partition by r.source order by part, h, doc_id nulls first, size
            rows between unbounded preceding and 1 preceding), 0) as start
    from (select *, h % 1024 as part from
        (select *, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint as h from rows)) r
    join targets t on r.source is not distinct from t.source
)
select doc_id, size::bigint as size, source_size, target,
    (case when size = 0 then 0 else quota // source_size * size
        + greatest(0, least(size, quota % source_size - start)) end)::bigint as taken
from places
"""

#: Levels of the unrolled trees: up to 3 ** 12 rows a source, up to 3 ** 5 sources.
MERKLE_LEVELS, MERKLE_TOP = 12, 5


def merkle_field(name: str) -> str:
    return f"coalesce(octet_length(encode({name}::varchar)) || ':' || {name}::varchar, '-')"


def merkle_levels(prefix: str, steps: int) -> str:
    """Tables prefix0 .. of nodes (g, i, n, h); a lone node stays as it is."""
    return ", ".join(
        f"""{prefix}{k + 1} as (
    select g, i, (max(n) + 2) // 3 as n,
        case when max(n) > 1 then sha256(string_agg(h, '' order by i0)) else max(h) end as h
    from (select g, i as i0, i // 3 as i, n, h from {prefix}{k}) group by g, i
)"""
        for k in range(steps)
    )


def merkle_paths(name: str, prefix: str, steps: int) -> str:
    """Tables name0 .. of rows (r, g, i, proof, folded), moved up level by level."""
    return ", ".join(
        f"""{name}{k + 1} as (
    select r, p.g, i // 3 as i, proof || coalesce(l, '') || coalesce(m, '') as proof,
        case when n > 1 then sha256(coalesce(l, '') || folded || coalesce(m, '')) else folded end as folded
    from (select p.r, p.g, p.i, p.proof, p.folded, max(s.n) as n,
            string_agg(s.h, '' order by s.i) filter (s.i < p.i) as l, string_agg(s.h, '' order by s.i) filter (s.i > p.i) as m
          from {name}{k} p join {prefix}{k} s on s.g = p.g and s.i // 3 = p.i // 3
          group by p.r, p.g, p.i, p.proof, p.folded) p
)"""
        for k in range(steps)
    )


MERKLE = f"""
with recursive steps(n, c, round) as (
    select n, n, 0 from range(256) t(n)
    union all
    select n, {CRC_STEP}, round + 1 from steps where round < 8
), crc_table as (
    select list(c order by n) as crcs from steps where round = 8
), prints as (
    select *, xor(list_reduce(
            list_transform(regexp_extract_all(hex(encode(doc_id::varchar)), '..'), lambda b: ('0x' || b)::bigint),
            lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) as crc
    from documents, crc_table
), leaves as (
    select row_number() over () as r, doc_id, coalesce('=' || source, '') as g,
        sha256({" || ".join(merkle_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) as leaf,
        sha256({" || ".join(merkle_field(c) for c in ("doc_id", "source", "lang", "n_chars"))} || case when crc % 2 = 0
            then {merkle_field("replace(text, chr(10), '')")} else {merkle_field("text")} end) as changed
    from prints
), s0 as (
    select r, g, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i,
        count(*) over (partition by g) as n, leaf as h, changed from leaves
), {merkle_levels("s", MERKLE_LEVELS)}, t0 as (
    select 0 as g, row_number() over (order by encode(g)) - 1 as i, count(*) over () as n, h, g as name from s{MERKLE_LEVELS}
), {merkle_levels("t", MERKLE_TOP)}, p0 as (
    select r, g, i, '' as proof, changed as folded from s0
), {merkle_paths("p", "s", MERKLE_LEVELS)}, q0 as (
    select r, 0 as g, t0.i, proof, folded from p{MERKLE_LEVELS} p join t0 on t0.name = p.g
), {merkle_paths("q", "t", MERKLE_TOP)}
select doc_id, leaf, t0.h as subroot, top.h as root, sha256(proof) as proof_sha256, folded as folded_root,
    folded = top.h as verified
from leaves join q{MERKLE_TOP} using (r) join t0 on t0.name = leaves.g, t{MERKLE_TOP} top
"""

CHAT_FORMAT = r"""
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all
    select -7, turn, role, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) t(turn, role)
), shown as (
    select *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ': ', ':\ ') || ': '
        || replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') || '</turn>' || chr(10) as formatted
    from rows
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(length(formatted))::bigint as formatted_chars
from shown group by conv_id
"""

ORACLES = {
    "op1_rendezvous_sharding": SHARDING,
    "op2_line_spread": LINE_SPREAD,
    "op3_url_filter": URL_FILTER,
    "op4_warc_zip": WARC,
    "op6_stream_dedup": STREAM_DEDUP,
    "op7_decontamination": DECONTAMINATION,
    "op9_source_mix": SOURCE_MIX,
    "op12_chat_format": CHAT_FORMAT,
    "op13_merkle_manifest": MERKLE,
}
