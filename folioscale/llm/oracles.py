"""SQL for the results of text operators that SQL can express, as DuckDB runs it."""

_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _sized(value: str) -> str:
    text = f"cast({value} as varchar)"
    return f"coalesce(concat(strlen({text}), ':', {text}), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_sized(value) for value in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: crc32 of the ids as text, by its table of 256 remainders (0xEDB88320 is the reversed polynomial).
_DRAWN = """
remainders(i, k, v) as (
    select i, 0, i from range(256) bytes(i)
    union all
    select i, k + 1, case when v & 1 = 1 then xor(3988292384, v >> 1) else v >> 1 end from remainders where k < 8),
crcs(doc_id, name, k, c) as (
    select distinct doc_id, cast(doc_id as varchar), 0, cast(4294967295 as bigint) from documents where doc_id is not null
    union all
    select doc_id, name, crcs.k + 1, xor(v, c >> 8)
    from crcs join remainders on remainders.k = 8 and i = (xor(c, cast(ascii(substr(name, crcs.k + 1, 1)) as bigint)) & 255)
    where crcs.k < length(name)),
drawn as (select doc_id from crcs where k = length(name) and xor(c, 4294967295) % 3 = 0)"""


def _flanks(side: str) -> str:
    return f"coalesce(string_agg(h, '' order by nodes.pos) filter (where nodes.pos {side} (own.pos >> (3 * lvl))), '')"


MANIFEST = f"""
with recursive {_DRAWN.strip()},
leaves as (
    select doc_id, coalesce('=' || lang, '') as tree, {_leaf('text')} as leaf,
           case when doc_id in (select doc_id from drawn) then {_leaf(f'translate(text, {_CAPITALS})')} end as tampered,
           row_number() over (partition by lang order by doc_id) - 1 as pos, count(*) over (partition by lang) as n
    from documents),
nodes(tree, lvl, pos, n, h) as (
    select tree, 0, pos, n, leaf from leaves
    union all
    select tree, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos))
    from nodes where n > 1 group by tree, lvl, pos // 8, n),
subroots as (
    select tree, h as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as n
    from nodes where n = 1),
peaks(lvl, pos, n, h) as (
    select 0, pos, n, subroot from subroots
    union all
    select lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos))
    from peaks where n > 1 group by lvl, pos // 8, n),
low as (
    select doc_id, lvl, {_flanks('<')} as before, {_flanks('>')} as after
    from leaves own join nodes on nodes.tree = own.tree and nodes.n > 1
        and nodes.pos // 8 = (own.pos >> (3 * lvl + 3))
    group by doc_id, lvl),
high as (
    select tree, lvl, {_flanks('<')} as before, {_flanks('>')} as after
    from subroots own join peaks nodes on nodes.n > 1 and nodes.pos // 8 = (own.pos >> (3 * lvl + 3))
    group by tree, lvl),
segments as (
    select doc_id, before, after, row_number() over (partition by doc_id order by part, lvl) as step
    from (select doc_id, 0 as part, lvl, before, after from low
          union all
          select doc_id, 1, lvl, before, after from leaves join high using (tree))),
proofs as (select doc_id, string_agg(before || after, '' order by step) as siblings, max(step) as steps from segments group by doc_id),
folds(doc_id, step, h) as (
    select doc_id, 0, coalesce(tampered, leaf) from leaves
    union all
    select doc_id, folds.step + 1, sha256(before || h || after) from folds join segments using (doc_id)
    where segments.step = folds.step + 1)
select leaves.doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) as proof_sha256,
       folds.h as folded_root, folds.h = root as verified
from leaves join subroots using (tree) cross join (select h as root from peaks where n = 1)
left join proofs using (doc_id)
join folds on folds.doc_id = leaves.doc_id and folds.step = coalesce(steps, 0)"""
