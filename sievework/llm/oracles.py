"""DuckDB SQL of the corpus queries that SQL can express."""

WARC = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from q where payload_bytes >= 100 group by 1)
select q.page_id, q.payload_bytes, q.payload_digest,
  case when f.first < q.page_id then 'revisit' else 'response' end as record_type,
  case when f.first < q.page_id then f.first end as refers_to
from q left join f on q.payload_digest = f.payload_digest and q.payload_bytes >= 100"""

#: One round of Lloyd's: assignments by the books before it, and the books after it.
ROUND = """a{r} as materialized (select pos, part, n, min(row(list_inner_product(part, part) - 2 * list_inner_product(part, entry) + list_inner_product(entry, entry), code)) as best
  from unlike join b{r} using (pos) group by pos, part, n),
s{r} as (select pos, code, list(floor(s / c) order by k) as entry from (
  select pos, best[2] as code, k, sum(n * part[k]) as s, sum(n) as c from (select *, unnest(generate_series(1, len(part))) as k from a{r}) group by 1, 2, 3) group by 1, 2),
b{q} as materialized (select pos, code, coalesce(s.entry, b.entry) as entry from b{r} b left join s{r} s using (pos, code)),"""

CODES = f"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select vec_id, label, pos, v[pos * len(v) // 4 + 1 : (pos + 1) * len(v) // 4] as part from (select *, unnest([0, 1, 2, 3]) as pos from kept)),
unlike as materialized (select pos, part, count(*) as n from parts group by 1, 2),
b0 as materialized (select pos, row_number() over (partition by pos order by vec_id) - 1 as code, part as entry from parts where vec_id in (select vec_id from kept order by vec_id limit 256)),
{"".join(ROUND.format(r=r, q=r + 1) for r in range(4))}
a4 as materialized (select pos, part, min(row(list_inner_product(part, part) - 2 * list_inner_product(part, entry) + list_inner_product(entry, entry), code)) as best
  from unlike join b4 using (pos) group by pos, part),
coded as (select vec_id, label, string_agg(lower(printf('%02x', best[2])), '' order by pos) as code, sum(best[1])::bigint as error from parts join a4 using (pos, part) group by 1, 2),
labelled as (select label, sum(error)::bigint as label_error from coded group by 1),
books as (select sha256(string_agg(array_to_string(list_transform(entry, lambda x: x::bigint), ','), ',' order by pos, code)) as codebooks_sha256 from b4)
select vec_id, code, error, label_error, codebooks_sha256 from coded c join labelled l on c.label is not distinct from l.label, books"""


def _part(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_part, ["doc_id", "source", "lang", "n_chars", text])) + ")"


MERKLE = f"""
with recursive bits(k, step, v) as (select k, 0, k from range(256) t(k) union all
  select k, step + 1, xor(v >> 1, 3988292384 * (v & 1)) from bits where step < 8),
tab as (select list(v order by k) as tab from bits where step = 8),
docs as materialized (select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda acc, c: xor(acc >> 8, tab[(xor(acc, c) & 255) + 1])), 4294967295) as crc from documents, tab),
leaves as materialized (select doc_id, source, {_leaf('text')} as leaf,
  case when crc % 5 = 0 then {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as changed from docs),
placed as materialized (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by source) as size from leaves),
nodes(source, level, place, size, digest) as (select source, 0, place, size, leaf from placed union all
  select source, level + 1, place // 16, (size + 15) // 16, sha256(string_agg(digest, '' order by place)) from nodes where size > 1 group by source, level, place // 16, size),
tops as materialized (select source, digest as subroot, row_number() over (order by source nulls first) - 1 as place, count(*) over () as size from nodes where size = 1),
crown(level, place, size, digest) as (select 0, place, size, subroot from tops union all
  select level + 1, place // 16, (size + 15) // 16, sha256(string_agg(digest, '' order by place)) from crown where size > 1 group by level, place // 16, size),
every as materialized (select p.doc_id, p.leaf, coalesce(p.changed, p.leaf) as changed, p.source, p.place, t.place as top, t.subroot, c.digest as root, row_number() over () as r
  from placed p join tops t on p.source is not distinct from t.source, (select digest from crown where size = 1) c),
steps as materialized (
  select e.r, n.level, n.place, n.digest, n.place = (e.place >> (4 * n.level)) as own from every e join nodes n on n.source is not distinct from e.source and n.size > 1 and (n.place >> 4) = (e.place >> (4 * n.level + 4))
  union all select e.r, 100 + n.level, n.place, n.digest, n.place = (e.top >> (4 * n.level)) from every e join crown n on n.size > 1 and (n.place >> 4) = (e.top >> (4 * n.level + 4))),
proofs as (select r, sha256(string_agg(digest, '' order by level, place)) as proof_sha256 from steps where not own group by 1),
runs as materialized (select r, row_number() over (partition by r order by level) as step, coalesce(string_agg(digest, '' order by place) filter (place < here), '') as before, coalesce(string_agg(digest, '' order by place) filter (place > here), '') as after
  from (select *, max(place) filter (own) over (partition by r, level) as here from steps) group by r, level),
fold(r, step, digest) as (select r, 0::bigint, changed from every union all select f.r, f.step + 1, sha256(before || digest || after) from fold f join runs s on s.r = f.r and s.step = f.step + 1),
ends as (select r, arg_max(digest, step) as folded_root from fold group by 1)
select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from every left join proofs using (r) join ends using (r)"""

ORACLES: dict[str, str] = {"op5_warc": WARC, "op11_codes": CODES, "op13_merkle": MERKLE}
