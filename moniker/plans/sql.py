"""The same queries in SQL, from public definitions of functions that DuckDB has."""

from __future__ import annotations

from ..functions.keys import LEGAL_FORMS, PREFIXES
from ..operators.clusters import QIDS, SYMBOLS

R = r"[\p{L}\p{N}_''-]+"


def toks(x: str) -> str:
    return f"regexp_extract_all({x}, '{R}')"


def fold(x: str) -> str:
    return f"replace(strip_accents(lower({x})), 'ß', 'ss')"


def forms(x: str) -> str:
    return f"list_filter(list_transform({toks(x)}, lambda t: trim({fold('t')}, '''-')), lambda t: t <> '')"


def phrase(x: str) -> str:
    return f"array_to_string({forms(x)}, ' ')"


def parts(x: str) -> str:
    cases = " ".join(f"when '{a}' then '{b}'" for a, b in LEGAL_FORMS.items())
    bare = rf"regexp_replace(trim(regexp_replace({fold(x)}, '\s+', ' ', 'g')), '^(?:(?:{'|'.join(PREFIXES)})\.? +)+', '')"
    return rf"list_transform(regexp_extract_all({bare}, '[\p{{L}}\p{{N}}]+'), lambda p: case p {cases} else p end)"


def key(x: str) -> str:
    return f"array_to_string(list_sort({parts(x)}), ' ')"


def common(x: str) -> str:
    """For sorted lists of the schemata that the gazetteers have: neighbours are reduced, twice."""
    pair = lambda a, b: f"case when {a} in ('Company', 'PublicBody') and {b} in ('Organization', 'LegalEntity') or {a} = 'LegalEntity' and false then {a} when {b} in ('Person', 'Organization', 'PublicBody', 'Company') and {a} = 'LegalEntity' or {b} = 'PublicBody' and {a} = 'Organization' then {b} end"
    once = lambda l: f"case when len({l}) > 1 then list_sort(list_distinct(list_filter(list_transform(range(1, len({l})), lambda i: {pair(f'{l}[i]', f'{l}[i + 1]')}), lambda s: s is not null))) else {l} end"  # noqa: E731, E741
    return f"(select coalesce(case when len(d) = 1 then d[1] end, 'LegalEntity') from (select {once('c')} as d from (select {once('b')} as c from (select {once('a')} as b from (select list_sort(list_distinct({x})) as a)))))"


BENCH_ENTITIES = f"""ents as (
  select 'b-' || item_id || '-' || k as id, case item_id % 4 when 0 then 'Person' when 1 then 'Company' when 2 then 'PublicBody' else 'LegalEntity' end as schema,
         array_to_string(w[1:k], ' ') as name, case when k = 3 then replace(upper(array_to_string(w[1:2], ' ')), 'ẞ', 'SS') end as alias, n_name as country
  from (select item_id, {toks('text')} as w from benchmark) b, (values (2), (3)) v(k), nation where n_nationkey = item_id % 25 and len(w) >= k)"""
PART_ENTITIES = """ents as (
  select 'p-' || p_partkey as id, case p_partkey % 4 when 0 then 'Company' when 1 then 'Organization' when 2 then 'Vessel' else 'PublicBody' end as schema,
         p_name as name, p_brand as alias, p_type as country from part)"""
NATION_ENTITIES = """ents as (
  select 'c-' || n_nationkey as id, 'Company' as schema, n_name || ' ' || f[n_nationkey % 5 + 1] as name, n_name || ' ' || f[(n_nationkey + 1) % 5 + 1] as alias, n_name as country
  from nation, (select ['Bank', 'Holding Ltd', 'Group Inc', 'International GmbH', 'Trading Company'] as f)
  union all select 'n-' || n_nationkey, 'Person', ['Jane', 'John', 'Maria'][n_nationkey % 3 + 1] || ' ' || n_name, null, n_name from nation)"""
ALLOWED = "schema in ('LegalEntity', 'Organization', 'PublicBody', 'Company', 'Person', 'Address')"


def facts(entities: str) -> str:
    return f"""{entities}, unpacked as (
  select {key('name')} as key, schema, name, alias, lower(country) as country from ents where {ALLOWED} and length(name) >= 6 and {key('name')} <> ''),
facts as (select distinct * from (
  select key, schema, 'name' as kind, name as value from unpacked union all
  select key, schema, 'alias', alias from unpacked where alias is not null union all
  select key, schema, 'country', country from unpacked))"""


def clusters(entities: str) -> str:
    of = lambda kind: f"coalesce(list_sort(list(distinct value) filter (where kind = '{kind}')), [])"
    return f"""{facts(entities)}, clusters as (
  select key, {of('name')} as names, {of('alias')} as aliases, {of('country')} as countries, list_sort(list(distinct schema)) as schemata from facts group by key)"""


def look(table: dict[str, str]) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(p, lambda x: case x {' '.join(f"when '{k}' then '{v}'" for k, v in table.items())} end), lambda x: x is not null)))"


BENCH, PARTS, NATIONS = clusters(BENCH_ENTITIES), clusters(PART_ENTITIES), clusters(NATION_ENTITIES)
FACETS = f"""with {NATIONS}, named as (select key, list_distinct(flatten(list({parts('name')}))) as p from (select key, unnest(list_concat(names, aliases)) as name from clusters) group by key),
facets as (select key, {look(SYMBOLS)} as symbols, {look(QIDS)} as qids from named)
select key, array_to_string(symbols, '|') as symbols, array_to_string(qids, '|') as qids from facets where"""
TOKENS = f"""raw as (
  select doc_id, unnest({toks('text')}) as original, unnest(regexp_split_to_array(text, '{R}')[1:len({toks('text')})]) as sep, unnest(range(len({toks('text')}))) as i from docs),
ended as (select doc_id, i, original, sum(length(sep) + length(original)) over (partition by doc_id order by i) as e, trim({fold('original')}, '''-') as form from raw),
tokens as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as pos, form, original, (e - length(original))::bigint as s, e::bigint as e from ended where form <> '')"""
DOCS = "docs as (select doc_id, text from documents)"
TURNS = "docs as (select conv_id * 100000 + turn as doc_id, text from conversations)"
PATTERNS = f"""surface as (select unnest(list_distinct(list_concat(names, aliases))) as name, schemata, key from clusters),
phrases as (select {forms('name')} as f, schemata, key, name from surface),
patterns as (
  select pattern, len(string_split(pattern, ' ')) as n_tokens, array_to_string(string_split(pattern, ' ')[1:2], ' ') as first_bigram, {common('all_s')} as schema
  from (select array_to_string(f, ' ') as pattern, flatten(list(schemata)) as all_s from phrases where len(f) >= 2 and length(array_to_string(f, ' ')) >= 8 group by 1))"""
CANDIDATES = """bigrams as (select doc_id, pos, form || ' ' || lead(form) over (partition by doc_id order by pos) as bigram from tokens),
candidates as (select b.doc_id, b.pos, p.pattern, p.n_tokens as n, p.schema from bigrams b join patterns p on p.first_bigram = b.bigram)"""
CHOSEN = """verified as (
  select c.doc_id, c.pos, c.n, c.pattern, c.schema from candidates c join tokens t on t.doc_id = c.doc_id and t.pos between c.pos and c.pos + c.n - 1
  group by all having string_agg(t.form, ' ' order by t.pos) = c.pattern),
longest as (select doc_id, pos, max(n) as n, arg_max(schema, n) as schema from verified group by doc_id, pos),
after as (select a.doc_id, a.pos, min(b.pos) as next_pos from longest a left join longest b on a.doc_id = b.doc_id and b.pos > a.pos + a.n group by a.doc_id, a.pos),
chosen as (
  select doc_id, min(pos) as pos from longest group by doc_id
  union all select c.doc_id, a.next_pos from chosen c join after a on a.doc_id = c.doc_id and a.pos = c.pos where a.next_pos is not null),
mentions as (
  select l.doc_id, string_agg(t.original, ' ' order by t.pos) as text, min(t.s) as start, max(t.e) as "end", l.schema
  from chosen c join longest l on l.doc_id = c.doc_id and l.pos = c.pos join tokens t on t.doc_id = l.doc_id and t.pos between l.pos and l.pos + l.n - 1
  group by l.doc_id, l.pos, l.schema)"""


def extraction(docs: str = DOCS) -> str:
    return f"with recursive {BENCH}, {docs}, {TOKENS}, {PATTERNS}, {CANDIDATES}, {CHOSEN}"


POSTINGS = f"""posting as (select distinct key, unnest(f) as token from (select key, {forms('name')} as f from (select key, unnest(list_concat(names, aliases)) as name from clusters))),
postings as (select key, token from posting where length(token) >= 2)"""
BLOCKED = """sizes as (select key, count(*) as len from postings group by key),
totals as (select count(*) as n_all, avg(len) as avg_len from sizes),
df as (select token, count(*) as df from postings group by token),
doc_tokens as (select distinct doc_id, form as token from tokens where length(form) >= 2),
blocked as (
  select doc_id, p.key, count(*) as n_shared, round(sum(ln(1 + (n_all - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) as score
  from doc_tokens d join postings p on p.token = d.token join df on df.token = p.token join sizes s on s.key = p.key, totals group by doc_id, p.key having count(*) >= 2),
ranked as (select *, row_number() over (partition by doc_id order by score desc, key) as rank from blocked)"""
BLOCK = f"with {BENCH}, {DOCS}, {TOKENS}, {POSTINGS}, {BLOCKED}"


def percolation(slop: int) -> str:
    """The gazetteer's names have two or three tokens."""
    return f"""with {BENCH}, {DOCS}, {TOKENS}, {POSTINGS}, {BLOCKED},
named as (select key, {common('schemata')} as schema, is_alias, name, {forms('name')} as f from (
  select key, schemata, 0 as is_alias, unnest(names) as name from clusters union all select key, schemata, 1, unnest(aliases) from clusters)),
one as (
  select r.doc_id, r.rank, n.is_alias, n.name, n.schema, len(n.f) as n, n.f[2] as f2, n.f[3] as f3, t.pos as p1
  from ranked r join (select *, f[1] as f1 from named where len(f) between 2 and 3) n on n.key = r.key join tokens t on t.doc_id = r.doc_id and t.form = n.f1 where r.rank <= 10000),
two as (
  select o.doc_id, o.rank, is_alias, name, schema, n, f3, p1, min(t.pos) as p2 from (select *, p1 + unnest(range(1, n + {slop})) as at from one) o
  join tokens t on t.doc_id = o.doc_id and t.pos = o.at where t.form = o.f2 group by all),
three as (
  select w.doc_id, w.rank, is_alias, name, schema, p1, min(t.pos) as last from (select *, p1 + unnest(range(2, 3 + {slop})) as at from two where n = 3) w
  join tokens t on t.doc_id = w.doc_id and t.pos = w.at where t.form = w.f3 and t.pos > w.p2 group by all),
hits as (select doc_id, rank, is_alias, name, schema, p1, p2 as last from two where n = 2 union all select * from three),
firsts as (select doc_id, p1, last, arg_min(schema, (rank, is_alias, name)) as schema from hits group by doc_id, p1, last),
mentions as (
  select f.doc_id, string_agg(t.original, ' ' order by t.pos) as text, min(t.s) as start, max(t.e) as "end", f.schema
  from firsts f join tokens t on t.doc_id = f.doc_id and t.pos between f.p1 and f.last group by f.doc_id, f.p1, f.last, f.schema)"""


_FOUND_TEXTS = f"{extraction()}, found as (select distinct lower(text) as text from mentions)"
_BOTH = f"with e as ({_FOUND_TEXTS} select text from found), p as ({percolation(0)} select distinct lower(text) as text from mentions)"
LOOKUP = f"""with {PARTS},
typos as (select distinct substr(p_name, 1, (p_partkey % length(p_name))::int) || substr(p_name, (p_partkey % length(p_name))::int + 2) as query from part),
cleaned as (select query, clean_q from (select query, {key('query')} as clean_q from typos) where length(clean_q) >= 4),
near as (
  select clean_q, key, 3.0::double * (damerau_levenshtein(clean_q, key) <= 2)::int + 2.0::double * (len(list_filter(names, lambda n: damerau_levenshtein(clean_q, n) <= 2)) > 0)::int
         + 1.0::double * (len(list_filter(aliases, lambda n: damerau_levenshtein(clean_q, n) <= 2)) > 0)::int as score
  from (select distinct clean_q from cleaned) q, clusters),
scored as (select query, c.clean_q, n.key, n.score from cleaned c join near n on n.clean_q = c.clean_q)"""


def first_hit(having: str, threshold: float, keep: str = "") -> str:
    return f"""{LOOKUP}, best as (
  select query, clean_q, key, score, row_number() over (partition by query order by score desc, key) as rank from scored where {having}),
good as (select query, key, jaro_similarity(clean_q, key) as score, rank from best where rank <= 10 and jaro_similarity(clean_q, key) > {threshold}),
hits as (select query, arg_min(key, rank) as key, round(arg_min(score, rank), 6) as score from good group by query)
select query, h.key, score{keep} from hits h join clusters c on c.key = h.key"""


def skeleton(x: str) -> str:
    return f"substr({x}, 1, 1) || regexp_replace(substr({x}, 2), '[aeiou]', '', 'g')"


CODES = f"""{LOOKUP}, coded as (select distinct key, {skeleton('p')} as code from (select key, unnest({parts('name')}) as p from (select key, unnest(list_concat(names, aliases)) as name from clusters)) where {skeleton('p')} <> ''),
lengths as (select key, count(*) as len from coded group by key),
sums as (select count(*) as n_all, avg(len) as avg_len from lengths),
dfs as (select code, count(*) as df from coded group by code),
asked as (select distinct query, {skeleton('p')} as code from (select query, unnest({parts('query')}) as p from cleaned)),
heard as (
  select query, c.key, round(0.5 * sum(ln(1 + (n_all - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) as score
  from asked a join coded c on c.code = a.code join dfs d on d.code = c.code join lengths l on l.key = c.key, sums group by query, c.key)"""


def joined(c: str) -> str:
    return f"array_to_string({c}, '|') as {c}"


SQL: dict[str, str] = {
    "scan_names_filter": f"with {PART_ENTITIES} select id, schema, name from ents where {ALLOWED}",
    "entity_unpack": f"with {facts(BENCH_ENTITIES)} select key, schema, name as names, coalesce(alias, '') as aliases, country as countries from unpacked",
    "fold_text": f"select doc_id, md5({fold('text')}) as folded_md5 from documents",
    "tokenize_offsets": f'with {DOCS}, {TOKENS} select doc_id, original, form, s as start, e as "end" from tokens',
    "token_forms": f"select conv_id, turn, len({forms('text')}) as n_forms, md5({phrase('text')}) as phrase_md5 from conversations",
    "name_keys": f"select name, {key('name')} as key from (select c_name as name from customer union all select s_name from supplier)",
    "name_key_cluster": f"with {PARTS} select key, {joined('names')}, {joined('aliases')}, {joined('countries')}, {joined('schemata')} from clusters",
    "fact_dedup": f"with {facts(PART_ENTITIES)} select * from facts",
    "cluster_count": f"with {facts(PART_ENTITIES)} select count(distinct key) as n_clusters from facts",
    "cluster_point_get": f"with {PARTS} select key, {joined('names')}, {joined('schemata')} from clusters where key = 'red ring'",
    "cluster_features_tokens": f"with {PARTS}, {POSTINGS} select key, string_agg(token, '|' order by token) as tokens from postings group by key",
    "names_union": f"with {PARTS} select distinct key, unnest(list_concat(names, aliases)) as name from clusters",
    "accumulate_loads": f"with a as (with {facts(PART_ENTITIES)} select * from facts), b as (with {facts(BENCH_ENTITIES)} select * from facts) select * from a union select * from b",
    "common_schemata": f"with {PARTS} select key, {common('schemata')} as schema from clusters",
    "pattern_table": f"with {BENCH}, {PATTERNS} select pattern, n_tokens, schema from patterns",
    "extract_candidates": f"with {BENCH}, {DOCS}, {TOKENS}, {PATTERNS}, {CANDIDATES} select doc_id, pos, pattern from candidates",
    "extract_mentions": f"{extraction()} select * from mentions",
    "extract_turns": f"{extraction(TURNS)} select * from mentions",
    "span_surface_vs_slice": f'{extraction()} select m.doc_id, m.start, m.text, substr(d.text, m.start + 1, m."end" - m.start) as slice from mentions m join docs d on d.doc_id = m.doc_id',
    "percolate_block_msm": f"{BLOCK} select doc_id, key, n_shared, score from blocked",
    "percolate_bm25_topk": f"{BLOCK} select doc_id, key, rank from ranked where rank <= 5",
    **{f"percolate_slop{s}": f"{percolation(s)} select * from mentions" for s in (0, 1, 2)},
    "extract_intersect_percolate": f"{_BOTH} select text from e intersect select text from p",
    "extract_minus_percolate": f"{_BOTH} select text from e except select text from p",
    "percolate_minus_extract": f"{_BOTH} select text from p except select text from e",
    "mention_stats": f"{extraction()} select count(*) as n_mentions, count(distinct lower(text)) as n_texts, count(distinct doc_id) as n_docs from mentions",
    "facet_filter_symbols": f"{FACETS} list_has_any(symbols, ['ORG_CLASS:ltd', 'SYMBOL:bank'])",
    "facet_filter_qid": f"{FACETS} list_contains(qids, '{QIDS['jane']}')",
    "scan_ndjson": f"with {PART_ENTITIES} select id, schema, name from ents where {ALLOWED}",
    "scan_name_lines": "select 'name-' || md5(trim(p_name)) as id, 'Company' as schema, trim(p_name) as name from part where trim(p_name) <> ''",
    "caption_pick": f"""with {BENCH}, distances as (
  select key, a, sum(levenshtein(a, b)) as d from (select key, unnest(names) as a, names from clusters), unnest(names) as u(b) group by key, a)
select key, arg_min(a, (d, a)) as caption from distances group by key""",
    "lookup_exact": first_hit("score > 0", 0.97).replace(LOOKUP, LOOKUP.replace("substr(p_name, 1, (p_partkey % length(p_name))::int) || substr(p_name, (p_partkey % length(p_name))::int + 2)", "upper(p_name)")),
    "lookup_fuzzy_key": f"{LOOKUP} select clean_q, key, score from near where score > 0",
    "lookup_topk": f"{LOOKUP} select query, key, score, rank from (select *, row_number() over (partition by query order by score desc, key) as rank from scored where score > 0) where rank <= 10",
    "lookup_codes": f"{CODES} select query, key, score from heard",
    "lookup_codes_topk": f"""{CODES}, together as (select query, key, round(sum(score), 6) as score from (select query, key, score from scored where score > 0 union all select query, key, score from heard) group by query, key)
select query, key, score, rank from (select *, row_number() over (partition by query order by score desc, key) as rank from together) where rank <= 10""",
    "lookup_jaro_first_hit": first_hit("score > 0", 0.9, f", {common('c.schemata')} as common_schema"),
    "lookup_schema_filter": first_hit("key in (select key from clusters where list_contains(schemata, 'PublicBody'))", 0.9),
}
