"""DuckDB statements for the queries that SQL can express."""

from redpen.llm.secret_scan import RULES

ORACLES: dict[str, str] = {}

ORACLES["op9_lines"] = """
with lines as (
  select doc_id, n, line, lower_az(line) as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n from documents)
), firsts as (
  select key, min(doc_id) as first, count(distinct doc_id) as holders from lines where length(key) >= 10 group by key
)
select l.doc_id, count(*) as n_lines, count(*) filter (where f.first < l.doc_id) as n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) order by l.n) filter (where f.first is null or f.first >= l.doc_id), '')) as kept_sha256
from lines l left join firsts f on l.key = f.key
group by l.doc_id
""".replace("lower_az(line)", "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


ORACLES["op2_warc"] = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest, coalesce(html, '') as payload from pages),
o as (select payload, max(page_id) as owner from p where payload_bytes >= 1000 group by payload)
select p.page_id, p.payload_bytes, p.payload_digest,
  case when o.owner > p.page_id then 'revisit' else 'response' end as record_type,
  case when o.owner > p.page_id then o.owner end as refers_to
from p left join o on p.payload = o.payload
"""

_LOWER = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex(%s, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES["op1_jaccard_join"] = f"""
with recursive words as (select doc_id, {_WORDS % (_LOWER % "coalesce(text, '')")} as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as shingle from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
links as (select a, b from common c join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c.n >= 85 * (x.n + y.n - c.n)),
steps as (select a, b from links union all select b, a from links),
reach as (select a, b from steps union select r.a, s.b from reach r join steps s on r.b = s.a)
select d.doc_id, coalesce(any_value(s.n), 0) as n_shingles, coalesce(least(d.doc_id, min(r.b)), d.doc_id) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join reach r on r.a = d.doc_id
group by d.doc_id
"""

ORACLES["op4_substring"] = f"""
with words as (select doc_id, {_WORDS % "coalesce(text, '')"} as w from documents),
windows as (select doc_id, p, array_to_string(w[p:p + 19], ' ') as said from (select doc_id, w, unnest(range(1, len(w) - 18)) as p from words)),
firsts as (select said, min(row(doc_id, p)) as first_place from windows group by said having count(*) > 1),
gone as (select distinct doc_id, unnest(range(p, p + 20)) as place from windows join firsts using (said) where row(doc_id, p) <> first_place),
placed as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as place from words),
kept as (
  select p.doc_id, count(g.place) as n_removed, string_agg(p.word, ' ' order by p.place) filter (g.place is null) as text
  from placed p left join gone g on g.doc_id = p.doc_id and g.place = p.place group by p.doc_id
)
select w.doc_id, len(w.w) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from words w left join kept k on k.doc_id = w.doc_id
"""


def _spans(rank: int, rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
    select doc_id, {rank} as rank, '{rule.kind}' as kind, stop - length(hits[i]) as start, stop from (
      select *, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(hits[1:i], lambda x: length(x))) as stop
      from (select *, unnest(range(1, len(hits) + 1)) as i
        from (select doc_id, string_split_regex(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}', 0) as hits, regexp_extract_all(text, '{pattern}', {rule.group}) as inside
          from documents where regexp_matches(text, '{pattern}'))))
    where length(inside[i]) >= {rule.least}"""


_BASE = [r.kind for r in RULES if r.base]
ORACLES["op5_secrets"] = f"""
with spans as ({" union all ".join(_spans(k, r) for k, r in enumerate(RULES))}),
labels as (select *, kind || ':' || start || ':' || stop as label from spans),
per_doc as (
  select doc_id, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in _BASE)},
    string_agg(label, ',' order by start, rank) filter (kind in ({", ".join(f"'{k}'" for k in _BASE)})) as base, string_agg(label, ',' order by start, rank) as spans
  from labels group by doc_id
)
select d.doc_id, {", ".join(f"coalesce(p.n_{k}, 0) as n_{k}" for k in _BASE)}, sha256(coalesce(p.base, '')) as base_sha256, coalesce(p.spans, '') as spans
from documents d left join per_doc p on p.doc_id = d.doc_id
"""


ORACLES["op13_divergence"] = """
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select r, lang, source, unnest(regexp_extract_all(lower_az(text), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term, count(*)::hugeint as n from w group by lang, term having count(distinct r) >= 10),
own as (select w.lang, w.source, w.term, count(*)::hugeint as n from w join kept k on w.lang = k.lang and w.term = k.term group by all),
langs as (select lang, sum(n)::hugeint as n, count(*)::hugeint as v from kept group by lang),
sizes as (select lang, source, sum(n)::hugeint as n from own group by all),
grp as (select g.lang, g.source, coalesce(s.n, 0) + 2 * l.v as m, l.n + 2 * l.v as lang_m
  from (select distinct lang, source from d) g join langs l on g.lang = l.lang left join sizes s on g.lang = s.lang and g.source = s.source),
p as (select g.lang, g.source, k.term, coalesce(o.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(o.n, 0) + 2)) // g.m as p, 1 + (1000000000::hugeint * (k.n + 2)) // g.lang_m as q
  from grp g join kept k on g.lang = k.lang left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
priced as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value
  from (select distinct lang, source from d) a join (select distinct lang, source from d) b on a.lang = b.lang and a.source <> b.source
  left join priced x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 10
""".replace("lower_az(text)", _LOWER % "text")

ORACLES["op12_minhash"] = f"select *, doc_id = component_id as kept from ({ORACLES['op1_jaccard_join'].replace('>= 85 *', '>= 80 *')})"
