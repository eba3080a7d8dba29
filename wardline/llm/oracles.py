"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# A line without white space at its ends, A-Z lower-cased.
_LINE_KEY = (
    "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

ORACLES["op7_line_dedup"] = f"""
with lines as (
  select doc_id, unnest(range(len(parts))) as pos, unnest(parts) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)
), keyed as (
  select *, {_LINE_KEY} as key from lines
), shared as (
  select key, min(doc_id) as owner from keyed where length(key) >= 10
  group by key having count(distinct doc_id) > 1
), marked as (
  select k.doc_id, k.pos, k.line, s.key is not null and s.owner <> k.doc_id as gone
  from keyed k left join shared s on k.key = s.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

# Words of letters and digits, A-Z lower-cased, as a list.
FOLDED_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

ORACLES["op5_decontamination"] = f"""
with items as (
  select item_id, {FOLDED_WORDS} as w from benchmark
), windows as (
  select item_id, least(10, len(w)) as n,
    unnest([array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ')
      for s in range(1, len(w) - least(10, len(w)) + 2)]) as words
  from items where len(w) > 0
), docs as (
  select doc_id, {FOLDED_WORDS} as w from documents
), sizes as (
  select distinct n from windows
), runs as (
  select doc_id, n, unnest(range(1, len(w) - n + 2)) as s,
    unnest([array_to_string(list_slice(w, s, s + n - 1), ' ') for s in range(1, len(w) - n + 2)]) as words
  from docs, sizes where len(w) >= n
), hits as (
  select r.doc_id, r.n, r.s, w.item_id from runs r join windows w on r.words = w.words and r.n = w.n
), places as (
  select distinct doc_id, unnest(range(s, s + n)) as p from hits
), per_doc as (
  select doc_id, count(*) as n_hit from places group by doc_id
), found as (
  select doc_id, count(distinct item_id) as n_items,
    string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
  from hits group by doc_id
)
select d.doc_id, len(d.w) as n_words, coalesce(p.n_hit, 0) as n_hit, coalesce(f.n_items, 0) as n_items,
  sha256(coalesce(f.ids, '')) as items_sha256, coalesce(p.n_hit, 0) > 0 as contaminated
from docs d left join per_doc p on d.doc_id = p.doc_id left join found f on d.doc_id = f.doc_id
"""

# Words between white space, as a list.
PLAIN_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLES["op8_substring_dedup"] = f"""
with docs as (
  select doc_id, {PLAIN_WORDS} as w from documents
), words as (
  select doc_id, unnest(range(len(w))) as i, unnest(w) as word from docs
), windows as (
  select doc_id, unnest(range(len(w) - 19)) as s,
    unnest([array_to_string(list_slice(w, s, s + 19), ' ') for s in range(1, len(w) - 18)]) as words
  from docs where len(w) >= 20
), repeated as (
  select doc_id, s from (
    select doc_id, s, row_number() over (partition by words order by doc_id, s) as r from windows
  ) where r > 1
), gone as (
  select distinct doc_id, unnest(range(s, s + 20)) as i from repeated
), kept as (
  select words.doc_id, count(*) filter (gone.i is not null) as n_removed,
    string_agg(words.word, ' ' order by words.i) filter (gone.i is null) as text
  from words left join gone on words.doc_id = gone.doc_id and words.i = gone.i group by words.doc_id
)
select d.doc_id, len(d.w) as n_words, coalesce(k.n_removed, 0) as n_removed,
  sha256(coalesce(k.text, '')) as kept_sha256
from docs d left join kept k on d.doc_id = k.doc_id
"""

# CRC-32 of UTF-8 bytes, byte by byte with the table of its polynomial.
_CRC = """
crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1
      then xor(c >> 1, 3988292384) else c >> 1 end, i) as c
    from (select unnest(range(256))::bigint as i)
  )
)"""


def _crc32(column: str, table: str = "t") -> str:
    parts = f"hex(encode({column}))"
    codes = (
        f"[('0x' || substr({parts}, 2 * i + 1, 2))::bigint "
        f"for i in range(length({parts}) // 2)]"
    )
    step = f"xor(c >> 8, {table}[1 + (xor(c, b) & 255)])"
    return f"xor(list_reduce({codes}, lambda c, b: {step}, 4294967295::bigint), 4294967295::bigint)"


def _cell(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 4))::bigint"


_RING_ORDER = "cell, text_crc32 % 4096, doc_id nulls first, text_crc32, size"

# The same ring and queue as one sequence: rows numbered along the ring, places opened along the ring.
ORACLES["op1_sharding"] = f"""
with {_CRC.strip()},
docs as (
  select doc_id, strlen(coalesce(text, '')) + 16 as size,
    {_crc32("coalesce(text, '')")} as text_crc32,
    {_cell("coalesce(cast(doc_id as varchar), '')")} as cell
  from documents, crc_table
), points as (
  select cell, shard, min(hash) as hash from (
    select s as shard, {_cell("'shard ' || s || ' node ' || v")} as cell,
      md5('shard ' || s || ' node ' || v) as hash
    from range(40) a(s), range(256) b(v)
  ) group by cell, shard
), owners as (
  select cell, arg_min(shard, hash) as shard from points group by cell
), owned as (
  select d.*, coalesce(p.shard, (select arg_min(shard, cell) from owners)) as owner
  from docs d asof left join owners p on d.cell <= p.cell
), numbered as (
  select *, row_number() over (partition by owner order by {_RING_ORDER}) - 1 as r from owned
), limits as (
  select s as shard, n // 40 + (case when s < n % 40 then 1 else 0 end) as capacity,
    (select count(*) from owned where owner = s) as own
  from range(40) a(s), (select count(*) as n from docs)
), placed as (
  select n.*, l.capacity, n.r < l.capacity as stays from numbered n join limits l on n.owner = l.shard
), dealt as (
  select cell, shard, least(own, capacity) as kept,
    free // nodes + (case when rank < free % nodes then 1 else 0 end) as places
  from (
    select p.cell, p.shard, l.own, l.capacity, l.capacity - least(l.capacity, l.own) as free,
      row_number() over (partition by p.shard order by p.cell) - 1 as rank,
      count(*) over (partition by p.shard) as nodes
    from points p join limits l on p.shard = l.shard
  )
), balance as (
  select c.cell, sum(coalesce(m.go, 0) - coalesce(d.places, 0)) over (order by c.cell) as waiting
  from (select unnest(range(65536)) as cell) c
  left join (select cell, count(*) as go from placed where not stays group by cell) m on c.cell = m.cell
  left join (select cell, sum(places) as places from dealt group by cell) d on c.cell = d.cell
), start as (
  select cell + 1 as origin from balance order by waiting, cell limit 1
), queue as (
  select p.*, row_number() over (
    order by (p.cell - s.origin + 65536) % 65536, text_crc32 % 4096, doc_id nulls first, text_crc32, size
  ) - 1 as q
  from placed p, start s where not stays
), opened as (
  select shard, cell, kept, rank,
    row_number() over (order by (cell - origin + 65536) % 65536, shard, rank) - 1 as q
  from (select shard, cell, kept, s.origin, unnest(range(places)) as rank from dealt, start s)
), moved as (
  select q.doc_id, q.size, q.text_crc32, o.shard,
    o.kept + row_number() over (partition by o.shard order by o.cell, o.rank) - 1 as slot
  from queue q join opened o on q.q = o.q
)
select doc_id, size, text_crc32, 'rows' as law, cast(shard as integer) as shard, slot,
  cast(null as integer) as grown_shard
from (
  select doc_id, size, text_crc32, owner as shard, r as slot from placed where stays
  union all select doc_id, size, text_crc32, shard, slot from moved
)
"""


def _license_sql() -> str:
    from wardline.llm.licenses import PHRASES, TEMPLATES, block_of

    phrases = ", ".join(f"('{label}', string_split('{p}', ' '))" for label, p in PHRASES.items())
    notices = ", ".join(
        f"({i}, '{label}', list_distinct(string_split('{t}', ' ')), string_split('{must}', ' '), {block_of(t)})"
        for i, (label, t, must) in enumerate(TEMPLATES)
    )
    return f"""
with docs as (
  select doc_id, {FOLDED_WORDS} as w from documents
), phrases(label, p) as (values {phrases}
), templates(id, label, t, must, size) as (values {notices}
), places as (
  select doc_id, label, unnest([s for s in range(len(w) - len(p) + 1)
    if list_slice(w, s + 1, s + len(p)) = p]) as s
  from docs, phrases where list_contains(w, p[1])
), base as (
  select doc_id, count(*) as n_base, min(s) as first_word, max(s) as last_word,
    list(distinct label) as found from places group by doc_id
), sizes as (
  select distinct size from templates
), blocks as (
  select doc_id, size, unnest([list_slice(w, s + 1, s + size) for s in range(0, len(w), size // 2)]) as b
  from docs, sizes
), shares as (
  select doc_id, label, len(list_intersect(t, b)) / len(t)::double as share,
    len(list_intersect(t, b)) as n, len(t) as m
  from blocks join templates on blocks.size = templates.size where list_has_all(b, must)
), contained as (
  select doc_id, list(distinct label) as found, max(share) as best
  from shares where 10 * n >= 8 * m group by doc_id
)
select d.doc_id, len(d.w) as n_words, coalesce(b.n_base, 0) as n_base, b.first_word, b.last_word,
  array_to_string(list_sort(coalesce(b.found, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.found, []), coalesce(c.found, [])))), ',')
    as labels,
  case when b.n_base > 0 then 1.0::double else coalesce(c.best, 0.0::double) end as score
from docs d left join base b on d.doc_id = b.doc_id left join contained c on d.doc_id = c.doc_id
"""


ORACLES["op3_license_scan"] = _license_sql()


def _rules_sql(alpha: float = 0.05, delta: float = 0.05) -> str:
    from wardline.llm.rules import PRICE, RULES

    part = alpha / len(RULES)
    values = "\nunion all ".join(
        f"select *, '{r}' as rule, case when {under} > 0 then 1000 * {over} // {under} else 0 end as value "
        "from figures"
        for r, (over, under, _) in RULES.items()
    )
    cuts = ", ".join(f"('{r}', {c})" for r, (_, _, cs) in RULES.items() for c in cs)
    return f"""
with docs as (
  select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as body, {PLAIN_WORDS} as w
  from documents
), words as (
  select doc_id, unnest(range(len(w) - 4)) as s,
    unnest([array_to_string(list_slice(w, s, s + 4), ' ') for s in range(1, len(w) - 3)]) as run
  from docs where len(w) >= 5
), repeated as (
  select doc_id, s from (
    select doc_id, s, count(*) over (partition by doc_id, run) as n from words
  ) where n > 1
), covered as (
  select doc_id, count(distinct i) as n from (
    select doc_id, unnest(range(s, s + 5)) as i from repeated
  ) group by doc_id
), lines as (
  select doc_id, body,
    [l for l in string_split(body, chr(10)) if regexp_matches(l, '[^\\x20\\x09-\\x0D]')] as ls
  from docs
), figures as (
  select d.doc_id, d.stratum, len(d.w) as n_words,
    length(regexp_replace(d.body, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
    len(regexp_extract_all(d.body, '[#*$%&|<>]')) as n_symbols,
    len(l.ls) - len(list_distinct(l.ls)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
    len(regexp_extract_all(d.body, '[A-Z]')) as n_capitals, len(l.ls) as n_lines,
    len(d.w) < 10 or 100 * coalesce(c.n, 0) > 20 * len(d.w) as base_failed
  from docs d join lines l on d.doc_id = l.doc_id left join covered c on d.doc_id = c.doc_id
), long as (
  {values}
), cuts(rule, cutoff) as (values {cuts}
), marks as (
  select doc_id, min(quality) as good from labels
  where quality is not null and doc_id is not null group by doc_id
), tests as (
  select l.stratum, l.rule, c.cutoff, count(*) filter (m.good = 1) as n,
    count(*) filter (m.good = 1 and l.value > c.cutoff) as k,
    count(*) filter (m.good <> 1 and l.value > c.cutoff) as bad
  from long l join marks m on l.doc_id = m.doc_id join cuts c on l.rule = c.rule
  where not l.base_failed group by l.stratum, l.rule, c.cutoff
), judged as (
  select *, {delta} / count(*) over () as level,
    case when k >= n * {part} then 1.0 else
      list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({part})
        + (n - i) * ln(1 - {part})) for i in range(k + 1)]) end as chance
  from tests
), best as (
  select stratum, rule, max((bad - {PRICE} * k, cutoff)) as b from judged
  where chance <= level and bad > {PRICE} * k group by stratum, rule
), rejected as (
  select distinct l.doc_id from long l join best b on l.stratum = b.stratum and l.rule = b.rule
  where l.value > b.b[2]
)
select f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
  not f.base_failed and r.doc_id is null as kept
from figures f left join rejected r on f.doc_id = r.doc_id
"""


ORACLES["op4_quality_rules"] = _rules_sql()

ORACLES["op12_hard_negatives"] = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * cast(x as double)) for x in embedding] as v
  from embeddings where label is not null and embedding is not null
    and coalesce(list_bool_and([x is not null and isfinite(x) for x in embedding]), true)
), scores as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
    cast(list_inner_product(a.v, b.v) as bigint) as score
  from rows a join rows b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
  cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as integer) as rank
from positives p join scores s on s.anchor_id = p.anchor_id and not s.same
where 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify rank <= 3
"""
