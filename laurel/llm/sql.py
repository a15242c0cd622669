"""DuckDB SQL for the queries that SQL can express, written from their contracts."""

from __future__ import annotations

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def _level(k: int) -> str:
    """One level of the path tree, from the nodes t{k} to t{k + 1}; e{k} are the pages that end."""
    return f"""
c{k} as (select *, shape[{k + 1}] child from t{k}),
e{k} as (select host, shape, template, purity, evidence from c{k} where child is null),
w{k} as (
  select host, template, any_value(purity) above, sum(pages) all_pages, sum(labelled) all_labelled,
    sum(blocked) all_blocked, count(distinct child) many, sum(pages) filter (where child is not null) below
  from c{k} group by all),
g{k} as (
  select host, template, child, sum(pages) pages, sum(labelled) labelled, sum(blocked) blocked
  from c{k} where child is not null group by all),
z{k} as (
  select *, case when all_pages < 5 then '/**' when many >= 8 and many >= 0.5 * below then '/*'
      when labelled >= 5 and all_labelled - labelled >= 5 and
        power(blocked / nullif(labelled, 0) - (all_blocked - blocked) / nullif(all_labelled - labelled, 0), 2) <=
        power(1.96, 2) * (all_blocked / nullif(all_labelled, 0)) * (1 - all_blocked / nullif(all_labelled, 0))
        * (1 / nullif(labelled, 0) + 1 / nullif(all_labelled - labelled, 0)) then '/~'
      else '/' || child end branch
  from g{k} join w{k} using (host, template)),
p{k} as (
  select host, template, branch, (sum(blocked) + 4 * any_value(above)) / (sum(labelled) + 4) purity, sum(labelled) evidence
  from z{k} group by host, template, branch),
m{k} as (
  select c.host, c.shape, c.pages, c.labelled, c.blocked, c.template || branch template, p.purity, p.evidence,
    branch = '/**' closed
  from c{k} c join z{k} z using (host, template, child) join p{k} p using (host, template, branch)),
x{k} as (select host, shape, template, purity, evidence from m{k} where closed),
t{k + 1} as (select * exclude (closed) from m{k} where not closed),"""


URL_FILTER = rf"""
with parts as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '{_URL}', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(coalesce(url, ''), '{_URL}', 2) path
  from pages),
ruled as (
  select *, case
    when starts_with(path, '/en/') and (host = 'example.net' or ends_with(host, '.example.net')) then 'example.net/en/'
    when starts_with(path, '/de/') and (host = 'example.com' or ends_with(host, '.example.com')) then 'example.com/de/'
    when starts_with(path, '/fr/') and (host = 'org' or ends_with(host, '.org')) then 'org/fr/'
    when starts_with(path, '/') and (host = 'net' or ends_with(host, '.net')) then 'net/' end rule,
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
      lambda s: case when regexp_full_match(s, '[0-9]+([.][a-z]+)?|[0-9a-f-]{{8,}}') then '*' else s end) shape
  from parts),
own as (
  select *, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' end ruling
  from ruled),
counted as (
  select host, shape, count(*) pages, count(rule) labelled, count(*) filter (where ruling = 'block') blocked
  from own group by host, shape),
overall as (select (sum(blocked) + 1) / (sum(labelled) + 2) share from counted),
t0 as (
  select *, '' template, (sum(blocked) over site + 4 * share) / (sum(labelled) over site + 4) purity,
    sum(labelled) over site evidence
  from counted, overall window site as (partition by host)),
{_level(0)}{_level(1)}{_level(2)}
tree as (
  select * from e0 union all select * from x0 union all select * from e1 union all select * from x1
  union all select * from e2 union all select * from x2
  union all select host, shape, template, purity, evidence from t3)
select page_id, own.host, path, rule, template, purity,
  coalesce(ruling, case when evidence >= 5 and purity >= 0.8 then 'block' else 'allow' end) verdict
from own join tree on own.host = tree.host and own.shape = tree.shape
"""

EMBEDDINGS = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) x from embeddings),
good as (
  select vec_id, x, sqrt(list_dot_product(x, x)) size from v
  where x is not null and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0
    and len(list_filter(x, lambda c: c <> 0)) > 0),
links as (
  select a.vec_id u, b.vec_id v from good a join good b on a.vec_id <> b.vec_id
  where list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.95),
reach as (
  select vec_id a, vec_id b from embeddings
  union select reach.a, links.v from reach join links on reach.b = links.u),
least as (select a, min(b) component_id from reach group by a),
amount as (select u, count(*) n from links group by u)
select vec_id, coalesce(n, 0)::bigint n_links, component_id, vec_id = component_id kept
from embeddings join least on vec_id = a left join amount on vec_id = u
"""

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) z from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
scored as (
  select q.vec_id query_id, c.vec_id, list_dot_product(q.z, c.z)::bigint score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

_TAGS = "p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|td|th|table|article|section|header|footer|nav|title"


def _decoded(text: str) -> str:
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
                              ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{character}')"
    return text


def _gone(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, '{pattern}', {by}, 'g')"


_REST = """[^>"'']*(?:(?:"[^"]*"|''[^'']*'')[^>"'']*)*>"""


def _plain(html: str) -> str:
    html = _gone(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "' '")
    html = _gone(html, rf"(?i)</?(?:{_TAGS})(?:>|[\s/]{_REST})", "chr(10)")
    html = _gone(_decoded(_gone(html, f"<[/!?A-Za-z]{_REST}", "''")), r"[ \t\r\x0B\f]+", "' '")
    return f"trim({_gone(html, ' ?\\n[\\n ]*', 'chr(10)')}, ' ' || chr(10))"


def _urn(text: str) -> str:
    code = f"md5({text})"
    return "'urn:uuid:' || " + " || '-' || ".join(
        f"substr({code}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


_CRLF = "chr(13) || chr(10)"

WARC = rf"""
with pages2 as (
  select page_id id, regexp_replace(url, '[\x00-\x1F\x7F]', '', 'g') target_uri, coalesce(html, '') html,
    {_urn("coalesce(page_id::varchar, '') || chr(10) || coalesce(url, '') || chr(10) || coalesce(html, '')")} refers_to
  from pages),
told as (
  select *, 'sha256:' || sha256(html) source_digest, {_plain("html")} plain,
    trim({_gone(_decoded(r"regexp_extract(html, '(?is)<title\b[^>]*>([^<]*)</title', 1)"), r"\s+", "' '")}) title,
    regexp_extract(html, '(?i)<html\b[^>]*\blang="([A-Za-z-]*)"', 1) lang,
    list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1),
      lambda x: 'outlink: ' || regexp_replace({_decoded("x")}, '[\x00-\x1F\x7F]', '', 'g') || {_CRLF}) links
  from pages2),
made as (
  select id, refers_to, target_uri, source_digest, 'conversion' record_type, 'text/plain' media, plain content from told
  union all
  select id, refers_to, target_uri, source_digest, 'metadata', 'application/warc-fields',
    'source-content-type: text/html' || {_CRLF} || 'source-payload-digest: ' || source_digest || {_CRLF}
    || 'source-length: ' || octet_length(encode(html)) || {_CRLF} || 'title: ' || title || {_CRLF}
    || 'language: ' || lang || {_CRLF} || coalesce(array_to_string(links, ''), '')
  from told),
named as (
  select *, {_urn("refers_to || chr(10) || record_type")} record_id, 'sha256:' || sha256(content) block_digest,
    octet_length(encode(content))::bigint content_length
  from made)
select id page_id, record_type, record_id, refers_to, target_uri, '1970-01-01T00:00:00Z' date, source_digest,
  block_digest, content_length, content,
  'WARC/1.1' || {_CRLF} || 'WARC-Type: ' || record_type || {_CRLF} || 'WARC-Record-ID: <' || record_id || '>' || {_CRLF}
  || 'WARC-Refers-To: <' || refers_to || '>' || {_CRLF}
  || coalesce('WARC-Target-URI: ' || target_uri || {_CRLF}, '') || 'WARC-Date: 1970-01-01T00:00:00Z' || {_CRLF}
  || 'Source-Content-Type: text/html' || {_CRLF} || 'Source-Payload-Digest: ' || source_digest || {_CRLF}
  || 'WARC-Block-Digest: ' || block_digest || {_CRLF} || 'Content-Type: ' || media || {_CRLF}
  || 'Content-Length: ' || content_length || {_CRLF} headers
from named
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# (measure, part, whole, least distance of the quartiles, whether there is a lower bound)
_RULES = [("word_length", "word_chars", "n_words", 200, True), ("symbols", "n_symbols", "n_words", 20, False),
          ("repeated_lines", "n_dup_lines", "n_lines", 50, False),
          ("repeated_words", "n_repeat_words", "n_words", 50, False)]


def _quality() -> str:
    values = " union all ".join(
        f"select lang, source, '{name}' measure, {part} * 1000 // nullif({whole}, 0) v, {least} least from passed"
        for name, part, whole, least, _ in _RULES)
    outside = " union all ".join(
        f"""select doc_id, {k} place, '{name}' broken from passed p join chosen c
            on p.lang is not distinct from c.lang and p.source is not distinct from c.source and c.measure = '{name}'
            where {part} * 1000 // nullif({whole}, 0) > high
            {f"or {part} * 1000 // nullif({whole}, 0) < low" if both else ""}"""
        for k, (name, part, whole, _, both) in enumerate(_RULES))
    # A bucket keeps the seven leading bits. The levels are a language and source, a language, all.
    return rf"""
with told as (
  select doc_id, lang, source, coalesce(text, '') text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) lines
  from documents),
windows as (
  select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) times
  from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) i from told) x),
again as (
  select doc_id, count(distinct place) n
  from (select doc_id, unnest([i, i + 1, i + 2]) place from windows where times > 1) x group by doc_id),
measured as (
  select doc_id, lang, source, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint n_symbols, len(lines)::bigint n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(again.n, 0)::bigint n_repeat_words
  from told left join again using (doc_id)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from measured),
passed as (select * from judged where not base_failed),
listed as (
  select *, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) bucket
  from ({values}) x where v is not null),
leveled as (
  select 0 level, lang, source, measure, least, bucket from listed
  union all select 1, lang, null, measure, least, bucket from listed
  union all select 2, null, null, measure, least, bucket from listed),
ranked as (
  select *, row_number() over (part order by bucket) place, count(*) over part size
  from leveled window part as (partition by level, lang, source, measure)),
quarters as (
  select level, lang, source, measure, any_value(least) least, any_value(size) size,
    min(bucket) filter (place * 4 >= size) q1, min(bucket) filter (place * 4 >= 3 * size) q3
  from ranked group by level, lang, source, measure),
sized as (select *, max(size) over (partition by level, lang, source) group_size from quarters),
fences as (select *, q1 - 8 * greatest(q3 - q1, least) low, q3 + 8 * greatest(q3 - q1, least) high from sized),
chosen as (
  select own.lang, own.source, own.measure,
    case when own.group_size >= 200 then own.low when mid.group_size >= 200 then mid.low else whole.low end low,
    case when own.group_size >= 200 then own.high when mid.group_size >= 200 then mid.high else whole.high end high
  from fences own
  join fences mid on mid.level = 1 and mid.lang is not distinct from own.lang and mid.measure = own.measure
  join fences whole on whole.level = 2 and whole.measure = own.measure
  where own.level = 0),
outside as (select doc_id, string_agg(broken, ',' order by place) broken from ({outside}) x group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and broken is null kept, coalesce(broken, '') broken
from judged left join outside using (doc_id)
"""


LEXICAL_SEARCH = rf"""
with words as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w
  from documents),
docs as (select doc_id, len(w) n, w from words where len(w) > 0),
total as (select count(*) documents, sum(n)::bigint occurrences from docs),
wanted as (
  select distinct item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")},
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term
  from benchmark),
held as (
  select doc_id, n, term, count(*) tf from (select doc_id, n, unnest(w) term from docs) x
  where term in (select term from wanted) group by all),
weights as (
  select term, floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1)))::bigint weight
  from held, total group by term, documents),
impacts as (
  select doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // occurrences))) impact
  from held join weights using (term), total),
scored as (
  select item_id, doc_id, sum(impact)::bigint score from wanted join impacts using (term)
  group by item_id, doc_id having sum(impact) > 0),
ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id)::int rank from scored)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""

COLLOCATIONS = rf"""
with texts as (
  select coalesce(lang, 'und') lang, {_LOWER.format("coalesce(text, '')")} t from documents),
words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') w
  from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) piece from texts) x),
grams as (
  select lang, 1 size, unnest(w) phrase from words
  union all
  select lang, 2, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) from words
  union all
  select lang, 3, unnest(list_transform(generate_series(1, len(w) - 2),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from words),
counts as (select lang, size, phrase, count(*) f from grams group by lang, size, phrase),
amount as (select lang, sum(f)::bigint n from counts where size = 1 group by lang),
candidates as (
  select lang, size, phrase, f a, string_split(phrase, ' ') w from counts where size > 1 and f >= 10),
cuts as (
  select lang, size, phrase, a, 1 k, w[1] first, array_to_string(w[2:], ' ') rest from candidates
  union all
  select lang, size, phrase, a, 2, w[1] || ' ' || w[2], w[3] from candidates where size = 3),
scored as (
  select c.*, l.f l, r.f r, (1000000::hugeint * a * a) // (l.f::hugeint * r.f) score
  from cuts c join counts l on c.lang = l.lang and c.first = l.phrase and l.size = k
  join counts r on c.lang = r.lang and c.rest = r.phrase and r.size = c.size - k),
weakest as (
  select * from scored
  qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (
  select lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) phrase, a from candidates where size = 3),
kept as (
  select * from weakest where not exists (
    select 1 from longer where longer.lang = weakest.lang and longer.phrase = weakest.phrase
    and 100 * longer.a >= 50 * weakest.a))
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) rank, phrase,
  a::bigint a, l::bigint l, r::bigint r, n, score::bigint score
from kept join amount using (lang) qualify rank <= 2000
"""

SQL = {
    "op1_url_filter": URL_FILTER,
    "op6_embedding_dedup": EMBEDDINGS,
    "op9_warc_derivatives": WARC,
    "op10_top_k": TOP_K,
    "op11_quality_rules": _quality(),
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_collocations": COLLOCATIONS,
}
