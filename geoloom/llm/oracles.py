"""DuckDB texts for the operators that SQL can express."""

OP1 = r"""
with src as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
   union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 e as (select *, replace(replace(replace(replace(r, '\', '\\'), chr(10), '\n'), ':', '\c'), '###', '\h') er,
   regexp_replace(t, '(\\*)(###|</turn>)', '\\\1\2', 'g') et from src),
 c as (select conv_id, count(*) n_turns, string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, t) said,
   string_agg('### ' || er || ': ' || t || chr(10) || '</turn>' || chr(10), '' order by turn nulls first, r, t) plain,
   string_agg('### ' || er || ': ' || et || chr(10) || '</turn>' || chr(10), '' order by turn nulls first, r, t) safe,
   list(er order by turn nulls first, r, t) roles, list(t order by turn nulls first, r, t) texts,
   coalesce(string_agg(t, '' order by turn nulls first, r, t) filter (r = 'assistant'), '') loss from e group by conv_id),
 p as (select *, regexp_extract_all(plain, '(?s)### ([^\n]*?): (.*?)\n</turn>\n', 1) pr,
   list_transform(regexp_extract_all(plain, '(?s)### ([^\n]*?): (.*?)\n</turn>\n', 2), lambda x: regexp_replace(x, '\\(\\*)(###|</turn>)', '\1\2', 'g')) pt from c),
 f as (select *, not (pr = roles and pt = texts) escaped from p)
select conv_id, n_turns, sha256(said) turns_sha256, length(loss) loss_chars, sha256(loss) loss_sha256,
   length(case when escaped then safe else plain end) formatted_chars, escaped from f"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
with b as (select item_id, {_WORDS} w from benchmark where text is not null),
 bl as (select item_id, w, least(10, len(w)) n from b where len(w) > 0),
 bw as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') win from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) i from bl)),
 d as (select row_number() over () rid, doc_id, coalesce({_WORDS}, []) w from documents),
 dw as (select rid, n, i, array_to_string(w[i : i + n - 1], ' ') win from (select rid, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from bl) where len(w) >= n)),
 h as (select rid, i, dw.n, item_id from dw join bw on dw.n = bw.n and dw.win = bw.win),
 p as (select rid, count(distinct i + k) n_hit from (select distinct rid, i, n from h), range(10) r(k) where k < n group by rid),
 t as (select rid, count(*) n_items, string_agg(s, ',' order by s) ids from (select distinct rid, cast(item_id as varchar) s from h where item_id is not null) group by rid)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join p using (rid) left join t using (rid)"""


#: CRC32 of a list of bytes `b`: `tt` holds the table of the reflected polynomial (a fixed value).
_CRC_TABLE = """tb(i, v, k) as (select range, range, 0 from range(256) union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from tb where k < 8),
 tt as (select list(v order by i) tbl from tb where k = 8)"""
_CRC = "xor(list_reduce(list_prepend(cast(4294967295 as bigint), b), lambda c, x: xor(c >> 8, tbl[xor(c & 255, x) + 1])), 4294967295)"


def op3(seed: int, n_shards: int) -> str:
    return f"""
with recursive {_CRC_TABLE},
 d as (select doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: cast(('0x' || h) as bigint)) b from documents),
 c as (select doc_id, source, size, {_CRC} crc from d, tt),
 r as (select *, row_number() over (partition by source order by substr(md5(concat_ws('|', '{seed}', cast(doc_id as varchar), cast(crc as varchar), cast(size as varchar))), 1, 15), doc_id nulls first, crc, size) - 1 place, count(*) over (partition by source) n from c),
 p as (select *, row_number() over (order by (2 * place + 1) / cast(2 * n as double), source is null, coalesce(source, ''), place) - 1 pos, count(*) over () total from r),
 s as (select *, pos * {n_shards} // total shard from p)
select doc_id, cast(size as bigint) size, cast(crc as bigint) text_crc32, 'rows' law, cast(shard as int) shard, cast(pos - (shard * total + {n_shards - 1}) // {n_shards} as bigint) slot, cast(null as int) grown_shard from s"""


def op10(length: int) -> str:
    """Byte windows as stretches of hex digits."""
    return f"""
with d as (select row_number() over (order by doc_id nulls last) uid, doc_id, hex(encode(coalesce(text, ''))) x from documents),
 n as (select uid, doc_id, x, length(x) // 2 n from d),
 w as (select uid, i, substr(x, cast(2 * i + 1 as int), {2 * length}) s from (select uid, x, unnest(range(0, n - {length - 1})) i from n where n >= {length})),
 m as (select s, min(uid * 1000000000 + i) least from w group by s having count(*) > 1),
 g as (select uid, i from w join m using (s) where uid * 1000000000 + i > least),
 b as (select uid, i, case when i <= lag(i) over (partition by uid order by i) + {length} then 0 else 1 end new from g),
 k as (select uid, i, sum(new) over (partition by uid order by i) run from b),
 r as (select uid, run, min(i) a, max(i) + {length} z from k group by 1, 2),
 o as (select r.*, x, n, coalesce(lag(z) over (partition by uid order by run), 0) p, lead(a) over (partition by uid order by run) is null ends from r join n using (uid)),
 t as (select uid, count(*) n_spans, sum(z - a) n_removed, string_agg(substr(x, cast(2 * p + 1 as int), cast(2 * (a - p) as int)) || case when ends then substr(x, cast(2 * z + 1 as int)) else '' end, '' order by run) kept from o group by 1)
select doc_id, cast(n as bigint) n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, cast(coalesce(n_spans, 0) as bigint) n_spans, sha256(unhex(coalesce(kept, x))) kept_sha256 from n left join t using (uid)"""


_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def op6(rules, min_confidence: float, min_support: float, min_rows: int, max_items: int) -> str:
    """The mining is by enumeration: every part of a labelled URL's frequent tokens is counted with each label."""
    given = " union all ".join(f"select '{h}' rh, '{p}' rp, '{v}' rv" for h, p, v in rules)
    return rf"""
with g as ({given}),
 p as (select row_number() over () rid, page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end rest from pages),
 h as (select rid, page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), {_UPPER}, {_LOWER}), '') host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path from p),
 t as (select *, case when host = '' then [] else list_sort(list_distinct(list_concat(list_concat(list_concat(
     list_transform(string_split(host, '.'), lambda x: 'host:' || x), list_transform(list_filter(string_split(path, '/'), lambda x: regexp_matches(x, '^[^0-9.]+\z')), lambda x: 'path:' || x)),
     list_concat(list_transform(regexp_extract_all(path, '\.([A-Za-z0-9]+)\z', 1), lambda x: 'end:' || x), list_transform(regexp_extract_all(url, '[?&]([^=&#]+)', 1), lambda x: 'key:' || x))),
     ['scheme:' || split_part(url, '://', 1), 'site:' || regexp_extract(host, '([^.]+\.[^.]+)\z', 1)]))) end toks from h),
 l as (select doc_id, max(quality) = 0 bad from labels where quality is not null and doc_id is not null group by 1),
 s as (select t.rid, toks, bad from t join l on page_id = doc_id where url is not null and len(toks) > 0),
 z as (select count(*) n, count(*) filter (bad) n_bad, greatest({min_rows}, cast(ceil({min_support} * count(*)) as bigint)) least from s),
 f as (select tok, count(*) df from (select unnest(toks) tok from s) group by 1 having count(*) >= (select least from z)),
 k as (select rid, bad, list(tok order by df desc, tok)[1:{max_items}] ts from (select rid, bad, unnest(toks) tok from s) join f using (tok) group by 1, 2),
 i as (select list_sort(list_filter(ts, lambda x, j: (m >> (j - 1)) & 1 = 1)) toks, bad from (select ts, bad, unnest(range(1, cast(pow(2, len(ts)) as bigint))) m from k)),
 c as (select toks, count(*) n, count(*) filter (bad) b, count(*) filter (not bad) a from i group by 1),
 r as (select toks need, 'block' v, b / cast(c.n as double) conf from c, z where b >= least and b / cast(c.n as double) >= {min_confidence} and b / cast(c.n as double) > (1 + 1e-9) * n_bad / z.n
   union all select toks, 'allow', a / cast(c.n as double) from c, z where a >= least and a / cast(c.n as double) >= {min_confidence} and a / cast(c.n as double) > (1 + 1e-9) * (z.n - n_bad) / z.n),
 u as (select rid, rh || rp rule, rv from t join g on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) qualify row_number() over (partition by rid order by length(rh || rp) desc) = 1),
 q as (select distinct toks from t where len(toks) > 0),
 m as (select toks, v from q join r on list_has_all(toks, need) qualify row_number() over (partition by toks order by conf desc, v desc) = 1)
select page_id, host, path, rule, coalesce(rv, v, 'allow') verdict, case when rule is not null then 'rule' when v is not null then 'mined' else 'default' end "by"
from t left join u using (rid) left join m using (toks)"""
