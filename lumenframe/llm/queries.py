"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm._spark import remove, saved
from lumenframe.llm.conversation_repair import conversation_repair
from lumenframe.llm.decontaminate import contaminated
from lumenframe.llm.filter_audit import filter_audit
from lumenframe.llm.jaccard_join import near_duplicates
from lumenframe.llm.langid import fit_language_id, language_id
from lumenframe.llm.line_dedup import line_dedup
from lumenframe.llm.lm_score import lm_score
from lumenframe.llm.packing import pack
from lumenframe.llm.secret_scan import secret_scan
from lumenframe.llm.substring_dedup import substring_dedup
from lumenframe.llm.suffix_dedup import suffix_dedup
from lumenframe.llm.token_files import read_documents, write_tokens
from lumenframe.llm.topk import integer_vectors, top_k
from lumenframe.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id(docs, fit_language_id(docs))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    out = saved(read_documents(spark, folder))
    remove(spark, folder)
    return out


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_packing": op3_packing,
    "op4_decontaminate": op4_decontaminate,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_top_k": op6_top_k,
    "op7_line_dedup": op7_line_dedup,
    "op8_lm_score": op8_lm_score,
    "op9_secret_scan": op9_secret_scan,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_token_files": op11_token_files,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_filter_audit": op13_filter_audit,
}

_LINE_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
firsts as (select k, min(doc_id) as first, count(distinct doc_id) as n from keyed where length(k) >= 10 group by k),
judged as (
  select doc_id, pos, line, coalesce(n >= 2 and doc_id <> first, false) as gone
  from keyed left join firsts using (k))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""

_TOP_SQL = """
with v as (
  select vec_id, row_number() over () as r, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.r, q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.r <> q.r)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from pairs)
where rank <= 5
"""

_WINDOW_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (
  select doc_id, i, array_to_string(ws[i:i + 34], ' ') as w
  from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from d)),
twice as (select doc_id, i from win where w in (select w from win group by w having count(*) > 1)),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as j from twice),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as j from d),
judged as (select words.*, gone.j is not null as g from words left join gone using (doc_id, j)),
sums as (
  select doc_id, count(*) filter (where g)::bigint as n_removed,
         coalesce(string_agg(word, ' ' order by j) filter (where not g), '') as kept
  from judged group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join sums using (doc_id)
"""

_REPAIR_SQL = r"""
with recursive
crc_table as (
  select list(list_reduce(range(8), lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t
  from (select range as i from range(256))),
src as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''),
                        lambda x: cast(ascii(x) as bigint)) as bytes
  from conversations),
hashed as (
  select src.*, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 as k
  from src, crc_table),
damaged as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role,
         case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case when k = 3 then 2 else 1 end)) as copy
  from hashed where k <> 0),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as i from damaged),
faulted as (
  select conv_id, turn, role, text, i, substr(role, 1, 1) as c, lag(substr(role, 1, 1)) over (partition by conv_id order by i) as c0,
         count(*) over (partition by conv_id) as n,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b'
              when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
              when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else '' end as f
  from numbered),
taken(q, c, letter, p, cost) as (
  select q, cast(null as varchar), 'D', q, 3 from (values (0), (1), (2), (3)) as v(q)
  union all values (0, null, 'R', 2, 2), (1, null, 'R', 2, 2), (2, null, 'R', 3, 2), (3, null, 'R', 2, 2),
                   (0, 's', 'K', 1, 0), (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0), (3, 'u', 'K', 2, 0)),
put(p, letters, r, cost, rows) as (
  values (0, '', 0, 0, []::varchar[]), (1, '', 1, 0, []), (2, '', 2, 0, []), (3, '', 3, 0, []),
         (0, 'I', 2, 2, ['user:']), (0, 'II', 3, 4, ['user:', 'assistant:']),
         (1, 'I', 2, 2, ['user:']), (1, 'II', 3, 4, ['user:', 'assistant:']),
         (2, 'I', 3, 2, ['assistant:']), (3, 'I', 2, 2, ['user:'])),
walk as (
  select distinct conv_id, n, cast(0 as bigint) as i, r as q, cast(cost as bigint) as cost, letters as audit, rows as repaired
  from faulted, put where p = 0
  union all
  select conv_id, n, i, q, best.cost, best.audit, best.repaired
  from (
    select w.conv_id, w.n, w.i + 1 as i, put.r as q,
           min({'cost': w.cost + taken.cost + put.cost + case when f = 't' and letter <> 'D' then 1 else 0 end,
                'audit': w.audit || letter || put.letters,
                'repaired': w.repaired || case letter when 'D' then [] when 'K' then [role || ':' || text]
                            else [case taken.p when 2 then 'user' else 'assistant' end || ':' || text] end || put.rows}) as best
    from walk w
    join faulted x on w.conv_id is not distinct from x.conv_id and x.i = w.i + 1
    join taken on taken.q = w.q and (taken.c is null or taken.c = x.c) and (letter = 'D' or f not in ('b', 'd'))
    join put on put.p = taken.p
    group by w.conv_id, w.n, w.i, put.r)),
best as (
  select conv_id, min({'cost': cost, 'audit': audit, 'repaired': repaired}) as b from walk where i = n and q in (0, 3) group by conv_id),
sums as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (where f = 'b') as blank, count(*) filter (where f = 'd') as duplicate, count(*) filter (where f = 't') as truncated,
         count(*) filter (where i > 1 and c0 || c not in ('su', 'ua', 'au')) as illegal
  from faulted group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(b.cost, 0)::bigint as cost,
       coalesce(b.audit, '') as audit, sha256(coalesce(array_to_string(b.repaired, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join sums on o.conv_id is not distinct from sums.conv_id
left join best on o.conv_id is not distinct from best.conv_id
"""

_AUDIT_SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws
  from documents),
first as (select t, min(doc_id) as first_id from d group by t),
l as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
judged as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
         case when len(ws) < 200 then 'A' else '' end
         || case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 'B' else '' end
         || case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) then 'C' else '' end
         || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
         || case when first_id is not null and (d.doc_id is null or d.doc_id > first_id) then 'E' else '' end as fails
  from d join first using (t) left join l on d.doc_id = l.doc_id),
patterns as (
  select part, fails, count(*) as n, count(*) filter (where good) as n_good, count(*) filter (where toxic) as n_toxic from judged group by part, fails),
letters(x) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order
  from letters a join letters b on b.x <> a.x join letters c on c.x not in (a.x, b.x)
  join letters d on d.x not in (a.x, b.x, c.x) join letters e on e.x not in (a.x, b.x, c.x, d.x)),
steps as (select filter_order, unnest(range(1, 6)) as step from orders),
lines as (
  select part, filter_order, cast(step as int) as step, substr(filter_order, step, 1) as f, fails, n, n_good, n_toxic,
         len(list_filter(string_split(substr(filter_order, 1, step - 1), ''), lambda x: x <> '' and contains(fails, x))) > 0 as before
  from patterns, steps),
counted as (
  select part, filter_order, step, f,
         coalesce(sum(n) filter (where not before and not contains(fails, f)), 0) as kept,
         coalesce(sum(n) filter (where not before and contains(fails, f)), 0) as removed,
         coalesce(sum(n) filter (where before and contains(fails, f)), 0) as redundant,
         coalesce(sum(n) filter (where fails = f), 0) as unique_fails,
         coalesce(sum(n_good) filter (where not before and contains(fails, f)), 0) as good_lost,
         coalesce(sum(n_toxic) filter (where not before and contains(fails, f)), 0) as toxic_lost
  from lines group by part, filter_order, step, f)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, f))::bigint as shapley
from counted
"""

SQL = {"op2_substring_dedup": _WINDOW_SQL, "op6_top_k": _TOP_SQL, "op7_line_dedup": _LINE_SQL, "op12_conversation_repair": _REPAIR_SQL, "op13_filter_audit": _AUDIT_SQL}
