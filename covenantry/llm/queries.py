"""The registered queries of this subpackage: each applies its operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from covenantry.llm.bpe import encode_digests
from covenantry.llm import chat, dac, language, lm_score, merkle, pii, toxicity
from covenantry.llm.decontaminate import contamination
from covenantry.llm.jaccard_join import near_duplicates
from covenantry.llm.licenses import scan
from covenantry.llm.radix_dedup import exact_groups
from covenantry.llm.shared import documents
from covenantry.llm.spelling import variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir).select("doc_id", "text"))


ORACLES["op2_exact_dedup"] = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = first_value(doc_id) over w as kept, sha256(norm) as text_sha256
from n window w as (partition by norm order by cp desc, doc_id)"""


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("copy")


WORD_LIST = r"""regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLES["op4_decontamination"] = f"""
with d as (select doc_id, {WORD_LIST} as w from documents),
b as (select item_id::varchar as item, {WORD_LIST} as w from benchmark),
i as (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as k from b where len(w) > 0),
iw as (select distinct item, array_to_string(w[k:k + 12], ' ') as win, least(len(w), 13) as n from i),
sizes as (select distinct n from iw),
dp as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n),
h as (select p.doc_id, p.k, p.n, iw.item from (select doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') as win from dp) p
      join iw on iw.win = p.win and iw.n = p.n),
c as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(k, k + n)) as x from h) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
      from (select distinct doc_id, item from h) group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join c using (doc_id) left join t using (doc_id)"""


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


ORACLES["op5_jaccard_join"] = r"""
with recursive d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as k from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[k:k + 3], ' ') as shingle from p),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as hits from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
e as (select c.a, c.b from c join n x on x.doc_id = c.a join n y on y.doc_id = c.b where 100 * hits >= 85 * (x.n + y.n - hits)),
r as (select doc_id as id, doc_id as root from d union select e.b, r.root from r join e on e.a = r.id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id
from d left join n on n.doc_id = d.doc_id join (select id, min(root) as component_id from r group by id) m on m.id = d.doc_id"""


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_check_conversation(chat.conversations(spark, sf_dir))
    return chat.read_digests(chat.format_pieces(turns))


@query
def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = dac.write_ids(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return dac.read_digests(spark, folder, files)


@query
def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


@query
def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(documents(spark, sf_dir))


# CRC-32 of a list of bytes: eight halvings each
CRC_OF_BYTES = """xor(4294967295, list_reduce({bytes},
  lambda crc, byte: list_reduce([0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(crc, byte)),
  4294967295::bigint))"""


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


CRC_OF_RUN = CRC_OF_BYTES.format(bytes="""list_transform(range(0, length(hx), 2),
    lambda i: (16 * (strpos('0123456789ABCDEF', hx[i + 1]) - 1) + strpos('0123456789ABCDEF', hx[i + 2]) - 1)::bigint)""")
ORACLES["op12_spelling"] = f"""
with recursive r as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{7,}}')) as run
  from documents),
g as (select doc_id, run, count(*) as times, hex(encode(doc_id || ':' || run)) as hx from r group by all),
h as (select run, times, {CRC_OF_RUN} as h from g),
w as (
  select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, times from h),
x as (select word, sum(times)::bigint as n from w where length(word) >= 7 group by word having sum(times) >= 2),
p as (select word, n, unnest(range(0, length(word))) as k from x),
c as (select word, n, k, left(word, k) || substr(word, k + 2) as cut from p),
near as (
  select a.word, a.n, b.word as near, b.n as near_n from c a join c b on a.k = b.k and a.cut = b.cut and a.word <> b.word
  union select x.word, x.n, c.word, c.n from x join c on c.cut = x.word
  union select c.word, c.n, x.word, x.n from x join c on c.cut = x.word),
best as (
  select word, any_value(n) as n, count(*) as n_near, min_by(near, (-near_n, near)) as near, max(near_n) as near_n from near group by word),
f as (
  select x.word, case when near_n >= 10 * x.n then near end as form, x.n, coalesce(n_near, 0) as n_near,
         case when near_n >= 10 * x.n then near_n end as form_n
  from x left join best on best.word = x.word),
way as (
  select word, word as last, form as next from f
  union all
  select way.word, f.word, f.form from way join f on f.word = way.next)
select f.word, f.form, way.last as root, f.n, f.n_near, f.form_n from f join way on way.word = f.word and way.next is null"""


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(documents(spark, sf_dir))


CRC_OF_ID = CRC_OF_BYTES.format(bytes="list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)")
ORACLES["op13_merkle"] = f"""
with recursive d as (
  select *, coalesce(':' || source, '-') as tree, case when {CRC_OF_ID} % 2 = 0 then replace(text, chr(10), '') else text end as later
  from documents),
f as (
  select doc_id, tree, [doc_id::varchar, source, lang, n_chars::varchar] as fields, text, later from d),
e as (
  select doc_id, tree, sha256(array_to_string(list_transform(list_append(fields, text),
           lambda x: case when x is null then '-' else strlen(x) || ':' || x end), '')) as leaf,
         sha256(array_to_string(list_transform(list_append(fields, later),
           lambda x: case when x is null then '-' else strlen(x) || ':' || x end), '')) as later from f),
l as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by tree) as n from e),
t as (
  select tree, 0 as lvl, place, leaf as digest, n from l
  union all
  select tree, lvl + 1, place // 3, sha256(string_agg(digest, '' order by place)), any_value((n + 2) // 3)
  from t where n > 1 group by tree, lvl, place // 3),
s as (
  select tree, digest as subroot, row_number() over (order by tree) - 1 as place, count(*) over () as n from t where n = 1),
c as (
  select 0 as lvl, place, subroot as digest, n from s
  union all
  select lvl + 1, place // 3, sha256(string_agg(digest, '' order by place)), any_value((n + 2) // 3)
  from c where n > 1 group by lvl, place // 3),
p as (
  select l.tree, l.place, t.lvl, 0 as crown, coalesce(string_agg(x.digest, '' order by x.place) filter (x.place < t.place), '') as before,
         coalesce(string_agg(x.digest, '' order by x.place) filter (x.place > t.place), '') as after
  from l join t on t.tree = l.tree and t.place = l.place // (3 ** t.lvl)::bigint and t.n > 1
  join t x on x.tree = t.tree and x.lvl = t.lvl and x.place // 3 = t.place // 3 group by all),
q as (
  select s.tree, c.lvl, coalesce(string_agg(x.digest, '' order by x.place) filter (x.place < c.place), '') as before,
         coalesce(string_agg(x.digest, '' order by x.place) filter (x.place > c.place), '') as after
  from s join c on c.place = s.place // (3 ** c.lvl)::bigint and c.n > 1
  join c x on x.lvl = c.lvl and x.place // 3 = c.place // 3 group by s.tree, c.lvl, c.place),
w as (
  select tree, place, list(before || '|' || after order by lvl) as steps from p group by tree, place),
v as (
  select tree, list(before || '|' || after order by lvl) as steps from q group by tree),
o as (
  select l.doc_id, l.leaf, l.later, s.subroot, list_concat(coalesce(w.steps, []), coalesce(v.steps, [])) as steps
  from l join s on s.tree = l.tree left join w on w.tree = l.tree and w.place = l.place left join v on v.tree = l.tree),
r as (
  select doc_id, leaf, subroot, (select digest from c where n = 1) as root, sha256(replace(array_to_string(steps, ''), '|', '')) as proof_sha256,
         list_reduce(list_prepend(later, steps), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) as folded_root from o)
select *, folded_root = root as verified from r"""
