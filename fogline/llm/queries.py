"""Driver queries of the operators in this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogline.functions.runtime import read, scratch_path
from fogline.llm import bpe, exact_dedup, html_text, media, mixing, piece_bpe, prefix_trie, secret_scan, sharding, signature_tree, spelling, token_files, toxicity

SHARDS = [(k, 1.0) for k in range(24)]


#: Files of the public tokenizers, found where their package is installed.
RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every text."""
    return bpe.digests(read(spark, sf_dir, "documents"), RANKS)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from the labels that aren't held out."""
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages"))


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of the documents with its score and the forest's verdict."""
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "position", F.sha2("candidate", 256).alias("candidate_sha256"), F.col("length").cast("long").alias("length"), "score", "secret")


def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 by doc_id; ``slot`` orders a shard's rows by hash bucket and id."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = sharding.assign_shards(rows, "doc_id", SHARDS, [*SHARDS, (24, 1.0)])
    return sharding.number_slots(placed, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the smallest id that links of a similarity of 0.8 or more lead to."""
    return signature_tree.linked(read(spark, sf_dir, "documents"))


def op7_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as chunks, and where they lie, read back from the files."""
    path = scratch_path(spark, "tokens")
    token_files.write(read(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_files.read(spark, path)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep decisions, with the digest of every text."""
    return exact_dedup.decisions(read(spark, sf_dir, "documents"), hash_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as lossless pictures, decoded again."""
    return media.digests(media.encode(read(spark, sf_dir, "documents")))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_spelling_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its form, its root and its near words' number."""
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every text."""
    return piece_bpe.digests(read(spark, sf_dir, "documents"), PIECES)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with its subtree's totals."""
    rows, every = prefix_trie.rebuilt(prefix_trie.turns(read(spark, sf_dir, "conversations")))
    return prefix_trie.trie(rows, every)


QUERIES = {
    f.__name__: f
    for f in (op1_bpe_merge_replay, op2_toxicity, op3_html_density, op4_secret_forest, op5_rendezvous_sharding, op6_signature_tree_join, op7_bit_plane_tokens, op8_exact_dedup, op9_lossless_webp, op10_source_mix, op11_spelling_chunks, op12_piece_backtracking, op13_conversation_trie)
}

OP8_SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, d.text_sha256 from d join g on d.text_sha256 = g.text_sha256
"""

OP6_SQL = r"""
with recursive w as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w
  from documents),
s as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end as shingle
  from w, lateral (select unnest(generate_series(1, greatest(len(w) - 4, 1)))) t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
reach as (select doc_id, doc_id as other from w union select doc_id, b from reach join link on other = a),
root as (select doc_id, min(other) as component_id from reach group by doc_id)
select root.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from root left join n on n.doc_id = root.doc_id
"""

OP10_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('17:' || coalesce(doc_id::varchar, '')) as key
  from documents),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from d group by source),
s1 as (select *, (place - 1) % 3 + 1 as weight, 3 * source_size as cap, sum(source_size) over () as total from s0),
s2 as (
  select *, coalesce(sum(cap) over w, 0) as spent, sum(weight) over () - coalesce(sum(weight) over w, 0) as weights
  from s1 window w as (order by cap::double / weight, place rows between unbounded preceding and 1 preceding)),
s3 as (select *, weight * (total - spent) >= cap * weights as capped from s2),
s4 as (
  select *, coalesce(max(case when not capped then total - spent end) over (), 0)::bigint as rest,
         coalesce(max(case when not capped then weights end) over (), 1)::bigint as open
  from s3),
s5 as (
  select source, place, source_size, total::bigint as total,
         case when capped then cap::double * open else (weight * rest)::double end as numerator,
         case when capped then cap::double else (weight * rest)::double / open end as target
  from s4),
s6 as (select *, greatest(1, least(2048, floor(coalesce(min(case when target > 0 then target end) over (), 1.0) / 64)))::bigint as block from s5),
seats as (
  select source, place, row_number() over (order by numerator / (2 * k + 1) desc, place) as rank, (2 * total + block) // (2 * block) as house
  from s6, lateral (select unnest(generate_series(0, (2 * total + block) // (2 * block)))) t(k) where numerator > 0),
quota as (select place, count(*) as blocks from seats where rank <= house group by place),
s7 as (
  select source, source_size, target, least(coalesce(blocks, 0) * block, 3 * source_size) as words
  from s6 left join quota on s6.place = quota.place),
run as (
  select *, coalesce(sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start
  from d)
select doc_id, size, source_size, target,
       (case when source_size = 0 then 0 else (words // source_size) * size
             + least(size, greatest(0, words - (words // source_size) * source_size - start)) end)::bigint as taken
from run join s7 on run.source is not distinct from s7.source
"""

#: The crc32 of a byte, and of strings byte by byte.
CRC_SQL = """
crc0 as (
  select k, k as v, 0 as i from range(256) r(k)
  union all select k, xor(v >> 1, (v & 1) * 3988292384), i + 1 from crc0 where i < 8),
crc as (select k, v from crc0 where i = 8)"""


def crc_sql(name: str, source: str) -> str:
    """``name`` (s, h): the crc32 of each string s of ``source`` (s)."""
    return f"""
{name}0 as (
  select s, hex(encode(s)) as x, 0 as i, 4294967295::bigint as h from {source}
  union all
  select s, x, i + 1, xor(v, h >> 8) from {name}0 join crc on k = xor(h & 255, cast('0x' || substr(x, 2 * i + 1, 2) as bigint)) where 2 * i < length(x)),
{name} as (select s, xor(h, 4294967295) as h from {name}0 where 2 * i = length(x))"""


OP11_SQL = rf"""
with recursive {CRC_SQL.strip()},
runs as materialized (
  select id, run, count(*) as c from (
    select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
    from documents) where length(run) >= 5 group by all),
said as materialized (select distinct id || ':' || run as s from runs),{crc_sql("told", "said")},
words as materialized (
  select word, sum(c)::bigint as n from (
    select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from runs join told on s = id || ':' || run)
  where length(word) >= 5 group by word having sum(c) >= 3),
less as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as v from words, lateral (select unnest(generate_series(1, length(word)))) t(i)),
one as materialized (
  select a.word, a.n, b.word as other, b.n as other_n from less a join less b on a.i = b.i and a.v = b.v and a.word <> b.word
  union select a.word, a.n, b.word, b.n from less a join words b on a.v = b.word
  union select b.word, b.n, a.word, a.n from less a join words b on a.v = b.word),
near as materialized (select word, n, count(*) as n_near, max(other_n) as most from one group by word, n),
forms as materialized (select a.word, min(other) as form, most as form_n from near a join one b on a.word = b.word and other_n = most where most >= 2 * a.n group by a.word, most),
up as (select word, form as root from forms union all select up.word, forms.form from up join forms on forms.word = up.root),
last as (select word, root from up where root not in (select word from forms))
select w.word, form, coalesce(root, w.word) as root, w.n, coalesce(n_near, 0) as n_near, form_n
from words w left join near on near.word = w.word left join forms on forms.word = w.word left join last on last.word = w.word
"""

OP13_SQL = rf"""
with recursive {CRC_SQL.strip()},
t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
ids as (select distinct conv_id::varchar as s from t),{crc_sql("told", "ids")},
c as (select distinct conv_id, h % 4 as h from t join told on s = conv_id::varchar),
lent as (select c.conv_id, t.i as d, role, text from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and t.i <= h),
k as (select conv_id, count(*) as k from lent group by 1),
made as (
  select * from lent
  union all select c.conv_id, coalesce(k, 0) + t.i - h, role, text from c join t on t.conv_id = c.conv_id left join k on k.conv_id = c.conv_id where t.i > h),
seq as (select conv_id, coalesce(list({{'role': role, 'text': text}} order by d) filter (d is not null), []) as s from c left join made using (conv_id) group by 1),
pre as (select conv_id, d, s[1:d] as p, len(s) = d as ends from seq, lateral (select unnest(generate_series(0, len(s)))) r(d)),
node as materialized (
  select p, d, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as e,
         (count(*) - 1) * case when d = 0 then 0 else len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) end as saved
  from pre group by p, d),
edge as materialized (select a.p, a.d, b.conv_id as parent from node a join node b on b.d = a.d - 1 and b.p = a.p[1 : a.d - 1]),
child as (select p[1 : d - 1] as p, d - 1 as d, count(*) as n from edge group by 1, 2),
own as (select node.p, node.d, saved, case when n is null then 1 else 0 end as leaf from node left join child on child.d = node.d and child.p = node.p),
sums as (select p[1:j] as p, j as d, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from own, lateral (select unnest(generate_series(0, d))) r(j) group by 1, 2)
select conv_id, node.d as depth, parent as parent_conv_id, n_convs, coalesce(n, 0) as n_children, n_leaves, saved_tokens, sha256(e) as ends_sha256
from node join sums on sums.d = node.d and sums.p = node.p left join edge on edge.d = node.d and edge.p = node.p left join child on child.d = node.d and child.p = node.p
"""

SQL = {"op6_signature_tree_join": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op10_source_mix": OP10_SQL, "op11_spelling_chunks": OP11_SQL, "op13_conversation_trie": OP13_SQL}
