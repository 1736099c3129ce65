"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digest
from .common import read_table
from .convtrie import conversation_trie
from .decontamination import contamination_digest
from .fingerprints import fingerprint_digest
from .langid import language_ids
from .lines import lines_digest
from .minhash import near_duplicates
from .packing import pack
from .resampling import resample
from .sharding import shard_digest
from .suffixtree import language_model_scores
from .tokencounts import token_counts
from .toxicity import toxicity_digest


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    return contamination_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and of its edited text."""
    return fingerprint_digest(read_table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document; class_root tells classes apart that have the same class_id or none."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", F.col("root").alias("class_root"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document's lines."""
    return lines_digest(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return toxicity_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, shuffled into shards 0 to 15."""
    return shard_digest(read_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_ids(read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token count of every document."""
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language-model score of every document."""
    return language_model_scores(read_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, and the drawn quarter's ranks."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_fingerprints": op2_fingerprints,
        "op3_minhash": op3_minhash,
        "op4_line_dedup": op4_line_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_sharding": op6_sharding,
        "op7_language_id": op7_language_id,
        "op8_packing": op8_packing,
        "op9_token_counts": op9_token_counts,
        "op10_language_model": op10_language_model,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_bpe": op12_bpe,
        "op13_resampling": op13_resampling,
    }


_WORDS = r"""regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_CONTAMINATION = f"""
with docs as (select doc_id, row_number() over () as r, {_WORDS.format(text="coalesce(text, '')")} as w from documents),
items as (select cast(item_id as varchar) as item_id, {_WORDS.format(text="text")} as w from benchmark where item_id is not null and text is not null),
places as (select item_id, w, least(13, len(w)) as n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as i from items where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as text from places),
sizes as (select distinct n from windows),
starts as (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs join sizes on n <= len(w)),
found as (select r, i, s.n, item_id from starts s join windows v on v.n = s.n and v.text = array_to_string(w[i:i + s.n - 1], ' ')),
places_hit as (select r, unnest(range(i, i + n)) as p from (select distinct r, i, n from found)),
hits as (select r, count(distinct p) as n_hit from places_hit group by r),
named as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from found) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hits using (r) left join named using (r)
"""


_CRC_TABLE = "(select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i)) as crc)"

# An id's decimal digits, and the minus, are bytes as they are.
_TRIE = f"""
with step as {_CRC_TABLE},
turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as n from conversations where conv_id is not null),
names as (select distinct conv_id as c, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint)) as b from turns),
ids as (select c, xor(list_reduce(b, lambda s, x: xor(s >> 8, crc[(xor(s, x) & 255) + 1]), 4294967295), 4294967295) % 4 as h from names, step),
rebuilt as (select c, n as o, role, text from ids join turns on conv_id = c - c % 20 where n <= h union all select c, n + 4, role, text from ids join turns on conv_id = c where n > h),
whole as (select c, coalesce(t, []) as t from ids left join (select c, list({{'role': role, 'text': text}} order by o) as t from rebuilt group by c) using (c)),
cut as (select c, t, unnest(range(len(t) + 1)) as d from whole),
prefixes as (select c, d, d = len(t) as last, sha256(cast(to_json(t[:d]) as varchar)) as k, case when d > 0 then sha256(cast(to_json(t[:d - 1]) as varchar)) end as p,
    case when d > 0 then len(regexp_extract_all(t[d].text, '[^\\x20\\x09-\\x0D]+')) else 0 end as words from cut),
nodes as (select k, p, d, words, min(c) as conv_id, count(*) as n_convs, coalesce(string_agg(cast(c as varchar), ',' order by c) filter (last), '') as ends from prefixes group by k, p, d, words),
children as (select p, count(*) as n_children from nodes where p is not null group by p),
above as (select distinct a.k as up, b.k as k from prefixes a join prefixes b on a.c = b.c and a.d <= b.d),
known as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children on children.p = n.k),
sums as (select up as k, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * words) as saved_tokens from above join known using (k) group by up)
select n.conv_id, n.d as depth, q.conv_id as parent_conv_id, n.n_convs, n.n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from known n join sums using (k) left join nodes q on q.k = n.p
"""

# crc32 byte by byte, with a table made by its rule.
_RESAMPLING = f"""
with step as {_CRC_TABLE},
docs as (select row_number() over () as r, doc_id, {_WORDS.format(text="coalesce(text, '')")} as w from documents),
marks as (select {_WORDS.format(text="coalesce(text, '')")} as w from benchmark),
source as (select r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from docs),
target as (select unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from marks),
merged as (select f, hex(f) as x, sum(s) as s, sum(t) as t from (select f, count(*) as s, 0 as t from source group by f union all select f, 0, count(*) from target group by f) group by f),
bytes as (select f, s, t, list_transform(range(1, 2 * strlen(f), 2), lambda i: 16 * (strpos('0123456789ABCDEF', x[i]) - 1) + strpos('0123456789ABCDEF', x[i + 1]) - 1) as b from merged),
hashed as (select f, s, t, xor(list_reduce(b, lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % 10000 as bucket from bytes, step),
sums as (select bucket, sum(s) as s, sum(t) as t from hashed group by bucket),
gains as (select bucket, cast(floor(1000 * ln(cast(t + 1 as double) * ((select sum(s) from sums) + 10000) / (cast(s + 1 as double) * ((select sum(t) from sums) + 10000)))) as bigint) as gain from sums),
weights as (select r, count(*) as n, cast(floor(cast(sum(gain) as double) / count(*)) as bigint) as weight from source join hashed using (f) join gains using (bucket) group by r),
scored as (select doc_id, len(w) as words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0)
    + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score from docs left join weights using (r)),
placed as (select *, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where words >= 20)
select doc_id, n_features, weight, score, case when place <= 25 * n // 100 then place end as rank from placed
union all select doc_id, n_features, weight, score, null from scored where words < 20
"""


def oracle_sql() -> dict[str, str]:
    """The others learn, sample, hash or run a tokenizer, which SQL does not express."""
    return {"op1_decontamination": _CONTAMINATION, "op11_conversation_trie": _TRIE, "op13_resampling": _RESAMPLING}
