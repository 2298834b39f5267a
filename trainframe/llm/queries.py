"""The operators bound to the given tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trainframe.llm import bwt, crf, dualtree, exact, forest, huffman, langid, mixing, packing, pq, resample, template, warc
from trainframe.session import table


def bpe_path() -> str:
    """Place of the byte-level BPE vocabulary; a parameter of every operator that tokenises."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, lengths = huffman.encode_documents(table(spark, sf_dir, "documents"), bpe_path(), end_id=2)
    return huffman.read_blocks(spark, folder, lengths)


def op2_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.main_text(table(spark, sf_dir, "pages"))


def op3_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.removal(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), bpe_path(), end_id=0))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.vector_duplicates(table(spark, sf_dir, "embeddings"), least=0.9, recall=0.99)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf.rules(docs, crf.fit(docs, table(spark, sf_dir, "labels")))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, buckets=10000, least=20, percent=10, seed=2024)


def op13_dualtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


WARC_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body) as n, sha256(body) as h from p),
f as (select h, min(page_id) as first from d where n >= 100 group by h)
select page_id, n as payload_bytes, d.h as payload_digest,
       case when first < page_id then 'revisit' else 'response' end as record_type,
       case when first < page_id then first end as refers_to
from d left join f on d.h = f.h and d.n >= 100
"""

EXACT_SQL = """
with d as (select doc_id, coalesce(text, '') as text from documents),
g as (select *, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
             row_number() over (partition by text order by doc_id desc nulls last) as nth from d)
select doc_id, keep_id, group_size, nth = 1 as kept, sha256(text) as text_sha256 from g
"""

_WORD = (
    "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"
)

# The CRC-32 of each distinct word: its bytes, from hexadecimal digits, folded into the register by the polynomial's table.
RESAMPLING_SQL = f"""
with recursive crc as (select list(list_reduce(list_prepend(i::ubigint, range(8)::ubigint[]), lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
words as (select false as target, doc_id as id, {_WORD} as word from documents
          union all select true, item_id, {_WORD} from benchmark),
vocab as (select word, hex(word) as hx from (select distinct word from words)),
bucket as (select word, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(0, length(hx), 2), lambda i: ('0x' || substr(hx, (i + 1)::int, 2))::ubigint)),
                  lambda c, b: xor(t[(xor(c, b) & 255)::int + 1], c >> 8)), 4294967295::ubigint) % 10000 as bucket from vocab, crc),
n as (select bucket, count(*) filter (not target) as s, count(*) filter (target) as t from words join bucket using (word) group by bucket),
z as (select sum(s)::double as s_all, sum(t)::double as t_all from n),
g as (select bucket, floor(1000 * ln((t::double + 1) * (s_all + 10000) / ((s::double + 1) * (t_all + 10000))))::bigint as gain from n, z),
w as (select id as doc_id, count(*) as n_features, sum(gain)::bigint as weight from words join bucket using (word) join g using (bucket) where not target group by 1),
e as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::ubigint::double + 0.5) / 4294967296.0::double)))::bigint as score
      from documents left join w using (doc_id)),
r as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as nth, count(*) filter (n_features >= 20) over () as n from e)
select doc_id, n_features, weight, score, case when n_features >= 20 and nth <= n * 10 // 100 then nth end as rank from r
"""

DUALTREE_SQL = f"""
with d as (select doc_id, {_WORD} as term from documents),
i as (select distinct item_id, {_WORD} as term from benchmark),
f as (select doc_id, term, count(*) as tf from d group by 1, 2),
n as (select doc_id, sum(tf)::bigint as n from f group by 1),
z as (select count(*) as docs, sum(n)::bigint as terms from n),
w as (select term, floor(1000 * ln((2 * max(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, z group by term),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::bigint as score
      from i join f using (term) join w using (term) join n using (doc_id), z group by 1, 2),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0)
select * from r where rank <= 10
"""

QUERIES = {
    "op1_huffman": (op1_huffman, None),
    "op2_template": (op2_template, None),
    "op3_forest": (op3_forest, None),
    "op4_passages": (op4_passages, None),
    "op5_packing": (op5_packing, None),
    "op6_mixing": (op6_mixing, None),
    "op7_warc": (op7_warc, WARC_SQL),
    "op8_quantised": (op8_quantised, None),
    "op9_language": (op9_language, None),
    "op10_quality": (op10_quality, None),
    "op11_fingerprints": (op11_fingerprints, EXACT_SQL),
    "op12_resampling": (op12_resampling, RESAMPLING_SQL),
    "op13_dualtree": (op13_dualtree, DUALTREE_SQL),
}
