"""The queries of the corpus operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotrain, decontaminate, divergence, jaccard, kd_shards, mixing, near_vectors, packing, secret_scan, substring, token_index, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return cotrain.score_documents(docs, *cotrain.train(docs, _table(spark, sf_dir, "labels")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op3_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_index.token_table(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "coverage", "n_windows", "verbatim")


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards.shard_documents(_table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_table(spark, sf_dir, "documents"), length=35, texts=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "domain", "lang", "source", "n_words", "epoch")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(spark, _table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").alias("refers_to"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_cotrain": op1_cotrain, "op2_secret_scan": op2_secret_scan, "op3_token_index": op3_token_index, "op4_decontaminate": op4_decontaminate, "op5_near_vectors": op5_near_vectors, "op6_kd_shards": op6_kd_shards, "op7_substring": op7_substring, "op8_mixing": op8_mixing, "op9_warc": op9_warc, "op10_jaccard": op10_jaccard, "op11_packing": op11_packing, "op12_divergence": op12_divergence, "op13_vector_codes": op13_vector_codes}

OP9 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha1(coalesce(html, '')) payload_digest from pages),
     m as (select payload_digest d, max(page_id) last from p where payload_bytes >= 1000 group by 1)
select page_id, cast(payload_bytes as bigint) payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end record_type,
       case when payload_bytes >= 1000 and page_id <> last then last end refers_to
from p left join m on d = payload_digest"""

_REACH = """
  reach as (select id, id other from node union select reach.id, l.b from reach join link l on l.a = reach.other),
  comp as (select id, min(other) component_id from reach group by 1)
"""

OP5 = f"""
with recursive v as (
    select vec_id, embedding::double[] e from embeddings
    where len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
  ),
  node as (select vec_id id from embeddings),
  link as (select x.vec_id a, y.vec_id b from v x join v y on x.vec_id <> y.vec_id and list_cosine_similarity(x.e, y.e) >= 0.95),
  {_REACH}
select id vec_id, (select count(*) from link where a = id) n_links, component_id, id = component_id kept from comp"""

_SPACE = r"[^\x20\x09-\x0D]+"

OP7 = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') w from documents),
  win as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) h from d, unnest(range(1, len(w) - 33)) t(i)),
  rep as (select doc_id, i from win where h in (select h from win group by 1 having count(*) > 1)),
  gone as (select distinct doc_id, i + j p from rep, range(35) r(j)),
  word as (select doc_id, p, w[p] x from d, unnest(range(1, len(w) + 1)) t(p)),
  kept as (select doc_id, count(*) n, string_agg(x, ' ' order by p) line from word anti join gone using (doc_id, p) group by 1)
select doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(line, '')) kept_sha256
from d left join kept using (doc_id)"""

OP10 = f"""
with recursive d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}') w from documents
  ),
  sh as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') s from d, unnest(range(1, greatest(len(w) - 2, 2))) t(i) where len(w) > 0),
  size as (select doc_id, count(*) n from sh group by 1),
  met as (select x.doc_id a, y.doc_id b, count(*) c from sh x join sh y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
  link as (select a, b from met join size p on p.doc_id = a join size q on q.doc_id = b where 100 * c >= 85 * (p.n + q.n - c)),
  node as (select doc_id id from d),
  {_REACH}
select id doc_id, coalesce(n, 0) n_shingles, component_id from comp left join size on size.doc_id = id"""

OP12 = r"""
with d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
  o as (select lang, source, id, unnest(w) term from d),
  g as (select distinct lang, source from d),
  k as (select lang, term from o group by 1, 2 having count(distinct id) >= 10),
  n as (select lang, source, term, count(*) n from o group by 1, 2, 3),
  c as (select g.lang, g.source, k.term, coalesce(n, 0) n from g join k using (lang) left join n using (lang, source, term)),
  p as (select lang, source, term, n, 1 + 1000000000::hugeint * (n + 2) // (sum(n) over (partition by lang, source) + 2 * count(*) over (partition by lang, source)) p from c),
  l as (select lang, term, sum(n) n from c group by 1, 2),
  q as (select lang, term, 1 + 1000000000::hugeint * (n + 2) // (sum(n) over (partition by lang) + 2 * count(*) over (partition by lang)) q from l),
  pairs as (select a.lang, a.source, b.source item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) value
            from g a join g b on a.lang = b.lang and a.source <> b.source
            left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by 1, 2, 3),
  terms as (select lang, source, term item, (p - q) * (p - q) // (p + q) value from p join q using (lang, term) where n > 0 and p > q),
  r as (select lang, source, 'pair' part, item, value, row_number() over (partition by lang, source order by value desc, item) rank from pairs
        union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from terms)
select lang, source, part, item, cast(value as bigint) value, cast(rank as int) rank from r where part = 'pair' or rank <= 10"""


def _op13(rounds: int = 2) -> str:
    """Rounds of assigning parts to entries and averaging, written out one after another."""
    floor = "cast((s - ((s % n) + n) % n) // n as bigint)"
    steps = [
        "v as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        "part as materialized (select vec_id, p, e[p * len(e) // 16 + 1:(p + 1) * len(e) // 16] x from v, range(16) r(p))",
        "b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 k, x from part where vec_id in (select vec_id from v order by vec_id limit 64))",
    ]
    for i in range(rounds + 1):
        d = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{i} as materialized (select vec_id, p, x, min(struct_pack(d := d, k := k)) m from (select a.vec_id, a.p, a.x, b.k, {d} d from part a join b{i} b using (p)) group by 1, 2, 3)")
        if i < rounds:
            steps.append(f"s{i} as (select p, k, i, sum(c)::hugeint s, count(*) n from (select p, m.k k, unnest(x) c, unnest(range(len(x))) i from a{i}) group by 1, 2, 3)")
            steps.append(f"b{i + 1} as materialized (select p, k, coalesce(y, x) x from b{i} left join (select p, k, list({floor} order by i) y from s{i} group by 1, 2) using (p, k))")
    return f"""
with {", ".join(steps)},
  h as (select sha256(string_agg(c, ',' order by p, k, i)) codebooks_sha256 from (select p, k, unnest(x)::varchar c, unnest(range(len(x))) i from b{rounds})),
  o as (select vec_id, string_agg(format('{{:02x}}', m.k), '' order by p) code, cast(sum(m.d) as bigint) error from a{rounds} group by 1)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, codebooks_sha256 from o join v using (vec_id), h"""


OP13 = _op13()

ORACLES = {"op5_near_vectors": OP5, "op7_substring": OP7, "op9_warc": OP9, "op10_jaccard": OP10, "op12_divergence": OP12, "op13_vector_codes": OP13}
