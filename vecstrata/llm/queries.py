"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode
from .codes import compress, digest_columns
from .decontaminate import contaminated
from .exact_dedup import exact_groups
from .fingerprints import fingerprints
from .html_extract import extract
from .licenses import licenses
from .lm_score import score
from .phrases import collocations
from .quality import judge, train
from .scratch import settle, table
from .sharding import interleaved_shards
from .simhash import near_groups
from .warc import captures, remove_archives


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are the documents labelled as good; the background are all."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score(table(spark, sf_dir, "documents"), good)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs))


def word_vocabulary() -> str:
    """The path of the vocabulary file that the BPE query and the pipeline use."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode(table(spark, sf_dir, "documents"), word_vocabulary())
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _, folder = captures(table(spark, sf_dir, "pages"))
    found = settle(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove_archives(spark, folder)
    return found


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
)
select doc_id,
       min(doc_id) over (partition by t) as keep_id,
       count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept,
       sha256(t) as text_sha256
from n
"""


OP6_SQL = """
with p as (
  select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, ''))) as n from pages
), f as (
  select *, max(page_id) over (partition by payload_digest, n >= 1000) as first from p
)
select page_id, cast(n as bigint) as payload_bytes, payload_digest,
       case when n >= 1000 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id <> first then first end as refers_to
from f
"""


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(compress(table(spark, sf_dir, "embeddings")))


def _op11_sql() -> str:
    """Each round: the nearest entry by (distance, index) as one number, then floored means; vectors of 64 components in 16 parts of 4."""
    far = "(p.x0 - c.x0) * (p.x0 - c.x0) + (p.x1 - c.x1) * (p.x1 - c.x1) + (p.x2 - c.x2) * (p.x2 - c.x2) + (p.x3 - c.x3) * (p.x3 - c.x3)"
    means = ", ".join(f"case when count(a.e) = 0 then any_value(c.x{j}) else ((sum(p.x{j}) - ((sum(p.x{j}) % count(a.e)) + count(a.e)) % count(a.e)) // count(a.e))::bigint end as x{j}" for j in range(4))
    steps = []
    for k in range(3):
        steps.append(f"n{k} as materialized (select p.vec_id, p.part, min(({far}) * 64 + c.e) as m from p join c{k} c using (part) group by all)")
        steps.append(f"a{k} as materialized (select vec_id, part, m % 64 as e, m // 64 as d from n{k})")
        if k < 2:
            steps.append(f"c{k + 1} as materialized (select c.part, c.e, {means} from c{k} c left join a{k} a on a.part = c.part and a.e = c.e left join p on p.vec_id = a.vec_id and p.part = a.part group by c.part, c.e)")
    return f"""
with r as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, part, v[4 * part + 1] as x0, v[4 * part + 2] as x1, v[4 * part + 3] as x2, v[4 * part + 4] as x3 from r, range(16) t(part)),
c0 as materialized (select * from (select part, row_number() over (partition by part order by vec_id) - 1 as e, x0, x1, x2, x3 from p) where e < 64),
{", ".join(steps)},
coded as (select vec_id, string_agg(printf('%02x', e::int), '' order by part) as code, sum(d)::bigint as error from a2 group by vec_id),
book as (select sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' order by part, e)) as codebooks_sha256 from c2)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from coded join r using (vec_id), book"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
said as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces),
spans as (select lang, k, w, unnest(range(1, len(w) - k + 2)) as i from said, range(1, 5) t(k)),
f as materialized (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as a from spans group by all),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
c as materialized (select * from f where k > 1 and a >= 30),
cuts as (
  select c.lang, c.phrase, c.a, j, array_to_string(string_split(c.phrase, ' ')[:j], ' ') as head, array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ') as rest
  from c, range(1, 4) t(j) where j < c.k),
cut_scores as (
  select u.lang, u.phrase, u.a, u.j, x.a as l, y.a as r, (2000000::hugeint * u.a // (x.a + y.a))::bigint as score
  from cuts u join f x on x.lang = u.lang and x.phrase = u.head join f y on y.lang = u.lang and y.phrase = u.rest),
best as (select * from (select *, row_number() over (partition by lang, phrase order by score, j) as o from cut_scores) where o = 1),
inside as (
  select c.lang, array_to_string(string_split(c.phrase, ' ')[i:i + m - 1], ' ') as phrase, max(c.a) as around
  from c, range(2, 4) t(m), range(1, 4) s(i) where m < c.k and i + m - 1 <= c.k group by all),
ranked as (
  select b.*, row_number() over (partition by b.lang order by b.score desc, b.a desc, b.phrase) as rank
  from best b left join inside s on s.lang = b.lang and s.phrase = b.phrase where s.around is null or 100::hugeint * s.around < 80::hugeint * b.a)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _op13_sql() -> str:
    """The likeness by sets of digests, which peeled sketches must give exactly."""
    check = "(({x} % 2147483647) * 1000003 + ({x} % 998244353) * 7919) % 4294967296"
    own = "list_filter({d}, lambda x: (x >> (20 + 3 * (c // 8)::int)) & 7 = c % 8)"
    xor = lambda items: f"coalesce(list_aggregate({items}, 'bit_xor'), 0)"
    cell = f"concat(len({own}), ':', {xor(own)}, ':', {xor(f'list_transform({own}, lambda x: {check.format(x="x")})')})"
    shown = lambda d: f"array_to_string(list_transform(range(24), lambda c: {cell.format(d=d)}), ' ')"
    digests = lambda t: f"list_distinct(list_transform(list_filter(flatten(list_transform(string_split({t}, chr(10)), lambda x: case when length(x) > 1000 then regexp_split_to_array(x, '[.!?] ') else [x] end)), lambda x: x <> ''), lambda x: ('0x' || md5(x)[1:15])::bigint))"
    near = lambda a, b: f"case when len({a}) + len({b}) = 0 then 1.0 else len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) end::double"
    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, text, length(text) as n, coalesce(lead(text) over w, first_value(text) over w) as next from t window w as (order by doc_id desc)),
e as (select doc_id, n, text, next, substring(text, 1, n - n // 2) || substring(next, 1, n // 2) as edited from n),
d as materialized (select doc_id, n, edited, {digests("text")} as a, {digests("edited")} as b, {digests("next")} as c from e)
select doc_id, n as n_chars, sha256(edited) as edited_sha256, {shown("a")} as fingerprint, {shown("b")} as edited_fingerprint, {near("a", "b")} as near_edited, {near("a", "d.c")} as near_next from d"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_lm_score": op2_lm_score,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_quality": op4_quality,
        "op5_bpe": op5_bpe,
        "op6_warc": op6_warc,
        "op7_licenses": op7_licenses,
        "op8_sharding": op8_sharding,
        "op9_html": op9_html,
        "op10_decontamination": op10_decontamination,
        "op11_vector_codes": op11_vector_codes,
        "op12_collocations": op12_collocations,
        "op13_fingerprints": op13_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op6_warc": OP6_SQL, "op11_vector_codes": _op11_sql(), "op12_collocations": OP12_SQL, "op13_fingerprints": _op13_sql()}
