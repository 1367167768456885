"""The numbered queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.llm import collocations, decontam, html, kdshards, langid, lexical, pieces, repeats, setjoin, topk, toxicity, urls, warc
from loopweave.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def fold(size: int):
    """The crc32 of the id's text modulo ``size``; 0 without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % size, F.lit(0))


@register(
    "op1_exact_topk",
    """
with v as (select cast(vec_id as bigint) vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) q from embeddings
  where vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id query_id, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) score
  from (select distinct * from v where vec_id % 50 = 0) a join v b on a.vec_id <> b.vec_id)
select query_id, cast(rank as integer) rank, vec_id, score from
  (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from p) where rank <= 5
""",
)
def exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").filter(topk.usable(F.col("embedding")))
    return topk.top_k(vectors.select("vec_id", topk.floor_terms(F.col("embedding")).alias("terms")), k=5, every=50)


@register("op2_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold(3) == 1)
    prototypes = langid.learn(docs.filter("not held_out"))
    return langid.identify(docs.drop("lang"), prototypes).select("doc_id", "held_out", "lang_pred", "score")


@register("op3_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("held_out", fold(5) == 0)
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.filter("not held_out"), labels)
    return toxicity.score(docs, model).select(
        "doc_id", "held_out", F.col("tox_score").alias("score"), F.col("tox_label").alias("predicted")
    )


@register(
    "op4_ngram_jaccard_join",
    r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') words from documents),
s as (select distinct doc_id, array_to_string(case when len(words) < 4 then words else words[i:i+3] end, ' ') || ' ' || least(len(words), 4) sh
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) i from w where len(words) > 0)),
n as (select doc_id, count(*) n from s group by 1),
links as (select a.doc_id a, b.doc_id b from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach(doc_id, r) as (select doc_id, doc_id from documents union select reach.doc_id, links.b from reach join links on reach.r = links.a)
select reach.doc_id, cast(coalesce(min(n.n), 0) as bigint) n_shingles, min(r) component_id
from reach left join n on n.doc_id = reach.doc_id group by reach.doc_id
""",
)
def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return setjoin.similarity_classes(docs, k=4, top=85, bottom=100).select("doc_id", "n_shingles", "component_id")


@register("op5_kd_sharding")
def kd_sharding(spark: SparkSession, folder: str) -> DataFrame:
    shards = kdshards.kd_shards(table(spark, folder, "documents"), leaves=8)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@register("op6_warc")
def warc_captures(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(table(spark, folder, "pages").select("page_id", "url", "html")).captures()


@register(
    "op7_decontamination",
    r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') words from documents),
b as (select coalesce(cast(item_id as varchar), '') item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') words from benchmark),
bw as (select distinct item_id, least(len(words), 10) k, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') win
  from (select item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) i from b where len(words) > 0)),
dw as (select doc_id, i, k, array_to_string(words[i:i + k - 1], ' ') win
  from (select doc_id, words, k, unnest(range(1, len(words) - k + 2)) i from d, (select distinct k from bw) ks where len(words) >= k)),
m as (select doc_id, i, k, item_id from dw join bw using (k, win)),
h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from m) group by 1),
it as (select doc_id, count(*) n_items, sha256(string_agg(item_id, ',' order by item_id)) items_sha256
  from (select distinct doc_id, item_id from m) group by 1)
select d.doc_id, cast(len(words) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  coalesce(items_sha256, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h on h.doc_id = d.doc_id left join it on it.doc_id = d.doc_id
""",
)
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = decontam.contamination(docs, table(spark, folder, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


@register("op8_url_filter")
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages").select("page_id", "url"), RULES)


@register("op9_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(table(spark, folder, "pages").select("page_id", "url", "html"))


@register("op10_piece_coding")
def piece_coding(spark: SparkSession, folder: str) -> DataFrame:
    coded = pieces.encode_documents(table(spark, folder, "documents"), with_text=False)
    return coded.select("doc_id", "ids", "n_ids", "exact")


@register(
    "op11_repeats",
    r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
w as (select doc_id, i, md5(x[2 * i - 1:2 * i + 198]) s from (select doc_id, x, unnest(range(1, len(x) // 2 - 98)) i from d)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) k from w) where k > 1),
o as (select doc_id, i, lag(i) over (partition by doc_id order by i) before from r),
g as (select doc_id, i, sum(case when before is null or i > before + 100 then 1 else 0 end) over (partition by doc_id order by i) g from o),
sp as (select doc_id, g, min(i) a, max(i) + 99 b from g group by 1, 2),
k as (select doc_id, a - 1 b, coalesce(lag(b) over (partition by doc_id order by a), 0) + 1 a from sp
  union all select doc_id, 1000000000000, max(b) + 1 from sp group by doc_id),
kept as (select d.doc_id, string_agg(x[2 * a - 1:least(2 * b, len(x))], '' order by a) x from d join k using (doc_id) group by d.doc_id),
n as (select doc_id, sum(b - a + 1) removed, count(*) spans from sp group by doc_id)
select d.doc_id, cast(len(d.x) // 2 as bigint) n_bytes, cast(coalesce(removed, 0) as bigint) n_removed, cast(coalesce(spans, 0) as bigint) n_spans,
  sha256(unhex(coalesce(kept.x, d.x))) kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)
""",
)
def repeated_text(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register(
    "op12_lexical_search",
    r"""
with d as (select row_number() over () i, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') words from documents where text is not null),
n as (select i, doc_id, cast(len(words) as bigint) n from d where len(words) > 0),
t as (select cast(count(*) as bigint) nn, cast(sum(n) as bigint) ll from n),
tf as (select i, w, cast(count(*) as bigint) tf from (select i, unnest(words) w from d) group by 1, 2),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) w from benchmark),
wt as (select w, cast(floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double)) as bigint) wt from
  (select w, count(*) df from tf group by w), t),
s as (select q.item_id, tf.i, cast(sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) as bigint) score
  from q join tf using (w) join wt using (w) join n on n.i = tf.i, t group by 1, 2)
select item_id, cast(rank as integer) rank, doc_id, score from
  (select s.item_id, n.doc_id, s.score, row_number() over (partition by s.item_id order by s.score desc, n.doc_id) rank
   from s join n on n.i = s.i where s.score > 0) where rank <= 50
""",
)
def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register(
    "op13_collocations",
    r"""
with p as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') words from p),
g1 as (select lang, w, cast(count(*) as bigint) f from (select lang, unnest(words) w from w) group by 1, 2),
n as (select lang, cast(sum(f) as bigint) n from g1 group by 1),
g2 as (select lang, words[i] w1, words[i + 1] w2, cast(count(*) as bigint) f
  from (select lang, words, unnest(range(1, len(words))) i from w) group by 1, 2, 3 having count(*) >= 10),
g3 as (select lang, words[i] w1, words[i + 1] w2, words[i + 2] w3, cast(count(*) as bigint) f
  from (select lang, words, unnest(range(1, len(words) - 1)) i from w) group by 1, 2, 3, 4 having count(*) >= 10),
longer as (select lang, w1, w2, max(f) m from (select lang, w1, w2, f from g3 union all select lang, w2, w3, f from g3) group by 1, 2, 3),
c2 as (select g.lang, g.w1 || ' ' || g.w2 phrase, g.f a, x.f l, y.f r,
    cast((1000000 * g.f::hugeint * g.f) // (x.f::hugeint * y.f) as bigint) score
  from g2 g join g1 x on x.lang = g.lang and x.w = g.w1 join g1 y on y.lang = g.lang and y.w = g.w2
  left join longer t on t.lang = g.lang and t.w1 = g.w1 and t.w2 = g.w2 where coalesce(t.m, 0) * 100 < 50 * g.f),
s3 as (select g.lang, g.w1 || ' ' || g.w2 || ' ' || g.w3 phrase, g.f a, x.f f1, yz.f f23, xy.f f12, z.f f3,
    (1000000 * g.f::hugeint * g.f) // (x.f::hugeint * yz.f) s1, (1000000 * g.f::hugeint * g.f) // (xy.f::hugeint * z.f) s2
  from g3 g join g1 x on x.lang = g.lang and x.w = g.w1 join g1 z on z.lang = g.lang and z.w = g.w3
  join g2 xy on xy.lang = g.lang and xy.w1 = g.w1 and xy.w2 = g.w2 join g2 yz on yz.lang = g.lang and yz.w1 = g.w2 and yz.w2 = g.w3),
a as (select * from c2 union all
  select lang, phrase, a, case when s1 <= s2 then f1 else f12 end, case when s1 <= s2 then f23 else f3 end, cast(least(s1, s2) as bigint) from s3)
select lang, rank, phrase, a, l, r, n, score from
  (select a.*, n.n, row_number() over (partition by a.lang order by score desc, a desc, phrase) rank from a join n on n.lang = a.lang)
where rank <= 2000
""",
)
def collocation_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
