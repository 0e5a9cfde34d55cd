"""The registered queries of this subpackage, opN_<name>. SQL expresses the n-gram join and the repeated word windows; for the others
(tokenizers, trained models, audio, and byte windows, for which SQL takes minutes on the smallest tables) tests/llm has brute force or
held-out accuracy."""

from pyspark.sql import DataFrame, SparkSession

from kinlink.llm.decontam import leaks
from kinlink.llm.lm import lm_scores
from kinlink.llm.media import fingerprints, recordings, rendered
from kinlink.llm.ngram_join import ngram_components
from kinlink.llm.packing import packed
from kinlink.llm.pii import pii
from kinlink.llm.quality import quality
from kinlink.llm.substring import substring_dedup
from kinlink.llm.suffix_dedup import suffix_dedup
from kinlink.llm.toxicity import toxicity


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_packing(spark, sf_dir):
    return packed(_docs(spark, sf_dir), tokenizer_path())


def op2_ngram_join(spark, sf_dir):
    return ngram_components(_docs(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op3_pii(spark, sf_dir):
    return pii(_docs(spark, sf_dir))


def op4_toxicity(spark, sf_dir):
    return toxicity(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup(_docs(spark, sf_dir))


def op6_quality(spark, sf_dir):
    return quality(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op7_lm(spark, sf_dir):
    return lm_scores(_docs(spark, sf_dir))


def op8_decontam(spark, sf_dir):
    return leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_media(spark, sf_dir):
    return recordings(fingerprints(rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))))


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_packing, op2_ngram_join, op3_pii, op4_toxicity, op5_suffix_dedup, op6_quality, op7_lm, op8_decontam, op9_media, op10_substring_dedup)}
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": r"""with recursive w as (select doc_id, list_filter(string_split_regex(regexp_replace(coalesce(text,''),'[\x09-\x0D]',' ','g'),' +'), lambda x: x<>'') ws from documents),
m as (select doc_id, len(ws) n from w), u as (select doc_id, unnest(ws) word, generate_subscripts(ws,1) i from w),
l as (select doc_id, i, translate(word,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') word from u),
g as (select doc_id, i, concat_ws(' ', word, lead(word,1) over q, lead(word,2) over q, lead(word,3) over q, lead(word,4) over q) s from l window q as (partition by doc_id order by i)),
s as (select distinct doc_id, s from g join m using (doc_id) where i<=greatest(1,n-4)), z as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b using (s) where a.doc_id<>b.doc_id group by 1,2),
e as materialized (select a, b from p join z x on x.doc_id=a join z y on y.doc_id=b where 100*c>=80*(x.n+y.n-c)),
r as (select doc_id node, doc_id root from z union select e.b, r.root from r join e on e.a=r.node where r.root<e.b)
select d.doc_id, coalesce(z.n,0) n_shingles, coalesce((select min(root) from r where r.node=d.doc_id), d.doc_id) component_id from documents d left join z using (doc_id)""",
    "op10_substring_dedup": r"""with w as (select doc_id, list_filter(string_split_regex(regexp_replace(coalesce(text,''),'[\x09-\x0D]',' ','g'),' +'), lambda x: x<>'') ws from documents),
u as (select doc_id, unnest(ws) word, generate_subscripts(ws,1) i, len(ws) n from w),
k as (select doc_id, i, n, word, md5(string_agg(word,' ') over (partition by doc_id order by i rows between current row and 49 following)) h from u),
f as (select h, min(doc_id) first from k where i<=n-49 group by 1),
b as (select k.doc_id, k.i, k.word, (k.i<=k.n-49 and f.first<k.doc_id)::int bad from k left join f using (h)),
c as (select doc_id, i, word, max(bad) over (partition by doc_id order by i rows between 49 preceding and current row) gone from b),
o as (select doc_id, count(*) n_words, sum(gone)::bigint n_removed, coalesce(string_agg(word,' ' order by i) filter (where gone=0),'') kept from c group by 1)
select d.doc_id, coalesce(n_words,0) n_words, coalesce(n_removed,0) n_removed, sha256(coalesce(kept,'')) kept_sha256 from documents d left join o using (doc_id)""",
}
