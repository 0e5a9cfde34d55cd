"""Registered queries: keys of names and addresses, on the records of queries_block."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlink.functions import keys as K
from kinlink.functions import text as T
from kinlink.operators import blocking as B
from kinlink.operators.queries_block import P, R, TOK, expanded, keyed, records, tasks_for

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _list(words) -> str:
    return "(" + ",".join(f"'{w}'" for w in words) + ")"


def _each(spark, d, **cols):
    return records(spark, d).select("id", *(c.alias(n) for n, c in cols.items()))


NAME, ADDRESS = "name", "address"
PLAIN = "regexp_replace({}, '^0+([0-9])', '\\1')"
#: Each row with its tokens and the number tokens among them.
N = R + f", t as (select *, {TOK.format('address')} t from r), n as (select *, list_transform(list_filter(t, lambda w: regexp_full_match(w,'[0-9]+')), lambda w: {PLAIN.format('w')}) n from t)"
WORD = "length({0})>=3 and not regexp_matches({0},'[0-9]')"
#: Distinct words of the benchmark, as a vocabulary for sound keys.
V = "with v as (select distinct unnest(list_filter(string_split(regexp_replace(lower(text),'[^a-z0-9]+',' ','g'),' '), lambda w: w<>'')) w from benchmark)"


def _words(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    return b.select(F.explode(T.tokens(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))).alias("w")).distinct()


def _sound_sql() -> str:
    w = "w"
    for a, b in K.SOUNDS:
        w = f"replace({w},'{a}','{b}')"
    w = f"regexp_replace(regexp_replace({w},'c([eiy])','s\\1','g'),'g([ei])','j\\1','g')"
    w = f"regexp_replace(replace({w},'c','k'),'^y([aeiou])','\\1')"
    return f"regexp_replace({w},'^[aeiou]','a')"


S = V + f", a as (select w, {_sound_sql()} a from v where w not in {_list(K.SOUND_STOP)} and not regexp_full_match(w,'[0-9]+')), b as (select w, string_split(substr(a,1,1)||regexp_replace(substr(a,2),'[aeiouyh]','','g'),'') c from a), s as (select w, array_to_string(list_filter(c, lambda x, i: i=1 or c[i-1]<>x),'') k from b)"


@query(R + ", x as (select id, case id%3 when 0 then 'US' when 1 then 'India' else 'Japan' end c, lpad((id*37%100000)::varchar,5,'0') z from r) select id, case when c='US' then z||' '||z||'-0001' when c='India' then (case when substr(z,1,1)='0' then '' else z||'1' end) else '' end codes from x")
def tx06_postal(spark, d):
    r = records(spark, d)
    c = F.when(F.col("src") == 0, "US").when(F.col("src") == 1, "India").otherwise("Japan")
    z = F.lpad((F.col("id") * 37 % 100000).cast("string"), 5, "0")
    text = F.concat(F.lit("at "), z, F.lit("-0001, "), z, F.lit(", "), z, F.lit("1"))
    return r.select("id", F.array_join(K.postal_codes(text, c), " ").alias("codes"))


@query(R + f" select id, array_to_string(list_filter({TOK.format('name')}, lambda w: w not in {_list(T.LEGAL)}),' ') core from r")
def tx07_core_name(spark, d):
    return _each(spark, d, core=K.drop_legal(F.col(NAME)))


@query("select doc_id, regexp_matches(text,'[ऀ-෿]') indic from documents")
def tx09_has_indic(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", K.has_indic(F.col("text")).alias("indic"))


@query(S + " select w, k from s")
def tx10_phonetic(spark, d):
    w = _words(spark, d).where(~F.col("w").isin(*K.SOUND_STOP) & ~F.col("w").rlike("^[0-9]+$"))
    return w.select("w", K.sound(F.col("w")).alias("k"))


@query(R + ", w as (select id, ' '||unnest(" + TOK.format("name") + ")||' ' p from r), g as (select id, p, unnest([3,4,5]) n from w), x as (select id, unnest(list_transform(range(1, greatest(2, length(p)-n+2)), lambda i: substr(p,i,n))) gram from g) select id, gram, count(*) tf from x group by 1,2")
def tx17_char_wb(spark, d):
    return records(spark, d).select("id", F.explode(T.grams(F.col(NAME), 3, 5)).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))


@query(S + ", g as (select ' '||k||' ' p, unnest([2,3,4]) n from s), x as (select unnest(list_transform(range(1, greatest(2, length(p)-n+2)), lambda i: substr(p,i,n))) gram from g) select gram, count(*) n from x group by 1")
def tx18_phonetic_grams(spark, d):
    keys = tx10_phonetic(spark, d)
    return keys.select(F.explode(T.grams(F.col("k"), 2, 4)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(R + ", g as (select id, name, unnest([3,4,5]) n from r), x as (select id, unnest(list_transform(range(1, greatest(1, length(name)-n+2)), lambda i: substr(name,i,n))) gram from g) select id, gram, count(*) tf from x group by 1,2")
def tx19_char_grams(spark, d):
    return records(spark, d).select("id", F.explode(K.plain_grams(F.col(NAME), 3, 5)).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))


@query(
    N
    + ", e as (select id, unnest(t) w, generate_subscripts(t,1) i from n), x as (select a.id, a.i, b.w, b.i<a.i side, abs(b.i-a.i) far, unnest(regexp_extract_all(a.w,'[0-9]+')) num from e a join e b on a.id=b.id and abs(a.i-b.i) between 1 and 2 where "
    + WORD.format("b.w")
    + "), y as (select *, min(far) over (partition by id, i, side) least from x)"
    + f" select id, array_to_string(list_sort(list_distinct(list({PLAIN.format('num')}||'|'||w))),' ') k from y where far=least group by id"
)
def tx20_anchors(spark, d):
    return _each(spark, d, k=F.array_join(K.anchors(F.col(ADDRESS)), " ")).where("k <> ''")


@query(N + ", df as (select w, count(*) df from (select distinct id, unnest(t) w from n where src=0) group by 1 having count(*)<3000), e as (select id, n[1] num, unnest(list_distinct(t)) w from n where len(n)>0 and n[1]<>'0') select id, num||'|'||w k from e join df using (w) where " + WORD.format("w") + f" and w not in {_list(T.GENERIC)}")
def tx21_rare_word_keys(spark, d):
    """First number with each street word that few records of the first source have; the word table is joined, not collected."""
    r = records(spark, d).withColumn("num", F.get(K.number_tokens(F.col(ADDRESS)), F.lit(0)))
    words = r.select("id", "src", "num", F.explode(F.array_distinct(T.tokens(F.col(ADDRESS)))).alias("w"))
    rare = words.where("src = 0").groupBy("w").agg(F.count("*").alias("df")).where("df < 3000")
    return words.where((F.col("num") != "0") & K.is_word(F.col("w")) & ~F.col("w").isin(*T.GENERIC)).join(rare, "w").select("id", F.concat_ws("|", "num", "w").alias("k"))


@query(N + f" select id, concat_ws('|', n[1], array_to_string(list_sort(list_distinct(list_filter(t, lambda w: {WORD.format('w')})))[1:6],' ')) k from n")
def tx22_address_key(spark, d):
    return _each(spark, d, k=K.address_key(F.col(ADDRESS)))


@query(N + " select id, coalesce(n[1],'') first_num, coalesce(n[2],'') second_num from n")
def tx24_first_numbers(spark, d):
    n = K.number_tokens(F.col(ADDRESS))
    return _each(spark, d, first_num=F.coalesce(F.get(n, F.lit(0)), F.lit("")), second_num=F.coalesce(F.get(n, F.lit(1)), F.lit("")))


@query(R + f", x as (select id, case id%4 when 0 then 'suite '||id when 1 then 'unit  b'||id when 2 then 'suites '||id else '' end||' '||address a from r) select id, regexp_extract(a,'{K.UNIT}',1) unit from x")
def tx25_unit(spark, d):
    i = F.col("id").cast("string")
    lead = F.when(F.col("id") % 4 == 0, F.concat(F.lit("suite "), i)).when(F.col("id") % 4 == 1, F.concat(F.lit("unit  b"), i)).when(F.col("id") % 4 == 2, F.concat(F.lit("suites "), i)).otherwise("")
    return _each(spark, d, unit=K.unit_of(F.concat(lead, F.lit(" "), ADDRESS)))


@query(R + " select id, case id%3 when 0 then 'sarl' when 1 then 'ei,sas' else '' end forms from r")
def tx26_legal_forms(spark, d):
    mark = F.when(F.col("src") == 0, " S.A.R.L.").when(F.col("src") == 1, " (SAS), e.i").otherwise(" sales")
    return _each(spark, d, forms=F.array_join(K.legal_forms(F.concat(NAME, mark)), ","))


@query(R + ", x as (select id, name, case when id%2=0 then split_part(name,' ',1)||' works' end other from r) select id, name main, other from x")
def tx28_alias(spark, d):
    full = F.concat(NAME, F.when(F.col("id") % 2 == 0, F.concat(F.lit(" dba "), F.split(NAME, " ")[0], F.lit(" works"))).otherwise(""))
    parts = K.alias_parts(full)
    return _each(spark, d, main=parts[0], other=F.get(parts, F.lit(1)))


@query("select doc_id, case when length(text)=0 then 0.0::double else round(length(regexp_replace(text,'[\\x00-\\x7F]','','g'))::double/length(text),6) end share from documents")
def tx30_non_ascii_share(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.round(K.non_ascii_share(F.col("text")), 6).alias("share"))


@query("select distinct trim(regexp_replace(o_orderpriority,'[^A-Za-z0-9]+','_','g'),'_')||'_'||substr(sha1(o_orderpriority),1,8) dir from orders")
def tx31_country_dir(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(K.folder_of(F.col("o_orderpriority")).alias("dir")).distinct()


@query(R + f" select id, array_to_string(list_filter({TOK.format('address')}, lambda w: w not in {_list(T.STOP)} and w not in ('com','www')),'') k from r")
def tx15_squash(spark, d):
    return _each(spark, d, k=K.squash(F.col(ADDRESS)))


@query(P + ", n as (select ref, tgt, regexp_extract_all(a1,'[0-9]+') x, regexp_extract_all(a2,'[0-9]+') y from pr), e as (select ref, tgt, unnest(x) u, y from n), f as (select ref, tgt, u, unnest(y) v from e) select ref, tgt, max((starts_with(u,v) or starts_with(v,u))::int)::double s from f group by 1,2")
def sm08_number_prefix(spark, d):
    """Pairs of records that have numbers; rows of one id count as one record."""
    side = lambda x, a, v: x.groupBy("country", "first", "id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(T.numbers(F.col(a)))))).alias(v)).where(F.size(v) > 0)
    a, b = keyed(spark, d, "name", "address")
    s = B.class_pairs(side(a, "a1", "x"), side(b, "a2", "y"), ["country", "first"], tasks_for(spark, d))
    return expanded(s.select("refs", "tgts", K.number_prefix(F.col("x"), F.col("y")).alias("s")), "s")
