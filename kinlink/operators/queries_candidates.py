"""Registered queries: candidate merging, enrichment, recall, uniqueness joins, rivals, LSH and decisions over lists. lineitem serves as
lists (ref = order, tgt = part), part as records, as in the other query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.functions import text as X
from kinlink.operators import blocking as B
from kinlink.operators import candidates as K
from kinlink.operators import decide as D
from kinlink.operators.queries_block import P, R, _list, expanded, records, scored_pairs, tasks_for
from kinlink.operators.queries_decide import T, lists

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


L = T + ", li as (select l_orderkey ref, l_partkey tgt, max(l_extendedprice) price, max(l_discount) discount from lineitem group by 1,2), f as (select ref, tgt, price score from li where price > 20000), v as (select ref, tgt, discount score from li where discount > 0.03)"


def routes(spark, d) -> dict[str, DataFrame]:
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("ref"), F.col("l_partkey").alias("tgt")).agg(F.max("l_extendedprice").alias("price"), F.max("l_discount").alias("discount"))
    return {"fwd": li.where("price > 20000").select("ref", "tgt", F.col("price").alias("score")), "rev": li.where("discount > 0.03").select("ref", "tgt", F.col("discount").alias("score"))}


@query(L + " select coalesce(f.ref,v.ref) ref, coalesce(f.tgt,v.tgt) tgt, coalesce(f.score,0) fwd, coalesce(v.score,0) rev, (f.ref is not null)::int+(v.ref is not null)::int hits from f full join v on f.ref=v.ref and f.tgt=v.tgt")
def jn14_outer_merge(spark, d):
    return K.merged(routes(spark, d))


@query(L + " select ref, tgt, score from f where ref in (select o_orderkey from orders where o_orderstatus='F')")
def jn15_lookup(spark, d):
    asked = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("ref"))
    return routes(spark, d)["fwd"].join(asked, "ref", "left_semi")


@query(T + " select ref, tgt, o_orderpriority priority, p_brand brand from t left join orders on o_orderkey=ref left join part on p_partkey=tgt")
def jn16_enrich(spark, d):
    o, p = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/part.parquet")
    x = lists(spark, d).select("ref", "tgt").join(o.select(F.col("o_orderkey").alias("ref"), F.col("o_orderpriority").alias("priority")), "ref", "left")
    return x.join(p.select(F.col("p_partkey").alias("tgt"), F.col("p_brand").alias("brand")), "tgt", "left").select("ref", "tgt", "priority", "brand")


@query(L + " select x.ref, x.tgt, v.score from (select distinct l_orderkey ref, l_partkey tgt from lineitem where l_linestatus='F') x join v on x.ref=v.ref and x.tgt=v.tgt")
def jn17_listed_computed(spark, d):
    listed = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("ref"), F.col("l_partkey").alias("tgt")).dropDuplicates()
    return listed.join(routes(spark, d)["rev"], ["ref", "tgt"])


@query(L + " select t.ref, t.tgt, v.score is not null found, coalesce(v.score,-1) score from t left join v on t.ref=v.ref and t.tgt=v.tgt")
def jn18_score_lookup(spark, d):
    x = lists(spark, d).select("ref", "tgt").join(routes(spark, d)["rev"], ["ref", "tgt"], "left")
    return x.select("ref", "tgt", F.col("score").isNotNull().alias("found"), F.coalesce("score", F.lit(-1.0)).alias("score"))


@query(L + " select count(*) gold, sum((f.ref is not null)::int)::bigint found, round(avg((f.ref is not null)::int),6) recall from t left join f on t.ref=f.ref and t.tgt=f.tgt where y=1")
def jn19_recall(spark, d):
    x = K.with_found(lists(spark, d).where("y = 1").select("ref", "tgt"), routes(spark, d)["fwd"])
    return x.agg(F.count("*").alias("gold"), F.sum("found").cast("long").alias("found"), F.round(F.avg("found"), 6).alias("recall"))


KEYS = R + ", k as (select *, regexp_extract(address,'[0-9]+$') num, case when id%5=0 then '' else address end addr, name||' '||(regexp_extract(address,'[0-9]+$')::int%5) name5, string_split(name,' ')[1] w1 from r)"


def keyed_records(spark, d) -> DataFrame:
    num = F.regexp_extract("address", "[0-9]+$", 0)
    r = records(spark, d).withColumn("num", num).withColumn("addr", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("address")))
    return r.withColumn("name5", F.concat_ws(" ", "name", (num.cast("int") % 5).cast("string"))).withColumn("w1", F.split("name", " ")[0])


@query(KEYS + ", u as (select country, name5, min(id) ref from k where src=0 group by 1,2 having count(*)=1) select ref, b.id tgt from u join k b using(country,name5) where b.src=1 and b.addr=''")
def jn21_unique_core_blank(spark, d):
    r = keyed_records(spark, d)
    return B.unique_join(r.where("src = 0").withColumnRenamed("id", "ref"), r.where("src = 1 and addr = ''").select("country", "name5", F.col("id").alias("tgt")), ["country", "name5"]).select("ref", "tgt")


@query(KEYS + ", acc as (select x.id ref, y.addr a from k x join k y on x.country=y.country and x.name5=y.name5 where x.src=0 and y.src=1 and y.addr<>''), s as (select distinct ref, a from (select id ref, addr a from k where src=0 and addr<>'' union all select * from acc)), u as (select a, min(ref) ref from s group by 1 having count(*)=1) select ref, b.id tgt from u join k b on b.addr=a where b.src=2")
def jn22_unique_address_set(spark, d):
    """Addresses of a reference and of the copies it has accepted; those that stand for one reference only bring in more records."""
    r = keyed_records(spark, d)
    own = r.where("src = 0 and addr <> ''").select(F.col("id").alias("ref"), "addr")
    copies = r.where("src = 0").select("country", "name5", F.col("id").alias("ref")).join(r.where("src = 1 and addr <> ''").select("country", "name5", "addr"), ["country", "name5"]).select("ref", "addr")
    return B.unique_join(own.unionByName(copies).distinct(), r.where("src = 2 and addr <> ''").select("addr", F.col("id").alias("tgt")), ["addr"]).select("ref", "tgt")


SORTED = "array_to_string(list_sort(string_split(addr,' ')),' ')"


@query(KEYS + f", s as (select id, src, country, {SORTED}||w1 a from k where addr<>'' and len(string_split(addr,' '))>=3 and regexp_matches(addr,'[0-9]')), u as (select country, a, min(id) ref from s where src=0 group by 1,2 having count(*)=1) select ref, b.id tgt from u join s b using(country,a) where b.src<>0")
def jn23_sorted_address(spark, d):
    r = keyed_records(spark, d)
    s = r.where(F.col("addr").rlike("[0-9]") & (F.size(F.split("addr", " ")) >= 3)).withColumn("a", F.concat(F.array_join(F.array_sort(F.split("addr", " ")), " "), "w1"))
    return B.unique_join(s.where("src = 0").withColumnRenamed("id", "ref"), s.where("src <> 0").select("country", "a", F.col("id").alias("tgt")), ["country", "a"]).select("ref", "tgt")


@query(T + " select ref, tgt, p from t where ref in (select o_orderkey from orders where o_custkey%7=0)")
def jn25_semi(spark, d):
    ids = spark.read.parquet(f"{d}/orders.parquet").where("o_custkey % 7 = 0").select(F.col("o_orderkey").alias("ref"))
    return lists(spark, d).join(ids, "ref", "left_semi").select("ref", "tgt", "p")


@query(T + " select a.ref, a.tgt, count(b.tgt) siblings, coalesce(max(b.p),0) best_sibling from t a left join t b on a.ref=b.ref and a.tgt<>b.tgt and b.p>=0.5 group by 1,2")
def jn26_siblings(spark, d):
    """Each candidate against the accepted ones of its list: counts and the two best serve all, no pairs are made."""
    t = lists(spark, d).withColumn("acc", F.col("p") >= 0.5)
    w = Window.partitionBy("ref")
    top = Window.partitionBy("ref").orderBy(F.desc(F.col("acc").cast("int")), F.desc("p"), "tgt")
    x = t.withColumn("n", F.sum(F.col("acc").cast("long")).over(w)).withColumn("k", F.row_number().over(top))
    first, second = F.max(F.when(F.col("acc") & (F.col("k") == 1), F.col("p"))).over(w), F.max(F.when(F.col("acc") & (F.col("k") == 2), F.col("p"))).over(w)
    x = x.withColumn("p1", first).withColumn("p2", second)
    return x.select("ref", "tgt", (F.col("n") - F.col("acc").cast("long")).alias("siblings"), F.coalesce(F.when(F.col("acc") & (F.col("k") == 1), F.col("p2")).otherwise(F.col("p1")), F.lit(0.0)).alias("best_sibling"))


@query(KEYS + ", c as (select country, name, count(*) n from k where src=0 group by 1,2), clear as (select country, name, sum((addr<>'')::int)::bigint clear, sum((addr='')::int)::bigint blank from k where src<>0 group by 1,2) select id ref, least(n-1,200) rivals, coalesce(clear,0) clear_copies, coalesce(blank,0) blank_copies from k join c using(country,name) left join clear using(country,name) where src=0")
def jn27_rivals(spark, d):
    r = keyed_records(spark, d)
    c = r.where("src = 0").groupBy("country", "name").agg(F.count("*").alias("n"))
    copies = r.where("src <> 0").groupBy("country", "name").agg(F.sum((F.col("addr") != "").cast("long")).alias("clear_copies"), F.sum((F.col("addr") == "").cast("long")).alias("blank_copies"))
    x = r.where("src = 0").join(c, ["country", "name"]).join(copies, ["country", "name"], "left").fillna(0, subset=["clear_copies", "blank_copies"])
    return x.select(F.col("id").alias("ref"), F.least(F.col("n") - 1, F.lit(200)).alias("rivals"), "clear_copies", "blank_copies")


@query(L + ", o as (select ref, tgt from f union select ref, tgt from v), s as (select o.ref, o.tgt, t.p from o join t on o.ref=t.ref and o.tgt=t.tgt) select a.ref, a.tgt, round(a.p-coalesce((select max(b.p) from s b where b.tgt=a.tgt and b.ref<>a.ref),0),6) margin from s a")
def jn28_owner_margin(spark, d):
    r = routes(spark, d)
    owners = r["fwd"].select("ref", "tgt").unionByName(r["rev"].select("ref", "tgt")).distinct()
    claims = owners.join(lists(spark, d), ["ref", "tgt"]).select("ref", "tgt", F.col("p").alias("score"))
    return K.rivals(claims).select("ref", "tgt", F.round("margin", 6).alias("margin"))


W2 = R + ", w as (select distinct id, src, unnest(list_filter(string_split(name,' '), lambda x: length(x)>2)) w from r)"


@query(W2 + " select a.id ref, b.id tgt from w a join w b on a.w=b.w where a.src=0 and b.src=1 and a.id%50=0 group by 1,2 having count(*)=2")
def jn31_conjunctive(spark, d):
    """Records that have both long words of a query's name. Queries: ids divisible by 50. Words are met and counted between the different
    sets of words, and the records of two such sets are expanded in blocks."""
    words = F.filter(F.split("name", " "), lambda w: F.length(w) > 2)
    r = records(spark, d).groupBy("src", "id").agg(F.array_distinct(F.flatten(F.collect_list(words))).alias("x")).withColumn("x", F.array_sort("x"))
    a, b = r.where("src = 0 and id % 50 = 0").select("id", "x"), r.where("src = 1").select("id", F.col("x").alias("y"))
    each = lambda t, c: t.select(c).distinct().withColumn("w", F.explode(c))
    two = each(a, "x").join(each(b, "y"), "w").groupBy("x", "y").agg(F.count("*").alias("n")).where("n = 2").select("x", F.col("y").alias("k"))
    return expanded(B.class_pairs(a.join(two, "x"), b.withColumn("k", F.col("y")), ["k"], tasks_for(spark, d)))


@query(R + " select country, name, count(*) filter (where src=0) n_first, count(*) filter (where src<>0) n_others from r group by 1,2")
def ag02_key_counts(spark, d):
    n = lambda c: F.sum(c.cast("long"))
    return records(spark, d).groupBy("country", "name").agg(n(F.col("src") == 0).alias("n_first"), n(F.col("src") != 0).alias("n_others"))


@query(R + " select address, count(distinct name) names from r where src<>0 group by 1")
def ag03_names_per_address(spark, d):
    return records(spark, d).where("src <> 0").groupBy("address").agg(F.countDistinct("name").alias("names"))


@query(KEYS + " select country, w1, src, count(*) filter (where addr<>'') clear, count(*) filter (where addr='') blank from k group by 1,2,3")
def ag04_copy_counts(spark, d):
    n = lambda c: F.sum(c.cast("long"))
    return keyed_records(spark, d).groupBy("country", "w1", "src").agg(n(F.col("addr") != "").alias("clear"), n(F.col("addr") == "").alias("blank"))


@query(T + " select ref, string_agg(tgt::varchar, ',' order by tgt) tgts from t where p>=0.5 group by 1")
def ag05_sets(spark, d):
    s = F.array_sort(F.collect_set("tgt"))
    return lists(spark, d).where("p >= 0.5").groupBy("ref").agg(F.array_join(F.transform(s, lambda x: x.cast("string")), ",").alias("tgts"))


RK = T + ", k as (select *, row_number() over(partition by ref order by p desc,tgt) k from t)"


@query(RK + ", c as (select unnest([1,2,3,5]) cut), x as (select cut, ref, sum(y) gold, sum((k<=cut)::int) n, sum(case when k<=cut then y else 0 end) hit from k, c group by 1,2) select cut, round(sum(hit)*1.0::double/sum(gold),6) recall, round(avg(n),6) mean_n, max(n)::bigint max_n, sum((gold>0 and hit=0)::int)::bigint refs_lost from x group by 1")
def ag12_cut_sweep(spark, d):
    return K.cut_sweep(lists(spark, d).withColumn("k", F.row_number().over(D.ranked())), [1, 2, 3, 5])


@query(T + ", x as (select ref, sum(y) gold, sum((p>=0.5)::int) links, sum((p>=0.5 and y=1)::int) tp, count(*) n from t group by 1) select case when gold=0 then 'none' when gold=1 then 'one' else 'many' end size, case when links=0 and gold>0 then 'empty' when tp<gold and links>tp then 'both' when tp<gold then 'missed' when links>tp then 'false' else 'right' end kind, count(*) refs, sum(gold-tp)::bigint missed, sum(links-tp)::bigint wrong from x group by 1,2")
def ag19_loss_by_kind(spark, d):
    i = lambda c: F.sum(c.cast("long"))
    x = lists(spark, d).groupBy("ref").agg(F.sum("y").alias("gold"), i(F.col("p") >= 0.5).alias("links"), i((F.col("p") >= 0.5) & (F.col("y") == 1)).alias("tp"))
    size = F.when(F.col("gold") == 0, "none").when(F.col("gold") == 1, "one").otherwise("many")
    kind = F.expr("case when links=0 and gold>0 then 'empty' when tp<gold and links>tp then 'both' when tp<gold then 'missed' when links>tp then 'false' else 'right' end")
    return x.groupBy(size.alias("size"), kind.alias("kind")).agg(F.count("*").alias("refs"), F.sum(F.col("gold") - F.col("tp")).alias("missed"), F.sum(F.col("links") - F.col("tp")).alias("wrong"))


@query(L + ", s as (select t.ref, t.tgt, p, row_number() over(partition by t.tgt order by p desc, t.ref) rk, max(p) over(partition by t.tgt) top from t) select ref, tgt, rk::bigint rk, round(top-p,6) gap, (select count(*) from s b where b.tgt=s.tgt and b.ref<>s.ref and abs(round(b.p*1000)-round(s.p*1000))<=20) close from s where rk<=20")
def wn14_reverse_competition(spark, d):
    """Rank of the reference among a target's, the gap to its best, and how many others are within 0.02: a frame over values counts them."""
    by = Window.partitionBy("tgt")
    x = lists(spark, d).withColumn("rk", F.row_number().over(by.orderBy(F.desc("p"), "ref")).cast("long")).withColumn("m", F.round(F.col("p") * 1000).cast("long"))
    x = x.withColumn("close", F.count("*").over(by.orderBy("m").rangeBetween(-20, 20)) - 1).withColumn("top", F.max("p").over(by))
    return x.where("rk <= 20").select("ref", "tgt", "rk", F.round(F.col("top") - F.col("p"), 6).alias("gap"), "close")


@query(L + " select ref, tgt from f union select ref, tgt from v")
def st02_union(spark, d):
    r = routes(spark, d)
    return r["fwd"].select("ref", "tgt").unionByName(r["rev"].select("ref", "tgt")).distinct()


@query(T + ", k as (select *, row_number() over(partition by ref order by p desc, y desc, tgt) k from t) select ref, tgt, k::bigint k from k")
def so01_multi_key_order(spark, d):
    return lists(spark, d).select("ref", "tgt", F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("p"), F.desc("y"), "tgt")).cast("long").alias("k"))


@query(T + " select ref, tgt, p from t order by p desc, ref, tgt limit 50")
def so02_global_top(spark, d):
    return lists(spark, d).select("ref", "tgt", "p").orderBy(F.desc("p"), "ref", "tgt").limit(50)


@query(RK + " select ref, tgt from k where k<=3")
def so03_grouped_top(spark, d):
    return lists(spark, d).withColumn("k", F.row_number().over(D.ranked())).where("k <= 3").select("ref", "tgt")


@query("with o as (select o_orderkey id, o_orderpriority country, o_orderstatus='F' single, sha256('11:'||o_orderkey::varchar) h from orders), k as (select *, row_number() over(partition by country, single order by h, id) k from o), m as (select id from k where k<=5) select m.id ref, t.tgt from m left join (select distinct l_orderkey ref, l_partkey tgt from lineitem where l_returnflag='R') t on t.ref=m.id")
def sa02_stratified(spark, d):
    """A fixed number from each stratum, with all gold links of those chosen."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ref"), F.col("o_orderpriority").alias("country"), (F.col("o_orderstatus") == "F").alias("single"))
    h = F.sha2(F.concat(F.lit("11:"), F.col("ref").cast("string")), 256)
    m = o.withColumn("k", F.row_number().over(Window.partitionBy("country", "single").orderBy(h, "ref"))).where("k <= 5").select("ref")
    gold = spark.read.parquet(f"{d}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("ref"), F.col("l_partkey").alias("tgt")).distinct()
    return m.join(gold, "ref", "left")


@query("select o_orderkey ref, (('0x'||substr(sha256('s:'||o_orderkey::varchar),1,8))::bigint % 8)::bigint shard from orders")
def sa03_shard(spark, d):
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("s:"), F.col("o_orderkey").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ref"), (h % 8).alias("shard"))


@query("select o_orderkey ref from orders order by sha256('lc:'||o_orderkey::varchar), o_orderkey limit 400")
def sa04_learning_subset(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ref")).orderBy(F.sha2(F.concat(F.lit("lc:"), F.col("ref").cast("string")), 256), "ref").limit(400)


GR = R + ", n as (select distinct name from r), g as (select distinct name id, unnest(list_transform(range(1, greatest(2, length(name)-1)), lambda i: substr(name,i,3))) gram from n)"


def gram_sets(spark, d) -> DataFrame:
    n = records(spark, d).select(F.col("name").alias("id")).distinct()
    return n.select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("id") - 2)), lambda i: F.substring("id", i, F.lit(3))))).alias("gram"))


MH = GR + ", m as (select id, [" + ",".join(f"min(md5('{s}:'||gram))" for s in range(24)) + "] sig from g group by 1)"
BD = MH + ", b as (select id, b band, md5(array_to_string(sig[b*3+1:b*3+3],',')) bucket from m, (select unnest(range(0,8)) b))"


@query(MH + " select id, md5(array_to_string(sig,',')) sig from m")
def ix14_minhash(spark, d):
    return K.minhash(gram_sets(spark, d)).select("id", F.md5(F.array_join("sig", ",")).alias("sig"))


@query(BD + " select id, band::int band, bucket from b")
def ix15_bands(spark, d):
    return K.bands(K.minhash(gram_sets(spark, d)))


@query(BD + ", ok as (select band from (select band, bucket, count(*) n from b group by 1,2) group by 1 having sum(n*n)<=500000) select distinct x.id ref, y.id tgt from b x join b y using(band,bucket) join ok using(band) where x.id<>y.id")
def jn08_minhash_join(spark, d):
    b = K.bands(K.minhash(gram_sets(spark, d)))
    return K.banded_pairs(b, b).where("ref <> tgt")


SH = GR + ", t as (select unnest(range(0,6)) t), s as (select id, t, b, case when sum(('0x'||substr(md5(t||':'||b||':'||gram),1,1))::int%2*2-1)>0 then '1' else '0' end bit from g, t, (select unnest(range(0,16)) b) group by 1,2,3), sh as (select id, t::int band, string_agg(bit,'' order by b) bucket from s group by 1,2)"


@query(SH + " select id, band, bucket from sh")
def ix16_simhash(spark, d):
    return K.simhash(gram_sets(spark, d).select("id", F.col("gram").alias("term"), F.lit(1).alias("weight")))


@query(SH + " select distinct x.id ref, y.id tgt from sh x join sh y using(band,bucket) where x.id<>y.id")
def jn06_simhash_join(spark, d):
    b = K.simhash(gram_sets(spark, d).select("id", F.col("gram").alias("term"), F.lit(1).alias("weight")))
    return K.banded_pairs(b, b).where("ref <> tgt")


@query(R + ", a as (select country, name k, count(*) n from r where src=0 group by 1,2), b as (select country, name k, count(*) n from r where src=1 group by 1,2) select country, k from a join b using(country,k) where a.n*b.n<=500000 and a.n<=50 and b.n<=50")
def jn07_safe_keys(spark, d):
    r = records(spark, d).withColumnRenamed("name", "k")
    return B.precheck(r.where("src = 0"), r.where("src = 1"), ["country", "k"]).where("pairs <= 500000 and n_left <= 50 and n_right <= 50").select("country", "k")


@query(GR + ", df as (select gram, count(*) df from g group by 1) select gram, df from df where df>=2")
def ix10_vocabulary(spark, d):
    return gram_sets(spark, d).groupBy("gram").agg(F.count("*").alias("df")).where("df >= 2")


@query(GR + ", q as (select distinct gram from g where id like 's%'), p as (select gram, count(*) n from g group by 1 having count(*)<=20) select gram, id from g where gram in (select gram from q) and gram in (select gram from p)")
def ix13_focused_postings(spark, d):
    """Postings of the terms that queries have; a posting list over the limit goes as a whole, which is the operator's meaning."""
    g = gram_sets(spark, d)
    few = g.groupBy("gram").agg(F.count("*").alias("n")).where("n <= 20").select("gram")
    return g.join(g.where("id like 's%'").select("gram").distinct(), "gram", "left_semi").join(few, "gram", "left_semi").select("gram", "id")


@query(GR + " select gram, count(*) df, string_agg(id, '|' order by id) ids from g group by 1")
def ix07_postings(spark, d):
    return gram_sets(spark, d).groupBy("gram").agg(F.count("*").alias("df"), F.array_join(F.array_sort(F.collect_set("id")), "|").alias("ids"))


@query()
def ag15_expected_f05(spark, d):
    """Tested against all outcomes of short lists."""
    x = lists(spark, d).groupBy("ref").agg(F.array_sort(F.collect_list("p"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("ps"), F.sum((F.col("p") >= 0.5).cast("int")).cast("int").alias("m"))
    return x.select("ref", F.col("m").cast("long").alias("links"), F.round(K.poisson_binomial_f05(F.col("ps"), F.col("m")), 9).alias("expected_f05"))


@query()
def dc03_exact_decision(spark, d):
    """The prefix of each list with the largest exact expectation; tested against all outcomes of short lists."""
    x = lists(spark, d).groupBy("ref").agg(F.array_sort(F.collect_list("p"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("ps"))
    x = x.select("ref", "ps", F.explode(F.sequence(F.lit(0), F.size("ps"))).alias("m")).withColumn("v", F.round(K.poisson_binomial_f05(F.col("ps"), F.col("m")), 9))
    return x.groupBy("ref").agg(F.max_by("m", F.struct("v", -F.col("m"))).cast("long").alias("links"), F.max("v").alias("expected_f05"))


@query(RK + ", x as (select *, max(p) over(partition by ref) top from k) select ref, tgt, p from x where p>=0.8 or (top<0.8 and k=1 and p>=0.4)")
def dc07_empty_guard(spark, d):
    x = lists(spark, d).withColumn("k", F.row_number().over(D.ranked())).withColumn("top", F.max("p").over(Window.partitionBy("ref")))
    return x.where("p >= 0.8 or (top < 0.8 and k = 1 and p >= 0.4)").select("ref", "tgt", "p")


@query(T + " select (ref%4)::int shard, count(distinct ref) refs, count(*) n from t group by 1 union all select -1, count(distinct ref), count(*) from t")
def dc15_merged_shards(spark, d):
    """Shards are put together; a reference in two shards, or in none, raises before anything is returned."""
    t = lists(spark, d)
    shards = [t.where(F.col("ref") % 4 == i).withColumn("shard", F.lit(i)) for i in range(4)]
    whole = shards[0].unionByName(shards[1]).unionByName(shards[2]).unionByName(shards[3])
    owners = whole.select("ref", "shard").distinct().groupBy("ref").agg(F.count("*").alias("n"))
    bad = t.select("ref").distinct().join(owners, "ref", "left").where("n is null or n <> 1").limit(1).count()
    if bad:
        raise ValueError("a reference is in no shard, or in two")
    by = whole.groupBy("shard").agg(F.countDistinct("ref").alias("refs"), F.count("*").alias("n"))
    return by.unionByName(whole.agg(F.countDistinct("ref").alias("refs"), F.count("*").alias("n")).withColumn("shard", F.lit(-1)))


@query(T + ", a as (select sum(y)::bigint tp, count(*) n from t where p>=0.7), b as (select sum(y)::bigint tp, count(*) n from t where p>=0.5 and p<0.7), g as (select sum(y)::bigint g from t) select b.n added, round(b.tp*1.0::double/b.n,6) hit_rate, round((5.0::double*a.tp/(a.n*4+a.tp+(g-a.tp)))*4/5,6) break_even from a,b,g")
def dc20_break_even(spark, d):
    """Precision that added links need, so that F0.5 = 5tp/(4 links + gold) does not fall: four fifths of the F0.5 before."""
    s = lambda c, v: F.sum(F.when(c, v).otherwise(0)).cast("double")
    base, more = F.col("p") >= 0.7, (F.col("p") >= 0.5) & (F.col("p") < 0.7)
    x = lists(spark, d).agg(s(base, 1).alias("n"), s(base, F.col("y")).alias("tp"), s(more, 1).alias("added"), s(more, F.col("y")).alias("hit"), F.sum("y").alias("g"))
    return x.select(F.col("added").cast("long").alias("added"), F.round(F.col("hit") / F.col("added"), 6).alias("hit_rate"), F.round(5.0 * F.col("tp") / (4.0 * F.col("n") + F.col("g")) * 4 / 5, 6).alias("break_even"))


@query(T + ", z as (select y, ln(greatest(p,1e-3::double)/(1-least(p,0.999::double))) z from t) select y, round(quantile_cont(z,0.1),6) p10, round(quantile_cont(z,0.5),6) p50, round(quantile_cont(z,0.1)-(select quantile_cont(z,0.1) from z),6) shift, quantile_cont(z,0.1)-(select quantile_cont(z,0.1) from z)<-2 flag from z group by 1")
def ag17_logit_shift(spark, d):
    z = lists(spark, d).select("y", F.log(F.greatest("p", F.lit(1e-3)) / (1 - F.least("p", F.lit(0.999)))).alias("z"))
    q = lambda x: F.percentile("z", F.lit(x))
    whole = z.agg(q(0.1).alias("w"))
    x = z.groupBy("y").agg(q(0.1).alias("a"), q(0.5).alias("b")).join(F.broadcast(whole))
    return x.select("y", F.round("a", 6).alias("p10"), F.round("b", 6).alias("p50"), F.round(F.col("a") - F.col("w"), 6).alias("shift"), (F.col("a") - F.col("w") < -2).alias("flag"))


@query(GR + ", h as (select gram, (substr(md5(id),1,1) in ('0','1','2','3','4','5','6','7'))::int part, count(*) df from g group by 1,2) select gram, sum(df)::bigint df from h group by 1")
def ag21_partial_final(spark, d):
    h = gram_sets(spark, d).groupBy("gram", (F.substring(F.md5("id"), 1, 1) < "8").alias("part")).agg(F.count("*").alias("df"))
    return h.groupBy("gram").agg(F.sum("df").alias("df"))


@query(P + " select ref, tgt, round(jaro_winkler_similarity(n1,n2),6) s from pr")
def sm05_jaro_winkler(spark, d):
    return scored_pairs(spark, d, F.col("n1"), F.col("n2"), s=F.round(X.jaro_winkler("x", "y"), 6))


@query(P + f", w as (select ref, tgt, n1, n2, list_distinct(list_filter(string_split(n1,' '), lambda w: w not in {_list(X.STOP)})) a, list_distinct(list_filter(string_split(n2,' '), lambda w: w not in {_list(X.STOP)})) b from pr) select ref, tgt, case when n1=n2 then 'exact' when len(a)>0 and list_sort(a)=list_sort(b) then 'same_core' when len(b)=0 then 'only_legal' when not list_has_any(a,b) then case when len(b)=1 then 'invented1' else 'none_multi' end when len(list_intersect(a,b))=len(b) and len(b)<len(a) then 'dropped_word' when len(list_intersect(a,b))=len(a) and len(a)<len(b) then 'added_word' when len(a)=len(b) and len(a)-len(list_intersect(a,b))=1 then 'swapped_word' else 'partial' end rel from w")
def sm12_name_relation(spark, d):
    return scored_pairs(spark, d, F.col("n1"), F.col("n2"), rel=X.name_relation(F.col("x"), F.col("y")))
