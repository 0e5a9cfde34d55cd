"""Registered queries over scored lists. lineitem serves as lists: ref = order, tgt = part, p a fixed function of both, y = returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.operators import decide as D

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def lists(spark, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = ((F.col("l_orderkey") * 31 + F.col("l_partkey") * 17) % 1000) / F.lit(1000.0)
    return li.groupBy(F.col("l_orderkey").alias("ref"), F.col("l_partkey").alias("tgt")).agg(F.max(p).alias("p"), F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("y"))


T = "with t as (select l_orderkey ref, l_partkey tgt, max(((l_orderkey*31+l_partkey*17)%1000)/1000.0::double) p, max(case when l_returnflag='R' then 1 else 0 end) y from lineitem group by 1,2)"
X = T + ", x as (select ref, tgt, y, case when row_number() over(partition by tgt order by p desc, ref)=1 then p else 0.0::double end p from t)"


def _expected(src: str, floor: float) -> str:
    return f""", k as (select *, row_number() over(partition by ref order by p desc, tgt) k, sum(p) over(partition by ref) s from {src}),
v as (select *, 1.25*sum(p) over(partition by ref order by k rows unbounded preceding)/(0.25*s+k) v, max(p) over(partition by ref) p1, exp(sum(ln(1-least(p,1-1e-9::double))) over(partition by ref)) e from k),
b as (select *, max(v) over(partition by ref) bv from v), z as (select *, min(case when v=bv then k end) over(partition by ref) bk from b),
sel as (select ref, tgt, p, y, (bv>e and p1>={floor} and k<=bk) sel from z)"""


FS = ", f as (select ref, sum(y)::bigint gold, sum(case when sel then 1 else 0 end)::bigint links, sum(case when sel and y=1 then 1 else 0 end)::bigint tp from sel group by 1), g as (select *, case when gold=0 then (case when links=0 then 1.0::double else 0.0::double end) else 5.0::double*tp/(5.0::double*tp+{c}::double*4*(links-tp)+(gold-tp)) end f05 from f)"
ROUTES = "with li as (select l_orderkey ref, l_partkey tgt, max(l_extendedprice) price, max(l_discount) discount from lineitem group by 1,2), a as (select ref, tgt, price score, row_number() over(partition by ref order by price desc, tgt) rank from li where price > 20000), b as (select ref, tgt, discount score, row_number() over(partition by ref order by discount desc, tgt) rank from li where discount > 0.03)"


def routes(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("ref"), F.col("l_partkey").alias("tgt")).agg(F.max("l_extendedprice").alias("price"), F.max("l_discount").alias("discount"))
    return {"price": li.where("price > 20000").select("ref", "tgt", F.col("price").alias("score")), "discount": li.where("discount > 0.03").select("ref", "tgt", F.col("discount").alias("score"))}


@query(T + " select ref, tgt, p from t where p >= 0.75")
def dc01_threshold(spark, d):
    return D.threshold(lists(spark, d), 0.75).where("sel").select("ref", "tgt", "p")


@query(X + _expected("x", 0.3) + " select ref, tgt, p from sel where sel")
def dc02_expected(spark, d):
    return D.expected(D.exclusive(lists(spark, d)), 0.3).where("sel").select("ref", "tgt", "p")


@query(X + " select ref, tgt, p from x")
def dc04_exclusive(spark, d):
    return D.exclusive(lists(spark, d)).select("ref", "tgt", "p")


@query(T + ", n as (select t.*, c_nationkey country from t join orders on ref=o_orderkey join customer on o_custkey=c_custkey) select country, count(*)::bigint links from n where p >= case when country%3=0 then 0.8 else 0.6 end group by 1")
def dc05_country_threshold(spark, d):
    o, c = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    n = lists(spark, d).join(o.select(F.col("o_orderkey").alias("ref"), "o_custkey"), "ref").join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("country")), "o_custkey")
    return n.where(F.col("p") >= F.when(F.col("country") % 3 == 0, 0.8).otherwise(0.6)).groupBy("country").agg(F.count("*").alias("links"))


@query(T + ", s as (select * from t where p>=0.5), w as (select *, sum(p) over(partition by tgt) claimed, row_number() over(partition by ref order by p desc, tgt) k from s) select ref, tgt, p, round(claimed,6) claimed from w where k=1 or not (claimed>1.2 and p/claimed<0.77)")
def dc06_overcommit_prune(spark, d):
    return D.prune_overcommitted(lists(spark, d).where("p >= 0.5")).select("ref", "tgt", "p", F.round("claimed", 6).alias("claimed"))


@query(X + _expected("x", 0.3) + FS.format(c="1.0") + " select ref, gold, links, tp, round(f05,6) f05 from g")
def dc08_f05(spark, d):
    return D.f05(D.expected(D.exclusive(lists(spark, d)), 0.3)).withColumn("f05", F.round("f05", 6))


@query(X + _expected("x", 0.3) + FS.format(c="1.0") + " select round(avg(f05),6) macro_f05, sum(links)::bigint links, count(*) refs from g")
def dc09_macro_f05(spark, d):
    return D.macro_f05(D.expected(D.exclusive(lists(spark, d)), 0.3))


@query(X + _expected("x", 0.3) + FS.format(c="2.06") + " select round(avg(f05),6) macro_f05, sum(links)::bigint links, count(*) refs from g")
def dc10_decoy_weighted(spark, d):
    return D.macro_f05(D.expected(D.exclusive(lists(spark, d)), 0.3), 2.06)


@query(T + ", r as (select unnest([0.3,0.5,0.7,0.9])::double t_), sel as (select t_, ref, y, p>=t_ sel from t, r), f as (select t_, ref, sum(y) gold, sum(case when sel then 1 else 0 end) links, sum(case when sel and y=1 then 1 else 0 end) tp from sel group by 1,2) select t_ t, round(avg(case when gold=0 then (case when links=0 then 1.0::double else 0.0 end) else 5.0::double*tp/(5*tp+4*(links-tp)+gold-tp) end),6) macro_f05 from f group by 1")
def dc11_rule_grid(spark, d):
    return D.grid(lists(spark, d), [0.3, 0.5, 0.7, 0.9])


@query(T + ", k as (select *, row_number() over(partition by ref order by p desc,tgt) k, sum(y) over(partition by ref order by p desc, tgt rows unbounded preceding) tp, sum(y) over(partition by ref) g from t), b as (select ref, case when max(g)=0 then 1.0::double else max(5.0::double*tp/(5*tp+4*(k-tp)+g-tp)) end b from k group by 1) select round(avg(b),6) ceiling, count(*) refs from b")
def dc12_oracle_ceiling(spark, d):
    return D.ceiling(lists(spark, d))


@query("select o_orderkey ref, ('0x'||substr(sha256(o_orderkey::varchar),1,8))::bigint % 100 bucket, case when ('0x'||substr(sha256(o_orderkey::varchar),1,8))::bigint % 100 < 70 then 'train' when ('0x'||substr(sha256(o_orderkey::varchar),1,8))::bigint % 100 < 85 then 'dev' else 'holdout' end part from orders")
def dc13_hash_split(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    b = D.split_bucket(F.col("o_orderkey"))
    return o.select(F.col("o_orderkey").alias("ref"), b.alias("bucket"), F.when(b < 70, "train").when(b < 85, "dev").otherwise("holdout").alias("part"))


@query()
def dc13_components(spark, d):
    from kinlink.operators.graph import connected_components

    # a ref without gold links is a component of its own; targets lie above all refs, so every root is a ref
    o = spark.read.parquet(f"{d}/orders.parquet")
    links = lists(spark, d).where("y = 1").select("ref", (F.col("tgt") + F.lit(10**12)).alias("tgt"))
    refs = o.select(F.col("o_orderkey").alias("ref"), F.col("o_orderkey").alias("tgt"))
    b = D.split_bucket(F.col("component"))
    return connected_components(links.unionByName(refs), "ref", "tgt").withColumn("bucket", b).withColumn("part", F.when(b < 70, "train").when(b < 85, "dev").otherwise("holdout"))


@query("select o_orderkey ref, ('0x'||substr(sha256(o_orderkey::varchar||'#fold'),1,8))::bigint % 100 % 2 fold from orders")
def dc14_folds(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ref"), (D.split_bucket(F.col("o_orderkey"), "#fold") % 2).alias("fold"))


@query(T + ", a as (select ref,tgt from t where p>=0.5), b as (select ref,tgt from t where p>=0.7) select m.ref, m.tgt from (select *, 1 src from a union all select *, 2 src from b) m join orders on o_orderkey=m.ref join customer on c_custkey=o_custkey where (c_nationkey=3 and src=2) or (c_nationkey<>3 and src=1)")
def dc16_country_merge(spark, d):
    t = lists(spark, d)
    own = spark.read.parquet(f"{d}/orders.parquet").join(spark.read.parquet(f"{d}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("ref"), F.col("c_nationkey").alias("n"))
    both = t.where("p >= 0.5").withColumn("src", F.lit(1)).unionByName(t.where("p >= 0.7").withColumn("src", F.lit(2)))
    return both.join(own, "ref").where("(n = 3 and src = 2) or (n <> 3 and src = 1)").select("ref", "tgt")


@query(T + " select ref, tgt from t where p>=0.5 intersect select ref, tgt from t where y=1")
def dc17_and_veto(spark, d):
    t = lists(spark, d)
    return t.where("p >= 0.5").select("ref", "tgt").intersect(t.where("y = 1").select("ref", "tgt"))


@query(T + ", l as (select ref,tgt from t where p>=0.9), n as (select ref,tgt from t where p>=0.8 and p<0.9), o as (select tgt, min(ref) ref from n group by 1 having count(distinct ref)=1) select ref,tgt from l union all select ref,tgt from o where tgt not in (select tgt from l)")
def dc18_guarded_add(spark, d):
    t = lists(spark, d)
    return D.guarded_add(t.where("p >= 0.9"), t.where("p >= 0.8 and p < 0.9"))


@query(T + ", n as (select *, row_number() over(partition by ref order by p desc,tgt) k from t), r as (select * from n where k between 3 and 6 and p>=0.3 and tgt not in (select tgt from n where k<=2 and p>=0.9)), w as (select *, row_number() over(partition by tgt order by p desc, ref) b from r) select ref,tgt,p from w where b=1")
def dc19_rank_rescue(spark, d):
    n = lists(spark, d).withColumn("k", F.row_number().over(D.ranked()))
    held = n.where("k <= 2 and p >= 0.9").select("tgt").distinct()
    r = n.where("k between 3 and 6 and p >= 0.3").join(held, "tgt", "left_anti")
    return r.withColumn("b", F.row_number().over(D.by_tgt().orderBy(F.desc("p"), "ref"))).where("b = 1").select("ref", "tgt", "p")


@query(T + " select tgt, round(sum(p),6) claimed, count(*) refs from t group by 1 having sum(p)>1.2")
def ag06_overcommit(spark, d):
    return lists(spark, d).groupBy("tgt").agg(F.sum("p").alias("s"), F.count("*").alias("refs")).where("s > 1.2").select("tgt", F.round("s", 6).alias("claimed"), "refs")


@query(T + " select ref, tgt, round(p/greatest(1.0::double, sum(p) over(partition by tgt)),9) p from t")
def ag07_exclusivity_norm(spark, d):
    return D.normalized(lists(spark, d)).select("ref", "tgt", F.round("p", 9).alias("p"))


@query(ROUTES + " select ref, tgt, 'price' route, rank from a union all select ref, tgt, 'discount', rank from b")
def wn01_route_rank(spark, d):
    w = D.by_ref().orderBy(F.desc("score"), "tgt")
    parts = [df.select("ref", "tgt", F.lit(n).alias("route"), F.row_number().over(w).cast("long").alias("rank")) for n, df in routes(spark, d).items()]
    return parts[0].unionByName(parts[1])


_RRF = ROUTES + ", u as (select *, 'price' route from a union all select *, 'discount' from b), f as (select ref, tgt, sum(1.0::double/(60+rank)) rrf, count(*) route_hits, coalesce(max(case when route='price' then score end),0.0::double) score_price, coalesce(max(case when route='price' then rank end),0) rank_price, coalesce(max(case when route='discount' then score end),0.0::double) score_discount, coalesce(max(case when route='discount' then rank end),0) rank_discount from u group by 1,2), r as (select *, row_number() over(partition by ref order by round(rrf,12) desc, tgt) fused_rank from f)"


@query(_RRF + " select ref, tgt, round(rrf,6) rrf, fused_rank from r where fused_rank<=10")
def wn02_rrf(spark, d):
    return D.rrf(routes(spark, d)).select("ref", "tgt", F.round("rrf", 6).alias("rrf"), F.col("fused_rank").cast("long").alias("fused_rank"))


@query(_RRF + " select ref, tgt, route_hits, score_price, rank_price, score_discount, rank_discount from r where fused_rank<=10")
def wn03_route_pivot(spark, d):
    return D.rrf(routes(spark, d)).select("ref", "tgt", F.col("route_hits").cast("long").alias("route_hits"), "score_price", F.col("rank_price").cast("long").alias("rank_price"), "score_discount", F.col("rank_discount").cast("long").alias("rank_discount"))


@query(_RRF + " select ref, tgt, round(score_price-max(score_price) over(partition by ref),4) gap_price, round(rrf/max(rrf) over(partition by ref),6) rrf_ratio from r where fused_rank<=10")
def wn04_gap(spark, d):
    x = D.rrf(routes(spark, d))
    return x.select("ref", "tgt", F.round(F.col("score_price") - F.max("score_price").over(D.by_ref()), 4).alias("gap_price"), F.round(F.col("rrf") / F.max("rrf").over(D.by_ref()), 6).alias("rrf_ratio"))


@query(T + " select ref, tgt, max(p) over(partition by ref) best, row_number() over(partition by ref order by p desc,tgt) rank from t")
def wn06_rank_within(spark, d):
    return lists(spark, d).select("ref", "tgt", F.max("p").over(D.by_ref()).alias("best"), F.row_number().over(D.ranked()).cast("long").alias("rank"))


@query(T + ", r as (select *, row_number() over(partition by ref order by p desc,tgt) k from t) select r.ref, r.tgt, a.tgt anchor1, b.tgt anchor2, round(r.p-a.p,6) gap, count(*) filter (where r.p>=0.8) over(partition by r.ref) strong from r join r a on a.ref=r.ref and a.k=1 left join r b on b.ref=r.ref and b.k=2")
def wn07_anchor(spark, d):
    top = lambda k: F.max(F.when(F.col("k") == k, F.col("tgt"))).over(D.by_ref())
    r = lists(spark, d).withColumn("k", F.row_number().over(D.ranked()))
    return r.select("ref", "tgt", top(1).alias("anchor1"), top(2).alias("anchor2"), F.round(F.col("p") - F.max("p").over(D.by_ref()), 6).alias("gap"), F.sum((F.col("p") >= 0.8).cast("long")).over(D.by_ref()).alias("strong"))


@query(_RRF + " select ref, tgt, case when rank_price>0 then round(1.0::double/rank_price,6) else 0.0::double end inv_price, (rank_price=1)::int top_price from r where fused_rank<=10")
def wn08_inverse_rank(spark, d):
    return D.rrf(routes(spark, d)).select("ref", "tgt", F.when(F.col("rank_price") > 0, F.round(1.0 / F.col("rank_price"), 6)).otherwise(F.lit(0.0)).alias("inv_price"), (F.col("rank_price") == 1).cast("int").alias("top_price"))


@query(T + " select ref, tgt, lag(p,1,1.0::double) over w before_p, lead(p,1,0.0::double) over w after_p from t window w as (partition by ref order by p desc,tgt)")
def wn09_lag_lead(spark, d):
    return lists(spark, d).select("ref", "tgt", F.lag("p", 1, 1.0).over(D.ranked()).alias("before_p"), F.lead("p", 1, 0.0).over(D.ranked()).alias("after_p"))


@query(T + " select ref, tgt, round(sum(p) over(partition by ref order by p desc,tgt rows unbounded preceding),6) mass from t")
def wn10_prefix_mass(spark, d):
    return lists(spark, d).select("ref", "tgt", F.round(F.sum("p").over(D.prefix()), 6).alias("mass"))


@query(T + " select ref, tgt, count(*) filter (where p>=0.9) over(partition by ref) n90, count(*) filter (where p>=0.5) over(partition by ref) n50, round(sum(p) over(partition by ref),6) total, round(p-lead(p,1,0.0::double) over(partition by ref order by p desc,tgt),6) gap_next from t")
def wn11_list_context(spark, d):
    n = lambda t: F.sum((F.col("p") >= t).cast("long")).over(D.by_ref())
    return lists(spark, d).select("ref", "tgt", n(0.9).alias("n90"), n(0.5).alias("n50"), F.round(F.sum("p").over(D.by_ref()), 6).alias("total"), F.round(F.col("p") - F.lead("p", 1, 0.0).over(D.ranked()), 6).alias("gap_next"))


@query(T + " select ref, tgt, count(*) filter (where p>=0.5) over(partition by ref) - (p>=0.5)::int others, round(sum(p) over(partition by ref)-p,6) rest from t")
def wn12_exclude_self(spark, d):
    on = (F.col("p") >= 0.5).cast("long")
    return lists(spark, d).select("ref", "tgt", (F.sum(on).over(D.by_ref()) - on).alias("others"), F.round(F.sum("p").over(D.by_ref()) - F.col("p"), 6).alias("rest"))


@query(T + ", r as (select *, row_number() over(partition by tgt order by p desc, ref) k, max(p) over(partition by tgt) b1 from t), s as (select *, max(case when k=2 then p end) over(partition by tgt) b2 from r) select ref, tgt, coalesce(case when k=1 then b2 else b1 end,0.0::double) rival, round(p-coalesce(case when k=1 then b2 else b1 end,0.0::double),6) margin, (k=1)::int is_best, count(*) filter (where p>=b1-0.01) over(partition by tgt) n_tied from s")
def wn13_margin(spark, d):
    r = lists(spark, d).withColumn("k", F.row_number().over(D.by_tgt().orderBy(F.desc("p"), "ref"))).withColumn("b1", F.max("p").over(D.by_tgt())).withColumn("b2", F.max(F.when(F.col("k") == 2, F.col("p"))).over(D.by_tgt()))
    rival = F.coalesce(F.when(F.col("k") == 1, F.col("b2")).otherwise(F.col("b1")), F.lit(0.0))
    return r.select("ref", "tgt", rival.alias("rival"), F.round(F.col("p") - rival, 6).alias("margin"), (F.col("k") == 1).cast("int").alias("is_best"), F.sum((F.col("p") >= F.col("b1") - 0.01).cast("long")).over(D.by_tgt()).alias("n_tied"))


@query("select l_orderkey ref, l_partkey%10 num, count(*) sharing, count(distinct l_suppkey) siblings from lineitem group by 1,2")
def wn15_number_group(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("ref"), (F.col("l_partkey") % 10).alias("num")).agg(F.count("*").alias("sharing"), F.countDistinct("l_suppkey").alias("siblings"))


@query(T + ", k as (select *, row_number() over(partition by tgt order by p desc, ref) k from t) select tgt, ref, p from k where k=1")
def wn16_winner(spark, d):
    return lists(spark, d).withColumn("k", F.row_number().over(D.by_tgt().orderBy(F.desc("p"), "ref"))).where("k = 1").select("tgt", "ref", "p")


@query(T + ", k as (select *, row_number() over(partition by ref order by p desc,tgt) k from t) select ref, tgt, p from k where k<=2 or (p>=0.7 and k<=4)")
def wn17_topk_adaptive(spark, d):
    return lists(spark, d).withColumn("k", F.row_number().over(D.ranked())).where("k <= 2 or (p >= 0.7 and k <= 4)").select("ref", "tgt", "p")


@query(T + ", q as (select ref, tgt from t where p>=0.8) select o_orderkey ref, coalesce(string_agg(tgt::varchar, ',' order by tgt),'') matched from orders left join q on ref=o_orderkey group by 1")
def sk01_result_rows(spark, d):
    links = lists(spark, d).where("p >= 0.8").groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_set("tgt")), lambda x: x.cast("string")), ",").alias("m"))
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ref")).join(links, "ref", "left").select("ref", F.coalesce("m", F.lit("")).alias("matched"))


@query(T + ", m as (select ref,tgt from t where p>=0.5 and p<0.6), c as (select ref,tgt from t where p>=0.55) select 'not_candidate' kind, count(*) n from (select * from m except select * from c) union all select 'missing_ref', count(*) from orders where o_orderkey not in (select ref from m) union all select 'two_owners', count(*) from (select tgt from m group by 1 having count(*)>1)")
def sk09_validate(spark, d):
    t = lists(spark, d)
    m, c = t.where("p >= 0.5 and p < 0.6").select("ref", "tgt"), t.where("p >= 0.55").select("ref", "tgt")
    kinds = [("not_candidate", m.join(c, ["ref", "tgt"], "left_anti")), ("missing_ref", spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ref")).join(m, "ref", "left_anti")), ("two_owners", m.groupBy("tgt").count().where("count > 1"))]
    parts = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, x in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(T + ", a as (select ref,tgt from t where p>=0.7), b as (select ref,tgt from t where y=1) select 'added' side, count(*) n from (select * from a except select * from b) union all select 'removed', count(*) from (select * from b except select * from a)")
def st03_link_diff(spark, d):
    t = lists(spark, d)
    a, b = t.where("p >= 0.7").select("ref", "tgt"), t.where("y = 1").select("ref", "tgt")
    return a.exceptAll(b).agg(F.count("*").alias("n")).select(F.lit("added").alias("side"), "n").unionByName(b.exceptAll(a).agg(F.count("*").alias("n")).select(F.lit("removed").alias("side"), "n"))


@query(T + " select round(quantile_cont(p,0.1),6) p10, round(quantile_cont(p,0.5),6) p50, round(quantile_cont(p,0.9),6) p90, y from t group by y")
def ag08_quantiles(spark, d):
    q = lambda x: F.round(F.percentile("p", F.lit(x)), 6)
    return lists(spark, d).groupBy("y").agg(q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"))


@query(T + " select floor(p*10)::int bin, count(*) n, round(avg(p),6) mean_p, round(avg(y),6) rate from t group by 1")
def ag09_reliability(spark, d):
    return lists(spark, d).groupBy(F.floor(F.col("p") * 10).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("rate"))


@query(T + ", n as (select ref, sum(case when p>=0.5 then 1 else 0 end)::bigint links from t group by 1) select links, count(*) refs from n group by 1")
def ag10_match_dist(spark, d):
    return lists(spark, d).groupBy("ref").agg(F.sum((F.col("p") >= 0.5).cast("long")).alias("links")).groupBy("links").agg(F.count("*").alias("refs"))


@query(T + ", k as (select *, row_number() over(partition by ref order by p desc,tgt) k from t), c as (select unnest([1,2,3,5]) cut) select cut, round(sum(case when k<=cut then y else 0 end)*1.0::double/sum(y),6) recall from k, c group by 1")
def ag11_recall_at_k(spark, d):
    k = lists(spark, d).withColumn("k", F.row_number().over(D.ranked())).groupBy("k").agg(F.sum("y").alias("y"))
    return k.select("*", F.explode(F.array(*map(F.lit, (1, 2, 3, 5)))).alias("cut")).groupBy("cut").agg(F.round(F.sum(F.when(F.col("k") <= F.col("cut"), F.col("y")).otherwise(0)) / F.sum("y"), 6).alias("recall"))


@query("select l_returnflag, l_linestatus, l_linenumber%2 odd, count(*) n, round(avg(case when l_discount>=0.05 then 1.0::double else 0.0::double end),6) rate from lineitem group by 1,2,3")
def ag13_cells(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 2).alias("odd")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0)), 6).alias("rate"))


@query(T + ", r as (select y, rank() over(order by p) + (count(*) over(partition by p)-1)/2.0::double r from t) select round((sum(case when y=1 then r end) - sum(y)*(sum(y)+1)/2.0::double)/(sum(y)*sum(1-y)),6) auc from r")
def ag18_auc(spark, d):
    from kinlink.operators.analytics import auc

    return auc(lists(spark, d), "p", "y")


@query(T + ", a as (select p, sum(case when y=1 then 1 else 0 end) n1, sum(case when y=0 then 1 else 0 end) n0 from t group by 1), c as (select p, sum(n1) over(order by p)*1.0::double/(select sum(n1) from a) f1, sum(n0) over(order by p)*1.0::double/(select sum(n0) from a) f0 from a) select round(max(abs(f1-f0)),6) ks from c")
def ag16_ks(spark, d):
    from kinlink.operators.analytics import ks

    return ks(lists(spark, d), "p", "y")
