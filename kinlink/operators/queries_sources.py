"""Registered queries: sources and sinks. Tables are written as the files that an operator reads, into the scratch folder, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.operators.queries_decide import T, lists
from kinlink.plans.scratch import _path, scratch_root
from kinlink.sources import tsv as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _folder(spark, name: str) -> str:
    """A folder of its own for files that go when the driver ends."""
    path = f"{scratch_root(spark)}/kinlink-{name}-{uuid.uuid4().hex}"
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    return path


def entities(spark, d) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.concat(F.lit("S1-"), F.col("p_partkey").cast("string")).alias("entity_id"), F.concat(F.lit('"'), "p_name").alias("business_name"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat_ws(", ", "p_brand", F.col("p_size").cast("string"))).alias("business_address"), F.col("p_type").alias("country"))


E = "with e as (select 'S1-'||p_partkey entity_id, '\"'||p_name business_name, case when p_partkey%5=0 then '' else p_brand||', '||p_size end business_address, p_type country from part)"


@query(E + " select * from e")
def sc01_records(spark, d):
    path = _folder(spark, "sc01")
    S.write_lines(entities(spark, d), path, gzip=True)
    return S.read_lines(spark, path)


@query(E + " select * from e")
def sc02_strict_scan(spark, d):
    path = _folder(spark, "sc02")
    S.write_lines(entities(spark, d), path)
    return S.read_strict(spark, path)


@query(E + " select entity_id, length(business_name) n, business_name like '\"%' quoted from e")
def sc03_unquoted_scan(spark, d):
    path = _folder(spark, "sc03")
    S.write_lines(entities(spark, d), path)
    return S.read_lines(spark, path).select("entity_id", F.length("business_name").cast("long").alias("n"), F.col("business_name").startswith('"').alias("quoted"))


@query(E + " select entity_id, business_name, business_address from e where entity_id in (select 'S1-'||l_partkey from lineitem where l_quantity>=49)")
def sc04_filtered_scan(spark, d):
    need = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity >= 49").select(F.concat(F.lit("S1-"), F.col("l_partkey").cast("string")).alias("entity_id"))
    return S.only(entities(spark, d), need, "entity_id", ["entity_id", "business_name", "business_address"])


@query("select p_type country, count(*) n from part group by 1")
def sc05_parquet_scan(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_type").alias("country")).agg(F.count("*").alias("n"))


def gold(spark, d) -> DataFrame:
    """Orders as references with the parts they returned, as a gold file, read back from disk."""
    path = _folder(spark, "gold")
    S.write_lines(S.result_rows(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ref")), lists(spark, d).where("y = 1")), path)
    return S.read_lines(spark, path, ("source1_entity_id", "matched_entity_ids"))


@query(T + " select ref::varchar ref, tgt::varchar tgt from t where y=1")
def sc06_gold_pairs(spark, d):
    return S.gold_pairs(gold(spark, d))


@query(T + ", g as (select ref, string_agg(tgt::varchar, ' ' order by tgt::varchar) s, count(*) n from t where y=1 group by 1) select o_orderkey::varchar ref, coalesce(n,0) n, coalesce(s,'') tgts from orders left join g on ref=o_orderkey")
def sc07_gold_sets(spark, d):
    refs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("ref"))
    return S.gold_sets(gold(spark, d), refs).select("ref", F.size("tgts").cast("long").alias("n"), F.array_join("tgts", " ").alias("tgts"))


@query(T + " select tgt::varchar tgt, min(ref::varchar) owner from t where y=1 group by 1")
def sc08_owner_map(spark, d):
    return S.owners(gold(spark, d))


@query(T + ", g as (select ref, tgt, row_number() over(partition by ref order by tgt::varchar)-1 pos from t where y=1) select ref::varchar ref, pos, tgt::varchar tgt from g")
def sc09_id_lists(spark, d):
    return S.expanded(gold(spark, d), "source1_entity_id", "matched_entity_ids").select("ref", F.col("pos").cast("long").alias("pos"), "tgt")


@query(T + " select count(*) n, count(distinct ref) refs from t where y=1")
def sc10_sharded_lists(spark, d):
    g = gold(spark, d)
    parts = [S.expanded(g, "source1_entity_id", "matched_entity_ids", 3, i) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.count("*").alias("n"), F.countDistinct("ref").alias("refs"))


@query("select vec_id, len(embedding) n, round(list_sum(list_transform(embedding::double[], lambda x: x*x)),5) norm2 from embeddings")
def sc11_vectors(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 5).alias("norm2"))


@query("select country, id, row_number() over(partition by country order by id) pos from (select p_type country, p_partkey id from part)")
def sc13_grouped_order(spark, d):
    from pyspark.sql import Window

    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("country"), F.col("p_partkey").alias("id"))
    return p.select("country", "id", F.row_number().over(Window.partitionBy("country").orderBy("id")).cast("long").alias("pos"))


@query(E + " select entity_id from e order by entity_id limit 20")
def sc14_first_rows(spark, d):
    return S.first_rows(entities(spark, d).select("entity_id"), "entity_id", 20)


@query(E + " select count(*) n, count(distinct entity_id) ids, true fresh, false again from e")
def sk02_manifest(spark, d):
    path, e = _folder(spark, "sk02"), entities(spark, d)
    fresh, again = S.write_with_manifest(e, path, {"version": 1}), S.write_with_manifest(e, path, {"version": 1})
    return spark.read.parquet(f"{path}/rows").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("ids")).withColumn("fresh", F.lit(fresh)).withColumn("again", F.lit(again))


@query(E + " select * from e")
def sk03_parquet_sink(spark, d):
    path = _folder(spark, "sk03")
    entities(spark, d).write.parquet(path)
    return spark.read.parquet(path)


@query("select p_type country, count(*) n, 0 again from part group by 1")
def sk04_shards(spark, d):
    path, e = _folder(spark, "sk04"), entities(spark, d)
    S.write_shards(e, path, "country")
    again = len(S.write_shards(e, path, "country"))
    return spark.read.option("basePath", path).parquet(f"{path}/country=*").groupBy("country").agg(F.count("*").alias("n")).withColumn("again", F.lit(again))


@query(T + ", f as (select ref, tgt, p from t where p>=0.3) select t.ref, t.tgt, f.p is not null found, coalesce(f.p,-1) p from t left join f using(ref,tgt)")
def sk05_listed_features(spark, d):
    t = lists(spark, d)
    x = S.listed_features(t.select("ref", "tgt"), t.where("p >= 0.3").select("ref", "tgt", "p"), ["ref", "tgt"])
    return x.select("ref", "tgt", "found", F.when(F.isnan("p"), -1.0).otherwise(F.col("p")).alias("p"))


@query("select true same, false changed")
def sk06_fingerprint(spark, d):
    t = lists(spark, d).select("ref", "tgt")
    a, b, c = S.fingerprint(t, "ref", "tgt"), S.fingerprint(t.repartition(5, "tgt"), "ref", "tgt"), S.fingerprint(t.where("ref > 10"), "ref", "tgt")
    return spark.createDataFrame([(a == b, a == c)], "same boolean, changed boolean")


@query(T + " select ref, tgt from t where p>=0.6 except select ref, tgt from t where p>=0.6 and y=1")
def sk07_added_links(spark, d):
    t = lists(spark, d).where("p >= 0.6")
    return t.select("ref", "tgt").join(t.where("y = 1").select("ref", "tgt"), ["ref", "tgt"], "left_anti")


@query(T + ", x as (select o_orderpriority country, p, y from t join orders on o_orderkey=ref) select country, count(*) pairs, sum((p>=0.7)::int)::bigint links, round(quantile_cont(p,0.25),6) p25, round(quantile_cont(p,0.75),6) p75, sum(y)::bigint gold from x group by 1")
def sk08_report(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ref"), F.col("o_orderpriority").alias("country"))
    q = lambda x: F.round(F.percentile("p", F.lit(x)), 6)
    return lists(spark, d).join(o, "ref").groupBy("country").agg(F.count("*").alias("pairs"), F.sum((F.col("p") >= 0.7).cast("long")).alias("links"), q(0.25).alias("p25"), q(0.75).alias("p75"), F.sum("y").cast("long").alias("gold"))


@query(T + ", k as (select *, row_number() over(partition by ref order by p desc,tgt) k from t) select ref, tgt, p, y::bigint y, ('0x'||substr(sha256(ref::varchar),1,8))::bigint%100 split from k where k<=3")
def sk10_matcher_pack(spark, d):
    from kinlink.operators import decide as D

    path = _folder(spark, "sk10")
    x = lists(spark, d).withColumn("k", F.row_number().over(D.ranked())).where("k <= 3").select("ref", "tgt", "p", F.col("y").cast("long").alias("y"), D.split_bucket(F.col("ref")).alias("split"))
    x.write.parquet(path)
    return spark.read.parquet(path)
