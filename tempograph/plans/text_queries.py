"""Queries over lines, names, layers and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempograph.functions import theory
from tempograph.operators import layout, temporal
from tempograph.plans.bindings import table

FOUND: dict = {}


def query(sql: str | None = None):
    def add(fn):
        FOUND[fn.__name__] = (fn, sql)
        return fn

    return add


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
  m as (select *, count(*) over (partition by doc_id, line) as n, min(pos) over (partition by doc_id, line) as f from l), k as (select *, case when n >= 2 then dense_rank() over (partition by doc_id, n >= 2 order by f) - 1 end as r from m)
  select doc_id, pos, case when r is not null then array_to_string(list_transform(range(w - 1, -1, -1), lambda p: chr(cast(65 + (r - (26 ** w - 26) // 25)::bigint // (26 ** p)::bigint % 26 as integer))), '') end as tag
  from (select *, 1 + (r >= 26)::int + (r >= 702)::int + (r >= 18278)::int + (r >= 475254)::int as w from k)""")
def line_repeat_tags(spark, d):
    """A24, A25."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return layout.repeat_tags(lines, ["doc_id"], ["pos"], "line").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "tag")


@query("""select p_partkey, case when p_partkey % 16 = 9 then 'DRUMS' when regexp_matches(lower(p_name || case when p_partkey % 5 = 0 then ' bass' else '' end), '\\bbass(line|es)?\\b') then 'BASS' else 'OTHER' end as role from part""")
def role_inference(spark, d):
    """P15 over part names, every fifth given a bass."""
    name = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 5 == 0, " bass").otherwise(""))
    return table(spark, d, "part").select("p_partkey", theory.part_role(name, F.col("p_partkey") % 16).alias("role"))


@query("select p_partkey, p_brand, p_name || case when k > 1 then ' (' || k || ')' else '' end as name from (select *, row_number() over (partition by p_brand, p_name order by p_partkey) as k from part)")
def role_dedupe(spark, d):
    """A second part of the same name gets a number."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("p_brand", "p_name").orderBy("p_partkey"))
    named = table(spark, d, "part").withColumn("k", k)
    return named.select("p_partkey", "p_brand", F.concat("p_name", F.when(F.col("k") > 1, F.concat(F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).otherwise("")).alias("name"))


@query("""select c_custkey, coalesce(case when c_acctbal > 5000 then c_mktsegment end, case when s_acctbal > 0 then s_name end, n_name, 'none') as setting
  from customer left join (select s_nationkey, min_by(s_name, s_suppkey) as s_name, min_by(s_acctbal, s_suppkey) as s_acctbal from supplier group by 1) s on c_nationkey = s_nationkey left join nation on c_nationkey = n_nationkey""")
def config_overlay(spark, d):
    """A customer's own value, else its supplier's, else its nation's, else the default."""
    s = temporal.first_of_each(table(spark, d, "supplier"), ["s_nationkey"], ["s_suppkey"])
    joined = table(spark, d, "customer").join(s, F.col("c_nationkey") == F.col("s_nationkey"), "left").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    layers = [F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")), F.when(F.col("s_acctbal") > 0, F.col("s_name")), F.col("n_name")]
    return joined.select("c_custkey", layout.overlay(layers, "none").alias("setting"))


@query("select page_id, sha256(html) as digest from pages")
def content_digest(spark, d):
    """R3."""
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("digest"))


@query("""select o_orderkey, sha256('chords;' || strlen('priority') || ':priority' || coalesce(strlen(o_orderpriority) || ':' || o_orderpriority, '-') || ';' || strlen('status') || ':status' || coalesce(strlen(o_orderstatus) || ':' || o_orderstatus, '-') || ';') as key from orders""")
def cache_key(spark, d):
    """Digest of a stage's name and its sorted, length-prefixed parts; a null differs from any text."""
    from tempograph.sources.score_json import cache_key_of

    parts = {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus")}
    return table(spark, d, "orders").select("o_orderkey", cache_key_of("chords", parts).alias("key"))


@query("""with w as (select doc_id, unnest(string_split(text, ' ')) as word, unnest(range(len(string_split(text, ' ')))) as pos from documents), p as (select *, regexp_replace(lower(word), '[^a-z]', '', 'g') as s from w),
  g as (select *, len(regexp_extract_all(s, '[aeiouy]+')) as n from p) select doc_id, pos, cast(greatest(1, n - case when n > 1 and regexp_matches(s, '[^aeiouy]e$') then 1 else 0 end) as integer) as syllables from g""")
def syllables(spark, d):
    """F5."""
    w = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return w.select("doc_id", F.col("pos").cast("bigint").alias("pos"), theory.syllables(F.col("word")).alias("syllables"))




@query("select o_orderkey, regexp_replace(o_orderpriority, '[^A-Za-z0-9._-]', '_', 'g') as stage, cast(floor(floor(o_totalprice) / 60) as bigint) || ':' || lpad(cast(cast(floor(o_totalprice) as bigint) % 60 as varchar), 2, '0') as took from orders")
def safe_names(spark, d):
    """F9, X26."""
    return table(spark, d, "orders").select("o_orderkey", theory.stage_name(F.col("o_orderpriority")).alias("stage"), theory.duration_text(F.col("o_totalprice")).alias("took"))
