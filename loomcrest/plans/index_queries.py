"""Queries that read indexes and versioned stores which they first write below the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import source
from ..operators import lsh, postings, rounds, vector_index, versioned
from ..session import shared_folder, table
from ..streaming import recurrences
from . import registry
from .registry import query
from .source_queries import _CODE, _ONE, _TWO

_SETS = r"list_distinct(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[A-Za-z0-9]+'))"


@query(f"""with s as (select page_id, {_SETS} t from pages), e as (select page_id, len(t) n, unnest(t) x from s)
select a.page_id, b.page_id other_id, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*))::double, 6) score from e a join e b on a.x = b.x and a.page_id % 20 = 0 and a.page_id <> b.page_id group by 1, 2 having score >= 0.5""")
def lsh_pages(spark, d):
    """Pages whose words overlap by half or more with those of each twentieth page: MinHash candidates, exact scores."""
    words = F.regexp_extract_all(F.regexp_replace("html", "<[^>]*>", " "), F.lit("[A-Za-z0-9]+"), F.lit(0))
    x = table(spark, d, "pages").select("page_id", words.alias("items"))
    bands = lsh.bands_for(0.5, rows=3)  # misses as little as the 64 bands of 2, and far fewer pairs of common words meet
    hits = lsh.lsh_search(x.where("page_id % 20 = 0").withColumnRenamed("page_id", "query_id"), x.withColumnRenamed("page_id", "doc_id"), 0.4999995, permutations=3 * bands, bands=bands, rows=3)
    return hits.where("query_id <> doc_id").select(F.col("query_id").alias("page_id"), F.col("doc_id").alias("other_id"), F.round("score", 6).alias("score")).where("score >= 0.5")


@query(registry.ORACLES["dense_topk"])
def vector_index_topk(spark, d):
    """The five nearest vectors of each twentieth one, from an inverted file, with the exact way for cells beyond the probes."""
    v = table(spark, d, "embeddings")
    index = vector_index.build_index(v, "vec_id", "embedding")
    hits = vector_index.search(index, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, exact=True, digits=5)
    return hits.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(registry.ORACLES["bm25_topk"])
def postings_topk(spark, d):
    """BM25 from an index of two segments: documents of even and of odd ids."""
    docs, path = table(spark, d, "documents"), shared_folder(spark)
    for k in (0, 1):
        postings.append(docs.where(F.pmod("doc_id", F.lit(2)) == k), path, segment=f"s{k}")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return postings.search(spark, path, q, 5).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(registry.ORACLES["upsert_merge"])
def merged_store(spark, d):
    """upsert_merge at rest: customers as the first batch, the changes as a second one that is replayed."""
    c = table(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("nm"), F.lit(0).alias("created"), F.lit(0).alias("seq"))
    new = c.select((F.col("c_custkey") + 700).alias("k"), F.col("c_name").alias("nm"), F.lit(1).alias("created"), F.lit(0).alias("seq"))
    new = new.union(c.where("c_custkey % 2 = 0").select(F.col("c_custkey") + 700, "c_mktsegment", F.lit(1), F.lit(1)))
    store = versioned.Store.create(spark, shared_folder(spark), "k", old.drop("seq").schema, 16, ("created",))
    for name, rows in (("first", old), ("second", new), ("second", new)):
        store.upsert(rows, "seq", name)
    return store.read()


@query("""with x as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) n from documents), a as (select doc_id, n, case when n % 5 = 4 then 99 else n % 5 + 1 end needs from x)
select doc_id, case when needs <= 3 then 'ok ' || n || ' at ' || needs else 'no ' || n || ' at 3' end answer, needs <= 3 accepted, least(needs, 3)::int attempts, needs > 1 used_feedback from a""")
def provider_rounds(spark, d):
    """Each text is sent up to three times to a provider that accepts it at an attempt its words decide, and says so in its feedback."""

    def provider(text, attempt, previous, feedback):
        n = len(text.encode().split())
        if (attempt > 1) != (feedback == f"attempt {attempt - 1} of {n}"):
            raise ValueError("the feedback of the attempt before is not here")
        ok = n % 5 < 4 and attempt > n % 5
        return {"answer": f"{'ok' if ok else 'no'} {n} at {attempt}", "accepted": ok, "feedback": f"attempt {attempt} of {n}"}

    docs = table(spark, d, "documents").select("doc_id", "text")
    out = rounds.run_rounds(docs, "text", provider, "answer string", shared_folder(spark))
    return out.select("doc_id", "answer", "accepted", "attempts", "used_feedback")


_DOUBLE = f"concat({_CODE}, ' function g', cast(p_partkey as string), '(int b) {{ }} ', {_TWO}, ' function open();')"


@query(f"""with x as (select p_partkey, {_DOUBLE} c, unnest([{{'place': 1, 'name': 'f' || p_partkey, 'code': {_ONE}}}, {{'place': 2, 'name': 'g' || p_partkey, 'code': {_TWO}}}, {{'place': 3, 'name': 'g' || p_partkey, 'code': 'function g' || p_partkey || '(int b) {{ }}'}}]) f from part)
select p_partkey, f.place, f.name, position(f.code in c) - 1 as start, md5(f.code) h from x""")
def function_blocks(spark, d):
    """Blocks of assembled sources by a table function in a lateral join; a repeated one counts once, an overload twice."""
    source.register(spark)
    table(spark, d, "part").select("p_partkey", F.expr(_DOUBLE).alias("c")).createOrReplaceTempView("loomcrest_sources")
    return spark.sql("select p_partkey, b.place, b.name, cast(b.start as bigint) start, md5(b.code) h from loomcrest_sources, lateral function_blocks(c) b")


@query(f"select event_id, lam, baseline, false too_late from ({registry.ORACLES['lagrange']}) join ({registry.ORACLES['ema_baseline']}) using (event_id)")
def live_log(spark, d):
    """Multiplier and baseline over a log that is read in three runs of one stream: the first half without some of its last rows, the rest with those, and rows that close every user."""
    base = shared_folder(spark)
    e = table(spark, d, "events").select("user_id", "event_id", F.least("value", F.lit(5.0)).alias("cost"), F.col("value").alias("reward"))
    top = e.agg(F.max("event_id")).first()[0] or 0
    half, late = top // 2, 500
    missing = (F.col("event_id") > half - late) & (F.col("event_id") % 5 == 0)
    close = e.select("user_id").distinct().select("user_id", F.lit(None).cast("long").alias("event_id"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("reward"))
    first = (F.col("event_id") <= half) & ~missing
    for part in (e.where(first), e.where(~first), close):
        part.write.mode("append").json(f"{base}/log")
        recurrences.settled(spark, f"{base}/log", part.schema, lambda s: recurrences.recurrences(s, "user_id", "event_id", "cost", "reward", late), f"{base}/out", f"{base}/state")
    out = spark.read.schema("at long, multiplier double, baseline double, too_late boolean").parquet(f"{base}/out")
    return out.select(F.col("at").alias("event_id"), F.round("multiplier", 5).alias("lam"), F.round("baseline", 5).alias("baseline"), "too_late")
