"""Queries over the driver's tables, and SQL that gives the same rows.

documents stand for the corpus (source and lang for data sets), labels for ground truth, benchmark for retrieval
queries, conversations for chat samples, pages.html for raw source text, embeddings for the dense index, orders with
lineitem for functions with fixes, events for findings and run logs.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import prompts, similarity, taxonomy, text
from ..operators import audit, curate, joins, logs, mentions, retrieve, store
from ..session import table
from .registry import ORACLES, QUERIES, query

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_TOKENS = r"list_transform(regexp_extract_all({0}, '[A-Za-z_][\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]+|\p{{Nd}}+|[^\s]'), lambda x: lower(x))"


def _bench(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_OVERLAP = f"""q as (select item_id query_id, list_distinct({_TOKENS.format("text")}) t from benchmark),
d as (select doc_id, list_distinct({_TOKENS.format("text")}) t from documents),
qe as (select query_id, len(t) nq, unnest(t) tok from q), de as (select doc_id, len(t) nd, unnest(t) tok from d),
s as (select query_id, doc_id, count(*) / (sqrt(any_value(nq)) * sqrt(any_value(nd))) score from de join qe using (tok) group by 1, 2)"""


@query(f"with {_OVERLAP}, r as (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) rank from s) select query_id, doc_id, round(score, 6) score, rank from r where rank <= 5")
def token_overlap_topk(spark, d):
    hits = retrieve.token_overlap(_bench(spark, d), table(spark, d, "documents"))
    return retrieve.top_k(hits.withColumn("score", F.round("score", 6)), "query_id", 5).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""with d as (select doc_id, {_TOKENS.format("text")} t from documents), e as (select doc_id, unnest(t) tok from d),
tf as (select doc_id, tok, count(*) tf from e group by 1, 2), dl as (select doc_id, len(t) dl from d), st as (select count(*) n, avg(dl) avgdl from dl),
i0 as (select tok, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) idf from tf, st group by tok, n), m as (select avg(idf) mi from i0),
i as (select tok, case when idf < 0 then 0.25 * mi else idf end idf from i0, m),
q as (select query_id, tok, count(*) qf from (select item_id query_id, unnest({_TOKENS.format("text")}) tok from benchmark) group by 1, 2),
s as (select query_id, tf.doc_id, sum(qf * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))) score from tf join q using (tok) join i using (tok) join dl on dl.doc_id = tf.doc_id, st group by 1, 2 having score > 0),
r as (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) rank from s) select query_id, doc_id, round(score, 6) score, rank from r where rank <= 5""")
def bm25_topk(spark, d):
    return retrieve.bm25_top(_bench(spark, d), table(spark, d, "documents"), 5).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""with s as (select q.vec_id query_id, e.vec_id doc_id, round(list_dot_product(e.embedding::double[], q.embedding::double[]), 5) score from embeddings e join embeddings q on q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from s) select query_id, doc_id, score, rank from r where rank <= 5""")
def dense_topk(spark, d):
    v = table(spark, d, "embeddings")
    hits = retrieve.dense_blocks(v.where("vec_id % 20 = 0"), v, 5, 5, "vec_id", "vec_id")
    return retrieve.top_k(hits, "query_id", 5).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_SIGN = "list_concat(regexp_extract_all(html, '<(nav|article|script|table)\\b', 1), regexp_extract_all(html, 'href=\"(/[a-z]{1,3})\"', 1))"


@query(f"""with s as (select page_id, list_distinct({_SIGN}) t from pages), e as (select page_id, len(t) n, unnest(t) x from s)
select a.page_id, b.page_id other_id, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*))::double, 6) score from e a join e b on a.x = b.x and a.page_id % 20 = 0 and a.page_id <> b.page_id group by 1, 2 having score >= 0.5""")
def jaccard_structural(spark, d):
    sign = F.array_distinct(F.concat(F.regexp_extract_all("html", F.lit(r"<(nav|article|script|table)\b"), F.lit(1)), F.regexp_extract_all("html", F.lit('href="(/[a-z]{1,3})"'), F.lit(1))))
    x = table(spark, d, "pages").select("page_id", sign.alias("items"))
    hits = retrieve.jaccard_search(x.where("page_id % 20 = 0").withColumnRenamed("page_id", "query_id"), x.withColumnRenamed("page_id", "doc_id"), 0.4999995)
    return hits.where("query_id <> doc_id").select(F.col("query_id").alias("page_id"), F.col("doc_id").alias("other_id"), F.round("score", 6).alias("score")).where("score >= 0.5")


@query("""with h as (select user_id query_id, event_type source, case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 else 3 end source_rank, cast(floor(value) as bigint) % 7 doc_key, value score, event_id seq from events),
m as (select query_id, doc_key, arg_max(score, source_rank * 100000000 - seq) score, arg_max(source, source_rank * 100000000 - seq) source, min(seq) seq from h group by 1, 2),
f as (select *, min(score) over w lo, max(score) over w hi from m window w as (partition by query_id, source))
select query_id, doc_key, source, seq, round(case when hi <= lo then 0 else (case source when 'view' then 0.35 when 'click' then 0.35 when 'purchase' then 0.2 else 0.1 end)::double * (score - lo) / (hi - lo) end, 6) fused from f""")
def hybrid_merge_fusion(spark, d):
    e = table(spark, d, "events")
    rank = taxonomy.lookup({"view": 0, "click": 1, "purchase": 2}, F.col("event_type"), F.lit(3))
    hits = e.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("source"), (rank.cast("long") * 100_000_000 - F.col("event_id")).alias("source_rank"), (F.floor("value") % 7).alias("doc_key"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    out = retrieve.fuse(retrieve.merge_sources(hits), {"view": 0.35, "click": 0.35, "purchase": 0.2, "error": 0.1, "signup": 0.1})
    return out.select("query_id", "doc_key", "source", "seq", F.round("fused", 6).alias("fused"))


@query(f"""with {_OVERLAP}, r as (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) rank from s), t as (select r.*, lang from r join documents using (doc_id) where rank <= 10),
f as (select *, max((lang = 'de')::int) over (partition by query_id) any_hit from t) select query_id, doc_id, lang from f where lang = 'de' or any_hit = 0""")
def type_filtered_topk(spark, d):
    docs = table(spark, d, "documents")
    hits = retrieve.token_overlap(_bench(spark, d), docs).withColumn("score", F.round("score", 6))
    top = retrieve.top_k(hits, "query_id", 10).join(docs.select("doc_id", "lang"), "doc_id")
    return retrieve.filter_or_all(top, F.lower(F.trim("lang")) == "de").select("query_id", "doc_id", "lang")


@query()
def mmr_rerank(spark, d):
    docs = table(spark, d, "documents")
    hits = retrieve.token_overlap(_bench(spark, d), docs).withColumn("score", F.round("score", 6))
    top = retrieve.top_k(hits, "query_id", 15).join(docs.select("doc_id", "text"), "doc_id")
    return retrieve.mmr(top.select("query_id", "doc_id", "score", "text", F.col("rank").alias("seq")), 3).select("query_id", "doc_id", "rank")


@query(f"""with recursive {_OVERLAP}, t as (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) n from s), c as (select t.query_id, t.doc_id, n, case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end k from t join documents using (doc_id) where n <= 8),
p(query_id, n, items, cost) as (select query_id, 0, []::bigint[], 6::bigint from c group by 1 union all select c.query_id, c.n::int, case when p.cost + k <= 600 then list_append(items, doc_id) else items end, case when p.cost + k <= 600 then p.cost + k else p.cost end from p join c on c.query_id = p.query_id and c.n = p.n + 1)
select query_id, array_to_string(arg_max(items, n), ',') items, arg_max(cost, n) as cost from p group by 1""")
def demo_packing(spark, d):
    docs = table(spark, d, "documents")
    hits = retrieve.token_overlap(_bench(spark, d), docs).withColumn("score", F.round("score", 6))
    top = retrieve.top_k(hits, "query_id", 8).join(docs.select("doc_id", text.token_estimate(F.col("text")).alias("cost")), "doc_id")
    return retrieve.pack(top, "cost", 600, 6).withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query(f"""with k as (select d.*, l.toxic, md5({_STRIP.format("text")}) k, (case when source = 'src0' then 1000 else 0 end + case when toxic = 1 then 110 else 0 end + case when quality = 0 then 55 else 0 end) p from documents d left join labels l using (doc_id)),
r as (select *, row_number() over (partition by k order by p desc, doc_id) rn from k) select doc_id, p::int as priority from r where rn = 1""")
def dedup_priority(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    p = curate.priority(F.col("source") == "src0", F.col("toxic") == 1, F.lit(1), F.col("quality") == 0, F.lit(1))
    out = curate.dedup_priority(x.select("doc_id", "text", p.alias("priority")), "text", F.col("priority"), "doc_id")
    return out.select("doc_id", "priority")


@query("""with x as (select doc_id, toxic = 1 y from labels), r as (select *, row_number() over (partition by y order by md5('42' || doc_id::varchar), doc_id) rn from x)
select doc_id, y as toxic from r where rn <= case when y then 30 else 70 end""")
def balanced_sample(spark, d):
    x = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    return curate.balanced_sample(x, "toxic", "doc_id", 100, 0.3)


@query("""with r as (select doc_id, count(*) over () n, row_number() over (order by md5('42' || doc_id::varchar), doc_id) rn from documents)
select doc_id, case when rn <= floor(n * 0.8::double) then 'train' when rn <= floor(n * 0.8::double) + floor(n * 0.1::double) then 'val' else 'test' end split from r""")
def random_split(spark, d):
    return curate.split(table(spark, d, "documents").select("doc_id"), "doc_id", {"train": 0.8, "val": 0.1, "test": 0.1})


@query("""with r as (select doc_id, lang, count(*) over (partition by lang) n, row_number() over (partition by lang order by md5('42' || doc_id::varchar), doc_id) rn from documents)
select doc_id, lang, case when rn <= floor(n * 0.8::double) then 'train' when rn <= floor(n * 0.8::double) + floor(n * 0.1::double) then 'val' else 'test' end split from r""")
def stratified_split(spark, d):
    return curate.split(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", {"train": 0.8, "val": 0.1, "test": 0.1}, ["lang"])


@query("""select p_partkey, case when p_size % 11 = 10 then 'unknown' when p_size % 11 <= 4 then 'early' when p_size % 11 <= 6 then 'late' when p_size % 11 <= 7 then 'transition' else 'modern' end era from part""")
def temporal_split(spark, d):
    minor = F.col("p_size") % 11
    version = F.when(minor == 10, "1.0").otherwise(F.concat(F.lit("0."), minor.cast("string"), F.lit(".25")))
    return table(spark, d, "part").select("p_partkey", curate.era(version).alias("era"))


@query("select doc_id, length(text)::int n_chars from documents where length(text) between 100 and 100000 and contains(lower(text), 'the')")
def quality_filter(spark, d):
    return table(spark, d, "documents").where(curate.quality_check(F.col("text"), ("the",))).select("doc_id", F.length("text").alias("n_chars"))


@query("select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')) n_lines from documents where n_lines between 5 and 100")
def line_window_filter(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where(curate.line_window(t)).select("doc_id", text.non_blank_lines(t).cast("long").alias("n_lines"))


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(9), '    '), '[ \t\f\v\r]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) h from documents""")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("h"))


@query("select page_id, md5(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) h, length(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'))::int n from pages")
def strip_comments(spark, d):
    c = text.strip_markup_comments(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(c).alias("h"), F.length(c).alias("n"))


@query("select conv_id, count(*) n_turns, md5(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' order by turn)) h from conversations group by 1")
def chat_render(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), turns.alias("t")).select("conv_id", "n_turns", F.md5(prompts.chat(F.col("t"))).alias("h"))


@query("""with x as (select l_orderkey, l_partkey, l_linenumber, o_orderpriority, l_returnflag, l_quantity, row_number() over (partition by l_orderkey order by l_quantity desc, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) rn from lineitem join orders on l_orderkey = o_orderkey where l_returnflag <> 'R')
select l_orderkey id, 'Priority: ' || o_orderpriority || chr(10) || 'Part: ' || l_partkey input, case when l_returnflag = 'A' then 'ACCEPTED' else 'OTHER' end bucket from x where rn = 1""")
def sft_export(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    best = F.min_by(F.struct("l_partkey", "l_returnflag"), F.struct((-F.col("l_quantity")).alias("q"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"))
    top = li.where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(best.alias("b"))
    j = top.join(o.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("Priority: "), "o_orderpriority", F.lit("\nPart: "), F.col("b.l_partkey").cast("string")).alias("input"), F.when(F.col("b.l_returnflag") == "A", "ACCEPTED").otherwise("OTHER").alias("bucket"))


@query("select o_orderkey, o_custkey, l_linenumber, l_quantity, l_returnflag from orders join lineitem on o_orderkey = l_orderkey where l_returnflag = 'A' and l_linestatus = 'F' and l_quantity >= 25")
def fix_pairs_join(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'A' and l_linestatus = 'F' and l_quantity >= 25")
    o = table(spark, d, "orders")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("select o_orderkey, o_totalprice from orders o where o_orderstatus = 'F' and not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R')")
def skip_fixed_anti(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.skip_done(table(spark, d, "orders").where("o_orderstatus = 'F'"), done, "o_orderkey").select("o_orderkey", "o_totalprice")


_RANGES = "r as (select user_id, min(event_id) s, max(event_id) e, event_type rt from events where event_type in ('click', 'view') group by user_id, event_type)"


@query(f"with {_RANGES} select user_id, rt, count(*) n, min(event_id) first_id, max(event_id) last_id from events join r using (user_id) where event_type = 'error' and event_id between s and e group by 1, 2")
def range_join(spark, d):
    e = table(spark, d, "events")
    r = e.where(F.col("event_type").isin("click", "view")).groupBy("user_id", F.col("event_type").alias("rt")).agg(F.min("event_id").alias("s"), F.max("event_id").alias("e"))
    hit = joins.range_join(e.where("event_type = 'error'").select("user_id", "event_id"), r, "user_id", "event_id", "s", "e")
    return hit.groupBy("user_id", "rt").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""with x as (select o_custkey k, o_orderkey id, epoch(o_orderdate)::bigint // 86400 s, epoch(o_orderdate)::bigint // 86400 + 30 e, o_orderstatus st from orders)
select a.k, a.id a_id, b.id b_id, greatest(a.s, b.s) clip_start, least(a.e, b.e) clip_end from x a join x b on a.k = b.k and a.st = 'F' and b.st = 'O' and a.s <= b.e and b.s <= a.e""")
def interval_overlap(spark, d):
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.unix_date(F.to_date("o_orderdate")).cast("long").alias("s"), "o_orderstatus").withColumn("e", F.col("s") + 30)
    a = x.where("o_orderstatus = 'F'").select("k", F.col("id").alias("a_id"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = x.where("o_orderstatus = 'O'").select("k", F.col("id").alias("b_id"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return joins.overlap_join(a, b, "k", ("s1", "e1"), ("s2", "e2")).select("k", "a_id", "b_id", "clip_start", "clip_end")


@query("""with p as (select distinct p_type g, p_name nm, p_name || ' ' || p_brand || ' small ring red widget' t from part), e as (select distinct a.g, a.nm f, b.nm o from p a join p b on a.g = b.g and a.nm <> b.nm and contains(a.t, b.nm)),
n as (select distinct g, nm from p), c as (select g, f nm, array_to_string(list_sort(list(distinct o))[1:3], ',') callees from e group by 1, 2), r as (select g, o nm, array_to_string(list_sort(list(distinct f))[1:3], ',') callers from e group by 1, 2)
select g, nm, coalesce(callees, '') callees, coalesce(callers, '') callers from n left join c using (g, nm) left join r using (g, nm)""")
def substring_graph(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("g"), F.col("p_name").alias("nm"), F.concat("p_name", F.lit(" "), "p_brand", F.lit(" small ring red widget")).alias("t")).distinct()
    return mentions.mention_graph(p, "g", "nm", "t").select("g", "nm", F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers"))


@query("""with v as (select l_partkey, l_linenumber, list_sort(list(distinct l_returnflag || l_linestatus)) tools from lineitem group by 1, 2 having count(distinct l_returnflag || l_linestatus) >= 2)
select l_partkey, count(*) n_locations, array_to_string(list_sort(list(distinct l_linenumber))::varchar[], ',') lines, array_to_string(list_sort(list_distinct(flatten(list(tools)))), ',') tools from v group by 1""")
def vote_threshold(spark, d):
    f = table(spark, d, "lineitem").select("l_partkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("tool"))
    v = joins.vote_threshold(f, ["l_partkey", "l_linenumber"], "tool", 2)
    return v.groupBy("l_partkey").agg(F.count("*").alias("n_locations"), F.array_join(F.array_sort(F.collect_set("l_linenumber")).cast("array<string>"), ",").alias("lines"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tools")))), ",").alias("tools"))


@query("select source, count(*) n, count(toxic) labelled, coalesce(sum(toxic), 0)::bigint toxic, coalesce(sum(case when quality = 0 then 1 end), 0)::bigint low, round(coalesce(sum(toxic) / nullif(count(toxic), 0)::double, 0), 6) toxic_rate from documents left join labels using (doc_id) group by 1")
def store_stats(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    n = F.coalesce(F.sum("toxic"), F.lit(0)).cast("long")
    return x.groupBy("source").agg(F.count("*").alias("n"), F.count("toxic").alias("labelled"), n.alias("toxic"), F.count_if(F.col("quality") == 0).alias("low"), F.round(similarity.rate(n, F.count("toxic")), 6).alias("toxic_rate"))


@query("""with t as (select event_id, unnest(case event_type when 'click' then ['SWC-101', 'SWC-116'] when 'view' then ['SWC-107'] when 'error' then ['SWC-104', 'SWC-113'] when 'purchase' then ['SWC-007'] else [] end) swc from events)
select swc, count(distinct event_id) samples, count(*) labels from t group by 1""")
def taxonomy_counts(spark, d):
    phrase = taxonomy.lookup({"click": "Integer overflow in timestamp calc", "view": "reentrancy-eth", "error": "Unchecked DoS call", "purchase": "7", "signup": "foo"}, F.col("event_type"))
    x = table(spark, d, "events").select("event_id", F.explode(taxonomy.swc_ids(F.array(phrase))).alias("swc"))
    return x.groupBy("swc").agg(F.countDistinct("event_id").alias("samples"), F.count("*").alias("labels"))


@query("""with x as (select user_id, event_id, case event_type when 'error' then 'High' when 'purchase' then 'Medium' when 'click' then 'Low' when 'view' then 'Informational' else 'Other' end sv, case event_type when 'error' then 4 when 'purchase' then 3 when 'click' then 2 when 'view' then 1 else 2 end r from events),
y as (select *, row_number() over (partition by user_id order by r desc, event_id) rn from x)
select user_id, event_id, sv severity, (case sv when 'High' then 10.0 when 'Medium' then 6.0 when 'Low' then 3.0 when 'Informational' then 1.0 else 5.0 end + case when sv = 'High' then 0 else 0 end)::double score from y where rn = 1""")
def severity_topk(spark, d):
    sv = taxonomy.lookup({"error": "High", "purchase": "Medium", "click": "Low", "view": "Informational"}, F.col("event_type"), F.lit("Other"))
    x = table(spark, d, "events").select("user_id", "event_id", sv.alias("severity"))
    rank = taxonomy.lookup(taxonomy.SEVERITY_RANK, F.col("severity"), F.lit(2))
    top = x.groupBy("user_id").agg(F.min_by(F.struct("event_id", "severity"), F.struct((-rank).alias("r"), "event_id")).alias("b")).select("user_id", "b.*")
    kind = F.when(F.col("severity") == "High", "reentrancy").otherwise("none")
    return top.select("user_id", "event_id", "severity", taxonomy.severity_score(F.col("severity"), kind).alias("score"))


@query("""with x as (select lang, case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end n from documents)
select lang, count(*) n, min(n)::bigint lo, max(n)::bigint hi, round(avg(n), 6) mean, round(quantile_cont(n, 0.5), 6) p50, round(quantile_cont(n, 0.9), 6) p90, round(quantile_cont(n, 0.99), 6) p99 from x group by 1""")
def length_percentiles(spark, d):
    x = logs.length_summary(table(spark, d, "documents").select("lang", text.token_estimate(F.col("text")).alias("n")), "n", groups=["lang"])
    return x.select("lang", "n", F.col("min").alias("lo"), F.col("max").alias("hi"), *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p90", "p99")))


@query("""with x as (select l_orderkey k, count(*) n, count(*) filter (where l_returnflag = 'R') c from lineitem group by 1)
select k, n, c, round(case when n < 1 then 0 when c = n then 1 else 1 - (n - c)::double / n end, 6) p1, round(case when n < 2 then 0 when c = n then 1 else 1 - (n - c)::double / n * (n - c - 1)::double / (n - 1) end, 6) p2 from x""")
def pass_at_k(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("c"))
    return x.select("k", "n", "c", *(F.round(similarity.pass_at_k(F.col("n"), F.col("c"), k), 6).alias(f"p{k}") for k in (1, 2)))


@query("""with b as (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', 'OTHER']) bucket), x as (select o_orderpriority bucket, count(*) n, count(*) filter (where o_orderstatus = 'F') c from orders group by 1)
select bucket, coalesce(n, 0) n, round(coalesce(c::double / n, 0), 6) solved_rate from b left join x using (bucket)""")
def bucket_metrics(spark, d):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "OTHER"]
    dim = spark.createDataFrame([(x,) for x in names], "bucket string")
    x = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("c"))
    return F.broadcast(dim).join(x, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce(similarity.rate(F.col("c"), F.col("n")), F.lit(0.0)), 6).alias("solved_rate"))


@query("""select o_orderpriority, o_custkey, count(*) n, round(avg(o_totalprice), 4) price_mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) price_std from orders group by 1, 2""")
def sweep_mean_std(spark, d):
    x = table(spark, d, "orders").withColumn("price", F.col("o_totalprice"))
    m = logs.mean_std(x, ["o_orderpriority", "o_custkey"], ["price"])
    return m.select("o_orderpriority", "o_custkey", "n", F.round("price_mean", 4).alias("price_mean"), F.round("price_std", 4).alias("price_std"))


@query("""with r as (select l_orderkey, l_extendedprice, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) rn from lineitem where l_returnflag = 'A'),
m as (select l_orderkey, max(l_extendedprice) best, arg_min(l_extendedprice, rn) first, count(*) n from r where rn <= 3 group by 1) select l_orderkey, n, round(best, 2) best, round(first, 2) first_passed from m""")
def best_of_passed(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    r = table(spark, d, "lineitem").where("l_returnflag = 'A'").withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    return r.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.max("l_extendedprice"), 2).alias("best"), F.round(F.min_by("l_extendedprice", "rn"), 2).alias("first_passed"))


@query("""with x as (select l_partkey f, l_suppkey % 3 model, l_returnflag = 'R' v from lineitem), f as (select f, count(*) filter (where v) v, count(*) filter (where not v) s, count(distinct v) = 1 consensus from x group by 1)
select f, v, s, consensus, round(abs(v - s) / (v + s)::double, 6) spread from f""")
def model_agreement(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("f"), (F.col("l_returnflag") == "R").alias("v_"))
    g = x.groupBy("f").agg(F.count_if("v_").alias("v"), F.count_if(~F.col("v_")).alias("s"), (F.count_distinct("v_") == 1).alias("consensus"))
    return g.withColumn("spread", F.round(F.abs(F.col("v") - F.col("s")) / (F.col("v") + F.col("s")), 6))


@query("select event_id, round(value - avg(value) over (partition by user_id), 5) advantage from events")
def advantage(spark, d):
    return table(spark, d, "events").select("event_id", F.round(logs.advantage(F.col("value"), "user_id"), 5).alias("advantage"))


@query("""with x as (select user_id, event_id, sum(0.05::double * (least(value, 5) - 0.5::double)) over (partition by user_id order by event_id) r from events)
select event_id, round(r - least(0, min(r) over (partition by user_id order by event_id)), 5) lam from x""")
def lagrange(spark, d):
    e = table(spark, d, "events").withColumn("cost", F.least("value", F.lit(5.0)))
    return logs.multiplier(e, "cost", ["user_id"], ["event_id"]).select("event_id", F.round("lambda", 5).alias("lam"))


@query("""with recursive o as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) n from events), b as (select user_id, event_id, n, (1 - 0.9::double) * value b from o where n = 1 union all select o.user_id, o.event_id, o.n, 0.9::double * b.b + (1 - 0.9::double) * o.value from b join o on o.user_id = b.user_id and o.n = b.n + 1)
select user_id, event_id, round(b, 5) baseline from b""")
def ema_baseline(spark, d):
    return logs.ema(table(spark, d, "events"), "value", "user_id", "event_id").select("user_id", "event_id", F.round("baseline", 5).alias("baseline"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) k from events where event_type <> 'view' and cast(json_extract(props, '$.k') as bigint) >= 50")
def json_extract_filter(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").where((F.col("event_type") != "view") & (k >= 50)).select("event_id", k.alias("k"))


@query("select 'label.type' issue_type, count(*) n, min(event_id) first_id from events where event_id % 2 = 1 and event_id % 5 <> 0 having count(*) > 0 union all select 'label.malformed_json', count(*), min(event_id) from events where event_id % 5 = 0 having count(*) > 0")
def json_audit(spark, d):
    bad = F.when(F.col("event_id") % 5 == 0, F.lit("{x")).when(F.col("event_id") % 2 == 1, F.lit("[1]")).otherwise(F.col("props"))
    found = audit.issues(table(spark, d, "events").select("event_id", bad.alias("label")), "event_id", ["label"], [])
    return audit.issue_statistics(found, "event_id")


@query("""with n as (select c_custkey + 700 k, c_name nm, 1 created from customer union all select c_custkey + 700, c_mktsegment, 1 from customer where c_custkey % 2 = 0)
, l as (select k, nm from (select k, nm, row_number() over (partition by k order by (nm not like 'Customer%') desc) rn from n) where rn = 1)
select coalesce(c_custkey, k) k, case when k is not null then nm else c_name end nm, case when c_custkey is not null then 0 else 1 end created from customer full join l on c_custkey = k""")
def upsert_merge(spark, d):
    c = table(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("nm"), F.lit(0).alias("created"))
    new = c.select((F.col("c_custkey") + 700).alias("k"), F.col("c_name").alias("nm"), F.lit(1).alias("created"), F.lit(0).alias("seq"))
    new = new.union(c.where("c_custkey % 2 = 0").select(F.col("c_custkey") + 700, "c_mktsegment", F.lit(1), F.lit(1)))
    return store.upsert(old, new, "k", "seq", keep=("created",))


@query("""with e as (select l_orderkey k, count(*) v from lineitem where l_returnflag = 'A' group by 1), n as (select l_orderkey k, l_partkey, l_suppkey, l_quantity, l_extendedprice, row_number() over (partition by l_orderkey order by l_extendedprice, l_partkey, l_suppkey, l_quantity) rn from lineitem where l_returnflag = 'R')
select n.k, l_partkey, coalesce(v, 0) + rn fix_version from n left join e using (k)""")
def version_append(spark, d):
    li = table(spark, d, "lineitem")
    old = li.where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("fix_version"))
    new = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), "l_partkey", F.struct("l_extendedprice", "l_partkey", "l_suppkey", "l_quantity").alias("seq"))
    return store.append_versions(old, new, "k", "fix_version", "seq").select("k", "l_partkey", F.col("fix_version").cast("long").alias("fix_version"))


def _turn_pairs(spark, d):
    c = table(spark, d, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("a"))
    return a.join(c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")), ["conv_id", "turn"])


@query()
def bleu(spark, d):
    return _turn_pairs(spark, d).select("conv_id", "turn", F.round(similarity.bleu_score(F.col("a"), F.col("b")), 6).alias("bleu"))


@query()
def edit_sim(spark, d):
    return _turn_pairs(spark, d).select("conv_id", "turn", F.round(similarity.edit_similarity(F.col("a"), F.col("b")), 6).alias("edit_sim"))


@query()
def text_sim(spark, d):
    return _turn_pairs(spark, d).select("conv_id", "turn", F.round(similarity.text_similarity(F.col("a"), F.col("b")), 6).alias("text_sim"))


@query("select time_bucket(interval 1 hour, ts)::timestamp window_start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def windowed_counts(spark, d):
    from ..streaming import events

    return events.windowed_counts(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("select page_id, len(regexp_extract_all(html, '<p>')) n_paragraphs, len(regexp_extract_all(html, 'href=\"[^\"]*\"')) n_links, contains(html, '<table')::int has_table from pages")
def page_flags(spark, d):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, d, "pages").select("page_id", n("<p>").alias("n_paragraphs"), n('href="[^"]*"').alias("n_links"), F.contains("html", F.lit("<table")).cast("int").alias("has_table"))


@query("select doc_id, md5(string_split(text, chr(10))[1]) first_line, length(text) - length(replace(text, chr(10), '')) + 1 n_lines from documents")
def line_positions(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(text.line_slice(t, F.lit(1), F.lit(1))).alias("first_line"), text.line_of(t, F.length(t)).cast("long").alias("n_lines"))


@query("select event_type, bucket, count(*) n from (select event_type, unnest(case event_type when 'click' then ['ARITHMETIC', 'TIMESTAMP_DEPENDENCE'] when 'view' then ['REENTRANCY'] when 'error' then ['UNCHECKED_CALL', 'DOS'] when 'purchase' then ['ACCESS_CONTROL'] else ['foo'] end) bucket from events) group by 1, 2")
def bucket_mapping(spark, d):
    phrase = taxonomy.lookup({"click": "Integer overflow in timestamp calc", "view": "reentrancy-eth", "error": "Unchecked DoS call", "purchase": "missing access control", "signup": "foo"}, F.col("event_type"))
    return table(spark, d, "events").select("event_type", F.explode(taxonomy.buckets(F.array(phrase))).alias("bucket")).groupBy("event_type", "bucket").agg(F.count("*").alias("n"))


@query("select conv_id, turn, md5(case when contains(text, '```') then text else '```text' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || '```' end) h from conversations where role = 'assistant'")
def wrap_fence(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.md5(text.wrap_fence(F.col("text"), "text")).alias("h"))


from . import answer_queries, index_queries, label_queries, report_queries, selection_queries, source_queries, text_queries  # noqa: E402  they register their queries

__all__ = ["ORACLES", "QUERIES", "answer_queries", "index_queries", "label_queries", "report_queries", "selection_queries", "source_queries", "text_queries"]
