"""Queries for evaluation rows, statistics and reports. lineitem stands for candidates of orders, events for calls of models and services."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity, taxonomy
from ..operators import evaluate, reports
from ..session import table
from .registry import query

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


def _candidates(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.struct(*_ORDER.split(", ")).alias("cand"), (F.col("l_linestatus") == "F").alias("compiles"), (F.col("l_returnflag") != "N").alias("passed"), (F.col("l_quantity") / 50).alias("orig_sim"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("ir_change"), F.col("l_tax").alias("ir_sim"), F.col("l_partkey").cast("string").alias("code"))


@query(f"""with x as (select *, l_linestatus = 'F' and l_returnflag <> 'N' and l_quantity / 50 < 0.9 and coalesce(l_discount > 0.02 and l_discount <= 0.08, false) ok from lineitem),
r as (select *, row_number() over (partition by l_orderkey, ok order by {_ORDER}) n from x)
select l_orderkey sample_id, count(*) total_generated, count(*) filter (where ok) correct_generated, max(case when ok and n = 1 then l_partkey::varchar end) best, coalesce(string_agg(l_partkey::varchar, ',' order by n) filter (where ok and n <= 3), '') passed, max(case when ok and n = 1 then l_tax end) ir_sim, max(case when ok and n = 1 then l_discount end) ir_change, round(max(case when ok and n = 1 then l_quantity / 50 end), 6) orig_sim from r group by 1""")
def evaluation_rows(spark, d):
    x = evaluate.evaluation_rows(_candidates(spark, d), max_orig_sim=0.9, max_change=0.08)
    return x.select("sample_id", "total_generated", "correct_generated", F.col("best_candidate_code").alias("best"), F.array_join("passed_candidate_codes", ",").alias("passed"), F.col("best_candidate_ir_sim").alias("ir_sim"), F.col("best_candidate_ir_change_rate").alias("ir_change"), F.round("best_candidate_orig_sim", 6).alias("orig_sim"))


@query("""with s as (select event_id, 'fix_' || user_id id from events where event_type <> 'view' union all select event_id, 'other' from events where event_type = 'view'), f as (select c_custkey, c_name, c_custkey % 4 <> 0 audited from customer)
select event_id, c_custkey as fid, c_name f_name, audited from s join f on s.id = 'fix_' || c_custkey""")
def eval_samples(spark, d):
    samples = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "view", F.concat(F.lit("fix_"), F.col("user_id").cast("string"))).otherwise("other").alias("id"))
    functions = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 != 0, "{}").otherwise("null").alias("llm_audit"))
    with_prompt = evaluate.eval_samples(samples, functions, own_prompt=True).select("event_id", F.col("f_id").alias("fid"), "f_name")
    audited = evaluate.eval_samples(samples, functions).select("event_id", F.lit(True).alias("audited"))
    return with_prompt.join(audited, "event_id", "left").withColumn("audited", F.coalesce("audited", F.lit(False)))


@query("""select o_orderkey, o_custkey, case when c_custkey is null or c_custkey % 2 = 0 then '' else c_name end c_name from orders left join customer on o_custkey = c_custkey""")
def with_details(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 2 == 1, F.col("c_name")).alias("c_name"))
    return evaluate.with_details(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey", ["c_name"])


@query("""select count(o_totalprice)::double as "count", round(avg(o_totalprice), 4) mean, round(quantile_cont(o_totalprice, 0.5), 4) median, round(quantile_cont(o_totalprice, 0.1), 4) p10, round(quantile_cont(o_totalprice, 0.25), 4) p25, round(quantile_cont(o_totalprice, 0.75), 4) p75, round(quantile_cont(o_totalprice, 0.9), 4) p90, min(o_totalprice) as "min", max(o_totalprice) as "max", 0.0::double none from orders""")
def score_summary(spark, d):
    x = evaluate.score_summary(table(spark, d, "orders"), "o_totalprice")
    none = evaluate.score_summary(table(spark, d, "orders").where("o_orderkey < 0"), "o_totalprice").select(F.col("p90").alias("none"))
    return x.withColumns({c: F.round(c, 4) for c in ("mean", "median", "p10", "p25", "p75", "p90")}).crossJoin(none)


_LOG = "select event_id // 100 step, value reward, value % 7 as cost, case when event_type = 'purchase' then 1 else 0 end success from events"


@query(f"with x as ({_LOG}) select step, round(avg(reward), 5) reward, round(avg(cost), 5) cost, round(avg(success), 5) success from x group by 1")
def step_means(spark, d):
    x = table(spark, d, "events").select(F.expr("event_id div 100").alias("step"), F.col("value").alias("reward"), (F.col("value") % 7).alias("cost"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("success"))
    return evaluate.step_means(x).select("step", *(F.round(c, 5).alias(c) for c in ("reward", "cost", "success")))


@query("""select count(*) requests, sum(user_id)::bigint tokens, sum(event_id % 4)::bigint retries, count(*) filter (where event_type = 'error') failures, round(avg(1 + event_id % 4), 6) mean_attempts, count(*) filter (where event_id % 4 = 0) once, count(*) filter (where event_id % 4 = 3) four from events""")
def service_counters(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("tokens"), (1 + F.col("event_id") % 4).alias("attempts"), (F.col("event_type") != "error").alias("ok"))
    n = evaluate.attempts_distribution(x)
    of = lambda k, name: n.where(F.col("attempts") == k).select(F.col("n").alias(name))
    return evaluate.service_counters(x).withColumn("mean_attempts", F.round("mean_attempts", 6)).crossJoin(of(1, "once")).crossJoin(of(4, "four"))


def _calls(spark, d):
    e = table(spark, d, "events")
    return e.select((F.col("event_id") % 300).alias("function"), (F.col("user_id") % 3).alias("model"), F.when(F.col("event_type") == "purchase", "vulnerable").otherwise("safe").alias("label"), F.col("value").alias("severity"), (F.col("event_id") % 10 / 10).alias("confidence"), F.col("user_id").alias("tokens"), F.lit(1.5).alias("seconds"), (F.col("event_type") != "error").alias("ok"))


@query("""with x as (select event_id % 300 f, case when event_type = 'purchase' then 'vulnerable' else 'safe' end l, value sev, (event_id % 10) / 10::double conf, user_id tok, event_type <> 'error' ok from events)
select f as "function", count(*) total_models, count(*) filter (where ok) successful, count(*) filter (where not ok) failed, count(*) filter (where ok and l = 'vulnerable') agree_on_vulnerable, count(*) filter (where ok and l = 'safe') agree_on_safe, count(distinct l) filter (where ok) = 1 consensus, round(avg(sev) filter (where ok), 5) avg_severity, round(avg(conf) filter (where ok), 5) avg_confidence, round(avg(tok) filter (where ok), 5) avg_tokens, 1.5::double avg_seconds from x group by 1 having count(*) filter (where ok) > 0""")
def function_comparison(spark, d):
    x = evaluate.function_comparison(_calls(spark, d))
    return x.withColumns({f"avg_{c}": F.round(f"avg_{c}", 5) for c in ("severity", "confidence", "tokens")}).withColumn("avg_seconds", F.round("avg_seconds", 5))


@query("""with x as (select event_id % 300 f, user_id % 3 m, case when event_type = 'purchase' then 'vulnerable' else 'safe' end l, value sev, (event_id % 10) / 10::double conf, user_id tok from events where event_type <> 'error'), c as (select f, count(distinct l) = 1 con from x group by 1)
select m model, round(avg(con::int), 6) agreement, round(avg(sev), 5) severity, round(avg(conf), 5) confidence, count(*) filter (where l = 'vulnerable') vulnerable, count(*) filter (where l = 'safe') safe, sum(tok)::bigint tokens from x join c using (f) group by 1""")
def model_summary(spark, d):
    x = reports.model_summary(_calls(spark, d))
    return x.withColumns({"agreement": F.round("agreement", 6), "severity": F.round("severity", 5), "confidence": F.round("confidence", 5)})


@query("""with x as (select event_id % 300 f, event_type, case when event_type = 'purchase' then 1 else 0 end v from events), c as (select f, abs(count(*) filter (where event_type <> 'error' and v = 1) - count(*) filter (where event_type <> 'error' and v = 0)) / count(*)::double gap, count(distinct v) filter (where event_type <> 'error') = 1 con from x group by 1 having count(*) filter (where event_type <> 'error') > 0)
select (select f from c where gap > 0 order by gap desc, f limit 1) most, count(*) functions, count(*) filter (where con) agreed, round(avg(con::int) * 100, 6) percent from c""")
def consensus(spark, d):
    x = evaluate.function_comparison(_calls(spark, d))
    most = evaluate.most_controversial(x, "function").select(F.col("function").alias("most"))
    return most.crossJoin(evaluate.consensus_rate(x)).withColumn("percent", F.round("percent", 6))


@query("""with x as (select l_orderkey k, l_linestatus = 'F' c, l_returnflag <> 'N' p, l_linenumber % 4 n, l_quantity > 45 s, l_discount cs, l_tax ch, l_quantity / 100 kl from lineitem)
select k, count(*) n, round(sum(case when not c then 5 when not p then greatest(1, n) else 0 end + case when s then 1 else 0 end), 6)::double cost, round(sum(case when not c then 5 when n > 0 then n else 0 end + case when s then 1 else 0 end), 6)::double plain, round(sum(0.8 * c::int + 0.3 * cs - 0.2 * (1 - ch) + case when c and p then 1 when c then 0.1 else 0 end - 0.02 * kl), 6) reward, sum((c and p)::int)::bigint success, count(*) filter (where c and p and cs < 0.05 and ch <= 0.06) correct from x group by 1""")
def rewards(spark, d):
    c, p, n, s = F.col("l_linestatus") == "F", F.col("l_returnflag") != "N", F.col("l_linenumber") % 4, F.col("l_quantity") > 45
    ok = similarity.correct(c, p, F.col("l_discount"), 0.05, F.col("l_tax"), 0.06)
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), similarity.cost(c, n, s, passed=p).alias("cost"), similarity.cost(c, n, s).alias("plain"), similarity.reward(c, p, F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100).alias("reward"), similarity.success(c, p).alias("success"), ok.alias("ok"))
    return x.groupBy("k").agg(F.count("*").alias("n"), *(F.round(F.sum(v), 6).alias(v) for v in ("cost", "plain", "reward")), F.sum("success").alias("success"), F.count_if("ok").alias("correct"))


@query("""with x as (select l_orderkey k, count(*) n, count(*) filter (where l_returnflag = 'R') c, avg(l_discount) b from lineitem group by 1)
select round(avg((c > 0)::int), 6) solved_rate, round(avg(case when c = n then 1 else c / n::double end), 6) pass_at_1, round(avg(b), 6) bleu_all, round(avg(b) filter (where c > 0), 6) bleu_solved, round(avg(b) filter (where c = 0), 6) bleu_unsolved from x""")
def suite(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total_generated"), F.count_if(F.col("l_returnflag") == "R").alias("correct_generated"), F.avg("l_discount").alias("bleu"))
    out = reports.suite(x, ks=(1,), scores=("bleu",))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


_MARK = "case when p_size % 7 = 0 then '' when p_size % 5 = 0 then 'reentrancy,dos' when p_size % 3 = 0 then 'foo' else 'overflow' end"


@query(f"""with x as (select p_partkey, {_MARK} t from part), e as (select p_partkey, unnest(case t when '' then [] when 'reentrancy,dos' then ['reentrancy', 'dos'] else [t] end) v from x)
select v as value, count(*) samples, count(*) labels, min(p_partkey) as "first", array_to_string(list_sort(list(p_partkey))[1:5]::varchar[], ',') examples from e group by 1""")
def type_histogram(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.filter(F.split(F.expr(_MARK), ","), lambda v: v != "").alias("t"))
    return reports.histogram(x, F.col("t"), "p_partkey", "p_partkey", 5).withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query(f"""with x as (select {_MARK} t, count(*) n from part group by 1) select sum(n)::bigint total, sum(n) filter (where t = '')::bigint missing, sum(n) filter (where t = 'foo')::bigint unmappable, sum(n) filter (where t = 'reentrancy,dos')::bigint multi_label, sum(n) filter (where t = 'reentrancy,dos')::bigint pairs from x""")
def type_report(spark, d):
    x = table(spark, d, "part").select(F.filter(F.split(F.expr(_MARK), ","), lambda v: v != "").alias("raw"))
    x = x.withColumn("norm", taxonomy.swc_ids(F.col("raw")))
    pairs = F.flatten(F.transform("raw", lambda r: F.transform(F.when(F.size(taxonomy.swc_of(r)) > 0, taxonomy.swc_of(r)).otherwise(F.array(F.lit(None).cast("string"))), lambda n: F.struct(r.alias("raw"), n.alias("norm")))))
    cross = reports.crosstab(x.select(pairs.alias("p")), "p").where("raw = 'reentrancy' and norm = 'SWC-107'").select(F.col("n").alias("pairs"))
    return reports.type_report(x, "raw", "norm").crossJoin(cross)


@query("""with n as (select p_brand v, count(*) n from part group by 1), t as (select * from n order by n desc, v limit 10) select v as version, n, round(n * 100::double / (select count(*) from part), 2) percent from t""")
def version_distribution(spark, d):
    return reports.top_versions(table(spark, d, "part").select(F.col("p_brand").alias("version")), "version")


@query("""(select o_orderkey, o_totalprice, 'lowest' as "end" from orders order by o_totalprice, o_orderkey limit 7) union all (select o_orderkey, o_totalprice, 'highest' from orders order by o_totalprice desc, o_orderkey limit 7)""")
def score_extremes(spark, d):
    return reports.extremes(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 7)


@query("""with s as (select l_orderkey k, sum(l_quantity) q from lineitem group by 1) select o_orderkey, round(o_totalprice, 2) stored, round(q, 2) computed, round(abs(o_totalprice - q), 2) difference from orders join s on k = o_orderkey""")
def score_differences(spark, d):
    stored = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("score"))
    computed = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("score"))
    x = reports.compare_scores(stored, computed, "o_orderkey", "score")
    return x.select("o_orderkey", *(F.round(c, 2).alias(c) for c in ("stored", "computed", "difference")))


@query("""with r as (select o_custkey g, sum(o_orderkey) s from orders group by 1), n as (select o_custkey g, count(*) n from orders group by 1) select o_orderkey, g o_custkey, round(s / n::double, 6) "seconds" from orders join r on g = o_custkey join n using (g)""")
def shared_results(spark, d):
    o = table(spark, d, "orders")
    results = o.groupBy("o_custkey").agg(F.sum("o_orderkey").alias("seconds"))
    return reports.shared_result(o.select("o_orderkey", "o_custkey"), results, "o_custkey", "seconds").withColumn("seconds", F.round("seconds", 6))


@query("""select count(*) samples, round(sum(l_quantity), 2) q_sum, round(avg(l_tax), 6) t_mean from lineitem""")
def run_totals(spark, d):
    x = reports.run_totals(table(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_tax").alias("t")), ["q"], ["t"])
    return x.select("samples", F.round("q_sum", 2).alias("q_sum"), F.round("t_mean", 6).alias("t_mean"))


@query("""select p_brand file, array_to_string(list_sort(list(distinct p_type)), '|') categories, array_to_string(list_sort(list(distinct p_name)), '|') as "names" from part group by 1""")
def contract_rollup(spark, d):
    x = reports.contract_rollup(table(spark, d, "part").select(F.col("p_brand").alias("file"), "p_type", "p_name"), "file", "p_type", "p_name")
    return x.select("file", F.array_join("categories", "|").alias("categories"), F.array_join("names", "|").alias("names"))


@query("""with x as (select event_id, user_id, sum(abs(value)) over (partition by user_id order by event_id rows unbounded preceding) t from events) select event_id, round(greatest(0, t - coalesce(lag(t) over (partition by user_id order by event_id), 0)), 3) t_used from x""")
def counter_deltas(spark, d):
    from pyspark.sql import Window

    x = table(spark, d, "events").select("event_id", "user_id", F.sum(F.abs("value")).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("t"))
    return evaluate.deltas(x, ["t"], "user_id", "event_id").select("event_id", F.round("t_used", 3).alias("t_used"))


@query("""with g as (select a, b from (select unnest([1, 2, 3]) a), (select unnest(['x', 'y']) b)) select a::bigint a, b, count(*) n from g, orders where o_orderkey % 3 + 1 = a group by 1, 2""")
def sweep_runs(spark, d):
    grid = evaluate.sweep_grid(spark, {"a": [1, 2, 3], "b": ["x", "y"]})
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 3 + 1).alias("a"))
    return F.broadcast(grid).join(o, "a").groupBy("a", "b").agg(F.count("*").alias("n"))
