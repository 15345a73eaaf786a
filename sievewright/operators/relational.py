"""Relational verbs of the screening code over the generic tables."""

from __future__ import annotations

from ..plans.catalogue import CATALOGUE as C

R = lambda x, n=6: f"round(CAST({x} AS DOUBLE), {n})"

C.add(
    scan_parquet_pruned=lambda d: "SELECT o_orderkey, o_totalprice FROM orders",
    project_rename=lambda d: "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status FROM orders",
    filter_isin=lambda d: "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 1000",
    join_left_one_to_one=lambda d: "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    join_many_to_one=lambda d: "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    lookup_map_join=lambda d: "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    anti_join_isin=lambda d: "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    semi_join=lambda d: "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    cross_join_briefs=lambda d: "SELECT b.item_id, t.r_name AS rubric FROM benchmark b CROSS JOIN region t",
    # the window runs over distinct lengths, not over documents
    rank_in_reference=lambda d: f"WITH v AS (SELECT lang, n_chars, count(l.doc_id) AS c FROM documents t LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON t.doc_id = l.doc_id GROUP BY lang, n_chars), cum AS (SELECT lang, n_chars, sum(c) OVER (PARTITION BY lang ORDER BY n_chars) AS le, sum(c) OVER (PARTITION BY lang) AS n FROM v) SELECT doc_id, {R('le * 1e0 / nullif(n, 0)')} AS share FROM documents t JOIN cum c ON t.lang = c.lang AND t.n_chars = c.n_chars",
    union_by_name_strict=lambda d: "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region",
    set_difference=lambda d: "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    set_intersect=lambda d: "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0",
    group_agg=lambda d: f"SELECT c_mktsegment, count(*) AS n, {R('sum(c_acctbal)', 2)} AS total, {R('avg(c_acctbal)', 4)} AS mean, {R('median(c_acctbal)', 4)} AS med, {R('stddev_samp(c_acctbal)', 4)} AS sd, min(c_name) AS first_name FROM customer GROUP BY c_mktsegment",
    value_counts_normalised=lambda d: f"SELECT lang, coalesce(CAST(quality AS VARCHAR(9)), 'none') AS label, count(*) AS n, {R('count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY lang)')} AS share FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang, coalesce(CAST(quality AS VARCHAR(9)), 'none')",
    pivot_crosstab=lambda d: "SELECT lang, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS good, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad, CAST(sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS none FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang",
    stack_melt=lambda d: "SELECT doc_id, 'quality' AS measure, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels",
    window_cumsum=lambda d: f"SELECT event_id, user_id, {R('sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 4)} AS running FROM events",
    first_row_per_group=lambda d: "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) q WHERE k = 1",
    # groups are named by a digest of the text, and only they are shuffled with the ids
    keep_first_dup_flag=lambda d: f"WITH k AS (SELECT doc_id, {d.sha('text')} AS k FROM documents), m AS (SELECT k, min(doc_id) AS lo FROM k GROUP BY k) SELECT doc_id, doc_id > lo AS dup FROM k JOIN m ON m.k = k.k",
    all_members_dup_flag=lambda d: f"WITH k AS (SELECT doc_id, {d.sha('text')} AS k FROM documents), m AS (SELECT k, count(*) AS n FROM k GROUP BY k) SELECT doc_id, n > 1 AS dup FROM k JOIN m ON m.k = k.k",
    string_functions=lambda d: f"SELECT c_custkey, length(c_name) AS n, substring(c_name, 1, 8) AS head, contains(c_name, '00001') AS has, {d.count_of('c_name', '0')} AS zeros, startswith(c_name, 'Cust') AS starts, endswith(c_name, '7') AS ends, lower(c_name) AS low FROM customer" if d.name == "spark" else "SELECT c_custkey, length(c_name) AS n, substring(c_name, 1, 8) AS head, contains(c_name, '00001') AS has, CAST(length(c_name) - length(replace(c_name, '0', '')) AS INT) AS zeros, starts_with(c_name, 'Cust') AS starts, ends_with(c_name, '7') AS ends, lower(c_name) AS low FROM customer",
    json_props=lambda d: f"SELECT event_id, CAST({d.json('props', 'k')} AS INT) AS k FROM events",
    map_functions=lambda d: "WITH m AS (SELECT user_id, map_from_entries(sort_array(collect_list(struct(event_type, n)))) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) q GROUP BY user_id) SELECT user_id, size(map_keys(m)) AS kinds, coalesce(m['view'], 0) AS views, array_max(map_values(m)) AS most FROM m" if d.name == "spark" else "SELECT user_id, count(DISTINCT event_type)::INT AS kinds, count(*) FILTER (event_type = 'view') AS views, (SELECT max(n) FROM (SELECT count(*) AS n FROM events x WHERE x.user_id = e.user_id GROUP BY event_type)) AS most FROM events e GROUP BY user_id",
    rollup_pooled=lambda d: "SELECT coalesce(lang, 'all') AS lang, count(*) AS n FROM documents GROUP BY ROLLUP(lang)",
    cube_counts=lambda d: "SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n FROM documents GROUP BY CUBE(lang, source)",
    grouping_sets=lambda d: "SELECT coalesce(c_mktsegment, 'all') AS segment, coalesce(CAST(c_nationkey AS VARCHAR(9)), 'all') AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    # on few values the approximations are exact
    approx_aggregates=lambda d: "SELECT approx_count_distinct(o_orderpriority, 0.01) AS priorities, percentile_approx(o_totalprice, 0.5, 1000000) AS median FROM orders" if d.name == "spark" else "SELECT count(DISTINCT o_orderpriority) AS priorities, quantile_disc(o_totalprice, 0.5) AS median FROM orders",
    preprocess_linear=lambda d: f"WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS v, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS g FROM customer), m AS (SELECT {d.pct('v', 0.5)} AS med FROM x), o AS (SELECT g AS mode FROM x WHERE g IS NOT NULL GROUP BY g ORDER BY count(*) DESC, g LIMIT 1), f AS (SELECT c_custkey, coalesce(v, med) AS v, coalesce(g, mode) AS g FROM x CROSS JOIN m CROSS JOIN o), s AS (SELECT avg(v) AS mu, nullif(stddev_pop(v), 0) AS sd FROM f) SELECT c_custkey, {R('(v - mu) / sd')} AS z, {', '.join(f'CASE WHEN g = {chr(39)}{k}{chr(39)} THEN 1 ELSE 0 END AS seg_{i}' for i, k in enumerate(('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')))} FROM f CROSS JOIN s",
    # a column without any value becomes 0 and stays
    tier1b_features=lambda d: f"WITH x AS (SELECT paper_id, s, CAST(NULL AS DOUBLE) AS gone, CASE WHEN paper_id % 4 <> 0 THEN s2 END AS holes FROM scored), m AS (SELECT {d.pct('s', 0.5)} AS ms, {d.pct('holes', 0.5)} AS mh, {d.pct('gone', 0.5)} AS mg FROM x) SELECT paper_id, {R('coalesce(s, ms, 0)')} AS s, {R('coalesce(holes, mh, 0)')} AS holes, {R('coalesce(gone, mg, 0)')} AS gone FROM x CROSS JOIN m",
    topk_nlargest=lambda d: "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    topk_per_group=lambda d: "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) q WHERE k <= 3",
    bin_cut=lambda d: "SELECT bin, count(*) AS n FROM (SELECT CASE WHEN n_chars <= 500 THEN '(0,500]' WHEN n_chars <= 2000 THEN '(500,2000]' ELSE '(2000,)' END AS bin FROM documents) q GROUP BY bin",
    quantile_bins=lambda d: f"WITH e AS (SELECT {d.pct('n_chars', 0.25)} AS a, {d.pct('n_chars', 0.5)} AS b, {d.pct('n_chars', 0.75)} AS c FROM documents) SELECT CASE WHEN n_chars <= a THEN 1 WHEN n_chars <= b THEN 2 WHEN n_chars <= c THEN 3 ELSE 4 END AS bin, count(*) AS n FROM documents CROSS JOIN e GROUP BY CASE WHEN n_chars <= a THEN 1 WHEN n_chars <= b THEN 2 WHEN n_chars <= c THEN 3 ELSE 4 END",
    describe_quantile_skew=lambda d: f"WITH m AS (SELECT avg(value) AS mu, count(*) AS n FROM events) SELECT max(n) AS n, {R('avg(value)', 4)} AS mean, {R(d.pct('value', 0.25), 4)} AS p25, {R(d.pct('value', 0.75), 4)} AS p75, {R('sqrt(max(n) * (max(n) - 1e0)) / (max(n) - 2) * (sum(power(value - mu, 3)) / max(n)) / power(sum(power(value - mu, 2)) / max(n), 1.5e0)', 4)} AS skew FROM events CROSS JOIN m",
    corr_pearson_spearman=lambda d: f"WITH x AS (SELECT quality AS a, n_chars AS b FROM documents d JOIN labels l ON d.doc_id = l.doc_id), ha AS (SELECT a, sum(count(*)) OVER (ORDER BY a) - (count(*) - 1) / 2e0 AS ra FROM x GROUP BY a), hb AS (SELECT b, sum(count(*)) OVER (ORDER BY b) - (count(*) - 1) / 2e0 AS rb FROM x GROUP BY b) SELECT {R('corr(x.a * 1e0, x.b * 1e0)')} AS pearson, {R('corr(ra, rb)')} AS spearman FROM x JOIN ha ON x.a = ha.a JOIN hb ON x.b = hb.b",
    explode_split=lambda d: f"SELECT token, count(*) AS n FROM (SELECT {d.each(d.split('text', ' '))} AS token FROM conversations) q GROUP BY token",
    clip_log_ratio=lambda d: f"SELECT doc_id, {R('ln(1 + n_chars)')} AS log_chars, greatest(0, 2000 - n_chars) AS gap FROM documents",
    date_part_year=lambda d: "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)",
    sample_per_stratum=lambda d: "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('42-', CAST(doc_id AS VARCHAR(20)))), doc_id) AS k FROM documents) q WHERE k <= 25",
    round_record=lambda d: f"SELECT event_id, {R('value', 2)} AS v FROM events",
    # one sort per user in place of a range join
    asof_join=lambda d: f"WITH w AS (SELECT event_id, event_type, max(CASE WHEN event_type = 'view' THEN {d.pair(d.epoch('ts'), 'event_id')} END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM events) SELECT event_id, v.b AS last_view FROM w WHERE event_type = 'purchase' AND v IS NOT NULL",
    rolling_window=lambda d: f"SELECT event_id, {R('avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 4)} AS rolling FROM events",
    sessionise=lambda d: f"WITH g AS (SELECT user_id, event_id, ts, CASE WHEN {d.epoch('ts')} - lag({d.epoch('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events) SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions FROM g GROUP BY user_id",
    tumbling_window=lambda d: f"SELECT {d.hour('ts')} AS hour, event_type, count(*) AS n FROM events GROUP BY {d.hour('ts')}, event_type",
    pricing_summary=lambda d: f"SELECT l_returnflag, l_linestatus, {R('sum(l_quantity)', 2)} AS sum_qty, {R('sum(l_extendedprice * (1 - l_discount))', 2)} AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
)
