"""The registered queries of the engine: each is text of its SQL dialect over the driver's tables (or an operator call), with DuckDB's SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, timeseries
from .session import Session

#: name here: (file, fields here -> columns there, primary key)
TABLES: dict[str, tuple[str, dict[str, str], str | None]] = {
    "acts": ("events", {"origin": "user_id", "destin": "event_type", "stamp": "ts", "value": "value", "props": "props", "id": "event_id"}, None),
    "ships": ("lineitem", {"origin": "l_suppkey", "destin": "l_partkey", "stamp": "l_shipdate", "ord": "l_orderkey", "line": "l_linenumber", "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "flag": "l_returnflag", "status": "l_linestatus"}, None),
    "places": ("orders", {"origin": "o_custkey", "destin": "o_orderkey", "stamp": "o_orderdate", "total": "o_totalprice", "status": "o_orderstatus", "priority": "o_orderpriority"}, None),
    "client": ("customer", {"client_key": "c_custkey", "client_name": "c_name", "nation": "c_nationkey", "balance": "c_acctbal", "segment": "c_mktsegment"}, "client_key"),
    "supplier": ("supplier", {"supp_key": "s_suppkey", "supp_name": "s_name", "nation": "s_nationkey", "balance": "s_acctbal"}, "supp_key"),
    "product": ("part", {"prod_key": "p_partkey", "prod_desc": "p_name", "brand": "p_brand", "prod_type": "p_type", "size": "p_size", "prod_price": "p_retailprice"}, "prod_key"),
    "nation": ("nation", {"nation_key": "n_nationkey", "nation_name": "n_name", "region": "n_regionkey"}, "nation_key"),
    "region": ("region", {"region_key": "r_regionkey", "region_name": "r_name"}, "region_key"),
}


def session(spark: SparkSession, sf_dir: str) -> Session:
    """A session over the driver's tables."""
    s = Session(spark)
    for name, (file, fields, pk) in TABLES.items():
        s.register(name, lambda file=file: spark.read.parquet(f"{sf_dir}/{file}.parquet"), fields, pk)
    return s


#: DuckDB: nanoseconds of a timestamp, and views with the engine's field names
NS = "epoch_ns(ts)"
SQL: dict[str, tuple[str, str]] = {
    # scans
    "scan_full": ("select origin, destin, value from acts", "SELECT user_id AS origin, event_type AS destin, value FROM events"),
    "scan_count_fast": ("select count(*) as n from ships", "SELECT count(*) AS n FROM lineitem"),
    "search_point": ("select client_name, balance from client where client_key = 7", "SELECT c_name AS client_name, c_acctbal AS balance FROM customer WHERE c_custkey = 7"),
    "search_in": ("select client_key, client_name from client where client_key in (1, 5, 9, 100)", "SELECT c_custkey AS client_key, c_name AS client_name FROM customer WHERE c_custkey IN (1, 5, 9, 100)"),
    "filter_period": ("select id, value from acts where stamp >= '2024-01-05' and stamp < '2024-01-08T12:00:00'", "SELECT event_id AS id, value FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-08 12:00:00'"),
    "filter_period_left": ("select id from acts where '2024-01-05' <= stamp and '2024-01-06' > stamp", "SELECT event_id AS id FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-06'"),
    "select_star": ("select * from nation", "SELECT CAST(n_nationkey AS BIGINT) AS nation_key, n_name AS nation_name, CAST(n_regionkey AS BIGINT) AS region FROM nation"),
    "select_alias": ("select prod_key as k, prod_price * 2 as twice from product", "SELECT p_partkey AS k, p_retailprice * 2 AS twice FROM part"),
    "select_const": ("select 3*2^1/2 as a, 7/2 as b, -7/2 as c, 7 % 3 as d, 'x' as t, true as y", "SELECT 3.0::DOUBLE AS a, 3::BIGINT AS b, -3::BIGINT AS c, 1::BIGINT AS d, 'x' AS t, true AS y"),
    # predicates
    "pred_and": ("select id from acts where value > 10 and value < 50", "SELECT event_id AS id FROM events WHERE value > 10 AND value < 50"),
    "pred_or": ("select id from acts where value < 5 or destin = 'click'", "SELECT event_id AS id FROM events WHERE value < 5 OR event_type = 'click'"),
    "pred_not": ("select id from acts where not (value < 50 or destin = 'click')", "SELECT event_id AS id FROM events WHERE NOT (value < 50 OR event_type = 'click')"),
    "pred_just": ("select id from acts where just (value < 20)", "SELECT event_id AS id FROM events WHERE value < 20"),
    "pred_const": ("select count(*) as n from acts where 1 = 0", "SELECT count(*) AS n FROM events WHERE 1 = 0"),
    "cmp_eq": ("select id from acts where origin = 3", "SELECT event_id AS id FROM events WHERE user_id = 3"),
    "cmp_ne": ("select id from acts where origin != 3", "SELECT event_id AS id FROM events WHERE user_id <> 3"),
    "cmp_lt": ("select id from acts where origin < 4", "SELECT event_id AS id FROM events WHERE user_id < 4"),
    "cmp_le": ("select id from acts where origin <= 4", "SELECT event_id AS id FROM events WHERE user_id <= 4"),
    "cmp_gt": ("select id from acts where origin > 4.5", "SELECT event_id AS id FROM events WHERE user_id > 4.5"),
    "cmp_ge": ("select id from acts where origin >= 4", "SELECT event_id AS id FROM events WHERE user_id >= 4"),
    "cmp_text_eq": ("select count(*) as n from ships where flag = 'R'", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'"),
    "cmp_text_ne": ("select count(*) as n from ships where flag <> 'R'", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag <> 'R'"),
    "cmp_stamp_ns": ("select id from acts where stamp >= 1704412800000000000", "SELECT event_id AS id FROM events WHERE epoch_ns(ts) >= 1704412800000000000"),
    "in_list_text": ("select count(*) as n from acts where destin in ('click', 'view', 'none')", "SELECT count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'none')"),
    "is_null": ("select id from acts where case when value > 100 then value end is null", "SELECT event_id AS id FROM events WHERE CASE WHEN value > 100 THEN value END IS NULL"),
    "is_not_null": ("select id from acts where case when value > 100 then value end is not null", "SELECT event_id AS id FROM events WHERE CASE WHEN value > 100 THEN value END IS NOT NULL"),
    "case_else": ("select id, case when value < 20 then 'low' when value < 80 then 'mid' else 'high' end as level from acts", "SELECT event_id AS id, CASE WHEN value < 20 THEN 'low' WHEN value < 80 THEN 'mid' ELSE 'high' END AS level FROM events"),
    "case_noelse": ("select id, case when value < 20 then value end as low from acts", "SELECT event_id AS id, CASE WHEN value < 20 THEN value END AS low FROM events"),
    "case_widened": ("select id, case when value < 20 then 1 else value end as v from acts", "SELECT event_id AS id, CASE WHEN value < 20 THEN 1.0::DOUBLE ELSE value END AS v FROM events"),
    "coalesce": ("select id, coalesce(case when value > 50 then value end, 0.5) as v from acts", "SELECT event_id AS id, coalesce(CASE WHEN value > 50 THEN value END, 0.5::DOUBLE) AS v FROM events"),
    "in_query": ("select origin, total from places where origin in (select client_key from client where balance > 5000)", "SELECT o_custkey AS origin, o_totalprice AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)"),
    "not_in_query": ("select client_key from client where client_key not in (select origin from places where total > 1000)", "SELECT c_custkey AS client_key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 1000)"),
    "exists_query": ("select count(*) as n from client where exists (select 1 from places where total < 0) or exists (select 1 from region)", "SELECT count(*) AS n FROM customer"),
    "scalar_query": ("select id, value from acts where value > (select avg(value) from acts) and stamp <= (select max(stamp) from acts)", "SELECT event_id AS id, value FROM events WHERE value > (SELECT avg(value) FROM events)"),
    "between": ("select id from acts where value between 10 and 20", "SELECT event_id AS id FROM events WHERE value BETWEEN 10 AND 20"),
    "between_open": ("select id from acts where value between ]10, 20]", "SELECT event_id AS id FROM events WHERE value > 10 AND value <= 20"),
    # aggregates
    "agg_count": ("select count(*) as n, count(value) as m, count(case when value > 100 then value end) as k from acts", "SELECT count(*) AS n, count(*) AS m, count(*) AS k FROM events"),
    "agg_sum": ("select sum(origin) as s, sum(1) as n, round(sum(value), 4) as v from acts", "SELECT CAST(sum(user_id) AS BIGINT) AS s, count(*) AS n, round(sum(value), 4) AS v FROM events"),
    "agg_prod": ("select origin, round(log(prod(case when value > 20 then 1.0 + value / 1000 end)), 6) as p from acts group by origin", "SELECT user_id AS origin, round(ln(product(CASE WHEN value > 20 THEN 1.0 + value / 1000 END)), 6) AS p FROM events GROUP BY 1"),
    "agg_max": ("select max(value) as v, max(stamp) as t from acts", "SELECT max(value) AS v, max(ts) AS t FROM events"),
    "agg_min": ("select min(value) as v, min(stamp) as t from acts", "SELECT min(value) AS v, min(ts) AS t FROM events"),
    "agg_spread": ("select round(spread(value), 9) as v, spread(origin) as o from acts", "SELECT round(max(value) - min(value), 9) AS v, max(user_id) - min(user_id) AS o FROM events"),
    "agg_avg": ("select round(avg(value), 6) as v from acts", "SELECT round(avg(value), 6) AS v FROM events"),
    "agg_median": ("select median(value) as v from acts", "SELECT median(value) AS v FROM events"),
    "agg_stddev": ("select round(stddev(value), 6) as v from acts", "SELECT round(stddev_samp(value), 6) AS v FROM events"),
    "agg_stddev_one": ("select stddev(value) as v from acts where id = 1", "SELECT coalesce(stddev_samp(value), 0.0::DOUBLE) AS v FROM events WHERE event_id = 1"),
    "agg_mode": ("select mode(origin) as m from acts", "SELECT user_id AS m FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"),
    "agg_count_distinct": ("select count(distinct destin) as n from acts", "SELECT count(DISTINCT event_type) AS n FROM events"),
    "agg_expr": ("select round(sum(log(price)), 4) as s, round(avg(price^0.5), 6) as a, sum(case when flag = 'R' then 1 else 0 end) as r from ships", "SELECT round(sum(ln(l_extendedprice)), 4) AS s, round(avg(sqrt(l_extendedprice)), 6) AS a, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS r FROM lineitem"),
    "agg_over_expr": ("select round(sum(price)/count(*), 4) as a, coal(sum(line), 0) as s from ships", "SELECT round(sum(l_extendedprice)/count(*), 4) AS a, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS s FROM lineitem"),
    "agg_none": ("select sum(value) as s, count(*) as n, avg(value) as a, max(value) as m from acts where 1 = 0", "SELECT sum(value) AS s, count(*) AS n, avg(value) AS a, max(value) AS m FROM events WHERE 1 = 0"),
    # groups and order
    "group_keys_only": ("select origin, destin from acts group by origin, destin", "SELECT DISTINCT user_id AS origin, event_type AS destin FROM events"),
    "group_agg": ("select origin, count(*) as n, round(sum(price), 2) as s, min(quantity) as q from ships group by origin", "SELECT l_suppkey AS origin, count(*) AS n, round(sum(l_extendedprice), 2) AS s, min(l_quantity) AS q FROM lineitem GROUP BY 1"),
    "group_multi_key": ("select flag, status, count(*) as n, round(sum(quantity), 2) as q, round(sum(price * (1 - discount)), 2) as r, round(avg(discount), 6) as d from ships where stamp <= '1998-09-02' group by flag, status", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS r, round(avg(l_discount), 6) AS d FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY 1, 2"),
    "group_filter": ("select origin, max(value) as m from acts where destin = 'click' and stamp >= '2024-01-05' group by origin", "SELECT user_id AS origin, max(value) AS m FROM events WHERE event_type = 'click' AND ts >= '2024-01-05' GROUP BY 1"),
    "group_median": ("select destin, median(value) as m, round(stddev(value), 6) as s, round(spread(value), 9) as w from acts group by destin", "SELECT event_type AS destin, median(value) AS m, round(coalesce(stddev_samp(value), 0), 6) AS s, round(max(value) - min(value), 9) AS w FROM events GROUP BY 1"),
    "group_expr": ("select year(stamp) as y, count(*) as n from ships group by year(stamp)", "SELECT CAST(year(l_shipdate) AS BIGINT) AS y, count(*) AS n FROM lineitem GROUP BY 1"),
    "group_null_key": ("select case when value > 50 then origin end as k, count(*) as n from acts group by k", "SELECT CASE WHEN value > 50 THEN user_id END AS k, count(*) AS n FROM events GROUP BY 1"),
    "group_having": ("select origin, count(*) as n from acts group by origin having count(*) > 20", "SELECT user_id AS origin, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 20"),
    "group_order": ("select origin, count(*) as n from acts group by origin order by origin", "SELECT user_id AS origin, count(*) AS n FROM events GROUP BY 1 ORDER BY 1"),
    "order_by": ("select origin, stamp, id from acts order by origin, stamp, id", "SELECT user_id AS origin, ts AS stamp, event_id AS id FROM events ORDER BY 1, 2, 3"),
    "order_desc_limit": ("select id, value from acts order by value desc, id limit 10", "SELECT event_id AS id, value FROM events ORDER BY value DESC, event_id LIMIT 10"),
    # arithmetic
    "arith_add": ("select id, value + 1 as a, origin + 2 as b from acts", "SELECT event_id AS id, value + 1 AS a, user_id + 2 AS b FROM events"),
    "arith_sub": ("select id, value - 1 as a, origin-1 as b from acts", "SELECT event_id AS id, value - 1 AS a, user_id - 1 AS b FROM events"),
    "arith_mul": ("select id, value * 2 as a, origin * 3 as b from acts", "SELECT event_id AS id, value * 2 AS a, user_id * 3 AS b FROM events"),
    "arith_fdiv": ("select id, value / 4 as a, value / (origin - 3) as b from acts", "SELECT event_id AS id, value / 4 AS a, CASE WHEN user_id <> 3 THEN value / (user_id - 3) END AS b FROM events"),
    "arith_idiv": ("select id, id / 7 as a, (0 - id) / 7 as b, id / (origin - 3) as c from acts", "SELECT event_id AS id, event_id // 7 AS a, -(event_id // 7) AS b, CASE WHEN user_id <> 3 THEN CAST(trunc(event_id / (user_id - 3)) AS BIGINT) END AS c FROM events"),
    "arith_rem": ("select id, id % 7 as a, (0 - id) % 7 as b, id % (origin - 3) as c from acts", "SELECT event_id AS id, event_id % 7 AS a, (-event_id) % 7 AS b, CASE WHEN user_id = 3 THEN 0 ELSE event_id % (user_id - 3) END AS c FROM events"),
    "arith_pow": ("select id, origin ^ 2 as a, 2 ^ 3 ^ 2 as b from acts", "SELECT event_id AS id, pow(user_id, 2)::DOUBLE AS a, 64.0::DOUBLE AS b FROM events"),
    # mathematics
    "math_log": ("select id, round(log(value + 1), 9) as v from acts", "SELECT event_id AS id, round(ln(value + 1), 9) AS v FROM events"),
    "math_abs": ("select id, abs(value - 50) as v, abs(5 - origin) as o from acts", "SELECT event_id AS id, abs(value - 50) AS v, abs(5 - user_id) AS o FROM events"),
    "math_ceil": ("select id, ceil(value) as v from acts", "SELECT event_id AS id, ceil(value)::DOUBLE AS v FROM events"),
    "math_floor": ("select id, floor(value) as v from acts", "SELECT event_id AS id, floor(value)::DOUBLE AS v FROM events"),
    "math_round": ("select id, round(value) as v from acts", "SELECT event_id AS id, round(value)::DOUBLE AS v FROM events"),
    "math_edges": ("select totext(log(0.0)) as a, totext(log(0.0 - 1.0)) as b, totext(asin(2.0)) as c, totext(acos(2.0)) as d, totext(acosh(0.0)) as e, totext(atanh(2.0)) as f, totext(atanh(1.0)) as g, 2.0 ^ 0.5 > 1.4142 as h", "SELECT '-Infinity' AS a, 'NaN' AS b, 'NaN' AS c, 'NaN' AS d, 'NaN' AS e, 'NaN' AS f, 'Infinity' AS g, true AS h"),
    "math_root": ("select id, round(root(value, 3), 6) as v from acts", "SELECT event_id AS id, round(pow(value, 1.0 / 3), 6) AS v FROM events"),
    "bitwise": ("select id, bitand(id, 12) as a, bitor(id, 5) as b, bitxor(id, 3) as c, bitnot(id) as d, shl(id, 3) as e, shr(id, 1) as f from acts", "SELECT event_id AS id, event_id & 12 AS a, event_id | 5 AS b, xor(event_id, 3) AS c, ~event_id AS d, event_id * 8 AS e, event_id >> 1 AS f FROM events"),
    "math_pi": ("select round(pi(), 12) as v", "SELECT round(pi(), 12) AS v"),
    "math_e": ("select round(e(), 12) as v", "SELECT round(exp(1), 12) AS v"),
    # conversions
    "conv_tofloat": ("select id, tofloat(origin) as v from acts", "SELECT event_id AS id, user_id::DOUBLE AS v FROM events"),
    "conv_toint": ("select id, toint(value) as v, toint(0.0 - value) as w from acts", "SELECT event_id AS id, CAST(trunc(value) AS BIGINT) AS v, -CAST(trunc(value) AS BIGINT) AS w FROM events"),
    "conv_touint": ("select id, touint(value) as v from acts", "SELECT event_id AS id, CAST(trunc(value) AS BIGINT) AS v FROM events"),
    "conv_totime": ("select id, year(totime(stamp + 0)) as v from acts", "SELECT event_id AS id, CAST(year(ts) AS BIGINT) AS v FROM events"),
    # time
    "time_nanos": ("select id, stamp + 0 as ns from acts", f"SELECT event_id AS id, {NS} AS ns FROM events"),
    "time_year": ("select id, year(stamp) as v from acts", "SELECT event_id AS id, CAST(year(ts) AS BIGINT) AS v FROM events"),
    "time_month": ("select id, month(stamp) as v from acts", "SELECT event_id AS id, CAST(month(ts) AS BIGINT) AS v FROM events"),
    "time_mday": ("select id, mday(stamp) as v from acts", "SELECT event_id AS id, CAST(day(ts) AS BIGINT) AS v FROM events"),
    "time_wday": ("select id, wday(stamp) as v from acts", "SELECT event_id AS id, CAST(dayofweek(ts) AS BIGINT) AS v FROM events"),
    "time_yday": ("select id, yday(stamp) as v from acts", "SELECT event_id AS id, CAST(dayofyear(ts) - 1 AS BIGINT) AS v FROM events"),
    "time_hour": ("select id, hour(stamp) as v from acts", "SELECT event_id AS id, CAST(hour(ts) AS BIGINT) AS v FROM events"),
    "time_minute": ("select id, minute(stamp) as v from acts", "SELECT event_id AS id, CAST(minute(ts) AS BIGINT) AS v FROM events"),
    "time_second": ("select id, second(stamp) as v from acts", "SELECT event_id AS id, CAST(second(ts) AS BIGINT) AS v FROM events"),
    "time_milli": ("select id, milli(stamp + 123456789) as v from acts", f"SELECT event_id AS id, (({NS} + 123456789) % 1000000000) // 1000000 AS v FROM events"),
    "time_micro": ("select id, micro(stamp + 123456789) as v from acts", f"SELECT event_id AS id, (({NS} + 123456789) % 1000000000) // 1000 AS v FROM events"),
    "time_nano": ("select id, nano(stamp + 123456789) as v from acts", f"SELECT event_id AS id, ({NS} + 123456789) % 1000000000 AS v FROM events"),
    "time_bounds": ("select dawn() as a, dusk() as b, epoch() as c", "SELECT (-9223372036854775807 - 1)::BIGINT AS a, 9223372036854775807::BIGINT AS b, 0::BIGINT AS c"),
    "bucket_hour": ("select stamp/3600000000000 as h, count(*) as n, round(sum(value), 4) as s from acts group by h", f"SELECT {NS} // 3600000000000 AS h, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1"),
    # text
    "text_functions": ("select client_key as k, substr(client_name, 1, 4) as a, length(client_name) as n, strcat(segment, '-', client_name) as c, pos(client_name, '#') as p from client", "SELECT c_custkey AS k, substr(c_name, 1, 4) AS a, length(c_name) AS n, c_mktsegment || '-' || c_name AS c, instr(c_name, '#') AS p FROM customer"),
    "text_pos_column": ("select client_key as k, pos(strcat(client_name, segment), segment) as p from client", "SELECT c_custkey AS k, instr(c_name || c_mktsegment, c_mktsegment) AS p FROM customer"),
    "text_escapes": (r"select 'it\'s\n\\' as t", r"SELECT 'it''s' || chr(10) || '\' AS t"),
    # idioms
    "top3_revenue": ("select origin, round(sum(price), 2) as revenue from ships where stamp >= '1997-01-01' and stamp < '1998-01-01' group by origin order by revenue desc, origin limit 3", "SELECT l_suppkey AS origin, round(sum(l_extendedprice), 2) AS revenue FROM lineitem WHERE l_shipdate >= '1997-01-01' AND l_shipdate < '1998-01-01' GROUP BY 1 ORDER BY revenue DESC, origin LIMIT 3"),
    "join_vertex": ("select o.origin, c.client_name, o.total from places as o join client as c on origin where o.total > 100000", "SELECT o_custkey AS origin, c_name AS client_name, o_totalprice AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000"),
    "join_vertex_group": ("select c.segment, count(*) as n, round(sum(o.total), 2) as s from places as o join client as c on origin group by c.segment", "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "join_left": ("select s.origin, p.brand, count(*) as n from ships as s left join product as p on destin group by s.origin, p.brand", "SELECT l_suppkey AS origin, p_brand AS brand, count(*) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"),
}
for _f in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh"):
    _arg = {"asin": ("value / 1000", "value / 1000"), "acos": ("value / 1000", "value / 1000"), "atanh": ("value / 1000", "value / 1000"), "acosh": ("1 + value / 100", "1 + value / 100"), "sinh": ("value / 100", "value / 100"), "cosh": ("value / 100", "value / 100")}.get(_f, ("value", "value"))
    SQL[f"math_{_f}"] = (f"select id, round({_f}({_arg[0]}), 6) as v from acts", f"SELECT event_id AS id, round({_f}({_arg[1]}), 6) AS v FROM events")


def _text(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir).sql(sql)


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = session(spark, sf_dir).table("acts").select("origin", "id", F.unix_micros(F.col("stamp").cast("timestamp")).alias("at"), "value")
    return timeseries.differences(acts, ["origin"], "at", "value", ["id"]).select("origin", "id", F.round("diff", 9).alias("diff"))


def integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = session(spark, sf_dir).table("acts").select("origin", "id", F.unix_micros(F.col("stamp").cast("timestamp")).alias("at"), "value")
    out = timeseries.integral(acts, ["origin"], "at", "value", "v", ["id"])
    return out.select("origin", F.round(F.col("v") / 1e9, 4).alias("v"))


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = session(spark, sf_dir).table("acts").select("origin", "destin", "id", F.unix_micros(F.col("stamp").cast("timestamp")).alias("at"), "value")
    left = acts.filter("destin = 'purchase'").select("origin", "id", "at")
    right = acts.filter("destin = 'click'").select("origin", "at", F.col("value").alias("click_value"))
    return timeseries.as_of(left, right, ["origin"], "at", "at", ["click_value"]).select("id", "click_value")


def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, then line items: two hops from customer 1 to products."""
    s = session(spark, sf_dir)
    a = s.table("places").select(F.concat(F.lit("c"), "origin").alias("origin"), F.concat(F.lit("o"), "destin").alias("destin"))
    b = s.table("ships").select(F.concat(F.lit("o"), "ord").alias("origin"), F.concat(F.lit("p"), "destin").alias("destin"))
    return graph.reach(a.unionByName(b), spark.createDataFrame([("c1",)], "v string"), 3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _text(sql) for name, (sql, _) in SQL.items()}
QUERIES |= {"diffs": diffs, "integral": integral, "as_of": as_of, "reach": reach}

ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in SQL.items()}
ORACLE_SQL |= {
    "diffs": "SELECT user_id AS origin, event_id AS id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 9) AS diff FROM events",
    "integral": "SELECT origin, round(coalesce(sum((x - p) * value), 0) / 1e9, 4) AS v FROM (SELECT user_id AS origin, value, epoch_us(ts) AS x, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1",
    "as_of": "SELECT e.event_id AS id, (SELECT c.value FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.ts <= e.ts ORDER BY c.ts DESC, c.value DESC LIMIT 1) AS click_value FROM events e WHERE e.event_type = 'purchase'",
    "reach": "SELECT DISTINCT vertex, hops FROM (SELECT 'c1' AS vertex, 0 AS hops UNION ALL SELECT 'o' || o_orderkey, 1 FROM orders WHERE o_custkey = 1 UNION ALL SELECT 'p' || l_partkey, 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 1)",
}
#: The query that entry() runs.
FLAGSHIP = "group_multi_key"
