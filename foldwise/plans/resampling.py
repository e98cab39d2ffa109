"""Queries on splits: samples are orders, groups are customers, bags are orders with lineitems as instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import resample as rs
from foldwise.plans.registry import query, table
from foldwise.sources.store import stored

LONG = "cast({} as bigint)"
SHUFFLED = "row_number() over (order by md5('{}:' || o_orderkey), o_orderkey) - 1"


@query("rs_holdout", """
select 'repeat_00' as resample_id, o_orderkey, case when pos >= n - ceil(0.25::double * n) then 'test' else 'train' end as role
from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos, count(*) over () as n from orders)""")
def _(spark, d):
    return rs.holdout(table(spark, d, "orders"), "o_orderkey", 0.25)


@query("rs_holdout_shuffled", f"""
select 'repeat_00' as resample_id, o_orderkey, case when pos >= n - ceil(0.25::double * n) then 'test' else 'train' end as role
from (select o_orderkey, {SHUFFLED.format(5)} as pos, count(*) over () as n from orders)""")
def _(spark, d):
    return rs.holdout(table(spark, d, "orders"), "o_orderkey", 0.25, seed=5)


QUOTAS = """
classes as (select o_orderpriority as c, count(*) as nc from orders group by 1),
exact as (select c, nc, sum(nc) over () as n, ceil(0.2::double * sum(nc) over ()) as want, nc * ceil(0.2::double * sum(nc) over ()) / sum(nc) over () as e from classes),
quotas as (select c, floor(e) + case when row_number() over (order by floor(e) - e, c) <= want - sum(floor(e)) over () then 1 else 0 end as quota from exact)"""


@query("rs_stratified_holdout", f"""
with {QUOTAS},
placed as (select o_orderkey, o_orderpriority as c, row_number() over (partition by o_orderpriority order by md5('3:' || o_orderkey), o_orderkey) - 1 as pos, count(*) over (partition by o_orderpriority) as n from orders)
select 'repeat_00' as resample_id, o_orderkey, case when pos >= n - quota then 'test' else 'train' end as role from placed join quotas using (c)""")
def _(spark, d):
    return rs.stratified_holdout(table(spark, d, "orders"), "o_orderkey", "o_orderpriority", 0.2, seed=3)


@query("rs_kfold", """
select o_orderkey, cast(ntile(5) over (order by md5('1:' || o_orderkey), o_orderkey) - 1 as integer) as fold from orders""")
def _(spark, d):
    return rs.kfold(table(spark, d, "orders"), "o_orderkey", 5, seed=1)


@query("rs_kfold_ordered", "select o_orderkey, cast(ntile(7) over (order by o_orderkey) - 1 as integer) as fold from orders")
def _(spark, d):
    return rs.kfold(table(spark, d, "orders"), "o_orderkey", 7)


@query("rs_fold_roles", """
select printf('fold_%02d', f) as resample_id, o_orderkey, case when fold = f then 'test' else 'train' end as role
from (select o_orderkey, ntile(5) over (order by md5('1:' || o_orderkey), o_orderkey) - 1 as fold from orders), (select unnest(range(5)) as f)""")
def _(spark, d):
    # a row for each order, which several passes read
    return rs.fold_roles(stored(rs.kfold(table(spark, d, "orders"), "o_orderkey", 5, seed=1), "folds"), "o_orderkey", 5)


@query("rs_stratified_kfold", """
with counts as (select o_orderpriority as c, count(*) as n from orders group by 1),
starts as (select c, n, sum(n) over (order by c) - n as s from counts),
quotas as (select c, f, floor((s + n - 1 - f)::double / 5) - floor((s - 1 - f)::double / 5) as q from starts, (select unnest(range(5)) as f)),
ends as (select c, f, sum(q) over (partition by c order by f) as e, sum(q) over (partition by c order by f) - q as b from quotas),
placed as (select o_orderkey, o_orderpriority as c, row_number() over (partition by o_orderpriority order by md5('2:' || o_orderkey), o_orderkey) - 1 as pos from orders)
select o_orderkey, cast(f as integer) as fold from placed join ends on placed.c = ends.c and pos >= b and pos < e""")
def _(spark, d):
    return rs.stratified_kfold(table(spark, d, "orders"), "o_orderkey", "o_orderpriority", 5, seed=2)


@query("rs_group_kfold", """with recursive sizes as materialized (select '{"o_custkey":' || o_custkey || '}' as name, count(*) as size from orders group by 1),
dealt as materialized (select size, row_number() over (order by size desc) as i from sizes),
turns as (select 0::bigint as i, [0, 0, 0, 0, 0]::bigint[] as loads, 0::bigint as size, 0::bigint as fold union all
 select d.i, list_transform(loads, lambda x, k: case when k = list_position(loads, list_min(loads)) then x + d.size else x end), d.size, list_position(loads, list_min(loads)) - 1 from turns t join dealt d on d.i = t.i + 1),
counts as (select s.size, f.fold, (select count(*) from turns t where t.i > 0 and t.size = s.size and t.fold <= f.fold) as upto from (select distinct size from sizes) s, (select unnest(range(5)) as fold) f),
placed as (select name, size, row_number() over (partition by size order by md5('groups:' || name), name) - 1 as pos from sizes),
folds as (select name, (select count(*) from counts c where c.size = p.size and c.upto <= p.pos)::integer as fold from placed p)
select o_orderkey, fold from orders join folds on name = '{"o_custkey":' || o_custkey || '}'""")
def _(spark, d):
    return rs.group_kfold(table(spark, d, "orders"), "o_orderkey", ["o_custkey"], 5)


@query("rs_group_kfold_check", """
select cast(0 as bigint) as split_groups, count(*) as n_rows, count(distinct o_custkey) as n_groups, true as balanced from orders""")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    folds = rs.group_kfold(orders, "o_orderkey", ["o_custkey"], 5).join(orders, "o_orderkey")
    groups = folds.groupBy("o_custkey").agg(F.count_distinct("fold").alias("k"), F.count("*").alias("n"))
    sizes = folds.groupBy("fold").agg(F.count("*").alias("n")).agg((F.max("n") - F.min("n")).alias("spread"))
    return groups.agg(F.sum((F.col("k") > 1).cast("long")).alias("split_groups"), F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.max("n").alias("_most")).crossJoin(sizes).select(
        "split_groups", "n_rows", "n_groups", (F.col("spread") <= F.col("_most")).alias("balanced"))


DRAWN = """
placed as materialized (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos, count(*) over () as n from orders),
draws as (select s, ('0x' || substr(md5('9:' || s || ':' || pos), 1, 15))::bigint % n as pos from placed, (select unnest(range(3)) as s)),
times as (select s, pos, count(*) as m from draws group by all),
boot as materialized (select printf('sample_%02d', every.s) as resample_id, o_orderkey, case when m is null then 'test' else 'train' end as role, coalesce(m, 1) as multiplicity
from (select o_orderkey, pos, s from placed, (select unnest(range(3)) as s)) every left join times on every.s = times.s and every.pos = times.pos)"""


@query("rs_bootstrap", f"with {DRAWN} select * from boot")
def _(spark, d):
    return rs.bootstrap(table(spark, d, "orders"), "o_orderkey", 3, seed=9)


@query("jn_out_of_bag", f"with {DRAWN} select resample_id, o_orderkey from boot where role = 'test'")
def _(spark, d):
    drawn = rs.bootstrap(table(spark, d, "orders"), "o_orderkey", 3, seed=9)
    every = drawn.select("resample_id", "o_orderkey")
    return every.join(drawn.filter("role = 'train'"), ["resample_id", "o_orderkey"], "left_anti")


@query("so_except", f"with {DRAWN} select o_orderkey from orders except select o_orderkey from boot where role = 'train' and resample_id = 'sample_00'")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    drawn = rs.bootstrap(orders, "o_orderkey", 3, seed=9).filter("role = 'train' and resample_id = 'sample_00'")
    return orders.exceptAll(drawn.select("o_orderkey"))


FOLDS = """folds as materialized (select printf('fold_%02d', f) as resample_id, o_orderkey, case when fold = f then 'test' else 'train' end as role
from (select o_orderkey, ntile(5) over (order by md5('1:' || o_orderkey), o_orderkey) - 1 as fold from orders), (select unnest(range(5)) as f))"""
VALID = f"""{FOLDS},
valid as materialized (select resample_id, o_orderkey, case when pos >= n - ceil(0.1::double * n) then 'valid' else 'train' end as role from (
  select resample_id, o_orderkey, row_number() over (partition by resample_id order by md5('4:' || o_orderkey), o_orderkey) - 1 as pos, count(*) over (partition by resample_id) as n
  from folds where role = 'train') union all select * from folds where role <> 'train')"""


def _folds(spark, d):
    # a row for each order, which several passes read
    return rs.fold_roles(stored(rs.kfold(table(spark, d, "orders"), "o_orderkey", 5, seed=1), "folds"), "o_orderkey", 5)


@query("rs_validation", f"with {VALID} select * from valid")
def _(spark, d):
    return rs.with_validation(_folds(spark, d), "o_orderkey", 0.1, seed=4)


@query("rs_stratified_validation", f"""with {FOLDS}, named as materialized (select folds.*, o_orderpriority as c from folds join orders using (o_orderkey)),
classes as (select resample_id, c, count(*) as nc from named where role = 'train' group by 1, 2),
exact as (select resample_id, c, ceil(0.1::double * sum(nc) over w) as want, nc * ceil(0.1::double * sum(nc) over w) / sum(nc) over w as e from classes window w as (partition by resample_id)),
quotas as (select resample_id, c, floor(e) + case when row_number() over (partition by resample_id order by floor(e) - e, c) <= want - sum(floor(e)) over (partition by resample_id) then 1 else 0 end as quota from exact),
placed as (select resample_id, c, o_orderkey, row_number() over (partition by resample_id, c order by md5('4:' || o_orderkey), o_orderkey) - 1 as pos, count(*) over (partition by resample_id, c) as n from named where role = 'train')
select resample_id, o_orderkey, case when pos >= n - quota then 'valid' else 'train' end as role from placed join quotas using (resample_id, c) union all select resample_id, o_orderkey, role from named where role <> 'train'""")
def _(spark, d):
    named = _folds(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return rs.with_validation(named, "o_orderkey", 0.1, seed=4, label="o_orderpriority")


@query("rs_group_validation", f"""
with {FOLDS}, named as (select folds.*, o_custkey from folds join orders using (o_orderkey)),
groups as (select distinct resample_id, o_custkey from named where role = 'train'),
chosen as (select resample_id, o_custkey from (select *, row_number() over (partition by resample_id order by md5('6:' || o_custkey), o_custkey) - 1 as pos, count(*) over (partition by resample_id) as n from groups)
  where pos < ceil(0.2::double * n))
select resample_id, o_custkey, o_orderkey, case when role = 'train' and (resample_id, o_custkey) in (select resample_id, o_custkey from chosen) then 'valid' else role end as role from named""")
def _(spark, d):
    named = _folds(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return rs.with_group_validation(named.select("resample_id", "o_custkey", "o_orderkey", "role"), "o_orderkey", "o_custkey", 0.2, seed=6)


@query("rs_train_plus_valid", f"with {VALID} select resample_id, count(*) as n_rows, sum(o_orderkey)::bigint as key_sum from valid where role in ('train', 'valid') group by 1")
def _(spark, d):
    both = rs.with_validation(_folds(spark, d), "o_orderkey", 0.1, seed=4).filter(F.col("role").isin("train", "valid"))
    return both.groupBy("resample_id").agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


@query("so_union_all", f"with {VALID} select resample_id, o_orderkey from valid where role = 'train' union all select resample_id, o_orderkey from valid where role = 'valid'")
def _(spark, d):
    roles = rs.with_validation(_folds(spark, d), "o_orderkey", 0.1, seed=4)
    return roles.filter("role = 'train'").unionByName(roles.filter("role = 'valid'")).select("resample_id", "o_orderkey")


@query("rs_repeated", """
select printf('repeat_%02d', r) as resample_id, o_orderkey, case when pos >= n - ceil(0.3::double * n) then 'test' else 'train' end as role from (
  select r, o_orderkey, count(*) over (partition by r) as n,
    row_number() over (partition by r order by md5(case when r = 0 then '8:' else '8:' || r || ':' end || o_orderkey), o_orderkey) - 1 as pos
  from orders, (select unnest(range(3)) as r))""")
def _(spark, d):
    orders = table(spark, d, "orders")
    parts = [rs.holdout(orders, "o_orderkey", 0.3, seed=8, repeat=r) for r in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("rs_repeated_stratified", f"""
with {QUOTAS},
placed as (select r, o_orderkey, o_orderpriority as c, row_number() over (partition by r, o_orderpriority order by md5(case when r = 0 then '3:' else '3:' || r || ':' end || o_orderkey), o_orderkey) - 1 as pos,
  count(*) over (partition by r, o_orderpriority) as n from orders, (select unnest(range(2)) as r))
select printf('repeat_%02d', r) as resample_id, o_orderkey, case when pos >= n - quota then 'test' else 'train' end as role from placed join quotas using (c)""")
def _(spark, d):
    orders = table(spark, d, "orders")
    parts = [rs.stratified_holdout(orders, "o_orderkey", "o_orderpriority", 0.2, seed=3, repeat=r) for r in range(2)]
    return parts[0].unionByName(parts[1])


@query("rs_bag_unit", """
with folds as (select o_orderkey, ntile(4) over (order by md5('1:' || o_orderkey), o_orderkey) - 1 as fold from orders)
select cast(fold as integer) as fold, count(distinct o_orderkey) as n_bags, count(l_orderkey) as n_instances from folds left join lineitem on l_orderkey = o_orderkey group by 1""")
def _(spark, d):
    folds = rs.kfold(table(spark, d, "orders"), "o_orderkey", 4, seed=1)
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return folds.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("fold").agg(
        F.count("*").alias("n_bags"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_instances"))


@query("rs_get_resample", f"with {FOLDS} select * from folds where resample_id = (select min(resample_id) from folds)")
def _(spark, d):
    folds = _folds(spark, d)
    first = folds.agg(F.min("resample_id").alias("resample_id"))
    return folds.join(F.broadcast(first), "resample_id")  # one row


@query("op_limit_first", f"with {FOLDS} select resample_id from folds order by resample_id limit 1")
def _(spark, d):
    return _folds(spark, d).select("resample_id").orderBy("resample_id").limit(1)


@query("jn_split_rows", f"""
with {DRAWN}, {FOLDS} select resample_id, role, count(*) as n_rows, round(sum(o_totalprice), 2) as price from (
  select resample_id, role, o_totalprice, unnest(range(multiplicity)) as draw from boot join orders using (o_orderkey)
  union all select resample_id, role, o_totalprice, 0 from folds join orders using (o_orderkey)) group by 1, 2""")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    drawn = rs.split_rows(orders, rs.bootstrap(orders, "o_orderkey", 3, seed=9), "o_orderkey").select("resample_id", "role", "o_totalprice")
    folded = rs.split_rows(orders, _folds(spark, d), "o_orderkey").select("resample_id", "role", "o_totalprice")
    return drawn.unionByName(folded).groupBy("resample_id", "role").agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query("jn_partition_overlap", f"with {VALID} select a.resample_id, a.o_orderkey from valid a where exists (select 1 from valid b where a.resample_id = b.resample_id and a.o_orderkey = b.o_orderkey and a.role <> b.role)")
def _(spark, d):
    roles = rs.with_validation(_folds(spark, d), "o_orderkey", 0.1, seed=4)
    role = F.xxhash64("role")  # numbers, so that the aggregation needs no sort
    return roles.groupBy("resample_id", "o_orderkey").agg(F.min(role).alias("a"), F.max(role).alias("b")).filter("a <> b").select("resample_id", "o_orderkey")


@query("so_intersect", f"with {FOLDS} select o_orderkey from folds where resample_id = 'fold_00' and role = 'train' intersect select o_orderkey from folds where resample_id = 'fold_01' and role = 'train'")
def _(spark, d):
    folds = _folds(spark, d).filter("role = 'train'")
    return folds.filter("resample_id = 'fold_00'").select("o_orderkey").intersect(folds.filter("resample_id = 'fold_01'").select("o_orderkey"))


@query("prd_positions_in_range", f"with {FOLDS} select o_orderkey from folds where o_orderkey not in (select l_orderkey from lineitem) group by 1")
def _(spark, d):
    # keys of the split that the instance table doesn't have
    return _folds(spark, d).join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey").distinct()


@query("op_positions", "select o_orderkey, row_number() over (order by o_orderkey) - 1 as position from orders")
def _(spark, d):
    return rs.ranked(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "position")
