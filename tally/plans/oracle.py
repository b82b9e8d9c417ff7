"""Reference SQL (DuckDB dialect) for every report in ``reports.REPORTS``.

Each statement recomputes its report directly from the raw star-schema tables
with plain joins and aggregates, independently of the Spark plan, and names
its columns exactly as the report does.
"""

from __future__ import annotations

from tally.functions.calendar import MONTH_NAMES, WEEKDAY_NAMES

SALES = "cast(l.l_extendedprice as decimal(18,2))"
PROFIT = ("cast(cast(l.l_extendedprice as decimal(18,2)) * (1 - cast(l.l_discount as decimal(4,2)))"
          " - cast(l.l_quantity as decimal(18,2)) * cast(p.p_retailprice as decimal(18,2))"
          " as decimal(18,4))")
L_O = "lineitem l join orders o on l.l_orderkey = o.o_orderkey"
L_P = "lineitem l join part p on l.l_partkey = p.p_partkey"
L_O_P = f"{L_O} join part p on l.l_partkey = p.p_partkey"
# lineitem's columns and their Spark type names, in table order.
LINEITEM_TYPES = (("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                  ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                  ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                  ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"))


def _domain(names, first):
    return ", ".join(f"('{n}', {i + first})" for i, n in enumerate(names))


WEEKDAYS = f"(values {_domain(WEEKDAY_NAMES, 0)}) as d(weekday, weekday_ordinal)"
MONTHS = f"(values {_domain(MONTH_NAMES, 1)}) as d(month_name, month_ordinal)"


def _zero_filled(dom: str, key: str, ordinal: str, measure: str, inner: str, zero: str) -> str:
    return (f"select d.{key}, cast(d.{ordinal} as integer) as {ordinal}, "
            f"coalesce(a.{measure}, {zero}) as {measure} "
            f"from {dom} left join ({inner}) a on a.{key} = d.{key} order by 2")


def _part_sum(attr: str, out: str, expr: str, measure: str, cast: str = "double") -> str:
    return (f"select p.{attr} as {out}, cast(sum({expr}) as {cast}) as {measure} "
            f"from {L_P} group by 1 order by 1")


def _share(inner_dec: str, key: str, measure: str) -> str:
    return (f"with a as ({inner_dec}) select {key}, cast({measure} as double) as {measure}, "
            f"100.0::double * cast({measure} as double) / cast((select sum({measure}) from a) as double)"
            f" as share_pct from a order by 1")


# The closed domains of the pivots' columns.
RETURN_FLAGS = ("A", "N", "R")
PART_SIZES = range(1, 51)


def _pivot(index: str, out: str, col: str, domain, scale: str = "", grand: str = "") -> str:
    """A pivot by conditional sums over a closed domain; rows without a key are left out."""
    cell = "{s}cast(coalesce(sum({v}) filter ({c} = {x}), 0) as double){g}"
    cells = ", ".join(cell.format(s=scale, v=SALES, c=col, x=repr(x), g=grand) + f' as "{x}"' for x in domain)
    return (f"select {index} as {out}, {cells} from {L_P} where {index} is not null and {col} is not null "
            f"group by 1 order by 1")


def _ranked(measure_sql: str, measure: str, desc: bool) -> str:
    order = "desc" if desc else "asc"
    return (f"select p.p_name as product, {measure_sql} as {measure} from {L_P} "
            f"group by 1 order by 2 {order}, 1 limit 5")


def _segment(with_ratio: bool) -> str:
    inner = (f"select c.c_mktsegment as segment, cast(sum({SALES}) as double) as sales, "
             f"cast(sum({PROFIT}) as double) as profit from {L_O_P} "
             f"join customer c on o.o_custkey = c.c_custkey group by 1")
    if with_ratio:
        return f"select segment, sales / profit as sales_to_profit_ratio from ({inner}) order by 1"
    return inner + " order by 1"


def _kpis() -> str:
    return (f"select cast(sum({SALES}) as double) as total_revenue, "
            "cast(sum(l.l_quantity) as double) as total_quantity, "
            "count(distinct l.l_orderkey) as total_orders, "
            f"cast(sum({SALES}) as double) / cast(count(distinct l.l_orderkey) as double) as avg_order_value, "
            "cast(sum(l.l_quantity) as double) / cast(count(distinct l.l_orderkey) as double)"
            " as avg_quantity_per_order from lineitem l")


def _fmt(x: str) -> str:
    return f"format('{{:,.2f}}', cast({x} as double))"


def _profile() -> str:
    n = len(LINEITEM_TYPES)
    return " union all ".join(
        f"select '{c}' as column_name, {i} as ordinal, '{t}' as data_type, count({c}) as non_null, "
        f"count(*) as n_rows, cast({n} as bigint) as n_columns from lineitem"
        for i, (c, t) in enumerate(LINEITEM_TYPES))


def _describe() -> str:
    """Moments from exact sums of whole millionths; each exact integer becomes a double through its digits."""
    numeric = [c for c, t in LINEITEM_TYPES if t in ("bigint", "int", "double")]
    unit = "cast(round({} * 1000000) as hugeint)"
    dbl = "cast(cast({} as varchar) as double)"
    return " union all ".join(
        f"select '{c}' as column_name, n, {dbl.format('s')} / 1e6 / n as mean, "
        f"sqrt({dbl.format('n * q - s * s')} / 1e12 / (cast(n as double) * (n - 1))) as std, min, p25, p50, p75, max "
        f"from (select count({c}) as n, sum({unit.format(c)}) as s, sum({unit.format(c)} * {unit.format(c)}) as q, "
        f"cast(min({c}) as double) as min, cast(quantile_cont({c}, 0.25) as double) as p25, "
        f"cast(quantile_cont({c}, 0.5) as double) as p50, cast(quantile_cont({c}, 0.75) as double) as p75, "
        f"cast(max({c}) as double) as max from lineitem)"
        for c in numeric)


def _rows(desc: bool) -> str:
    way = "desc" if desc else "asc"
    key = ["l_orderkey", "l_linenumber"]
    order = ", ".join(f"{c} {way}" for c in [*key, *[c for c, _ in LINEITEM_TYPES if c not in key]])
    return f"select * from lineitem order by {order} limit 5"


def oracle_sql() -> dict[str, str]:
    cat_sales = (f"select p.p_type as category, sum({SALES}) as sales from {L_P} group by 1")
    cat_profit = (f"select p.p_type as category, sum({PROFIT}) as profit from {L_P} group by 1")
    cat_rev = (f"select p.p_type as category, sum({SALES}) as revenue from {L_P} group by 1")
    grand = f"(select cast(sum({SALES}) as double) from {L_P} where l.l_returnflag is not null and p.p_type is not null)"
    found = {
        "sales_by_month": (f"select cast(month(o.o_orderdate) as integer) as order_month, "
                           f"cast(sum({SALES}) as double) as sales from {L_O} group by 1 order by 1"),
        "sales_by_category": _part_sum("p_type", "category", SALES, "sales"),
        "sales_share_by_category": _share(cat_sales, "category", "sales"),
        "sales_by_subcategory": _part_sum("p_brand", "sub_category", SALES, "sales"),
        "profit_by_month": (f"select cast(month(o.o_orderdate) as integer) as order_month, "
                            f"cast(sum({PROFIT}) as double) as profit from {L_O_P} group by 1 order by 1"),
        "profit_by_category": _part_sum("p_type", "category", PROFIT, "profit"),
        "profit_share_by_category": _share(cat_profit, "category", "profit"),
        "profit_by_subcategory": _part_sum("p_brand", "sub_category", PROFIT, "profit"),
        "sales_profit_by_segment": _segment(False),
        "sales_to_profit_ratio": _segment(True),
        "kpi_summary": _kpis(),
        "kpi_labels": (f"select concat('$', {_fmt('total_revenue')}) as total_revenue, "
                       f"{_fmt('total_quantity')} as total_quantity, {_fmt('total_orders')} as total_orders, "
                       f"{_fmt('avg_order_value')} as avg_order_value, "
                       f"{_fmt('avg_quantity_per_order')} as avg_quantity_per_order from ({_kpis()})"),
        "ingredient_counts": ("select trim(t) as ingredient, count(*) as n from (select "
                              f"unnest(string_split(replace(p.p_name, ' ', ', '), ',')) as t from {L_P}) "
                              "group by 1 order by 2 desc, 1"),
        "ingredient_top10": ("select trim(t) as ingredient, count(*) as n from (select "
                             f"unnest(string_split(replace(p.p_name, ' ', ', '), ',')) as t from {L_P}) "
                             "group by 1 order by 2 desc, 1 limit 10"),
        "orders_by_weekday": _zero_filled(
            WEEKDAYS, "weekday", "weekday_ordinal", "orders",
            f"select dayname(o.o_orderdate) as weekday, count(distinct l.l_orderkey) as orders from {L_O} group by 1",
            "0"),
        "revenue_by_weekday": _zero_filled(
            WEEKDAYS, "weekday", "weekday_ordinal", "revenue",
            f"select dayname(o.o_orderdate) as weekday, cast(sum({SALES}) as double) as revenue from {L_O} group by 1",
            "0::double"),
        "orders_by_hour": ("select cast(hour(ts) as integer) as order_hour, count(distinct user_id) as orders "
                           "from events group by 1 order by 1"),
        "orders_by_month": _zero_filled(
            MONTHS, "month_name", "month_ordinal", "orders",
            f"select monthname(o.o_orderdate) as month_name, count(distinct l.l_orderkey) as orders "
            f"from {L_O} group by 1", "0"),
        "category_share": _share(cat_rev, "category", "revenue"),
        "category_size_pivot": _pivot("p.p_type", "category", "l.l_returnflag", RETURN_FLAGS),
        "category_size_share": _pivot("p.p_type", "category", "l.l_returnflag", RETURN_FLAGS,
                                      "100.0::double * ", f" / {grand}"),
        "quantity_by_category": _part_sum("p_type", "category", "l.l_quantity", "quantity"),
        "top5_by_quantity": _ranked("cast(sum(l.l_quantity) as double)", "quantity", True),
        "top5_by_orders": _ranked("count(distinct l.l_orderkey)", "orders", True),
        "top5_by_revenue": _ranked(f"cast(sum({SALES}) as double)", "revenue", True),
        "bottom5_by_revenue": _ranked(f"cast(sum({SALES}) as double)", "revenue", False),
        "bottom5_by_quantity": _ranked("cast(sum(l.l_quantity) as double)", "quantity", False),
        "bottom5_by_orders": _ranked("count(distinct l.l_orderkey)", "orders", False),
        "dataset_profile": _profile(),
        "numeric_describe": _describe(),
        "calendar_parts": ("select l.l_orderkey as order_id, l.l_linenumber as line_number, "
                           "cast(o.o_orderdate as date) as order_date, "
                           "cast(month(o.o_orderdate) as integer) as order_month, "
                           "cast(year(o.o_orderdate) as integer) as order_year, "
                           f"cast(isodow(o.o_orderdate) - 1 as integer) as order_day_of_week from {L_O}"),
        "parse_day_first": ("select o_orderkey as order_id, strftime(o_orderdate, '%d-%m-%Y') as order_date_text, "
                            "cast(strptime(strftime(o_orderdate, '%d-%m-%Y'), '%d-%m-%Y') as date) as order_date "
                            "from orders"),
        "parse_month_first": ("select o_orderkey as order_id, strftime(o_orderdate, '%-m/%-d/%Y') as order_date_text, "
                              "cast(strptime(strftime(o_orderdate, '%-m/%-d/%Y'), '%-m/%-d/%Y') as date) as order_date "
                              "from orders"),
        "dataset_shape": f"select count(*) as n_rows, cast({len(LINEITEM_TYPES)} as bigint) as n_columns from lineitem",
        "orders_by_month_sparse": _zero_filled(
            MONTHS, "month_name", "month_ordinal", "orders",
            "select monthname(ts) as month_name, count(distinct user_id) as orders from events group by 1", "0"),
        "brand_size_pivot_filled": _pivot("p.p_brand", "sub_category", "p.p_size", PART_SIZES),
        "weekday_revenue_labels": (
            f"select weekday, weekday_ordinal, concat('$', {_fmt('revenue')}) as revenue_label from ("
            + _zero_filled(WEEKDAYS, "weekday", "weekday_ordinal", "revenue",
                           f"select dayname(o.o_orderdate) as weekday, cast(sum({SALES}) as double) as revenue "
                           f"from {L_O} group by 1", "0::double") + ")"),
        "share_labels": (
            f"select category, regexp_replace(cast(cast(revenue as decimal(38,2)) as varchar), '0$', '') as revenue_text, "
            f"concat(format('{{:.1f}}', share_pct), '%') as share_label from ({_share(cat_rev, 'category', 'revenue')})"),
        "first_rows": _rows(False),
        "last_rows": _rows(True),
    }
    # other ways to the same rows
    found |= {f"{name}_laid_out": found[name] for name in ("sales_by_month", "revenue_by_weekday", "orders_by_weekday")}
    found |= {f"{name}_pruned": found[name] for name in ("top5_by_orders", "bottom5_by_orders")}
    found["ingredient_top10_certified"] = found["ingredient_top10"]
    found |= {f"{name}_sketched": f"select *, true as within_bound from ({found[name]})"
              for name in ("orders_by_weekday", "orders_by_hour")}
    return found
