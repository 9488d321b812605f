"""Independent SQL for the queries, for DuckDB over the same tables."""

from __future__ import annotations

from string import Formatter

from checks import samples
from checks.queries import SQL_CONSTRUCTS
from checks.samples import JSON_TEXTS
from starqa import fixed_values as fixed
from starqa.sources.schemas import ORDERS

ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- shared parts

REVENUE = (
    "(cast(l_extendedprice as decimal(12,2)) * "
    "cast(1 - cast(l_discount as decimal(4,2)) as decimal(4,2)))"
)

CTES = {
    "cust": """select c_custkey as customer_id, c_name as customer_name, n_name as country
        from customer left join nation on c_nationkey = n_nationkey""",
    "lines": f"""select o_custkey as customer_id, year(o_orderdate) as year, l_partkey, l_suppkey,
        cast(l_quantity as decimal(12,2)) as qty, {REVENUE} as rev
        from lineitem join orders on l_orderkey = o_orderkey""",
    "eligible": """select country, count(*) as customers from cust where country is not null
        group by country having count(*) >= least({min_customers}, (select max(n) from
        (select count(*) as n from cust where country is not null group by country)))""".format(
        min_customers=fixed.MIN_CUSTOMERS_PER_COUNTRY
    ),
    "years": "select distinct year from lines",
    "cust_year": "select customer_id, year, sum(rev) as rev from lines group by all",
    "q1": "select country, count(*) as value from cust where country is not null group by country",
    "q2": "select year, round(sum(rev), 2) as value from lines group by year",
    "q3": """select p_brand as genre, year, cast(sum(qty) as bigint) as value
        from lines join part on p_partkey = l_partkey group by all having sum(qty) <> 0""",
    "q4v": """select year, cast(customer_id as varchar) as key, customer_name as display,
        lpad(cast(customer_id as varchar), 20, '0') as order_key, round(rev, 2) as value
        from cust_year join cust using (customer_id)""",
    "q4bv": """select year(o_orderdate) as year, cast(o_custkey as varchar) as key,
        any_value(customer_name) as display, lpad(cast(o_custkey as varchar), 20, '0') as order_key,
        count(*) as value
        from orders join cust on customer_id = o_custkey group by all""",
    "q5v": """select year, s_name as key, s_name as display, s_name as order_key,
        round(sum(rev), 2) as value from lines join supplier on s_suppkey = l_suppkey
        where s_name is not null group by all""",
    "q6v": """select country, p_brand as key, p_brand as display, p_brand as order_key,
        round(sum(rev), 2) as value
        from lines join cust using (customer_id) join part on p_partkey = l_partkey
        where country in (select country from eligible) and p_brand is not null group by all""",
    "q7v": """select year, country as key, country as display, country as order_key,
        round(sum(rev), 2) as value from lines join cust using (customer_id)
        where country is not null group by all""",
    "q8v": """select a.year as year_a, b.year as year_b, cast(c.customer_id as varchar) as key,
        c.customer_name as display, lpad(cast(c.customer_id as varchar), 20, '0') as order_key,
        coalesce(round(rb.rev, 2), 0) - coalesce(round(ra.rev, 2), 0) as value
        from years a join years b on a.year < b.year cross join cust c
        left join cust_year ra on ra.customer_id = c.customer_id and ra.year = a.year
        left join cust_year rb on rb.customer_id = c.customer_id and rb.year = b.year""",
    "cat": "select distinct p_brand as genre, p_name || ' ' || p_partkey as member from part",
    "sold": """select distinct p_brand as genre, year, p_name || ' ' || p_partkey as member
        from lines join part on p_partkey = l_partkey""",
    "silent": """select c.genre, y.year, c.member from cat c cross join years y
        where c.genre in (select genre from cat group by genre having count(*) >= {least})
        and not exists (select 1 from sold s
            where s.genre = c.genre and s.year = y.year and s.member = c.member)""".format(
        least=fixed.MIN_CATALOGUE
    ),
    "q9": """select genre, year, member, n_silent from
        (select *, count(*) over (partition by genre, year) as n_silent from silent)
        where n_silent between {lo} and {hi}""".format(
        lo=fixed.MIN_SET_ANSWERS, hi=fixed.MAX_SET_ANSWERS
    ),
}

# The parts each part is built from, in the order they are listed above.
USES = {
    "eligible": ["cust"], "years": ["lines"], "cust_year": ["lines"], "q1": ["cust"],
    "q2": ["lines"], "q3": ["lines"], "q4v": ["cust", "lines", "cust_year"], "q4bv": ["cust"],
    "q5v": ["lines"], "q6v": ["cust", "lines", "eligible"], "q7v": ["cust", "lines"],
    "q8v": ["cust", "lines", "years", "cust_year"], "sold": ["lines"],
    "silent": ["lines", "years", "cat", "sold"],
    "q9": ["lines", "years", "cat", "sold", "silent"],
}


def with_parts(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """A statement over the named shared parts and further parts of its own."""
    wanted = {part for name in names for part in (*USES.get(name, []), name)}
    parts = {name: text for name, text in CTES.items() if name in wanted} | (extra or {})
    listed = ",\n".join(f"{name} as ({text})" for name, text in parts.items())
    return f"with {listed}\n{body}"


def banded(source: str, by: str) -> str:
    """Bands of a whole ranking."""
    return f"""select *, rank() over (partition by {by} order by value desc) - 1 as lo,
        dense_rank() over (partition by {by} order by value desc) as tie_group,
        count(*) over (partition by {by}, value) as ties,
        count(*) over (partition by {by}) as n,
        max(value) over (partition by {by}) as best from {source}"""


def ranking(source: str, by: str, ks=fixed.TOP_KS, needs: str = "true") -> str:
    """The top-k rows of every k, ties kept whole."""
    listed = ", ".join(f"({k})" for k in ks)
    return f"""select {by}, k, tie_group, lo, lo + ties - 1 as hi, key, display, order_key, value
        from ({banded(source, by)}) cross join (values {listed}) as t(k)
        where lo < k and n >= k and {needs}"""


RANKED_OUT = "k, tie_group, lo, hi, key, display, cast(value as double) as value"


def ranked_oracle(source: str, by: str, ks=fixed.TOP_KS, needs: str = "true") -> str:
    return with_parts(
        [source], f"select {by}, {RANKED_OUT} from r", {"r": ranking(source, by, ks, needs)}
    )


# ---------------------------------------------------------------- sources

ORACLES["s1_scan_lineitem"] = "select * from lineitem"
ORACLES["s3_table_counts"] = " union all ".join(
    f"select '{name}' as table_name, count(*) as row_count from {name}" for name in ORDERS
)
ORACLES["s4_unexpected_counts"] = f"""
with counts as ({ORACLES["s3_table_counts"]}),
expected as (select t as table_name, (select count(*) // 10 from orders) as expected_rows
  from (values ('customer'), ('supplier'), ('part'), ('absent')) as v(t))
select table_name, expected_rows, row_count,
  case when row_count is null then 'missing' when row_count = 0 then 'empty'
  else 'other size' end as kind
from expected left join counts using (table_name)
where row_count is null or row_count = 0 or row_count <> expected_rows"""


def _profile_sql() -> str:
    selects = []
    for name, spec in ORDERS.items():
        targets = {c: f"{t}({k})" for c, t, k in spec.foreign_keys}
        for position, column in enumerate(spec.schema.split(", "), 1):
            column, kind = column.split()
            selects.append(
                f"select '{name}' as table_name, {position} as position, "
                f"'{column}' as column_name, '{kind}' as data_type, count(*) as row_count, "
                f"count(distinct {column}) as distinct_count, "
                f"count(*) - count({column}) as null_count, "
                f"'{targets.get(column, '')}' as refers_to, "
                f"{str(column == spec.primary_key).lower()} as is_primary_key from {name}"
            )
    return " union all ".join(selects)


ORACLES["s5_profile"] = _profile_sql()
ORACLES["s5b_profile_sketch"] = " union all ".join(
    f"select '{name}' as table_name, '{column}' as column_name, {str(column != spec.primary_key).lower()} as nullable, "
    f"count(distinct {column}) as distinct_count, true as within_bound from {name}"
    for name, spec in ORDERS.items()
    for column in (c.split()[0] for c in spec.schema.split(", "))
)


def _sample_sql() -> str:
    selects = []
    for name, spec in ORDERS.items():
        fields = [c.split() for c in spec.schema.split(", ")]
        quote = lambda c, kind: f"chr(39) || {c} || chr(39)" if kind == "string" else f"cast({c} as varchar)"
        text = " || ', ' || ".join(f"'{c}=' || coalesce({quote(c, kind)}, 'None')" for c, kind in fields)
        order = ", ".join([spec.primary_key] if spec.primary_key else [c for c, _ in fields])
        selects.append(
            f"select '{name}' as table_name, n::int as sample, text from (select row_number() over (order by {order}) as n, "
            f"{text} as text from {name}) where n <= 3"
        )
    return " union all ".join(selects)


ORACLES["s5c_sample_rows"] = _sample_sql()
ORACLES["s7_preview"] = f"""select o_orderkey, o_custkey, o_orderstatus,
  (select count(*) from orders) > {fixed.PREVIEW_ROWS} as truncated
  from orders order by o_orderkey limit {fixed.PREVIEW_ROWS}"""

# ---------------------------------------------------------------- joins and filters

SALES = f"""select l_orderkey as invoice_id, o_custkey as customer_id, c_name as customer_name,
  n_name as country, year(o_orderdate) as year, quarter(o_orderdate) as quarter,
  l_partkey as track_id, p_name as track_name, p_type as album_title, s_name as artist_name,
  p_brand as genre_name, cast(cast(l_extendedprice as decimal(12,2)) as double) as unit_price,
  l_quantity as quantity, {REVENUE} as rev
  from lineitem left join orders on o_orderkey = l_orderkey
  left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey
  left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey"""
ORACLES["j1_sales"] = f"""select * exclude (rev), cast(rev as double) as revenue from ({SALES})"""
ORACLES["j1_sales_strict"] = f"""select year, quarter, country, count(*) as lines,
  cast(sum(rev) as double) as revenue, count(artist_name) as with_artist,
  count(genre_name) as with_genre from ({SALES}) group by all"""
ORACLES["j2_many_to_one_violations"] = """select l_orderkey, l_linenumber, count(*) as n
  from lineitem group by all having count(*) > 1"""
ORACLES["j6_reconcile"] = """select o_orderkey, stated, counted,
  case when stated is null then 'no stated' when counted is null then 'no counted'
  else 'mismatch' end as kind
  from (select o_orderkey, o_orderkey % 7 as stated from orders)
  full join (select l_orderkey as o_orderkey, count(*) as counted from lineitem group by all)
  using (o_orderkey) where stated is null or counted is null or stated <> counted"""
ORACLES["j7_country_check"] = """select c_custkey as customer_id, o_orderkey,
  cast(o_custkey % 25 as int) as billing_country, c_nationkey as country
  from orders join customer on c_custkey = o_custkey where o_custkey % 25 <> c_nationkey"""
ORACLES["j5_zero_filled_year"] = with_parts(
    ["cust_year", "cust"],
    """select customer_id, cast(coalesce(round(rev, 2), 0) as double) as revenue
    from cust left join (select * from cust_year where year = 1997) using (customer_id)""",
)
ORACLES["a4_pivot_years"] = with_parts(
    ["lines", "cust"],
    """select country,
    cast(coalesce(round(sum(rev) filter (year = 1996), 2), 0) as double) as y1996,
    cast(coalesce(round(sum(rev) filter (year = 1997), 2), 0) as double) as y1997
    from lines join cust using (customer_id) where country is not null group by country""",
)
ORACLES["a6_distinct_values"] = """
select distinct 'year' as kind, cast(year(o_orderdate) as varchar) as value from orders
union select 'country', n_name from customer join nation on n_nationkey = c_nationkey
union select 'genre', p_brand from part"""
ORACLES["a7_date_range"] = (
    "select min(o_orderdate) as first_date, max(o_orderdate) as last_date from orders"
)
ORACLES["p7_threshold"] = with_parts(["eligible"], "select * from eligible")
ORACLES["p9_display_names"] = """
select c_custkey as customer_id, trim(
    coalesce(case when c_custkey % 5 <> 0 then split_part(c_name, '#', 1) end, '') || ' '
    || coalesce(case when c_custkey % 7 <> 0 then split_part(c_name, '#', 2) end, '')) as customer_name
from customer"""
ORACLES["p6_null_dimension"] = with_parts(
    ["lines", "cust"],
    """select country, p_brand as genre_name, cast(round(sum(rev), 2) as double) as revenue
    from lines join cust using (customer_id) join part on p_partkey = l_partkey
    where customer_id % 4 <> 0 and l_partkey % 6 <> 0 group by all""",
)
ORACLES["a3_country_genre_revenue"] = with_parts(
    ["lines", "cust"],
    """select country, p_brand as genre_name, cast(round(sum(rev), 2) as double) as revenue
    from lines join cust using (customer_id) join part on p_partkey = l_partkey group by all""",
)

# ---------------------------------------------------------------- ranking and questions

ORACLES["w3_tie_groups"] = with_parts(
    ["q4bv"],
    "select year, tie_group, lo, hi, key, display, cast(value as double) as value from r",
    {"r": ranking("q4bv", "year", (5,))},
)
ORACLES["w4_rank_bands"] = with_parts(
    ["q4bv"],
    """select year, k, tie_group, lo, hi, cast(value as double) as value, count(*) as members
    from r group by all""",
    {"r": ranking("q4bv", "year", (3, 5, 10))},
)
ORACLES["w6_top_k_exact"] = with_parts(
    ["q7v"],
    """select key as country, cast(value as double) as revenue from q7v where year = 1998
    order by value desc, key limit 3""",
)
ORACLES["q1_count_by_country"] = with_parts(["q1"], "select * from q1")
ORACLES["q2_revenue_by_year"] = with_parts(
    ["q2"], "select year, cast(value as double) as value from q2"
)
ORACLES["q2b_revenue_in_one_year"] = with_parts(
    ["q2"], "select year, cast(value as double) as value from q2 where year = 1996"
)
ORACLES["q3_quantity_by_genre_year"] = with_parts(["q3"], "select * from q3")
ORACLES["q4_top_customers"] = ranked_oracle("q4v", "year")
ORACLES["q4b_top_customers_by_orders"] = ranked_oracle("q4bv", "year")
ORACLES["q5_top_artists"] = ranked_oracle("q5v", "year")
ORACLES["q6_top_genre_by_country"] = ranked_oracle("q6v", "country", (1,))
ORACLES["u2_losing_genres"] = with_parts(
    ["q6v"],
    """select country, genre_name from (select distinct country from r) cross join
    (select distinct p_brand as genre_name from part)
    where (country, genre_name) not in (select (country, key) from r)""",
    {"r": ranking("q6v", "country", (1,))},
)
ORACLES["q7_top_countries"] = ranked_oracle("q7v", "year")
ORACLES["q8_revenue_increase"] = ranked_oracle("q8v", "year_a, year_b", needs="best > 0")
ORACLES["q9_no_sales"] = with_parts(["q9"], "select genre, year, member, n_silent from q9")
ORACLES["j3_catalogue"] = with_parts(["cat"], "select * from cat")

# ---------------------------------------------------------------- tasks

ALL = ["q1", "q2", "q3", "q4v", "q5v", "q6v", "q7v", "q8v", "q9"]
RANKINGS = {
    "top_customers_by_revenue": ("q4v", "year", fixed.TOP_KS, "true"),
    "top_artists_by_revenue": ("q5v", "year", fixed.TOP_KS, "true"),
    "top_genre_in_country": ("q6v", "country", (1,), "true"),
    "top_countries_by_revenue": ("q7v", "year", fixed.TOP_KS, "true"),
    "top_customer_revenue_increase": ("q8v", "year_a, year_b", fixed.TOP_KS, "best > 0"),
}
PARAMS = {
    "customer_count_in_country": ("country",),
    "total_revenue_in_year": ("year",),
    "tracks_sold_in_genre_year": ("genre", "year"),
    "top_customers_by_revenue": ("year", "k"),
    "top_artists_by_revenue": ("year", "k"),
    "top_genre_in_country": ("country",),
    "top_countries_by_revenue": ("year", "k"),
    "top_customer_revenue_increase": ("year_a", "year_b", "k"),
    "artists_with_no_sales_in_year": ("genre", "year"),
}
AMONG = {
    "customer_count_in_country": "n_countries",
    "total_revenue_in_year": "n_years",
    "tracks_sold_in_genre_year": "n_genres * n_years",
    "top_customers_by_revenue": "n_years * 2",
    "top_artists_by_revenue": "n_years * 2",
    "top_genre_in_country": "n_eligible",
    "top_countries_by_revenue": "n_years * 2",
    "top_customer_revenue_increase": (
        "(n_years - 1) * (select count(*) from years y where y.year > p.year_a) * 2"
    ),
    "artists_with_no_sales_in_year": "n_genres * n_years",
}
FACTS = """select (select count(distinct country) from cust) as n_countries,
    (select count(*) from eligible) as n_eligible,
    (select count(distinct p_brand) from part) as n_genres,
    (select count(*) from years) as n_years"""
TICKS = "1000000000000"
CENTS = "regexp_replace(cast(cast({0} as decimal(38,2)) as varchar), '(\\.\\d)0$', '\\1')"


def params_json(template: str) -> str:
    strings = ("country", "genre")
    fields = " || ',' || ".join(
        f"""'"{p}":' || """ + (f"""'"' || {p} || '"'""" if p in strings else p)
        for p in PARAMS[template]
    )
    return "'{' || " + fields + " || '}'"


def task_key(template: str) -> str:
    return f"md5('{template}' || {params_json(template)})"


def filled(text: str, values: dict[str, str]) -> str:
    parts = []
    for literal, name, _, _ in Formatter().parse(text):
        if literal:
            parts.append("'" + literal.replace("'", "''") + "'")
        if name:
            parts.append(f"cast({values.get(name, name)} as varchar)")
    return " || ".join(parts)


def _truth_part() -> str:
    selects = []
    for name, (source, by, ks, needs) in RANKINGS.items():
        selects.append(
            f"""select {task_key(name)} as task_id, 'winner' as role, lo, hi, key, display, order_key
            from ({ranking(source, by, ks, needs)})"""
        )
    selects.append(
        f"""select {task_key("artists_with_no_sales_in_year")} as task_id, 'member' as role, 0 as lo,
        n_silent - 1 as hi, member as key, member as display, member as order_key from q9"""
    )
    return " union all ".join(selects)


def _task_select(name: str, chosen_value: str) -> str:
    """One template's task rows out of ``p``: parameters, value, n_truth, winners."""
    spec = fixed.TEMPLATES[name]
    money = name == "total_revenue_in_year"
    numeric = spec["answer_type"] == fixed.NUMERIC
    values = {
        "count": "cast(value as bigint)" if numeric else "n_truth",
        "value": CENTS.format("value"),
        "winners": "winners",
    }
    if name == "top_genre_in_country":
        k = "1"
    else:
        k = "k" if "k" in PARAMS[name] else "0"
    return f"""select {task_key(name)} as task_id, '{name}' as template_id,
        '{spec["difficulty"]}' as difficulty, {params_json(name)} as params_json,
        {filled(spec["question"], values)} as question,
        {filled(spec["answer_format"], values)} as answer_format,
        {filled(spec["question"], values)} || chr(10) || chr(10) || 'Answer format: '
        || {filled(spec["answer_format"], values)} as prompt,
        '{spec["answer_type"]}' as answer_type, {k} as k,
        {"cast(value as double)" if numeric else "cast(null as double)"} as value,
        cast({fixed.MONEY_ABS_TOL if money or not numeric else 0} as double) as abs_tol,
        cast({fixed.MONEY_REL_TOL if money or not numeric else 0} as double) as rel_tol,
        {filled(spec["notes"], values)} as notes,
        cast({"0" if numeric else "n_truth"} as int) as n_truth,
        cast({TICKS} // ({AMONG[name]}) as bigint) as ticks
        from ({chosen_value}) p cross join facts"""


def _tasks_part(names=tuple(PARAMS)) -> str:
    sources = {
        "customer_count_in_country": "select * from q1",
        "total_revenue_in_year": "select * from q2",
        "tracks_sold_in_genre_year": "select * from q3",
        "artists_with_no_sales_in_year": (
            "select genre, year, count(*) as n_truth from q9 group by all"
        ),
    }
    for name, (source, by, ks, needs) in RANKINGS.items():
        params = ", ".join(PARAMS[name])
        sources[name] = f"""select {params}, count(*) as n_truth,
            string_agg(display, ', ' order by display) as winners
            from ({ranking(source, by, ks, needs)}) group by {params}"""
    return " union all ".join(_task_select(name, sources[name]) for name in names)


def over_tasks(body: str, extra: dict[str, str] | None = None) -> str:
    own = {"facts": FACTS, "truth": _truth_part(), "tasks": _tasks_part()} | (extra or {})
    return with_parts([*ALL, "eligible"], body, own)


ORACLES["t2_task_table"] = over_tasks("select * from tasks")
SINGLE = tuple(n for n, s in fixed.TEMPLATES.items() if s["difficulty"] == fixed.SINGLE_TABLE)
ORACLES["t5_filtered_tasks"] = with_parts(
    ["q1", "q2", "q3", "eligible", "years"],
    "select task_id, template_id, params_json, value, ticks from tasks",
    {"facts": FACTS, "tasks": _tasks_part(SINGLE)},
)
GRIDS = {
    "customer_count_in_country": "select distinct country from cust",
    "total_revenue_in_year": "select year from years",
    "tracks_sold_in_genre_year": "select distinct p_brand as genre, year from part, years",
    "top_customers_by_revenue": "select year, k from years, ks",
    "top_artists_by_revenue": "select year, k from years, ks",
    "top_genre_in_country": "select country from eligible",
    "top_countries_by_revenue": "select year, k from years, ks",
    "top_customer_revenue_increase": (
        "select a.year as year_a, b.year as year_b, k from years a join years b "
        "on a.year < b.year cross join ks"
    ),
    "artists_with_no_sales_in_year": "select distinct p_brand as genre, year from part, years",
}
ORACLES["t1_param_grid"] = with_parts(
    ["eligible", "years", "cust"],
    " union all ".join(
        f"""select '{name}' as template_id, {params_json(name)} as params_json,
        cast({TICKS} // ({AMONG[name]}) as bigint) as ticks from ({text}) p cross join facts"""
        for name, text in GRIDS.items()
    ),
    {"facts": FACTS, "ks": "select unnest([3, 5]) as k"},
)

# The alias table of tasks: what light slots lack and heavy ones have to spare, as one line.
IN_ORDER = "order by substr(md5(task_id), 1, 2), task_id"
DRAWN = {
    "scaled_tasks": f"""select task_id, row_number() over ({IN_ORDER}) - 1 as slot, ticks::hugeint * n as scaled, total,
        sum(greatest(ticks::hugeint * n - total, 0)) over ({IN_ORDER}) as spares,
        sum(greatest(total - ticks::hugeint * n, 0)) over ({IN_ORDER}) as lacks
        from (select *, count(*) over () as n, sum(ticks) over () as total from tasks where ticks > 0)""",
    "heavy_tasks": "select *, lead(task_id) over (order by slot) as next from scaled_tasks where scaled >= total",
    "light_tasks": "select *, lacks - (total - scaled) as begins from scaled_tasks where scaled < total",
    "alias_tasks": """select l.slot, l.task_id, h.task_id as other, l.scaled as threshold from light_tasks l
        asof join (select * from heavy_tasks where scaled > total) h on l.begins < h.spares
        union all select h.slot, h.task_id, coalesce(h.next, h.task_id),
            h.total - greatest(coalesce(l.lacks - h.spares, 0), 0)
        from heavy_tasks h asof left join light_tasks l on l.begins < h.spares""",
}


def drawn(source: str, key: str) -> str:
    share = lambda first, size: f"""cast((cast(('0x' || substr(md5('{samples.DRAW_SEED}|' || {key}), {first}, 15))::bigint as hugeint)
        * (select {size} from tasks where ticks > 0)) // 1152921504606846976 as bigint)"""  # noqa: E731
    return f"""select d.draw_id, t.* from (select {key} as draw_id, {share(1, "count(*)")} as slot,
        {share(16, "cast(sum(ticks) as hugeint)")} as rest from {source}) d join alias_tasks a on a.slot = d.slot
        join tasks t on t.task_id = case when d.rest < a.threshold then a.task_id else a.other end"""


ORACLES["t4_draw"] = over_tasks(
    f"""select draw_id, task_id, template_id, params_json
    from ({drawn("customer", "c_custkey")})""",
    DRAWN,
)
ORACLES["v8_diversity"] = over_tasks(
    f"""select count(*) as draws, count(distinct template_id) as templates,
    count(distinct difficulty) as tiers, count(distinct question) as questions
    from ({drawn("customer", "c_custkey")})""",
    DRAWN,
)
ORACLES["t7_describe"] = over_tasks(
    f"""select task_id, 0 as lo, '' as order_key, {CENTS.format("value")} as text from tasks
    where answer_type = 'numeric'
    union all select task_id, 0, '', '{{' || string_agg(display, ', ' order by display) || '}}'
    from truth where role = 'member' group by task_id
    union all select task_id, lo, order_key, case when lo = hi then (lo + 1) || '. ' || display
        else (lo + 1) || '-' || (hi + 1) || '. ' || display || ' (tied)' end
      from truth where role = 'winner'"""
)

ORACLES["t7b_describe_text"] = over_tasks(
    f"""select task_id, 0 as chunk, {CENTS.format("value")} as text from tasks where answer_type = 'numeric'
    union all select task_id, 0, '{{' || string_agg(display, ', ' order by display) || '}}'
    from truth where role = 'member' group by task_id
    union all select task_id, pos // {samples.NAMES_A_CHUNK}, string_agg(case when pos <> lo then ' | ' else
        case when pos > 0 then '; ' else '' end || (lo + 1) || case when hi > lo then '-' || (hi + 1) else '' end || '. ' end
        || display || case when pos = hi and hi > lo then ' (tied)' else '' end, '' order by pos)
    from (select *, row_number() over (partition by task_id order by lo, order_key, key) - 1 as pos
      from truth where role = 'winner') group by task_id, pos // {samples.NAMES_A_CHUNK}"""
)


def folded(col: str) -> str:
    """Name normalisation in DuckDB terms."""
    return (
        "lower(trim(regexp_replace(regexp_replace(strip_accents(replace("
        f"{col}, 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')))"
    )


ORACLES["t8_flat_entities"] = over_tasks(
    f"""select distinct task_id, role, lo, hi, key, display, alias from (
    select *, {folded("display")} as alias from truth
    union all select *, {folded("key")} as alias from truth) where alias <> ''"""
)
ORACLES["v7_task_invariants"] = over_tasks(
    """select task_id, template_id, params_json, 'no truth' as problem from tasks
    where answer_type <> 'numeric' and task_id not in (select task_id from truth)"""
)

ORACLES["v7b_injected_faults"] = over_tasks(
    """select task_id, template_id, params_json, problem from (
    select task_id, template_id, params_json, case
        when answer_type = 'numeric' then case when digit in ('0', '1') then 'no value' end
        when entities is null then 'no entities'
        when covered < k then 'bands too short'
        when entities <> n_truth + case when digit in ('4', '5') then 1 else 0 end then 'entities miscounted' end as problem
    from (select *, substr(md5(task_id), 1, 1) as digit from tasks) left join (
        select task_id, count(*) as entities, max(hi) + 1 as covered from (
            select *, substr(md5(task_id), 1, 1) as digit, max(lo) over (partition by task_id) as last_lo,
                row_number() over (partition by task_id order by lo desc, order_key desc, key desc) as back from truth)
        where digit not in ('0', '1') and not (digit in ('2', '3') and case when role = 'member' then back = 1 else lo = last_lo end)
        group by task_id) using (task_id)) where problem is not null"""
)

# ---------------------------------------------------------------- text

TEXTS = """select 'document' as kind, doc_id as id, text from documents
    union all select 'turn', conv_id * 1000 + turn, text from conversations
    union all select 'event', event_id, props from events"""
# the same white space as the library's, in RE2 terms
WS = "[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]"


def stripped(col: str) -> str:
    return f"regexp_replace({col}, '^{WS}+|{WS}+$', '', 'g')"


def number_in(col: str) -> str:
    """The one number of a text, in DuckDB terms."""
    json_number = "-?(?:0|[1-9][0-9]*)(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    one_key = f'^\\{{\\s*"[^"]*"\\s*:\\s*({json_number})\\s*\\}}$'
    found = (
        f"list_distinct(list_transform(regexp_extract_all({col}, '-?[0-9][0-9,]*(?:\\.[0-9]+)?'), "
        "lambda x: cast(replace(x, ',', '') as double) + 0.0))"
    )
    return f"""case when regexp_full_match({col}, '{json_number}') then try_cast({col} as double)
        when regexp_matches({col}, '{one_key}')
          then try_cast(regexp_extract({col}, '{one_key}', 1) as double)
        when len({found}) = 1 then {found}[1] end"""


def cleaned(col: str) -> str:
    """Item cleaning in DuckDB terms."""
    bare = f"regexp_replace({stripped(col)}, '^{WS}*(?:\\p{{Nd}}+[.)]|[-*•]){WS}*', '')"
    noted = f"regexp_replace({bare}, '{WS}*[(\\[].*?[)\\]]{WS}*$', '')"
    named = (
        f"regexp_replace({noted}, '{WS}*[-:–—]{WS}*\\$?-?[\\p{{Nd}},]+(?:\\.\\p{{Nd}}+)?{WS}*$', '')"
    )
    return stripped(f"trim({stripped(named)}, '\"''')")


ORACLES["x1_normalize"] = f"select kind, id, {folded('text')} as name from ({TEXTS})"
ORACLES["x2_parse_numeric"] = f"""select kind, id, {number_in("t")} as number
    from (select kind, id, {stripped("text")} as t from ({TEXTS}))"""
ORACLES["x3_parse_list"] = f"""
with texts as (select kind, id, {stripped("text")} as t from ({TEXTS}) where kind <> 'event'),
lines as (select *, list_filter(list_transform(
    regexp_split_to_array(t, '\\r\\n|[\\n-\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
    lambda x: {stripped("x")}), lambda x: x <> '') as ls from texts),
parts as (select kind, id, case when len(ls) > 1 then ls else
    list_transform(string_split(list_aggregate(list_transform(
      regexp_extract_all(t, '[^()]*[()]?'),
      lambda p: case when p like '%)' then replace(p, ',', chr(1)) else p end), 'string_agg', ''), ','),
      lambda p: replace(p, chr(1), ',')) end as ps from lines),
items as (select kind, id, list_filter(list_transform(ps, lambda x: {cleaned("x")}),
    lambda x: x <> '') as its from parts)
select kind, id, unnest(range(len(its))) as pos, unnest(its) as item from items"""
ORACLES["x3b_parse_list_json"] = f"""
with texts as (
    select 'event' as kind, event_id as id, props as t from events
    {"".join(f"union all select '{k}', event_id, printf('{t}', event_id, event_type, user_id) from events " for k, t in JSON_TEXTS.items())}),
lists as (select kind, id, t, case when t like '[%' then cast(t as json) else
    list_filter(list_transform(json_keys(t), lambda k: json_extract(t, '$."' || k || '"')),
      lambda v: json_type(v) = 'ARRAY')[1] end as l from (select kind, id, {stripped("t")} as t from texts)),
listed as (select kind, id, case when l is null then string_split(t, ',') else
    list_transform(cast(l as json[]), lambda v: case when v is null or json_type(v) = 'NULL' then 'None'
      when json_type(v) = 'BOOLEAN' then upper(cast(v as varchar)[1]) || cast(v as varchar)[2:]
      else v->>'$' end) end as ps from lists),
items as (select kind, id, list_transform(list_filter(ps, lambda x: {stripped("x")} <> ''),
    lambda x: {cleaned("x")}) as its from listed)
select kind, id, unnest(range(len(its))) as pos, unnest(its) as item from items"""
ORACLES["x4_clean_item"] = f"""select doc_id, pos, {cleaned("line")} as item from (
    select doc_id, unnest(range(len(ls))) as pos, unnest(ls) as line
    from (select doc_id, string_split(text, chr(10)) as ls from documents))"""
ORACLES["x7_mentions"] = f"""
with names as (select distinct unnest(string_split({folded("text")}, ' ')) as key from benchmark),
words as (select distinct doc_id, unnest(string_split({folded("text")}, ' ')) as key from documents)
select doc_id, key from words join names using (key) where key <> ''"""

ORACLES["x7b_long_mentions"] = f"""
with named as (select item_id::varchar as key, string_split({folded("text")}, ' ') as w from benchmark),
aliases as (select distinct key, unnest([array_to_string(w[1:2], ' '), array_to_string(w[1:3], ' '), array_to_string(w[1:5], ' '),
    array_to_string(w[greatest(1, len(w)):], ' '), array_to_string(w[greatest(1, len(w) - 3):], ' ')]) as alias from named),
texts as (select doc_id, ' ' || {folded("text")} || ' ' as t from documents)
select distinct doc_id, key from texts join (select * from aliases where alias <> '') a on contains(t, ' ' || alias || ' ')"""

# ---------------------------------------------------------------- grading

VARIANT_PARTS = {
    "numeric_variants": f"""select task_id, unnest(range(8)) as variant, unnest([m, '$' || m,
        '{{"total": ' || m || '}}', {CENTS.format("value + 1")}, 'The total was ' || m || ' dollars.',
        'either ' || m || ' or 7',
        cast(cast(value as decimal(18,2)) * cast(1.0005 as decimal(5,4)) as varchar), '']) as answer
        from (select *, {CENTS.format("value")} as m from tasks where answer_type = 'numeric')""",
    "names": """select task_id, list(display order by pos) as ns from (
        select t.task_id, display, row_number() over (partition by t.task_id order by lo, order_key)
          as pos, case when k > 0 then k else n_truth end as wanted
        from truth t join tasks s on s.task_id = t.task_id) where pos <= wanted group by task_id""",
    "listed_variants": """select task_id, unnest(range(8)) as variant, unnest([
        array_to_string(list_transform(ns, lambda n, i: i || '. ' || n), chr(10)),
        array_to_string(ns, ', '),
        '["' || array_to_string(ns, '", "') || '"]',
        array_to_string(list_reverse(ns), chr(10)),
        array_to_string(list_transform(ns, lambda n, i: i || '. ' || n || ' ($49.62)'), chr(10)),
        '- ' || ns[1], 'The answer is ' || ns[1] || '.',
        ns[1] || chr(10) || ns[1] || chr(10) || 'Zed']) as answer from names""",
    "numeric_scores": f"""select task_id, variant, cast(case when submitted is null then 0
        when abs(submitted - value) <= abs_tol then 1
        when value <> 0 and abs(submitted - value) / abs(value) <= rel_tol then 1
        else 0 end as double) as score
        from (select task_id, variant, {number_in("answer")} as submitted from numeric_variants)
        join tasks using (task_id)""",
    "parsed": f"""select task_id, variant, answer, list_transform(list_filter(list_transform(
        case when answer like '[%' then from_json(answer, '["VARCHAR"]')
        when contains(answer, chr(10)) then string_split(answer, chr(10))
        else string_split(answer, ',') end, lambda x: {cleaned("x")}), lambda x: x <> ''),
        lambda x: {folded("x")}) as items from listed_variants""",
    "placed_items": """select task_id, variant, unnest(items) as item,
        unnest(range(len(items))) as pos from parsed""",
    "aliases": f"""select distinct task_id, key, lo, hi, {folded("display")} as alias from truth
        union select task_id, key, lo, hi, {folded("key")} from truth""",
    "hits": """select i.task_id, i.variant, item, pos, key, lo, hi from placed_items i
        left join aliases a on a.task_id = i.task_id and a.alias = i.item""",
    "measures": """select task_id, variant, count(distinct key) as matched,
        count(distinct case when key is null then item end) as unmatched,
        count(*) as n_items, count(*) filter (key is null) as misses,
        count(distinct case when pos < t.k and pos between lo and hi then key end) as placed
        from hits join tasks t using (task_id) group by all""",
    "mentioned": f"""select p.task_id, p.variant, count(distinct g.key) as genres,
        count(distinct w.key) as winners
        from parsed p join (select distinct p_brand as key, {folded("p_brand")} as alias from part) g
        on contains(' ' || {folded("p.answer")} || ' ', ' ' || g.alias || ' ')
        left join aliases w on w.task_id = p.task_id and w.alias = g.alias group by all""",
    "listed_scores": """select p.task_id, p.variant, cast(case s.answer_type
        when 'entity_set' then coalesce(m.matched / (s.n_truth + m.unmatched), 0)
        when 'ranked_list' then coalesce(m.placed / s.k, 0)
        else case when coalesce(m.n_items, 0) = 0 then 0
          when m.misses = 0 and m.n_items <= s.n_truth then 1
          when c.genres = 1 and c.winners = 1 then 1 else 0 end end as double) as score
        from parsed p join tasks s using (task_id)
        left join measures m using (task_id, variant) left join mentioned c using (task_id, variant)""",
    "scores": "select * from numeric_scores union all select * from listed_scores",
}


def graded(kind: str | None) -> str:
    kept = "true" if kind is None else f"answer_type = '{kind}'"
    return over_tasks(
        f"""select draw_id as answer_id, task_id, answer_type, round(score, 9) as score
        from ({drawn("orders", "o_orderkey")}) d join scores s using (task_id)
        where s.variant = d.draw_id % {samples.VARIANTS} and {kept}""",
        DRAWN | VARIANT_PARTS,
    )


ORACLES["g0_all_scores"] = graded(None)
ORACLES["g1_numeric"] = graded(fixed.NUMERIC)
ORACLES["g2_set"] = graded(fixed.ENTITY_SET)
ORACLES["g3_categorical"] = graded(fixed.CATEGORICAL)
ORACLES["g4_ranked"] = graded(fixed.RANKED_LIST)

# ---------------------------------------------------------------- query log

LOG = f"select o_orderkey as query_id, {samples.LOGGED_SQL} as sql from orders"


def scrubbed(col: str) -> str:
    quoted = """'(?:[^']|'')*'|"(?:[^"]|"")*"|\\[[^\\]]*\\]|`[^`]*`""".replace("'", "''")
    return (
        f"regexp_replace(regexp_replace(regexp_replace({col}, '/\\*.*?\\*/', ' ', 'gs'), "
        f"'--[^\\n]*', ' ', 'g'), '{quoted}', ' '''' ', 'g')"
    )


def listed(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


ORACLES["l1_scrub"] = f"select query_id, {scrubbed('sql')} as scrubbed from ({LOG})"
ORACLES["l1b_scrub_documents"] = f"select doc_id, {scrubbed('text')} as scrubbed from documents"


def message(text: str, value: str) -> str:
    before, after = text.split("%s") if "%s" in text else text.split("%d")
    quote = lambda part: "'" + part.replace("'", "''") + "'"
    return f"{quote(before)} || {value} || {quote(after)}"


ORACLES["l5_verdict"] = f"""
with parts as (select query_id, sql, list_filter(list_transform(
    string_split({scrubbed("sql")}, ';'), lambda x: {stripped("x")}), lambda x: x <> '') as ps
    from ({LOG})),
worded as (select *, len(ps) as n_statements,
    regexp_extract_all(ps[1], '{fixed.SQL_WORD}') as ws from parts),
judged as (select *, upper(ws[1]) as leading_keyword,
    list_sort(list_distinct(list_filter(list_transform(ws, lambda w: upper(w)),
      lambda w: w in {listed(fixed.FORBIDDEN_KEYWORDS)}))) as kws,
    list_sort(list_distinct(list_filter(list_transform(ws, lambda w: lower(w)),
      lambda w: w in {listed(fixed.FORBIDDEN_FUNCTIONS)}))) as fns from worded),
reasons as (select *, case when n_statements = 0 then 'empty_query'
    when n_statements > 1 then 'multiple_statements' when leading_keyword is null then 'empty_query'
    when leading_keyword not in {listed(fixed.ALLOWED_LEADING_KEYWORDS)} then 'disallowed_statement'
    when len(kws) > 0 then 'forbidden_keyword' when len(fns) > 0 then 'forbidden_function'
    else 'ok' end as reason from judged)
select query_id, n_statements, leading_keyword, reason,
    case reason when 'forbidden_keyword' then array_to_string(kws, ',')
      when 'forbidden_function' then array_to_string(fns, ',') else '' end as denied,
    case when trim(sql) = '' then '{fixed.MESSAGE_EMPTY}'
      when n_statements = 0 then '{fixed.MESSAGE_NO_STATEMENT}'
      when n_statements > 1 then {message(fixed.MESSAGE_MULTIPLE, "n_statements")}
      when leading_keyword is null then '{fixed.MESSAGE_NO_WORDS}'
      when reason = 'disallowed_statement' then {message(fixed.MESSAGE_LEADING, "leading_keyword")}
      when reason = 'forbidden_keyword'
        then {message(fixed.MESSAGE_KEYWORD, "array_to_string(kws, ', ')")}
      when reason = 'forbidden_function'
        then {message(fixed.MESSAGE_FUNCTION, "array_to_string(fns, ', ')")} end as message
from reasons"""

READS = f"""select user_id as query_id, {samples.READ_TABLE} as tbl, {samples.READ_COLUMN} as col
    from events"""
ORACLES["l6_read_audit"] = f"""
with reads as (select distinct query_id, tbl, coalesce(col, '') as col,
    starts_with(lower(tbl), 'sqlite_') as meta from ({READS}) where coalesce(tbl, '') <> '')
select query_id,
    coalesce(string_agg(distinct case when not meta then tbl end, ','
      order by case when not meta then tbl end), '') as tables_read,
    coalesce(string_agg(distinct case when not meta and col <> '' then tbl || '.' || col end, ','
      order by case when not meta and col <> '' then tbl || '.' || col end), '') as columns_read,
    coalesce(string_agg(distinct case when meta then tbl end, ','
      order by case when meta then tbl end), '') as metadata_tables_read,
    count(*) filter (not meta) > 0 as touched_real_tables
from reads group by query_id"""
ORACLES["l7_grounded"] = f"""
select o_orderkey as query_id, o_orderkey in (select query_id from ({READS})
    where tbl <> '' and not starts_with(lower(tbl), 'sqlite_')) as grounded from orders"""
ORACLES["l8_outcome_summary"] = f"""
select case when event_type <> 'error' then 'ok' else {samples.ERROR_TYPE} end as outcome,
    count(*) as queries, sum(event_id % 61) as rows_returned,
    count(*) filter (event_id % 61 > 50) as truncated, max(value) as slowest_s
from events group by 1"""

# Every segment is one item of the answer, so no two items name the same customer: the
# first customer of a segment, in order of the ranking, is the one its item stands for.
ORACLES["g4b_ranked_shared_alias"] = over_tasks(
    """select t.task_id as answer_id, t.task_id, t.answer_type, count(hit.pos) / cast(t.k as double) as score
    from tasks t left join (
      select task_id, k, pos from (
        select truth.task_id, ranked.k, pos, lo, hi, row_number() over (
            partition by truth.task_id, pos order by lo, order_key) as n
        from truth join tasks ranked on ranked.task_id = truth.task_id
            and ranked.template_id = 'top_customers_by_revenue'
        join customer on c_custkey = try_cast(key as bigint)
        join (select c_mktsegment as segment, row_number() over (order by c_mktsegment) - 1 as pos
            from (select distinct c_mktsegment from customer)) on segment = c_mktsegment)
      where n = 1 and pos < k and pos between lo and hi) hit on hit.task_id = t.task_id
    where t.template_id = 'top_customers_by_revenue'
    group by t.task_id, t.answer_type, t.k"""
)

# ---------------------------------------------------------------- data quality

ORACLES["v1_repeated_keys"] = " union all ".join(
    [
        f"""select '{name}' as table_name, cast({spec.primary_key} as varchar) as key, count(*) as n
        from {name} group by {spec.primary_key} having count(*) > 1"""
        for name, spec in ORDERS.items()
        if spec.primary_key
    ]
    + ["""select 'numbered_lines', l_orderkey || ':' || l_linenumber, count(*)
       from lineitem group by 2 having count(*) > 1"""]
)
ORACLES["v2_key_mismatches"] = " union all ".join(
    f"""select '{name}.{column} -> {parent}.{key}' as reference, 'orphan' as kind,
    cast({column} as varchar) as key from (select distinct {column} from {name})
    where {column} not in (select {key} from {parent})
    union all select '{name}.{column} -> {parent}.{key}', 'childless', cast({key} as varchar)
    from {parent} where {key} not in (select {column} from {name})"""
    for name, spec in ORDERS.items()
    for column, parent, key in spec.foreign_keys
)
ORACLES["v3_unreconciled"] = f"""
select coalesce(o_orderkey, l_orderkey) as invoice_id,
    cast(stated as double) as stated, cast(computed as double) as computed,
    case when stated is null then 'no stated' when computed is null then 'no computed'
    else 'mismatch' end as kind
from (select o_orderkey, cast(o_totalprice as decimal(12,2)) as stated from orders)
full join (select l_orderkey, round(sum({REVENUE}), 2) as computed from lineitem group by all)
on o_orderkey = l_orderkey
where stated is null or computed is null or abs(stated - computed) > 0.005"""
ORACLES["v5_years"] = """
select year(o_orderdate) as year, count(*) as invoices, cast(sum(n) as bigint) as lines
from orders left join (select l_orderkey, count(*) as n from lineitem group by all)
on l_orderkey = o_orderkey group by all"""
ORACLES["v6_absent_customers"] = """
with active as (select o_custkey, year(o_orderdate) as year from orders
    where o_orderkey in (select l_orderkey from lineitem)),
ends as (select min(year) as a, max(year) as b from active)
select o_custkey as customer_id, any_value(c_name) as customer_name,
    count(*) filter (year = b) as last_year_invoices
from active cross join ends join customer on c_custkey = o_custkey
group by o_custkey having count(*) filter (year = a) = 0 and count(*) filter (year = b) > 0"""

ORACLES["v6b_absent_in_ranking"] = with_parts(
    ["q8v"],
    """select cast(key as bigint) as customer_id, lo, hi, cast(value as double) as value from r
    where year_a = (select min(year_a) from r) and year_b = (select max(year_b) from r) and key in (
        select cast(customer_id as varchar) from absent)""",
    {"r": ranking("q8v", "year_a, year_b", (200,), "best > 0"), "absent": ORACLES["v6_absent_customers"]},
)

# ---------------------------------------------------------------- SQL constructs

for _name, _text in SQL_CONSTRUCTS.items():
    ORACLES[_name] = _text.replace("{", "").replace("}", "")
