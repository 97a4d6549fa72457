"""DuckDB SQL for the toolkit's queries, over the same tables."""

from __future__ import annotations

_ORDERED = "row_number() over (order by {}) - 1"


def _group(fn: str) -> str:
    return f"select o_orderpriority, {fn} as value from orders group by o_orderpriority"


_SEGMENTS = "select *, nullif(c_mktsegment, 'BUILDING') as segment, case when c_custkey % 3 <> 1 then c_name end as name from customer"
_LEFT = "select o_orderkey, o_custkey as custkey, o_orderstatus as note from orders where o_totalprice > 150000"
_RIGHT = "select c_custkey as custkey, c_mktsegment as note, c_acctbal, true as matched from customer where c_acctbal > 3000"


def _join(how: str) -> str:
    return f"select l.o_orderkey, case when r.matched then r.custkey else l.custkey end as custkey, case when r.matched then r.note else l.note end as note, r.c_acctbal from ({_LEFT}) l {how} join ({_RIGHT}) r on l.custkey is not distinct from r.custkey"


def _profile(table: str, columns: list[str]) -> str:
    # numbers as the profile shows them: a double with one decimal at least
    show = "case when {0} is null then null when {0} = floor({0}) and abs({0}) < 1e7 then cast(cast({0} as bigint) as varchar) || '.0' else cast({0} as varchar) end"
    parts = []
    for c in columns:
        number = rf"try_cast(nullif(regexp_extract({c}::varchar, '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1), '') as double)"
        parts.append(f"""select '{c}' as name, n_rows, n_rows - filled as null_count, unique_count, kind, case when kind = 'number' then {show.format("low")} when kind = 'string' then least end as least,
          case when kind = 'number' then {show.format("high")} when kind = 'string' then most end as most, case when kind = 'number' then round(average, 3) end as average
          from (select *, case when filled > 0 and numbers = filled then 'number' when unique_count <= 10 and n_rows > 100 then 'categorical' else 'string' end as kind
            from (select count(*) as n_rows, count(nullif({c}::varchar, '')) as filled, count(distinct nullif({c}::varchar, '')) as unique_count, count({number}) as numbers, min({number}) as low, max({number}) as high, avg({number}) as average, min({c}::varchar) as least, max({c}::varchar) as most from {table}))""")
    return " union all ".join(parts)


def _quoted(text: str, sign: str = ",") -> str:
    return f"""case when contains({text}, '{sign}') or contains({text}, '"') or regexp_matches({text}, '[\\n\\r]') or starts_with({text}, ' ') or ends_with({text}, ' ') then '"' || replace({text}, '"', '""') || '"' else {text} end"""


_CENTS = "round(c_acctbal * 100)::bigint"

ORACLES: dict[str, str] = {
    "select_cols": "select o_totalprice, o_orderkey from orders",
    "select_by_index": "select c_name, c_acctbal, c_custkey from customer",
    "filter_eq": "select c_custkey, c_mktsegment from customer where c_mktsegment = 'BUILDING'",
    "filter_num": "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 45",
    "filter_contains": "select p_partkey, p_type from part where contains(p_type, 'AND')",
    "filter_startswith": "select p_partkey, p_type from part where starts_with(p_type, 'PROMO')",
    "filter_endswith": "select p_partkey, p_type from part where ends_with(p_type, 'MO')",
    "filter_matches": "select c_custkey, c_name from customer where regexp_matches(c_name, '0+[1-9]7$')",
    "filter_bool": "select o_orderkey from orders where (o_orderstatus = 'O' or o_orderstatus = 'F') and o_totalprice > 100000 and not (o_orderpriority = '1-URGENT')",
    "filter_ne_nulls": "select c_custkey, nullif(c_mktsegment, 'BUILDING') as segment from customer where nullif(c_mktsegment, 'BUILDING') is distinct from 'MACHINERY'",
    "filter_number_prefix": "select p_partkey, p_size::varchar || ' cm' as size from part where p_size < 7",
    "filter_index": f"select o_orderkey from (select o_orderkey, {_ORDERED.format('o_orderkey')} as i from orders) where i % 7 = 3",
    "map_expr": "select l_orderkey, l_linenumber, floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.5) / 100 as charge from lineitem",
    "sort_top": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
    "sort_positions": f"select o_orderkey, {_ORDERED.format('o_orderpriority desc, o_orderkey')} as place from orders",
    "sort_numeric_text": f"select p_partkey, {_ORDERED.format('p_retailprice::decimal(12,2), p_partkey')} as place from part",
    "head": "select event_id, event_type from events order by event_id limit 10",
    "tail": "select event_id, event_type from events order by event_id desc limit 10",
    "at": "select o_orderkey, o_totalprice from orders order by o_orderkey limit 1 offset 17",
    "flagship": "select l_returnflag, round(sum(l_quantity), 2) as sum_qty, round(avg(l_extendedprice), 4) as avg_price, count(*) as n from lineitem where l_quantity > 10 group by l_returnflag",
    "group_count": _group("count(*)"),
    "group_sum": _group("round(sum(o_totalprice), 2)"),
    "group_min": _group("round(min(o_totalprice), 2)"),
    "group_max": _group("round(max(o_totalprice), 2)"),
    "group_mean": _group("round(avg(o_totalprice), 2)"),
    "group_median": _group("round(median(o_totalprice), 2)"),
    "group_stddev": _group("round(stddev_pop(o_totalprice), 2)"),
    "group_first": f"select c_nationkey, first(name order by c_custkey) as value from ({_SEGMENTS}) group by c_nationkey",
    "group_last": f"select c_nationkey, last(name order by c_custkey) as value from ({_SEGMENTS}) group by c_nationkey",
    "group_concat": f"select c_nationkey, string_agg(coalesce(name, ''), ', ' order by c_custkey) as value from ({_SEGMENTS}) group by c_nationkey",
    "group_null_key": f"select segment, count(*) as n, max(c_acctbal) as largest from ({_SEGMENTS}) group by segment",
    "group_order": f"select segment, n, row_number() over (order by least_key) - 1 as place from (select segment, count(*) as n, min(c_custkey) as least_key from ({_SEGMENTS}) group by segment)",
    "group_custom_range": "select event_type, round(max(value) - min(value), 4) as spread from events group by event_type",
    "group_python": "select n_regionkey, string_agg(n_name[1:2], '/' order by n_nationkey) as value from nation group by n_regionkey",
    "group_count_groups": "select count(*) as n from (select distinct nullif(c_mktsegment, 'BUILDING') from customer)",
    "global_aggs": "select round(sum(l_extendedprice), 2) as sum_price, round(min(l_extendedprice), 2) as min_price, round(max(l_extendedprice), 2) as max_price, round(avg(l_extendedprice), 2) as mean_price, round(median(l_extendedprice), 2) as median_price, round(stddev_pop(l_extendedprice), 2) as stddev_price, count(*) as count_price from lineitem",
    "global_aggs_loose": "select round(sum(round(abs(c_acctbal), 2)), 2) as money, round(avg(c_custkey % 100), 4) as share, max(round(abs(c_acctbal), 2)) as most, count(*) as n from customer",
    **{f"join_{how}": _join(how) for how in ("inner", "left", "right", "full")},
    "join_cross": "select r_name, n_name from region cross join nation",
    "join_null_keys": "select n_name, r_name, l.key from (select n_name, nullif(n_regionkey, 2) as key from nation) l join (select r_name, nullif(r_regionkey, 2) as key from region) r on l.key is not distinct from r.key",
    "join_two_names": "select s_suppkey, s_nationkey, n_nationkey, n_name from supplier join nation on s_nationkey = n_nationkey",
    "join_order": f"select o_orderkey, custkey, row_number() over (order by o_orderkey nulls last, custkey) - 1 as place from ({_join('full')})",
    "profile_customer": _profile("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "profile_part": _profile("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "dynamic_typing": "select p_partkey, p_name, p_size::bigint as p_size, p_retailprice, p_size > 25 as big from part",
    "typed_coerce": f"select c_custkey, round({_CENTS} / 100.0, 2)::double as money, round((c_custkey % 100) / 100.0, 4)::double as share, round((c_custkey % 100) / 100.0, 4)::double as number, case c_custkey % 5 when 0 then true when 1 then false when 2 then true when 3 then false end as flag, c_custkey as prefixed from customer",
    "typed_dates": "select o_orderkey, case when o_orderkey % 11 <> 0 then strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' end as at from orders",
    "typed_errors": f"select 'InvalidCast' as code, i as row, 'flag' as name from (select c_custkey, {_ORDERED.format('c_custkey')} as i from customer) where c_custkey % 5 = 4",
    "trim_ws": "select p_partkey, p_name as both, p_name || chr(12288) || '  ' as lead, ' ' || chr(9) || chr(160) || p_name as rest from part",
    "from_to_line": f"select c_custkey::varchar as c_custkey, c_name from (select *, {_ORDERED.format('c_custkey')} as i from customer) where i between 3 and 59",
    "preview": "select c_custkey::varchar as c_custkey, c_name from customer order by customer.c_custkey limit 12",
    "skip_empty_values": "select n_name as name, n_regionkey::varchar as region from nation where n_nationkey % 3 <> 0",
    "csv_roundtrip": "select doc_id, text, lang from documents",
    "csv_roundtrip_typed": "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer",
    "escape_formulae": "select p_partkey, case when p_partkey % 6 < 5 then '''' else '' end || case p_partkey % 6 when 0 then '=' when 1 then '+' when 2 then '-' when 3 then '@' when 4 then chr(9) else '' end || p_name as v from part",
    "unparse_lines": f"select doc_id::varchar || ',' || {_quoted('text')} || ',' || source as line from documents",
    "unparse_quoted": "select c_custkey || ';\"' || c_name || '\";' || case when c_acctbal = floor(c_acctbal) then c_acctbal::bigint::varchar else c_acctbal::varchar end as line from customer",
    "tsv_escape": r"select doc_id || chr(9) || replace(replace(replace(text, chr(9), '\t'), chr(10), '\n'), chr(13), '\r') as line from documents",
    "to_json_lines": "select c_custkey, nullif(c_mktsegment, 'BUILDING') as segment, c_mktsegment = 'BUILDING' as has_null from customer",
    "flatten_nested": "select event_id, user_id, json_extract(props, '$.k')::bigint as user_props_k from events",
    "unflatten_nested": """select c_custkey as id, '{"name":"' || c_name || '","home":{"nation":' || c_nationkey || '}}' as who from customer""",
    "edits_apply": f"""with t as (select c_custkey, case i when 0 then 'edited' when 5 then 'edited last' else c_name end as c_name, i from (select *, {_ORDERED.format('c_custkey')} as i from customer) where i not in (2, 7)),
        r as (select c_custkey, c_name, row_number() over (order by i) - 1 as k from t)
        select c_custkey, c_name, case when k < 4 then k + 2 else k + 3 end as place from r
        union all values (-1, 'first', 0), (-2, 'second', 1), (-3, 'sixth', 6) union all select -4, 'end', count(*) + 3 from t""",
    "stream_batches": "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_totalprice > 50000 group by o_orderstatus",
    "csv_headed_files": "select c_custkey::varchar as c_custkey, c_name, c_mktsegment from customer",
    "csv_ragged": "select c_custkey::varchar as k, case when c_custkey % 7 <> 1 then c_name end as name, case when c_custkey % 7 = 0 then 'one|t,wo' end as extra from customer",
    "csv_ragged_errors": f"""select case c_custkey % 7 when 0 then 'TooManyFields' else 'TooFewFields' end as code, i as row, 'Expected 2 fields but found ' || case c_custkey % 7 when 0 then 3 else 1 end as message
        from (select c_custkey, {_ORDERED.format('c_custkey')} as i from customer) where c_custkey % 7 < 2""",
    "csv_skip_errors": "select c_custkey::varchar as k, c_name as name from customer where c_custkey % 7 <> 1",
    "csv_comments": "select c_custkey::varchar as k, c_name as name from customer where c_custkey % 5 <> 0",
    "csv_preamble": "select c_custkey::varchar as k, c_name || chr(10) || c_mktsegment as name from customer",
    "csv_record_size": "select c_custkey::varchar as k, c_name as name from customer where length(c_custkey::varchar) + length(c_name) + 2 * (c_custkey % 2) <= 21",
    "csv_delimiter": "select c_custkey::varchar as k, c_name as name, c_mktsegment as segment from customer",
    "csv_twice_named": "select c_custkey::varchar as k, c_name as v, c_mktsegment as v_1, c_nationkey::varchar as col3 from customer",
    "csv_fast": """select c_custkey::varchar as k, '"' || c_name as name from customer where c_custkey % 5 <> 0""",
    "csv_utf16": "select c_custkey::varchar as c_custkey, c_name from customer",
    "csv_strict": "select doc_id, octet_length(encode(coalesce(text, '')))::bigint as n_bytes, md5(coalesce(text, '')) as digest from documents",
    "csv_hooks": f"select c_custkey * 2 as k0, upper(c_name) || '!' as name1 from (select *, {_ORDERED.format('c_custkey')} as i from customer) where i % 3 <> 0",
    "validate_report": "select count(*) filter (where c_custkey % 7 = 1) = 0 as valid, count(*) as n_rows, 2::bigint as n_columns, count(*) filter (where c_custkey % 7 = 1) as n_errors from customer",
    "pull_chunks": f"select i // 10 as chunk, count(*) as n, min_by(n_name, i) as first from (select n_name, {_ORDERED.format('n_nationkey')} as i from nation) group by i // 10",
}
