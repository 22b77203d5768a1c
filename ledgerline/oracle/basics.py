from ledgerline.oracle.kit import big, cents, money, pct, rnd


def _q(x: str, p: float) -> str:
    return f"quantile_cont(CAST({x} AS DOUBLE), {p})"


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
         "l_returnflag", "l_linestatus", "l_shipdate"]
_ZERO = {"l_tax": "NULLIF(l_tax, 0)", "l_discount": "NULLIF(l_discount, 0)"}
_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]

SQL = {
    "tab_quoted_csv": """
        SELECT doc_id, source, length(v) AS chars, length(v) - length(replace(v, chr(10), '')) AS line_breaks,
               md5(v) AS text_md5, true AS whole
        FROM (SELECT doc_id, source, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS v FROM documents)""",
    "tab_separated": """
        SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name || ', "' || CAST(n_regionkey AS VARCHAR) || '"; x' AS label,
               CASE WHEN n_regionkey <> 1 THEN n_name END AS name, kind
        FROM nation, (VALUES ('semicolon'), ('tab'), ('comma')) kinds(kind)""",
    "tab_inline": """
        SELECT segment, CAST(weight AS DOUBLE) AS weight, customers
        FROM (VALUES ('AUTOMOBILE', 1.5), ('BUILDING', 2.0), ('NOWHERE', 9.0)) listed(segment, weight)
        LEFT JOIN (SELECT c_mktsegment AS segment, COUNT(*) AS customers FROM customer GROUP BY 1) USING (segment)""",
    "tab_csv": "SELECT c_custkey, c_name, c_mktsegment, CAST(c_nationkey AS INTEGER) AS c_nationkey FROM customer",
    "tab_dirty_csv": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_type, TRUE AS whole FROM part",
    "tab_export": """SELECT o_orderstatus, COUNT(*) AS orders, MAX(o_orderkey) AS last_order FROM orders GROUP BY 1""",
    "tab_view": "SELECT n_nationkey, n_name FROM nation",
    "tab_shape": "SELECT COUNT(*) AS row_cnt, CAST(11 AS BIGINT) AS column_cnt FROM lineitem",
    "tab_peek": " UNION ALL ".join(
        f"SELECT * FROM (SELECT c_custkey AS row_key, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM customer "
        f"ORDER BY c_custkey LIMIT 2)" for c in _CUSTOMER),
    "tab_null_profile": " UNION ALL ".join(f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({_ZERO.get(c, c)}) AS null_cnt,
        {pct(f'COUNT(*) - COUNT({_ZERO.get(c, c)})', 'COUNT(*)')} AS null_percent FROM lineitem""" for c in _LINE),
    "tab_duplicates": f"""SELECT row_cnt, distinct_rows, row_cnt - distinct_rows AS duplicate_rows,
        {pct('row_cnt - distinct_rows', 'row_cnt')} AS duplicate_percent FROM (SELECT (SELECT COUNT(*) FROM lineitem) AS row_cnt,
        COUNT(*) AS distinct_rows FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))""",
    "tab_describe": " UNION ALL ".join(f"""SELECT '{c}' AS "column", COUNT({c}) AS cnt, {rnd(f'AVG({c})', 4)} AS mean,
        {rnd(f'STDDEV_SAMP({c})', 4)} AS std, MIN({c}) AS min, MAX({c}) AS max, {rnd(_q(c, 0.25), 4)} AS q1,
        {rnd(_q(c, 0.5), 4)} AS median, {rnd(_q(c, 0.75), 4)} AS q3 FROM lineitem""" for c in _MEASURES),
    "tab_iqr": f"""SELECT 'value' AS "column", {rnd('AVG(value)', 4)} AS mean, {rnd('MAX(m)', 4)} AS median,
        {rnd('MAX(q1 - 1.5 * (q3 - q1))', 4)} AS lower_bound, {rnd('MAX(q3 + 1.5 * (q3 - q1))', 4)} AS upper_bound,
        COUNT(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN 1 END) AS normal_cnt,
        {pct('COUNT(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN 1 END)', 'COUNT(value)', 1)} AS normal_percent
        FROM events, (SELECT {_q('value', 0.25)} AS q1, {_q('value', 0.5)} AS m, {_q('value', 0.75)} AS q3 FROM events)""",
    "tab_box": f"""WITH q AS (SELECT event_type, {_q('value', 0.25)} AS q1, {_q('value', 0.5)} AS m, {_q('value', 0.75)} AS q3
          FROM events GROUP BY 1),
        f AS (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM events JOIN q USING (event_type))
        SELECT event_type, COUNT(*) AS cnt, {rnd('MAX(q1)', 4)} AS q1, {rnd('MAX(m)', 4)} AS median, {rnd('MAX(q3)', 4)} AS q3,
               {rnd('MIN(CASE WHEN ok THEN value END)', 4)} AS whisker_low, {rnd('MAX(CASE WHEN ok THEN value END)', 4)} AS whisker_high,
               COUNT(CASE WHEN NOT ok THEN 1 END) AS outlier_cnt FROM f GROUP BY 1""",
    "tab_histogram": """SELECT bin, COUNT(*) AS cnt, CAST((bin - 1) * 5.0 AS DOUBLE) AS bin_start FROM (
        SELECT LEAST(CAST(FLOOR(value / 5.0) AS BIGINT) + 1, 20) AS bin FROM events WHERE value BETWEEN 0 AND 100) GROUP BY 1""",
    "tab_quantiles": f"""SELECT l_suppkey, COUNT(*) AS n, {_q('l_quantity', 0.1)} AS p10, {_q('l_quantity', 0.5)} AS p50,
        {_q('l_quantity', 0.99)} AS p99 FROM lineitem GROUP BY 1""",
    "tab_median_price": f"""SELECT l_returnflag, COUNT(*) AS cnt, {rnd('AVG(l_extendedprice)', 2)} AS mean,
        {rnd(_q('l_extendedprice', 0.5), 2)} AS median FROM lineitem GROUP BY 1""",
    "tab_mode": f"""SELECT l_suppkey, mode, mode_cnt, {big('total')} AS value_cnt, {big('total')} AS obs_cnt FROM (
        SELECT l_suppkey, l_linenumber AS mode, COUNT(*) AS mode_cnt, SUM(COUNT(*)) OVER (PARTITION BY l_suppkey) AS total,
               ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY COUNT(*) DESC, l_linenumber) AS r
        FROM lineitem GROUP BY 1, 2) WHERE r = 1""",
    "tab_correlation": f"SELECT {rnd('corr(l_quantity, l_extendedprice)', 6)} AS r FROM lineitem",
    "tab_extreme_rows": """SELECT * FROM part WHERE p_retailprice = (SELECT MAX(p_retailprice) FROM part)
        OR p_retailprice = (SELECT MIN(p_retailprice) FROM part)""",
    "tab_string_agg": """SELECT r_name, string_agg(n_name, ' ' ORDER BY n_name) AS nations FROM nation
        JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    "tab_flag_summary": f"""SELECT l_returnflag, l_linestatus, COUNT(*) AS cnt, {big('SUM(l_quantity)')} AS quantity,
        {money(f"SUM({cents('l_extendedprice')})")} AS price, {rnd('AVG(l_discount)', 4)} AS avg_discount
        FROM lineitem GROUP BY 1, 2""",
    "tab_rounding": f"""SELECT value, cnt, {rnd('value')} AS half_up, round_even(value, 0) AS half_even
        FROM (SELECT l_quantity / 2 AS value, COUNT(*) AS cnt FROM lineitem GROUP BY 1)""",
    "tab_synonym_table": "SELECT p_partkey, LOWER(SUBSTR(p_type, 1, 3)) AS p_type FROM part",
    "tab_missing_members": "SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
}
