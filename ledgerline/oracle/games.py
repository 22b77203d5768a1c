from ledgerline.oracle.kit import area, rnd, steps, using

_CLEAN = """
g AS (SELECT "Name" AS name, "Platform" AS platform, "Year_of_Release" AS year_of_release, "Genre" AS genre,
             "NA_sales" AS na_sales, "EU_sales" AS eu_sales, "JP_sales" AS jp_sales, "Other_sales" AS other_sales,
             CAST("Critic_Score" AS BIGINT) AS critic_score,
             CAST(NULLIF("User_Score", 'tbd') AS DOUBLE) AS user_score, "Rating" AS rating,
             "NA_sales" + "EU_sales" + "JP_sales" + "Other_sales" AS total_sales FROM games),
n AS (SELECT * FROM g WHERE year_of_release IN (1998, 1999, 2000))"""
_W = using("games", rest=_CLEAN)
_S = rnd("SUM(total_sales)", 2)


def _by(table: str, *by: str) -> str:
    keys = ", ".join(by)
    return f"""SELECT {keys}, {_S} AS total_sales FROM {table}
        WHERE {' AND '.join(f'{b} IS NOT NULL' for b in by)} GROUP BY {keys}"""


def _q(p: float) -> str:
    return f"quantile_cont(total_sales, {p})"


def _leaders(d: str) -> str:
    return _W + f"""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY region ORDER BY sales DESC, {d}) AS place
        FROM ({' UNION ALL '.join(f"SELECT {d}, '{r}' AS region, {rnd(f'SUM({r})', 2)} AS sales FROM n WHERE {d} IS NOT NULL GROUP BY {d}" for r in ('na_sales', 'eu_sales', 'jp_sales'))}))
        WHERE place <= 5"""


def _welch(column: str, a: str, b: str) -> str:
    return _W + f""", s AS (SELECT
          COUNT(CASE WHEN {column} = '{a}' THEN user_score END) AS n1, COUNT(CASE WHEN {column} = '{b}' THEN user_score END) AS n2,
          AVG(CASE WHEN {column} = '{a}' THEN user_score END) AS m1, AVG(CASE WHEN {column} = '{b}' THEN user_score END) AS m2,
          VAR_SAMP(CASE WHEN {column} = '{a}' THEN user_score END) AS v1,
          VAR_SAMP(CASE WHEN {column} = '{b}' THEN user_score END) AS v2 FROM n)
        SELECT '{a}' AS group_1, '{b}' AS group_2, n1, n2, {rnd('m1', 6)} AS mean_1, {rnd('m2', 6)} AS mean_2,
               {rnd('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)', 6)} AS t,
               {rnd('(v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))', 6)} AS dof
        FROM s"""


_T_DENSITY = "exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi()) * pow(1 + x * x / dof, -(dof + 1) / 2)"


def _welch_p(column: str, a: str, b: str) -> str:
    """The tail of Student's distribution, integrated from its density."""
    samples = _welch(column, a, b)
    exact = samples[: samples.rindex("SELECT '")].rstrip() + """,
        w AS (SELECT n1, n2, m1, m2, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
                     (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS dof FROM s)"""
    return exact + f""",
        p AS (SELECT {area(_T_DENSITY, 'ABS(t)', 'w')} AS inside FROM {steps('w')})
        SELECT '{a}' AS group_1, '{b}' AS group_2, {rnd('t', 6)} AS t, {rnd('dof', 6)} AS dof,
               {rnd('1 - 2 * inside', 6)} AS p_value, 1 - 2 * inside < 0.05 AS rejected FROM w, p"""


SQL = {
    "gam_clean": _W + "SELECT * FROM g",
    "gam_by_year": _W + "SELECT year_of_release, COUNT(name) AS games_cnt FROM g WHERE year_of_release IS NOT NULL GROUP BY 1",
    "gam_by_platform": _W + _by("g", "platform"),
    "gam_by_platform_year": _W + _by("g", "year_of_release", "platform"),
    "gam_top6_platforms": _W + f"""SELECT * FROM ({_by('g', 'year_of_release', 'platform')})
        WHERE platform IN (SELECT platform FROM ({_by('g', 'platform')}) ORDER BY total_sales DESC, platform LIMIT 6)""",
    "gam_actual_period": _W + _by("n", "platform"),
    "gam_actual_period_years": _W + _by("n", "year_of_release", "platform"),
    "gam_boxplot": _W + f""", q AS (SELECT platform, {_q(0.25)} AS q1, {_q(0.5)} AS m, {_q(0.75)} AS q3 FROM n GROUP BY 1),
        f AS (SELECT n.platform, total_sales AS v, q1, m, q3,
                     total_sales BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM n JOIN q USING (platform))
        SELECT platform, COUNT(*) AS cnt, {rnd('MAX(q1)', 4)} AS q1, {rnd('MAX(m)', 4)} AS median, {rnd('MAX(q3)', 4)} AS q3,
               {rnd('MIN(CASE WHEN ok THEN v END)', 4)} AS whisker_low, {rnd('MAX(CASE WHEN ok THEN v END)', 4)} AS whisker_high,
               COUNT(CASE WHEN NOT ok THEN 1 END) AS outlier_cnt FROM f GROUP BY 1""",
    "gam_score_corr": _W + f"""SELECT platform, {rnd('corr(user_score, total_sales)', 6)} AS user_score_r,
        {rnd('corr(critic_score, total_sales)', 6)} AS critic_score_r FROM n GROUP BY 1""",
    "gam_genre_stats": _W + f"""SELECT genre, COUNT(*) AS cnt, {rnd('AVG(total_sales)', 4)} AS mean,
        {rnd('SUM(total_sales)', 4)} AS sum, {rnd(_q(0.5), 4)} AS median FROM n WHERE genre IS NOT NULL GROUP BY 1""",
    "gam_region_platforms": _leaders("platform"),
    "gam_region_genres": _leaders("genre"),
    "gam_region_ratings": _W + f"""SELECT COALESCE(rating, 'No rating') AS rating, {rnd('SUM(na_sales)', 2)} AS na_sales,
        {rnd('SUM(eu_sales)', 2)} AS eu_sales, {rnd('SUM(jp_sales)', 2)} AS jp_sales FROM n GROUP BY 1""",
    "gam_welch_platforms": _welch("platform", "P1", "P2"),
    "gam_welch_p_values": _welch_p("platform", "P1", "P2"),
    "gam_welch_genres": _welch("genre", "URGENT", "HIGH"),
}
