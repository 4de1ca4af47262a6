"""DuckDB SQL with the same results as the registered queries, written independently of them.

Ranks come from window functions over raw rows, tail probabilities from Simpson's rule over the
densities, neighbours from comparing every pair: slow and plain where the Spark side is not.
"""

from __future__ import annotations

SEED = 7
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]
LINEITEM_COLUMNS = ["l_linenumber", *NUMBERS, "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_CATEGORIES = ["l_linenumber", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
R = "SELECT * FROM lineitem WHERE l_returnflag = 'R'"
A = "SELECT * FROM lineitem WHERE l_returnflag = 'A'"
Y95 = "SELECT * FROM orders WHERE year(o_orderdate) = 1995"
Y96 = "SELECT * FROM orders WHERE year(o_orderdate) = 1996"
E1 = "SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16'"
E2 = "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16'"
GAPS = """SELECT c_custkey, c_nationkey,
  CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment,
  CASE WHEN c_custkey % 11 <> 0 THEN right(c_name, 1) END AS c_digit FROM customer"""


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def r6(name: str, alias: str | None = None) -> str:
    return f"round({name}, 6) + 0.0 AS {alias or name}"


def places(x: str) -> str:
    """Digits after the point of a double that prints without an exponent."""
    return f"CASE WHEN {x} = floor({x}) THEN 0 ELSE length({x}::VARCHAR) - strpos({x}::VARCHAR, '.') END"


# profile


def profile_sql(source: str, numeric: list[str], other: list[str]) -> str:
    rows = [
        f"SELECT '{c}' AS \"column\", count({c}) > 0 AS is_num, count(DISTINCT {c}) AS unique_count, "
        f"coalesce(max({places(f'{c}::DOUBLE')}), 0) AS places FROM src"
        for c in numeric
    ] + [f"SELECT '{c}', false, count(DISTINCT {c}), 0 FROM src" for c in other]
    return f"""WITH src AS ({source}), facts AS ({union(rows)})
SELECT "column", CASE WHEN is_num AND unique_count > 10 THEN 'numerical' ELSE 'categorical' END AS type,
  unique_count, is_num AND unique_count <= 10 AS is_heuristic_categorical,
  CASE WHEN is_num THEN places ELSE 0 END::INTEGER AS precision FROM facts"""


def probe_sql(source: str, key: str, columns: list[str]) -> str:
    """Text profile: numeric when the first 50 non-missing cells all spell numbers."""
    clean = (
        "CASE WHEN v <> '' AND lower(trim(v)) NOT IN ('null', 'continuous', 'nan', 'n/a', 'undefined') THEN v END"
    )
    number = r"CASE WHEN regexp_matches(v, '^\s*-?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$') THEN try_cast(v AS DOUBLE) END"
    cells = union([f"SELECT '{c}' AS \"column\", {key} AS pos, {c}::VARCHAR AS v FROM src" for c in columns])
    return f"""WITH src AS ({source}), cells AS ({cells}),
cleaned AS (SELECT "column", pos, {clean} AS v FROM cells),
typed AS (SELECT *, {number} AS x, row_number() OVER (PARTITION BY "column" ORDER BY pos) AS n
  FROM cleaned WHERE v IS NOT NULL),
facts AS (SELECT "column", bool_and(x IS NOT NULL) FILTER (n <= 50) AS is_num,
  count(DISTINCT CASE WHEN x IS NULL THEN v ELSE x::VARCHAR END) AS unique_count,
  coalesce(max({places('x')}), 0) AS places FROM typed GROUP BY 1)
SELECT "column", CASE WHEN is_num AND unique_count > 10 THEN 'numerical' ELSE 'categorical' END AS type,
  unique_count, is_num AND unique_count <= 10 AS is_heuristic_categorical,
  CASE WHEN is_num THEN places ELSE 0 END::INTEGER AS precision FROM facts"""


# two-sample comparisons; every fragment builds on CTEs o (original) and a (synthetic)

SIMPSON_WEIGHT = "CASE WHEN j IN (0, {n}) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END"


def simpson(source: str, upper: str, density: str, n: int) -> str:
    """Per column 1 - integral of ``density`` (in x) from 0 to ``upper``, never below 0."""
    weight = SIMPSON_WEIGHT.format(n=n)
    return f"""SELECT "column", greatest(1 - sum({weight} * ({density})) * max(up) / {n} / 3, 0.0) AS p
FROM (SELECT *, {upper} AS up, j * ({upper}) / {n} AS x FROM {source}, range(0, {n + 1}) g(j)) GROUP BY "column\""""


T_DENSITY = (
    "2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi()) - (df + 1) / 2 * ln(1 + x * x / df))"
)
NORMAL_DENSITY = "2 * exp(-x * x / 2) / sqrt(2 * pi())"
CHI_DENSITY = (
    "CASE WHEN df = 1 THEN 2 * exp(-x * x / 2) / sqrt(2 * pi()) WHEN x = 0 THEN 0 "
    "ELSE 2 * exp((df - 1) * ln(greatest(x, 1e-300)) - x * x / 2 - df / 2 * ln(2) - lgamma(df / 2)) END"
)


def side_ctes(o: str, a: str) -> str:
    return f"o AS ({o}), a AS ({a})"


def moment_ctes(columns: list[str]) -> str:
    rows = [
        f"""SELECT '{c}' AS "column", * FROM
 (SELECT avg({c}) AS mean_o, stddev_samp({c}) AS std_o, min({c})::DOUBLE AS min_o, max({c})::DOUBLE AS max_o,
   count({c}) AS count_o FROM o),
 (SELECT avg({c}) AS mean_a, stddev_samp({c}) AS std_a, min({c})::DOUBLE AS min_a, max({c})::DOUBLE AS max_a,
   count({c}) AS count_a FROM a)"""
        for c in columns
    ]
    z = "1.959963984540054::DOUBLE"
    return f"""moments AS ({union(rows)}),
spread AS (SELECT *, std_o * std_o / count_o AS so, std_a * std_a / count_a AS sa FROM moments),
welch AS (SELECT *, pow(so + sa, 2) / (so * so / (count_o - 1) + sa * sa / (count_a - 1)) AS wdf FROM spread),
critical AS (SELECT *, {z} + (pow({z}, 3) + {z}) / (4 * wdf)
  + (5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / (96 * wdf * wdf)
  + (3 * pow({z}, 7) + 19 * pow({z}, 5) + 17 * pow({z}, 3) - 15 * {z}) / (384 * pow(wdf, 3)) AS crit FROM welch),
described AS (SELECT "column", mean_o, std_o, min_o, max_o, count_o, mean_a, std_a, min_a, max_a, count_a,
  mean_a - mean_o AS diff, mean_a - mean_o - crit * sqrt(so + sa) AS ci_lower,
  mean_a - mean_o + crit * sqrt(so + sa) AS ci_upper FROM critical),
t_in AS (SELECT "column", (mean_a - mean_o) / (std_o / sqrt(count_o)) AS statistic,
  (count_o - 1)::DOUBLE AS df FROM moments),
t_p AS ({simpson('t_in', 'abs(statistic)', T_DENSITY, 2000)}),
t_test AS (SELECT t_in."column", statistic, p AS p_value, p > 0.05 AS is_similar FROM t_in JOIN t_p USING ("column"))"""


def rank_ctes(columns: list[str]) -> str:
    pooled = union(
        [f"SELECT '{c}' AS \"column\", {side == 'o'} AS orig, {c}::DOUBLE AS v FROM {side} WHERE {c} IS NOT NULL"
         for c in columns for side in ("o", "a")]
    )
    return f"""pooled AS ({pooled}),
ecdf AS (SELECT DISTINCT "column", v AS value, count(*) FILTER (orig) OVER e AS c1,
  count(*) FILTER (NOT orig) OVER e AS c2, count(*) FILTER (orig) OVER r AS k1,
  count(*) FILTER (NOT orig) OVER r AS k2, count(*) FILTER (orig) OVER c AS n1,
  count(*) FILTER (NOT orig) OVER c AS n2 FROM pooled
  WINDOW e AS (PARTITION BY "column", v), c AS (PARTITION BY "column"),
  r AS (PARTITION BY "column" ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ranked AS (SELECT *, rank() OVER (PARTITION BY "column" ORDER BY v)
  + (count(*) OVER (PARTITION BY "column", v) - 1) / 2.0 AS rnk FROM pooled),
sizes AS (SELECT "column", sum(rnk) FILTER (orig) AS r1, (count(*) FILTER (orig))::DOUBLE AS n1,
  (count(*) FILTER (NOT orig))::DOUBLE AS n2 FROM ranked GROUP BY 1),
mw_in AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS statistic FROM sizes),
mw_z AS (SELECT *, (statistic - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z FROM mw_in),
mw_p AS ({simpson('mw_z', 'abs(z)', NORMAL_DENSITY, 2000)}),
mann_whitney AS (SELECT mw_z."column", statistic::DOUBLE AS statistic, p AS p_value, p > 0.05 AS is_similar
  FROM mw_z JOIN mw_p USING ("column")),
gaps AS (SELECT "column", max(abs(k1::DOUBLE / n1 - k2::DOUBLE / n2)) AS d, max(n1)::DOUBLE AS n1,
  max(n2)::DOUBLE AS n2 FROM ecdf GROUP BY 1),
ks_test AS (SELECT "column", d AS statistic, least(1.0, 2 * exp(-2 * n1 * n2 / (n1 + n2) * d * d)) AS p_value,
  least(1.0, 2 * exp(-2 * n1 * n2 / (n1 + n2) * d * d)) > 0.05 AS is_similar FROM gaps)"""


def category_ctes(columns: list[str]) -> str:
    tall = union(
        [f"SELECT '{c}' AS \"column\", coalesce({c}::VARCHAR, 'null') AS category, {side == 'o'} AS orig FROM {side}"
         for c in columns for side in ("o", "a")]
    )
    return f"""tall AS ({tall}),
counts AS (SELECT "column", category, count(*) FILTER (orig) AS c_orig, count(*) FILTER (NOT orig) AS c_aug
  FROM tall GROUP BY 1, 2),
shares AS (SELECT *, c_orig / greatest(n_orig, 1) AS p_orig, c_aug / greatest(n_aug, 1) AS p_aug FROM
  (SELECT *, (sum(c_orig) OVER c)::BIGINT AS n_orig, (sum(c_aug) OVER c)::BIGINT AS n_aug FROM counts
   WINDOW c AS (PARTITION BY "column"))),
chi_in AS (SELECT "column", sum(pow(c_aug - p_orig * n_aug, 2) / (p_orig * n_aug)) AS statistic,
  (count(*) - 1)::DOUBLE AS df, max(n_aug) AS n FROM shares WHERE c_orig > 0 GROUP BY 1 HAVING count(*) >= 2),
chi_p AS ({simpson('chi_in', 'sqrt(statistic)', CHI_DENSITY, 4000)}),
chi AS (SELECT chi_in."column", statistic, p AS p_value, sqrt(statistic / (n * df)) AS cramers_v,
  p > 0.05 AS is_similar FROM chi_in JOIN chi_p USING ("column")),
tvd AS (SELECT "column", sum(abs(p_orig - p_aug)) / 2 AS value, sum(abs(p_orig - p_aug)) / 2 < 0.1 AS is_similar
  FROM shares GROUP BY 1)"""


# reports


def report_ctes(o: str, a: str, headers: list[str], numeric: list[str], categorical: list[str], numbers: list[str]) -> str:
    """All report CTEs; ``numbers`` lists the columns that are numeric by type."""
    profile = profile_sql("SELECT * FROM o", [c for c in headers if c in numbers], [c for c in headers if c not in numbers])
    return f"""WITH {side_ctes(o, a)}, {moment_ctes(numeric)}, {rank_ctes(numeric)}, {category_ctes(categorical)},
prof AS ({profile}),
tests AS (
  SELECT "column", 't' AS test, statistic, p_value, NULL::DOUBLE AS effect, is_similar FROM t_test
  UNION ALL SELECT "column", 'mw', statistic, p_value, NULL, is_similar FROM mann_whitney
  UNION ALL SELECT "column", 'ks', statistic, p_value, NULL, is_similar FROM ks_test
  UNION ALL SELECT "column", 'chi', statistic, p_value, cramers_v, is_similar FROM chi
  UNION ALL SELECT "column", 'tvd', value, NULL, NULL, is_similar FROM tvd),
badges AS (SELECT *, CASE WHEN is_heuristic_categorical THEN 'Discrete' WHEN type = 'numerical' THEN 'Continuous'
  ELSE 'Categorical' END AS badge FROM prof),
stats AS (SELECT prof."column" AS variable, type, unique_count AS unique_values,
  CASE WHEN is_heuristic_categorical THEN 'Categorical' ELSE 'Standard' END AS heuristic, precision,
  t.p_value AS t_test_p, m.p_value AS mann_whitney_p, k.p_value AS ks_p, diff AS mean_difference, ci_lower, ci_upper,
  chi.p_value AS chi_square_p, cramers_v, tvd.value AS tvd,
  CASE WHEN CASE WHEN type = 'numerical' THEN t.is_similar AND m.is_similar AND k.is_similar
    ELSE coalesce(chi.is_similar, false) OR coalesce(cramers_v < 0.1, false) OR tvd.is_similar END
  THEN 'YES' ELSE 'NO' END AS is_similar
  FROM prof LEFT JOIN t_test t USING ("column") LEFT JOIN mann_whitney m USING ("column")
  LEFT JOIN ks_test k USING ("column") LEFT JOIN described d USING ("column") LEFT JOIN chi USING ("column")
  LEFT JOIN tvd USING ("column"))"""


STATS_SELECT = (
    "SELECT variable, type, unique_values, heuristic, precision, "
    + ", ".join(
        r6(c)
        for c in (
            "t_test_p",
            "mann_whitney_p",
            "ks_p",
            "mean_difference",
            "ci_lower",
            "ci_upper",
            "chi_square_p",
            "cramers_v",
            "tvd",
        )
    )
    + ", is_similar FROM stats"
)


def fixed(x: str, p: str) -> str:
    cases = " ".join(f"WHEN {n} THEN printf('%.{n}f', {x})" for n in range(7))
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE CASE {p} {cases} END END"


def shown_p(p: str) -> str:
    return f"CASE WHEN {p} < 0.001 THEN '< 0.001' WHEN {p} IS NOT NULL THEN printf('%.3f', {p}) END"


SUMMARY_SELECT = f"""SELECT t_similar, mw_similar, ks_similar, chi_similar, {r6('avg_tvd')}, {r6('avg_cramers_v')},
  total_numerical, total_categorical,
  {r6('coalesce(t_similar * 100.0::DOUBLE / nullif(total_numerical, 0), 0.0)', 't_rate')},
  {r6('coalesce(ks_similar * 100.0::DOUBLE / nullif(total_numerical, 0), 0.0)', 'ks_rate')},
  {r6('coalesce(chi_similar * 100.0::DOUBLE / nullif(total_categorical, 0), 0.0)', 'chi_rate')},
  CASE WHEN avg_tvd < 0.1 THEN 'good' ELSE 'warning' END AS tvd_band,
  CASE WHEN avg_cramers_v < 0.1 THEN 'negligible' WHEN avg_cramers_v < 0.3 THEN 'moderate' ELSE 'large' END
    AS effect_band
FROM (SELECT count(*) FILTER (test = 't' AND is_similar) AS t_similar,
  count(*) FILTER (test = 'mw' AND is_similar) AS mw_similar,
  count(*) FILTER (test = 'ks' AND is_similar) AS ks_similar,
  count(*) FILTER (test = 'chi' AND is_similar) AS chi_similar,
  coalesce(avg(statistic) FILTER (test = 'tvd'), 0.0) AS avg_tvd,
  coalesce(avg(effect) FILTER (test = 'chi'), 0.0) AS avg_cramers_v,
  count(*) FILTER (test = 't') AS total_numerical, count(*) FILTER (test = 'tvd') AS total_categorical FROM tests)"""

TEXT_SELECT = f"""SELECT * FROM (VALUES (0::BIGINT, 'Statistical Comparison Report'),
  (1, '============================='), (2, ''), (3, '1. Descriptive Statistics'), (4, '-------------------------'),
  (1099511627776, ''), (1099511627777, '... (detailed p-values, TVD, and Cramers V available in CSV Summary)')
) v(line_no, line)
UNION ALL SELECT 5 + 4 * ordinal + pos, CASE pos WHEN 0 THEN '' WHEN 1 THEN "column" || ':'
  WHEN 2 THEN '  Mean: ' || {fixed('mean_o', 'precision')} || ' -> ' || {fixed('mean_a', 'precision')}
  ELSE '  95% CI Diff: [' || {fixed('ci_lower', 'precision')} || ', ' || {fixed('ci_upper', 'precision')} || ']' END
FROM described JOIN prof USING ("column"), range(4) g(pos),
  LATERAL (SELECT list_position({LINEITEM_COLUMNS}, "column") - 1 AS ordinal)"""


# synthesis


def uniform(tag: str, row: str = "i") -> str:
    bits = f"('0x' || substr(md5('{SEED}:' || {row}::VARCHAR || ':{tag}'), 1, 13))::BIGINT::DOUBLE"
    return f"(({bits} + 0.5) / 4503599627370496.0::DOUBLE)"


def steady(x: str) -> str:
    return f"format('{{:.12g}}', ({x})::DOUBLE)::DOUBLE"


def synthesis_ctes(
    source: str, key: str, numeric: list[str], categorical: list[str], target: str = "(SELECT count(*) FROM src)"
) -> str:
    """CTEs orig, facts, base, made (numbers), nearest (5 per i and target), picked (one class each)."""
    stats = ", ".join(
        f"{steady(f'avg({c})')} AS {c}_mean, {steady(f'stddev_pop({c})')} AS {c}_std, min({c})::DOUBLE AS {c}_min, "
        f"max({c})::DOUBLE AS {c}_max, bool_and({c} = floor({c})) AS {c}_int, "
        f"max({places(f'{c}::DOUBLE')}) AS {c}_places"
        for c in numeric
    )

    def made(c: str) -> str:
        normal = (
            f"sqrt(-2.0::DOUBLE * ln({uniform(c + ':a')})) * cos(6.283185307179586::DOUBLE * {uniform(c + ':b')})"
        )
        moved = f"coalesce({c}::DOUBLE, {c}_mean) + ({c}_std * 0.05::DOUBLE) * ({normal})"
        kept = f"greatest({c}_min, least({c}_max, {moved}))"
        power = f"pow(10.0::DOUBLE, {c}_places)"
        return f"CASE WHEN {c}_int THEN floor({kept} + 0.5) ELSE floor({kept} * {power} + 0.5) / {power} END AS {c}_new"

    def z(value: str, c: str) -> str:
        return f"coalesce(({value}::DOUBLE - {c}_mean) / {c}_std, 0.0::DOUBLE)"

    ctes = f"""src AS ({source}),
orig AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS row_idx FROM src),
facts AS (SELECT count(*) AS n{', ' + stats if stats else ''} FROM src),
draws AS (SELECT i, floor({uniform('base')} * n)::BIGINT AS row_idx FROM range({target}) g(i), facts),
base AS (SELECT i, orig.* FROM draws JOIN orig USING (row_idx)),
made AS MATERIALIZED (SELECT base.*{''.join(', ' + made(c) for c in numeric)} FROM base, facts)"""
    if not categorical:
        return ctes
    s_z = "".join(f", {z(f'{c}_new', c)} AS {c}_z" for c in numeric)
    o_z = "".join(f", {z(c, c)} AS {c}_z" for c in numeric)
    squares = " + ".join(f"(s.{c}_z - c.{c}_z) * (s.{c}_z - c.{c}_z)" for c in numeric) or "0.0::DOUBLE"
    nearest = []
    for t, c in enumerate(categorical):
        others = [f"(c.{d} IS DISTINCT FROM s.{d})::INTEGER" for d in categorical if d != c]
        nearest.append(
            f"SELECT i, {t} AS t, '{c}' AS target, min({{'distance': sqrt({squares} + ({' + '.join(others) or '0'})), "
            f"'row_idx': c.row_idx, 'class': c.{c}::VARCHAR}}, 5) AS five FROM seeds s, cands c GROUP BY i"
        )
    return f"""{ctes},
seeds AS MATERIALIZED (SELECT made.*{s_z} FROM made, facts),
cands AS MATERIALIZED (SELECT orig.*{o_z} FROM orig, facts),
five AS ({union(nearest)}),
nearest AS MATERIALIZED (SELECT i, target, rank::INTEGER AS rank, e.row_idx AS row_idx, e.distance AS distance,
  e.class AS class FROM (SELECT i, target, unnest(five) AS e, generate_subscripts(five, 1) AS rank FROM five)),
votes AS (SELECT i, target, class, count(*) AS votes, min(rank) AS first_rank FROM nearest GROUP BY ALL),
walk AS (SELECT *, sum(votes) OVER (PARTITION BY i, target ORDER BY first_rank) AS reach,
  sum(votes) OVER (PARTITION BY i, target) AS total FROM votes),
draw AS ({union([f"SELECT i, '{c}' AS target, {uniform(c + ':pick')} AS u FROM draws" for c in categorical])}),
chosen AS (SELECT i, target, arg_min_null(class, first_rank) AS class FROM walk JOIN draw USING (i, target)
  WHERE reach >= u * total GROUP BY ALL),
picked AS (SELECT i, {', '.join(f"any_value(class) FILTER (target = '{c}') AS {c}_new" for c in categorical)}
  FROM chosen GROUP BY i)"""


def synthesized(
    columns: list[str], numeric: list[str], categorical: list[str], types: dict[str, str], keep_row: bool = True
) -> str:
    """The final select over the synthesis CTEs, in header order and source types."""
    kept = ["made.i"] if keep_row else []
    kept += [f"{c}_new::{types.get(c, 'VARCHAR')} AS {c}" for c in columns]
    joined = "made JOIN picked USING (i)" if categorical else "made"
    return f"SELECT {', '.join(kept)} FROM {joined}"


CUSTOMER = ["c_nationkey", "c_acctbal", "c_mktsegment"]
CUSTOMER_TYPES = {"c_nationkey": "INTEGER", "c_acctbal": "DOUBLE"}
PART = ["p_brand", "p_type", "p_size", "p_retailprice", "p_name"]
PART_TYPES = {"p_size": "INTEGER", "p_retailprice": "DOUBLE"}
PART_NUMBERS, PART_WORDS = ["p_size", "p_retailprice"], ["p_brand", "p_type", "p_name"]
LINE = ["l_linenumber", *NUMBERS, "l_tax", "l_returnflag", "l_linestatus"]
LINE_TYPES = {"l_linenumber": "INTEGER", "l_tax": "DOUBLE", **{c: "DOUBLE" for c in NUMBERS}}
LINE_KEY = (
    "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate"
)
CUSTOMER_SYNTH = synthesis_ctes("SELECT * FROM customer", "c_custkey", CUSTOMER[:2], CUSTOMER[2:])
GAPS_SYNTH = synthesis_ctes(GAPS, "c_custkey", CUSTOMER[:2], ["c_mktsegment", "c_digit"])
PART_SYNTH = synthesis_ctes("SELECT * FROM part", "p_partkey", PART_NUMBERS, PART_WORDS)
LINE_SYNTH = synthesis_ctes(
    "SELECT * FROM lineitem", LINE_KEY, NUMBERS, ["l_linenumber", "l_tax", "l_returnflag", "l_linestatus"], "1000"
)
LINE_REPORT = report_ctes(R, A, LINEITEM_COLUMNS, NUMBERS, LINEITEM_CATEGORIES, ["l_linenumber", *NUMBERS, "l_tax"])
PART_SELECT = f"WITH {PART_SYNTH} {synthesized(PART, PART_NUMBERS, PART_WORDS, PART_TYPES)}"


def _histogram() -> str:
    spans = union(
        [f"SELECT '{c}' AS \"column\", min({c}) AS low, max({c}) AS high FROM (FROM o UNION ALL FROM a)" for c in NUMBERS]
    )
    tall = union(
        [f"SELECT '{c}' AS \"column\", {side == 'o'} AS orig, {c} AS v FROM {side}" for c in NUMBERS for side in "oa"]
    )
    return f"""WITH {side_ctes(R, A)}, spans AS (SELECT *, CASE WHEN high = low THEN 1 ELSE (high - low) / 15 END AS step
  FROM ({spans})),
bins AS (SELECT *, low + b * step AS bin_min,
  CASE WHEN b = 14 THEN high + 0.0001::DOUBLE ELSE low + (b + 1) * step END AS bin_max FROM spans, range(15) g(b)),
tall AS ({tall}),
shares AS (SELECT "column", b::INTEGER AS bin, bin_min, bin_max,
  (count(v) FILTER (orig AND v >= bin_min AND v < bin_max)) / (SELECT count(*) FROM o) AS orig_share,
  (count(v) FILTER (NOT orig AND v >= bin_min AND v < bin_max)) / (SELECT count(*) FROM a) AS aug_share,
  printf('%.1f', low) AS low_label, printf('%.1f', high) AS high_label
  FROM bins JOIN tall USING ("column") GROUP BY ALL),
peaks AS (SELECT *, greatest(max(greatest(orig_share, aug_share)) OVER (PARTITION BY "column"), 0.001) AS peak FROM shares)
SELECT "column", bin, {r6('bin_min')}, {r6('bin_max')}, {r6('orig_share')}, {r6('aug_share')}, low_label, high_label,
  {r6('orig_share / peak', 'peak_share_orig')}, {r6('aug_share / peak', 'peak_share_aug')} FROM peaks"""


def _clean() -> str:
    tokens = ["null", " NaN ", "N/A", "Continuous", "undefined", "none", ""]
    cases = " ".join(f"WHEN {at} THEN '{token}'" for at, token in enumerate(tokens))
    return f"""SELECT o_orderkey, CASE WHEN cell <> '' AND lower(trim(cell)) NOT IN
  ('null', 'continuous', 'nan', 'n/a', 'undefined') THEN cell END AS cell
FROM (SELECT o_orderkey, CASE o_orderkey % 11 {cases} ELSE o_orderpriority END AS cell FROM orders)"""


def _moments_select() -> str:
    names = ["mean_o", "std_o", "min_o", "max_o", "mean_a", "std_a", "min_a", "max_a", "diff", "ci_lower", "ci_upper"]
    return f'SELECT "column", count_o, count_a, {", ".join(r6(n) for n in names)} FROM described'


def _gaps_rows() -> str:
    z = ", ".join(f"coalesce(({c}::DOUBLE - {c}_mean) / {c}_std, 0.0::DOUBLE) AS z_{c}" for c in CUSTOMER[:2])
    return f"""WITH {synthesis_ctes(GAPS, 'c_custkey', CUSTOMER[:2], [])},
zs AS (SELECT row_idx, {z}, c_mktsegment FROM orig, facts)
SELECT row_idx, {r6('z_c_nationkey')}, {r6('z_c_acctbal')}, c_mktsegment FROM zs"""


SKEWED = "SELECT * REPLACE (CASE WHEN l_orderkey % 200 = 0 THEN l_extendedprice ELSE 0 END AS l_extendedprice) FROM"
CLASH = {"z": "p_brand", "cats": "p_type", "key": "p_size", "is_orig": "p_retailprice", "neighbours": "p_name"}
CLASH_SYNTH = synthesis_ctes(
    f"SELECT p_partkey AS part, {', '.join(f'{c} AS {n}' for n, c in CLASH.items())} FROM part",
    "part",
    ["key", "is_orig"],
    ["z", "cats", "neighbours"],
)
A_LACKING = "SELECT * REPLACE (NULL::VARCHAR AS l_returnflag, NULL::VARCHAR AS l_linestatus) FROM lineitem WHERE l_returnflag = 'A'"

TEST_SELECT = f'SELECT "column", {r6("statistic")}, {r6("p_value")}, is_similar FROM '

ORACLES: dict[str, str] = {
    "profile_lineitem": f"""WITH p AS ({profile_sql('SELECT * FROM lineitem', ['l_orderkey', 'l_partkey', 'l_suppkey',
      'l_linenumber', *NUMBERS, 'l_tax'], ['l_returnflag', 'l_linestatus', 'l_shipdate'])})
SELECT *, CASE WHEN is_heuristic_categorical THEN 'Discrete' WHEN type = 'numerical' THEN 'Continuous'
  ELSE 'Categorical' END AS badge FROM p""",
    "profile_customer_gaps": profile_sql(
        GAPS, ["c_custkey", "c_nationkey", "c_acctbal"], ["c_mktsegment", "c_digit"]
    ),
    "numeric_probe_documents": probe_sql("SELECT * FROM documents", "doc_id", ["text", "lang", "source", "n_chars"]),
    "numeric_probe_events": probe_sql(
        "SELECT *, CASE WHEN event_id < 60 THEN user_id::VARCHAR ELSE event_type END AS mixed FROM events",
        "event_id",
        ["user_id", "event_type", "value", "props", "mixed"],
    ),
    "clean_missing_tokens": _clean(),
    "clean_timestamps": """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN strftime(ts::TIMESTAMP, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(ts::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') || '.000Z' END AS stamp FROM events""",
    "csv_roundtrip": """SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_nationkey::DOUBLE AS c_nationkey, c_acctbal,
  c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx FROM customer""",
    "row_index_orders": """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_idx
FROM orders""",
    "row_index_gaps": f"""SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment NULLS FIRST, c_acctbal NULLS FIRST,
  c_digit NULLS FIRST, c_nationkey NULLS FIRST, c_custkey) - 1 AS row_idx FROM ({GAPS})""",
    "csv_roundtrip_text": """SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role,
  text || ' "quoted", and' || chr(10) || 'below ' || role AS text FROM conversations""",
    "synthesis_stats_lineitem": union(
        [f"SELECT '{c}' AS \"column\", {r6(f'avg({c})', 'mean')}, {r6(f'stddev_pop({c})', 'std')}, "
         f"{r6(f'min({c})', 'min')}, {r6(f'max({c})', 'max')}, bool_and({c} = floor({c})) AS is_integer FROM lineitem"
         for c in NUMBERS]
    ),
    "describe_two_sample": f"WITH {side_ctes(R, A)}, {moment_ctes(NUMBERS)} {_moments_select()}",
    "t_test_lineitem": f"WITH {side_ctes(R, A)}, {moment_ctes(NUMBERS)} {TEST_SELECT} t_test",
    "ecdf_lineitem": f"WITH {side_ctes(R, A)}, {rank_ctes(NUMBERS)} SELECT * FROM ecdf",
    "average_ranks_lineitem": f"""WITH {side_ctes(R, A)}, {rank_ctes(NUMBERS)}
SELECT "column", v AS value, max(rnk)::DOUBLE AS rank, count(*) AS ties FROM ranked GROUP BY 1, 2""",
    "mann_whitney_lineitem": f"WITH {side_ctes(R, A)}, {rank_ctes(NUMBERS)} {TEST_SELECT} mann_whitney",
    "ks_test_lineitem": f"WITH {side_ctes(R, A)}, {rank_ctes(NUMBERS)} {TEST_SELECT} ks_test",
    "ks_test_skewed": f"""WITH {side_ctes(f"{SKEWED} ({R})", f"{SKEWED} ({A})")}, {rank_ctes(NUMBERS)}
{TEST_SELECT} ks_test""",
    "category_freq": f"""WITH {side_ctes(Y95, Y96)}, {category_ctes(['o_orderstatus', 'o_orderpriority'])}
SELECT "column", category, c_orig, c_aug, n_orig, n_aug, {r6('p_orig')}, {r6('p_aug')} FROM shares""",
    "chi_square_cramers_v": f"""WITH {side_ctes(Y95, Y96)}, {category_ctes(['o_orderstatus', 'o_orderpriority'])}
SELECT "column", {r6('statistic')}, {r6('p_value')}, {r6('cramers_v')}, is_similar FROM chi""",
    "tvd_events": f"""WITH {side_ctes(E1, E2)}, {category_ctes(['event_type', 'user_id'])}
SELECT "column", {r6('value')}, is_similar FROM tvd""",
    "histogram_two_sample": _histogram(),
    "zscore_features": _gaps_rows(),
    "bootstrap_customers": f"""WITH {synthesis_ctes('SELECT * FROM customer', 'c_custkey', [], [])}
SELECT i, row_idx, c_custkey, c_acctbal FROM base""",
    "numeric_synthesis_customer": f"""WITH {synthesis_ctes(GAPS, 'c_custkey', CUSTOMER[:2], [])}
SELECT i, row_idx, {r6('c_nationkey_new', 'c_nationkey')}, {r6('c_acctbal_new', 'c_acctbal')} FROM made""",
    "numeric_synthesis_part": f"""WITH {synthesis_ctes('SELECT * FROM part', 'p_partkey', PART_NUMBERS, [])}
SELECT i, row_idx, {r6('p_size_new', 'p_size')}, {r6('p_retailprice_new', 'p_retailprice')} FROM made""",
    "knn_top5": f"WITH {PART_SYNTH} SELECT i, target, rank, row_idx, {r6('distance')}, class FROM nearest",
    "knn_votes": f"WITH {PART_SYNTH} SELECT i, target, class, votes, first_rank FROM votes",
    "knn_vote_choice": f"""WITH {PART_SYNTH}
SELECT i, {', '.join(f'{c}_new AS {c}' for c in PART_WORDS)} FROM picked""",
    "knn_weighted_choice": f"WITH {PART_SYNTH} SELECT i, target, class FROM chosen",
    "lone_category_copy": f"""WITH {synthesis_ctes('SELECT * FROM nation', 'n_nationkey', [], [])}
SELECT i, n_name FROM base""",
    "synthesize_supplier": f"""WITH {synthesis_ctes('SELECT * FROM supplier', 's_suppkey', ['s_nationkey', 's_acctbal'], [])}
SELECT i, s_nationkey_new::INTEGER AS s_nationkey, s_acctbal_new AS s_acctbal FROM made""",
    "synthesize_customer": f"WITH {CUSTOMER_SYNTH} {synthesized(CUSTOMER, CUSTOMER[:2], CUSTOMER[2:], CUSTOMER_TYPES)}",
    "synthesize_customer_gaps": f"""WITH {GAPS_SYNTH}
{synthesized([*CUSTOMER, 'c_digit'], CUSTOMER[:2], ['c_mktsegment', 'c_digit'], CUSTOMER_TYPES)}""",
    "synthesize_part": PART_SELECT,
    "synthesize_part_blocked": PART_SELECT,
    "synthesize_lineitem": f"WITH {LINE_SYNTH} {synthesized(LINE, NUMBERS, LINE[4:], LINE_TYPES)}",
    "synthesize_clashing_names": f"WITH {CLASH_SYNTH} "
    + synthesized(list(CLASH), ["key", "is_orig"], ["z", "cats", "neighbours"], {"key": "INTEGER", "is_orig": "DOUBLE"}, False),
    "stats_summary_missing_column": report_ctes(
        R, A_LACKING, LINEITEM_COLUMNS, NUMBERS, LINEITEM_CATEGORIES, ["l_linenumber", *NUMBERS, "l_tax"]
    )
    + f" {STATS_SELECT}",
    "stats_summary_lineitem": f"{LINE_REPORT} {STATS_SELECT}",
    "stats_summary_orders": report_ctes(
        Y95,
        Y96,
        ["o_totalprice", "o_orderstatus", "o_orderpriority"],
        ["o_totalprice"],
        ["o_orderstatus", "o_orderpriority"],
        ["o_totalprice"],
    )
    + f" {STATS_SELECT}",
    "stats_summary_csv": f"""{LINE_REPORT} SELECT variable AS "Variable", type AS "Type", unique_values AS "UniqueValues",
  heuristic AS "Heuristic", """
    + ", ".join(
        f"CASE WHEN type {'=' if numeric else '<>'} 'numerical' THEN coalesce({fixed(c, p)}, 'N/A') END AS \"{name}\""
        for c, p, name, numeric in (
            ("t_test_p", "5", "T-Test P", True),
            ("mann_whitney_p", "5", "Mann-Whitney P", True),
            ("ks_p", "5", "KS-Test P", True),
            ("mean_difference", "precision", "Mean Difference", True),
            ("ci_lower", "precision", "CI Lower", True),
            ("ci_upper", "precision", "CI Upper", True),
            ("chi_square_p", "5", "Chi-Square P", False),
            ("cramers_v", "4", "Cramers V", False),
            ("tvd", "5", "TVD", False),
        )
    )
    + ', is_similar AS "Is Similar" FROM stats',
    "test_results": f"""{LINE_REPORT} SELECT "column", test, {r6('statistic')}, {r6('p_value')}, {r6('effect')},
  is_similar, unique_count FROM tests JOIN prof USING ("column")""",
    "test_tables": f"""{LINE_REPORT} SELECT "column", test, badge, unique_count, {shown_p('p_value')} AS p_shown,
  printf('%.2f', statistic) AS statistic_shown, CASE WHEN is_similar THEN 'HIGH' ELSE 'LOW' END AS fidelity
FROM tests JOIN badges USING ("column") WHERE test IN ('t', 'mw', 'ks')""",
    "categorical_table": f"""{LINE_REPORT} SELECT "column", badge, unique_count,
  coalesce({shown_p('chi.p_value')}, 'N/A') AS chi_p_shown, {r6('coalesce(cramers_v, 0.0)', 'cramers_v')},
  CASE WHEN coalesce(cramers_v, 0.0) < 0.1 THEN 'negligible' WHEN cramers_v < 0.3 THEN 'moderate' ELSE 'large' END
    AS effect_band, {r6('value', 'tvd')},
  CASE WHEN coalesce(chi.is_similar, false) OR coalesce(cramers_v, 0.0) < 0.1 OR tvd.is_similar THEN 'HIGH' ELSE 'LOW'
    END AS fidelity
FROM tvd JOIN badges USING ("column") LEFT JOIN chi USING ("column")""",
    "descriptive_table": f"""{LINE_REPORT} SELECT "column", {fixed('mean_o', 'precision')} AS mean_orig,
  {fixed('mean_a', 'precision')} AS mean_aug, {fixed('ci_lower', 'precision')} AS ci_lower,
  {fixed('ci_upper', 'precision')} AS ci_upper FROM described JOIN prof USING ("column")""",
    "report_summary": f"{LINE_REPORT} {SUMMARY_SELECT}",
    "text_report": f"{LINE_REPORT} {TEXT_SELECT}",
    "synthesis_fidelity": report_ctes(
        "SELECT * FROM customer",
        f"WITH {CUSTOMER_SYNTH} {synthesized(CUSTOMER, CUSTOMER[:2], CUSTOMER[2:], CUSTOMER_TYPES, keep_row=False)}",
        CUSTOMER,
        CUSTOMER[:2],
        CUSTOMER[2:],
        CUSTOMER[:2],
    )
    + f" {STATS_SELECT}",
}
ORACLES["histograms_report"] = ORACLES["histogram_two_sample"]
ORACLES["text_sink"] = f"SELECT line FROM ({ORACLES['text_report']})"
ORACLES["summary_sink"] = f"""SELECT * REPLACE ("UniqueValues"::VARCHAR AS "UniqueValues")
FROM ({ORACLES['stats_summary_csv']})"""
