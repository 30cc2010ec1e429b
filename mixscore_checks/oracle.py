"""The registered queries restated in SQL for DuckDB.

The SQL shares only the fixed values with the engine. It looks keys up by
joining, never reduces rows to distinct texts, correlates with ``corr`` and
finds components in closed form (two and three features) or by power iteration
with deflation (fifteen features).
"""

from __future__ import annotations

from mixscore.operators.decide import CANDIDATES, FLOOR, SPREAD, THRESHOLD, TIE
from mixscore.plans.report import PASS_THROUGH
from mixscore.sources.dictionary import DISPLAY_LABELS, FEATURES, INITIAL_WEIGHTS, SOLVENTS
from mixscore_checks.queries import LINE_WEIGHTS
from mixscore_checks.views import LINE_FEATURES_4, LINE_TEXT, PART_KEY, QUANTITIES, SOLVENT_TEXTS

_P = len(FEATURES)
_REAL = 9  # components with a direction: ten reachable rows span nine dimensions
_STEPS = 300


def _r(expr: str, name: str | None = None) -> str:
    return f'round_even(({expr}) * 1e6, 0) / 1e6 + 0.0 AS "{name or expr}"'


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)


def _literal(value) -> str:
    if isinstance(value, str):
        return _text(value)
    return f"{value!r}::DOUBLE" if isinstance(value, float) else repr(value)


# --- measurements, labels, profiles -------------------------------------------

MEAS = (
    "meas AS (SELECT p_partkey AS row_id, p_name AS \"Name\", nullif(list_extract(["
    + ", ".join(_text(s) for s in SOLVENT_TEXTS)
    + "], CAST(p_partkey % 16 AS INTEGER) + 1), '') AS \"Solvent\", "
    + ", ".join(f'{text} AS "{name}"' for name, text in QUANTITIES.items())
    + " FROM part), keyed AS (SELECT *, coalesce(nullif(\"Solvent\", ''), 'Unknown') AS k FROM meas)"
)
DICT = (
    f"dict(ord, key, {', '.join(SOLVENTS.properties)}) AS (VALUES "
    + _values((i, k, *row) for i, (k, row) in enumerate(zip(SOLVENTS.keys, SOLVENTS.rows)))
    + ")"
)
LABELLED = (
    "labelled AS (SELECT row_id, coalesce(arg_min(key, ord), 'Other') AS label FROM keyed "
    "LEFT JOIN dict ON contains(lower(k), lower(key)) GROUP BY row_id)"
)
PROFILES = (
    "parts AS (SELECT row_id, unnest(range(len(string_split(k, '/')))) AS pos, unnest(string_split(k, '/')) AS part FROM keyed), "
    "hits AS (SELECT row_id, pos, min(ord) AS ord FROM parts JOIN dict ON contains(lower(part), lower(key)) GROUP BY row_id, pos), "
    "prof AS (SELECT row_id, " + ", ".join(f"avg({p}) AS {p}" for p in SOLVENTS.properties)
    + " FROM (SELECT keyed.row_id, coalesce(hits.ord, 0) AS ord FROM keyed LEFT JOIN hits ON keyed.row_id = hits.row_id) "
    "JOIN dict USING (ord) GROUP BY row_id)"
)


def _corr_matrix(features, source: str) -> str:
    cells = [
        ["CAST(1 AS DOUBLE)" if i == j else f"corr({a}, {b})" for j, b in enumerate(features)]
        for i, a in enumerate(features)
    ]
    rows = ", ".join("[" + ", ".join(r) + "]" for r in cells)
    return f"cm AS (SELECT count(*) AS n, [{rows}] AS m FROM {source})"


_START = "[" + ", ".join(_literal(1.0 / (i + 1)) for i in range(_P)) + "]"
_MV = "list_transform(m, lambda r: list_dot_product(r, v))"
# One step of the iteration; after the last step of a component the matrix is
# deflated and the next component starts.
POWER = f"""
power AS (
  SELECT 1 AS k, 0 AS t, m, {_START} AS v FROM cm
  UNION ALL
  SELECT CASE WHEN t < {_STEPS} THEN k ELSE k + 1 END,
         CASE WHEN t < {_STEPS} THEN t + 1 ELSE 0 END,
         CASE WHEN t < {_STEPS} THEN m ELSE
           list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - list_dot_product(mv, v) * v[i] * v[j])) END,
         CASE WHEN t < {_STEPS} THEN list_transform(mv, lambda x: x / sqrt(list_dot_product(mv, mv))) ELSE {_START} END
  FROM (SELECT *, {_MV} AS mv FROM power WHERE NOT (k = {_REAL} AND t = {_STEPS}))
),
raw AS (SELECT k AS component, list_dot_product({_MV}, v) AS lam, v,
          list_transform(v, lambda x: round(abs(x), 9)) AS a FROM power WHERE t = {_STEPS}),
eig AS (SELECT component, lam,
          CASE WHEN v[list_position(a, list_max(a))] < 0 THEN list_transform(v, lambda x: -x) ELSE v END AS v FROM raw),
variance AS (SELECT component, lam * n / (n - 1) AS eigenvalue, lam / {_P} AS ratio,
          sum(lam / {_P}) OVER (ORDER BY component) AS cumulative
        FROM (SELECT c.component, coalesce(lam, 0.0) AS lam FROM (SELECT unnest(range(1, {_P + 1})) AS component) c
              LEFT JOIN eig ON eig.component = c.component), (SELECT n FROM cm)),
loadings AS (SELECT component, ord, feature, v[ord + 1] AS loading FROM eig,
          (VALUES {_values(enumerate(FEATURES))}) f(ord, feature))
"""
ZSCORES = "zs AS (SELECT row_id, [" + ", ".join(
    f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER ()" for f in FEATURES
) + "] AS z FROM prof)"
SCORES = "scores AS (SELECT row_id, " + ", ".join(
    f"list_dot_product(z, (SELECT v FROM eig WHERE component = {j})) AS pc{j}" for j in (1, 2, 3)
) + " FROM zs)"

BASE = f"WITH RECURSIVE {MEAS}, {DICT}, {LABELLED}, {PROFILES}, {_corr_matrix(FEATURES, 'prof')}"
FIT = f"{BASE}, {POWER}"
ROWS = f"{FIT}, {ZSCORES}, {SCORES}"
WIDE = "wide AS (SELECT ord, feature, " + ", ".join(
    f"max(loading) FILTER (component = {j}) AS pc{j}" for j in range(1, 9)
) + " FROM loadings GROUP BY ord, feature)"
LABELS = f"labels_of(feature, label) AS (VALUES {_values(DISPLAY_LABELS.items())})"
WEIGHTS = f"w(ord, feature, weight) AS (VALUES {_values((i, f, INITIAL_WEIGHTS[f]) for i, f in enumerate(FEATURES))})"

# --- line items: closed forms -------------------------------------------------

LINE = """WITH c AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b,
  corr(l_extendedprice, l_discount) AS d FROM lineitem),
angle AS (SELECT *, sqrt((a * a + b * b + d * d) / 3) AS s FROM c),
turned AS (SELECT *, acos(least(1, greatest(-1, a * b * d / (s * s * s)))) / 3 AS phi FROM angle),
lams AS (SELECT *, 1 + 2 * s * cos(phi) AS l1, 1 + 2 * s * cos(phi + 2 * pi() / 3) AS l3 FROM turned),
lam3 AS (SELECT n, a, b, d, unnest([1, 2, 3]) AS component, unnest([l1, 3 - l1 - l3, l3]) AS lam FROM lams),
variance AS (SELECT component, lam * n / (n - 1) AS eigenvalue, lam / 3 AS ratio,
  sum(lam / 3) OVER (ORDER BY component) AS cumulative FROM lam3),
crossed AS (SELECT component, [a * d - b * (1 - lam), a * b - (1 - lam) * d, (1 - lam) * (1 - lam) - a * a] AS u FROM lam3),
unit AS (SELECT component, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) AS v FROM crossed),
sized AS (SELECT component, v, list_transform(v, lambda x: round(abs(x), 9)) AS m FROM unit),
eig AS (SELECT component, CASE WHEN v[list_position(m, list_max(m))] < 0 THEN list_transform(v, lambda x: -x) ELSE v END AS v FROM sized)"""

_LINE_KEYS = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey"
_GAPPY = (
    "WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, "
    "CASE WHEN l_linenumber <> 3 THEN l_discount END AS l_discount, "
    "CASE WHEN l_returnflag <> 'R' THEN l_tax END AS l_tax, 0.1 AS constant FROM lineitem)"
)


def _z(c: str) -> str:
    return f"(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ())"


def _ellipse(source: str, group: str, columns: str) -> str:
    """Ellipses from ``mom(group, n, cx, cy, a, b, c)``."""
    return (
        f"raw_mom AS (SELECT {group}, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS a, covar_samp(x, y) AS b, "
        f"var_samp(y) AS c FROM {source} GROUP BY {group} HAVING count(*) >= 3), "
        "mom AS (SELECT * REPLACE (CASE WHEN abs(b) <= 1e-12 * sqrt(a * c) THEN 0.0 ELSE b END AS b) FROM raw_mom), "
        "axes AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS hi, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS lo FROM mom), "
        "noisy AS (SELECT *, (1e-15 * greatest(abs(cx), abs(cy))) ** 2 AS centre FROM axes), "
        "flat AS (SELECT *, CASE WHEN hi <= centre THEN 0.0 ELSE hi END AS major, "
        "CASE WHEN lo <= 1e-12 * (a + c) + centre THEN 0.0 ELSE lo END AS minor FROM noisy), "
        "ellipse AS (SELECT *, 2 * 1.7 * sqrt(major) AS width, 2 * 1.7 * sqrt(minor) AS height, "
        "CASE WHEN major = 0 THEN 0.0 ELSE degrees(0.5 * atan2(2 * b, a - c)) END AS angle, minor = 0 AS degenerate FROM flat) "
        f"SELECT {columns} FROM ellipse"
    )


_ELLIPSE = ", ".join(["n"] + [_r(c) for c in ("cx", "cy", "major", "minor", "width", "height", "angle")] + ["degenerate"])
_DECISION = (
    "SELECT " + _r("100 * max(ratio) FILTER (component = 1)", "pc1_pct") + ", "
    + _r("100 * max(ratio) FILTER (component = 2)", "pc2_pct") + ", "
    + _r("100 * max(cumulative) FILTER (component = 2)", "pc12_pct")
    + f", max(cumulative) FILTER (component = 2) < {THRESHOLD} AS search_needed, "
    f"CAST(coalesce(min(component) FILTER (cumulative >= {THRESHOLD}), max(component)) AS BIGINT) AS n_to_threshold FROM variance"
)
_VARIANCE = f"SELECT CAST(component AS BIGINT) AS component, {_r('eigenvalue')}, {_r('ratio')}, {_r('cumulative')} FROM variance"


def _loading_rows(first: int, last: int) -> str:
    return (
        f"{FIT} SELECT feature, CAST(component AS BIGINT) AS component, {_r('loading')} FROM loadings "
        f"WHERE component BETWEEN {first} AND {last}"
    )




def _candidates(weights) -> str:
    """Every candidate's floored weights by the rule, and the id of the best of ``swept(id, cum2, objective)``."""
    place = SPREAD.format(id="id", j="ord")
    return (
        f"base(ord, weight) AS (VALUES {_values((i, float(w)) for i, w in enumerate(weights))}), "
        f"cands AS (SELECT id, ord, greatest(CASE WHEN id = ord + 1 THEN weight * 1.05 WHEN id <= {len(weights)} THEN weight "
        f"ELSE ({place}) / 1000003.0::DOUBLE * {_literal(5.0 - FLOOR)} + {_literal(FLOOR)} END, {_literal(FLOOR)}) AS weight "
        f"FROM (SELECT unnest(range({CANDIDATES})) AS id) c, base), "
        f"swept AS (SELECT id, cum2, abs(cum2 - {THRESHOLD}) AS objective FROM (SELECT DISTINCT id FROM cands) c, share), "
        f"best AS (SELECT min(id) AS id FROM swept WHERE objective <= (SELECT min(objective) FROM swept) + {TIE})"
    )


# Standardising cancels every weight, so each candidate's share is that of the fit.
_SHARE = "share AS (SELECT max(cumulative) FILTER (component = 2) AS cum2 FROM variance)"
_SWEEP = (
    f"SELECT CAST(cands.id AS BIGINT) AS cand_id, {_r('cum2')}, {_r('objective')}, CAST(ord AS BIGINT) AS ord, "
    f"{_r('weight')} FROM cands JOIN swept USING (id)"
)
# The weights in use: the best candidate's below the threshold, else the initial ones.
_USED = (
    f"used AS (SELECT ord, feature, CASE WHEN cum2 < {THRESHOLD} THEN cands.weight ELSE w.weight END AS weight "
    "FROM w JOIN cands USING (ord) JOIN best ON best.id = cands.id, share)"
)
_COLOURS = (
    "firsts AS (SELECT label, min(row_id) AS first_row FROM labelled GROUP BY label), "
    "ordinals AS (SELECT label, first_row, row_number() OVER (ORDER BY first_row) - 1 AS ordinal FROM firsts)"
)
_POINTS = "FROM scores JOIN labelled USING (row_id) JOIN ordinals USING (label)"
_SOLVENT_PCS = ", ".join(_r(f"pc{j}", f"Solvent_PC{j}") for j in (1, 2, 3))

ORACLE = {
    "q01_normalise_and_label": f"WITH {MEAS}, {DICT}, {LABELLED} SELECT row_id, k AS solvent_key, label FROM keyed JOIN labelled USING (row_id)",
    "q01b_label_counts": f"WITH {MEAS}, {DICT}, {LABELLED} SELECT label, count(*) AS n FROM labelled GROUP BY label",
    "q01c_label_texts": (
        f"WITH {DICT}, texts AS (SELECT 'part' AS source, p_partkey AS id, p_name AS t FROM part "
        "UNION ALL SELECT 'documents', doc_id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages) "
        "SELECT source, id, coalesce(arg_min(key, ord), 'Other') AS label FROM texts "
        "LEFT JOIN dict ON contains(lower(t), lower(key)) GROUP BY source, id"
    ),
    "q01d_long_dictionary": (
        f"WITH pkeys AS (SELECT p_partkey AS ord, {PART_KEY} AS key, lower({PART_KEY}) AS low, p_size AS size, p_retailprice AS price FROM part), "
        f"texts AS (SELECT l_orderkey, l_linenumber, l_partkey, {LINE_TEXT} AS t FROM lineitem JOIN part ON p_partkey = l_partkey), "
        "parts AS (SELECT t, unnest(range(len(string_split(t, '/')))) AS pos, lower(unnest(string_split(t, '/'))) AS part FROM (SELECT DISTINCT t FROM texts)), "
        "hits AS (SELECT t, pos, min(ord) AS ord FROM parts JOIN pkeys ON contains(part, low) GROUP BY t, pos), "
        "found AS (SELECT t, arg_min(key, ord) AS label, avg(size) AS size, avg(price) AS price FROM hits JOIN pkeys USING (ord) GROUP BY t), "
        "plain AS (SELECT arg_min(size, ord) AS size, arg_min(price, ord) AS price FROM pkeys) "
        f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, coalesce(label, 'Other') AS label, "
        f"{_r('coalesce(found.size, plain.size)', 'size')}, {_r('coalesce(found.price, plain.price)', 'price')} "
        "FROM texts LEFT JOIN found USING (t), plain"
    ),
    "q01e_longest_match": (
        f"WITH {MEAS}, {DICT}, found AS (SELECT row_id, unnest(regexp_extract_all(lower(k), "
        + _text("|".join(sorted((k.lower() for k in SOLVENTS.keys), key=len, reverse=True)))
        + ")) AS key FROM keyed) SELECT k.row_id, coalesce(arg_min(d.key, ord), 'Other') AS label FROM keyed k "
        "LEFT JOIN found f USING (row_id) LEFT JOIN dict d ON lower(d.key) = f.key GROUP BY k.row_id"
    ),
    "q02_mixture_profile": (
        f'WITH {MEAS}, {DICT}, {LABELLED}, {PROFILES} SELECT row_id, label AS "Solvent_Main", '
        + ", ".join(_r(p) for p in SOLVENTS.properties) + " FROM prof JOIN labelled USING (row_id)"
    ),
    "q03_impute_mean": (
        f"{_GAPPY} SELECT {_LINE_KEYS}, "
        + ", ".join(_r(f"coalesce({c}, avg({c}) OVER ())", c) for c in ("l_discount", "l_tax")) + " FROM g"
    ),
    "q04_standardise": (
        f"{_GAPPY}, f AS (SELECT * REPLACE (coalesce(l_discount, avg(l_discount) OVER ()) AS l_discount, "
        f"coalesce(l_tax, avg(l_tax) OVER ()) AS l_tax) FROM g) SELECT {_LINE_KEYS}, "
        + ", ".join(_r(_z(c), c) for c in LINE_FEATURES_4)
        + ", CAST(CASE WHEN min(constant) OVER () = max(constant) OVER () THEN 0 END AS DOUBLE) AS constant FROM f"
    ),
    "q05_correlation_long": " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_r('1.0::DOUBLE' if a == b else f'corr({a}, {b})', 'corr')} FROM lineitem"
        + (" HAVING count(*) > 0" if a == b else "")
        for i, a in enumerate(LINE_FEATURES_4)
        for b in LINE_FEATURES_4[i:]
    ),
    "q05b_correlation_profiles": (
        f"{BASE}, f(ord, feature) AS (VALUES {_values(enumerate(FEATURES))}) "
        f"SELECT a.feature AS feature_a, b.feature AS feature_b, {_r('m[a.ord + 1][b.ord + 1]', 'corr')} "
        "FROM cm, f a, f b WHERE a.ord <= b.ord"
    ),
    "q06_pca3_variance": f"{LINE} {_VARIANCE}",
    "q07_pca3_loadings": (
        f"{LINE} SELECT feature, CAST(component AS BIGINT) AS component, {_r('v[ord]', 'loading')} FROM eig, "
        "(VALUES (1, 'l_quantity'), (2, 'l_extendedprice'), (3, 'l_discount')) f(ord, feature)"
    ),
    "q07b_pca3_scores": (
        f"{LINE}, z AS (SELECT l_orderkey, l_linenumber, l_partkey, [{_z('l_quantity')}, {_z('l_extendedprice')}, {_z('l_discount')}] AS z FROM lineitem) "
        f"SELECT {_LINE_KEYS}, "
        + ", ".join(_r(f"list_dot_product(z, (SELECT v FROM eig WHERE component = {j}))", f"PC{j}") for j in (1, 2, 3))
        + " FROM z"
    ),
    "q07c_pca2_scores": (
        f"WITH z AS (SELECT l_orderkey, l_linenumber, l_partkey, {_z('l_quantity')} AS x, {_z('l_discount')} AS y FROM lineitem), "
        "s AS (SELECT CASE WHEN corr(l_quantity, l_discount) < 0 THEN -1 ELSE 1 END AS sgn FROM lineitem) "
        f"SELECT {_LINE_KEYS}, {_r('(x + sgn * y) / sqrt(2)', 'PC1')}, {_r('(x - sgn * y) / sqrt(2)', 'PC2')}, "
        'CAST(NULL AS DOUBLE) AS "PC3" FROM z, s'
    ),
    "q08_pca15_pc1": _loading_rows(1, 1),
    "q09_pca15_pc2_pc3": _loading_rows(2, 3),
    "q09b_pca15_pc4_pc9": _loading_rows(4, 9),
    "q10_scores": (
        f'{ROWS} SELECT row_id, "Name", "Solvent" AS "Solvent_Original", label AS "Solvent_Main", '
        + ", ".join(_r(f"pc{j}", f"PC{j}") for j in (1, 2, 3)) + ", "
        + ", ".join(_r(f'"{c}"', name) for c, name in PASS_THROUGH.items())
        + " FROM meas JOIN labelled USING (row_id) JOIN scores USING (row_id)"
    ),
    "q10b_enriched": (
        f'{ROWS} SELECT row_id, "Name", "Solvent", ' + ", ".join(_r(f'"{c}"', c) for c in PASS_THROUGH)
        + f', {_SOLVENT_PCS}, label AS "Solvent_Main" FROM meas JOIN labelled USING (row_id) JOIN scores USING (row_id)'
    ),
    "q10c_profile_scores": (
        f'{ROWS} SELECT row_id, {_SOLVENT_PCS}, label AS "Solvent_Main" FROM scores JOIN labelled USING (row_id)'
    ),
    "q11_variance_table": (
        f"{FIT} SELECT 'PC' || component AS \"Principal Component\", {_r('ratio', 'Explained Variance Ratio')}, "
        f"{_r('ratio * 100', 'Explained Variance (%)')}, {_r('cumulative', 'Cumulative Variance Ratio')}, "
        f"{_r('cumulative * 100', 'Cumulative Variance (%)')} FROM variance WHERE component <= 10"
    ),
    "q11b_variance": f"{FIT} {_VARIANCE}",
    "q12_n85_and_flags": f"{FIT} {_DECISION}",
    "q12b_n85_and_flags_lines": f"{LINE} {_DECISION}",
    "q12c_headline": (
        f"{FIT}, d AS (SELECT max(ratio) FILTER (component = 1) * 100 AS pc1, max(ratio) FILTER (component = 2) * 100 AS pc2, "
        "max(cumulative) FILTER (component = 2) * 100 AS pc12 FROM variance) SELECT "
        + ", ".join(_r(c, f"{c}_pct") + f", printf('%.2f', {c}) AS {c}_text" for c in ("pc1", "pc2", "pc12")) + " FROM d"
    ),
    "q12d_axis_labels": (
        f"{FIT} SELECT CAST(component AS BIGINT) AS component, 'PC' || component || ' (' || printf('%.1f', ratio * 100) || '%)' AS axis_label "
        "FROM variance WHERE component <= 3"
    ),
    "q13_weight_invariance": " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_r('1.0::DOUBLE' if a == b else f'corr({a}, {b})', 'corr')}, "
        f"abs(corr({a} * {INITIAL_WEIGHTS[a]}, {b} * {INITIAL_WEIGHTS[b]}) - corr({a}, {b})) < 1e-9 AS same FROM prof"
        for i, a in enumerate(FEATURES)
        for b in FEATURES[i:]
    ),
    "q14_weight_sweep": f"{FIT}, {_SHARE}, {_candidates(INITIAL_WEIGHTS.values())} {_SWEEP}",
    "q14b_weight_sweep_best": (
        f"{FIT}, {_SHARE}, {_candidates(INITIAL_WEIGHTS.values())} {_SWEEP} JOIN best ON best.id = cands.id"
    ),
    "q14c_weight_sweep_lines": (
        f"{LINE}, {_SHARE}, {_candidates(LINE_WEIGHTS.values())} {_SWEEP} JOIN best ON best.id = cands.id"
    ),
    "q15_loading_strength": (
        f"{FIT}, {WIDE}, s AS (SELECT *, sqrt(pc1 * pc1 + pc2 * pc2) AS strength FROM wide), "
        "q AS (SELECT quantile_cont(strength, 0.67) AS cut FROM s) "
        f", {LABELS} SELECT CAST(ord AS BIGINT) AS ord, feature, label, {_r('strength')}, strength >= cut AS is_strong, "
        f"{_r('pc1 * 0.92', 'tip_x')}, {_r('pc2 * 0.92', 'tip_y')}, {_r('pc1 * 1.03', 'label_x')}, {_r('pc2 * 1.03', 'label_y')} FROM s JOIN labels_of USING (feature), q"
    ),
    "q16_weight_table": (
        f"{FIT}, {_SHARE}, {_candidates(INITIAL_WEIGHTS.values())}, {WEIGHTS}, {LABELS}, {_USED} "
        f"SELECT label AS \"Property\", {_r('weight', 'Weight')} FROM used JOIN labels_of USING (feature)"
    ),
    "q16b_weight_bars": (
        f"{FIT}, {_SHARE}, {_candidates(INITIAL_WEIGHTS.values())}, {WEIGHTS}, {LABELS}, {_USED} "
        f"SELECT label, {_r('weight')}, weight < median(weight) OVER () AS below_median, "
        "printf('%.2f', weight) AS weight_text FROM used JOIN labels_of USING (feature)"
    ),
    "q17_group_ellipse": (
        f'{ROWS}, pts AS (SELECT label AS "Solvent_Main", pc1 AS x, pc2 AS y FROM scores JOIN labelled USING (row_id)), '
        + _ellipse("pts", '"Solvent_Main"', f'"Solvent_Main", {_ELLIPSE}')
    ),
    "q17b_group_ellipse_lines": (
        f"WITH pts AS (SELECT l_returnflag, {_z('l_quantity')} AS x, {_z('l_extendedprice')} AS y FROM lineitem), "
        + _ellipse("pts", "l_returnflag", f"l_returnflag, {_ELLIPSE}")
    ),
    "q17c_group_ellipse_orders": (
        f"WITH pts AS (SELECT l_orderkey, {_z('l_quantity')} AS x, {_z('l_discount')} AS y FROM lineitem), "
        + _ellipse("pts", "l_orderkey", f"l_orderkey, {_ELLIPSE}")
    ),
    "q17d_group_ellipse_raw": (
        "WITH pts AS (SELECT l_orderkey, l_quantity AS x, l_discount AS y FROM lineitem), "
        + _ellipse("pts", "l_orderkey", f"l_orderkey, {_ELLIPSE}")
    ),
    "q17e_group_ellipse_collinear": (
        "WITH pts AS (SELECT l_orderkey, l_extendedprice / 1000 AS x, 3 * (l_extendedprice / 1000) + 7 AS y FROM lineitem), "
        + _ellipse("pts", "l_orderkey", f"l_orderkey, {_ELLIPSE}")
    ),
    "q18_group_ordinal": (
        f'WITH {MEAS}, {DICT}, {LABELLED}, {_COLOURS} SELECT label AS "Solvent_Main", first_row, ordinal, ordinal % 12 AS colour FROM ordinals'
    ),
    "q18b_group_ordinal_orders": (
        "WITH f AS (SELECT l_orderkey, min(l_partkey * 1000000000 + l_orderkey * 10 + l_linenumber) AS first_row FROM lineitem GROUP BY 1) "
        "SELECT l_orderkey, first_row, row_number() OVER (ORDER BY first_row) - 1 AS ordinal, "
        "(row_number() OVER (ORDER BY first_row) - 1) % 12 AS colour FROM f"
    ),
    "q19_loadings_wide": (
        f'{FIT}, {WIDE}, {LABELS} SELECT label AS "Property", ' + ", ".join(_r(f"pc{j}", f"PC{j}") for j in range(1, 6))
        + " FROM wide JOIN labels_of USING (feature)"
    ),
    "q19b_loadings_heatmap": (
        f'{FIT}, {WIDE}, {LABELS} SELECT label AS "Property", '
        + ", ".join(_r(f"pc{j}", f"PC{j}") + f", printf('%.2f', pc{j}) AS \"PC{j}_text\"" for j in range(1, 9))
        + " FROM wide JOIN labels_of USING (feature)"
    ),
    "q20_biplot": (
        f"{ROWS}, {WIDE}, {LABELS}, ext AS (SELECT max(abs(pc1)) AS ex, max(abs(pc2)) AS ey FROM scores) "
        f"SELECT CAST(ord AS BIGINT) AS ord, feature, label, {_r('pc1 * ex * 0.55', 'tip_x')}, {_r('pc2 * ey * 0.55', 'tip_y')}, "
        f"{_r('pc1 * ex * 0.62', 'label_x')}, {_r('pc2 * ey * 0.62', 'label_y')} FROM wide JOIN labels_of USING (feature), ext"
    ),
    "q20b_biplot_points": f"{ROWS} SELECT row_id, {_r('pc1', 'PC1')}, {_r('pc2', 'PC2')} FROM scores",
    "q21_scree": (
        f"{FIT} SELECT CAST(component AS BIGINT) AS component, {_r('ratio')}, {_r('cumulative')}, component <= 2 AS is_top2, "
        f"CAST({THRESHOLD} AS DOUBLE) AS threshold FROM variance"
    ),
    "q21b_variance_percent": (
        f"{FIT} SELECT CAST(component AS BIGINT) AS component, {_r('ratio * 100', 'ratio_pct')}, {_r('cumulative * 100', 'cumulative_pct')}, "
        "printf('%.1f', ratio * 100) AS bar_label FROM variance WHERE component <= 10"
    ),
    "q22_cumulative": (
        f"{FIT}, n85 AS (SELECT coalesce(min(component) FILTER (cumulative >= {THRESHOLD}), max(component)) AS n FROM variance) "
        f"SELECT CAST(component AS BIGINT) AS component, {_r('cumulative * 100', 'cumulative_pct')}, CAST(85 AS DOUBLE) AS lower_guide, "
        "CAST(90 AS DOUBLE) AS upper_guide, component = n AS reaches_threshold FROM variance, n85"
    ),
    "q23_eigen": f"{FIT} SELECT CAST(component AS BIGINT) AS component, {_r('eigenvalue')}, eigenvalue >= 1 AS kaiser FROM variance",
    "q24_points3d": (
        f'{ROWS}, {_COLOURS} SELECT row_id, label AS "Solvent_Main", ordinal % 12 AS colour, '
        + ", ".join(_r(f"pc{j}", f"PC{j}") for j in (1, 2, 3)) + f" {_POINTS}"
    ),
    "q24b_points": (
        f'{ROWS}, {_COLOURS} SELECT row_id, label AS "Solvent_Main", ordinal % 12 AS colour, '
        + ", ".join(_r(f"pc{j}", f"PC{j}") for j in (1, 2)) + f" {_POINTS}"
    ),
    "q25_shape": (
        f"SELECT 'measurements' AS name, count(*) AS n_rows, CAST({3 + len(QUANTITIES)} AS BIGINT) AS n_columns FROM part "
        f"UNION ALL SELECT 'profiles', count(*), CAST({_P} AS BIGINT) FROM part"
    ),
    "q26_display_labels": (
        f"{BASE}, f(ord, feature) AS (VALUES {_values(enumerate(FEATURES))}), {LABELS} "
        "SELECT la.label AS label_a, CASE b.feature WHEN 'eps' THEN 'Dielectric constant' ELSE b.feature END AS label_b, "
        f"{_r('m[a.ord + 1][b.ord + 1]', 'corr')} "
        "FROM cm, f a JOIN labels_of la ON la.feature = a.feature, f b WHERE a.ord <= b.ord"
    ),
}
ORACLE["q13_weight_invariance"] = f"WITH {MEAS}, {DICT}, {PROFILES} " + ORACLE["q13_weight_invariance"]
ORACLE["q27_scanned_rows"] = (
    f'WITH {MEAS} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, "Name", "Solvent", '
    + ", ".join(_r(f'"{c}"', c) for c in QUANTITIES) + " FROM meas"
)
ORACLE["q27c_scanned_csv_rows"] = (
    f'WITH {MEAS} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, "Name", "Solvent", {_r('"Ex(nm)"', "Ex(nm)")} FROM meas'
)
ORACLE["q27b_scanned_csv"] = (
    f'WITH {MEAS}, g AS (SELECT "Solvent", count(*) AS n, sum("Ex(nm)") AS ex_nm, min(row_id) AS first_row FROM meas '
    f'WHERE "Solvent" IS NOT NULL GROUP BY "Solvent") SELECT "Solvent", n, {_r("ex_nm")}, '
    "row_number() OVER (ORDER BY first_row) - 1 AS ordinal FROM g"
)
for _written, _same in (
    ("q28_written_enriched", "q10b_enriched"),
    ("q28b_written_plot_data", "q10_scores"),
    ("q28c_written_variance", "q11_variance_table"),
    ("q28d_written_loadings", "q19_loadings_wide"),
    ("q28e_written_feature_weights", "q16_weight_table"),
):
    ORACLE[_written] = ORACLE[_same]
ORACLE["q29_dictionary_rows"] = (
    f"WITH {MEAS}, {DICT}, {LABELLED} SELECT label, count(*) AS n, CAST(ord AS BIGINT) AS ord, "
    + ", ".join(_r(p) for p in SOLVENTS.properties)
    + f" FROM labelled JOIN dict ON key = label GROUP BY label, ord, {', '.join(SOLVENTS.properties)}"
)
ORACLE["q29b_weighted_loadings"] = (
    f"{FIT}, {WEIGHTS}, {LABELS} SELECT label, {_r('weight')}, {_r('weight * loading', 'weighted')} "
    "FROM loadings JOIN w USING (feature) JOIN labels_of USING (feature) WHERE component = 1"
)
