"""ANSI SQL (DuckDB dialect) oracles for the registered queries.

These are an independent statement of each query's expected result over
the same parquet tables; the Spark plans never use them.
"""

from __future__ import annotations

from pricelens.sources.tables import (
    RAW_BAD_DATE_BUCKETS, RAW_BAD_PRICE_BUCKETS, RAW_OVERFLOW_COMMAS, RAW_SEED, RAW_WRAPPED_BUCKETS,
    TABLE_BIN_WIDTH, TABLE_DATE_VIEWPORT, TABLE_FILTERS, TABLE_LADDER, TABLE_PRICE_CLIP, TABLE_PRICE_VIEWPORT,
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LISTINGS = """listings AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS url,
         n_name AS voivodeship, o_orderdate AS scrap_time, p_name AS name,
         CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN NULL ELSE l_extendedprice END AS price,
         p_brand AS brand, l_returnflag AS condition, o_orderpriority AS offer_from, l_linestatus AS type,
         upper(p_type) || ' ' || p_name AS description, l_shipdate AS added_at,
         CAST(l_quantity AS DOUBLE) AS views, o_orderdate AS user_since
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
       JOIN nation ON n_nationkey = s_nationkey LEFT JOIN orders ON o_orderkey = l_orderkey)"""

CATEGORY = " AND ".join(f"{k} = {q(v)}" for k, v in TABLE_FILTERS.items())
CLIP = repr(float(TABLE_PRICE_CLIP))


def tag_case(text: str, ladder=TABLE_LADDER) -> str:
    whens = " ".join(f"WHEN contains({text}, {q(p)}) THEN {q(p)}" for p in ladder)
    return f"CASE {whens} ELSE NULL END"


# Filtered, clipped, lower-cased rows with day offset, prompts and tag.
PREPARED = f"""base AS (
  SELECT url, price, name, description, CAST(added_at AS DATE) AS date
  FROM listings WHERE price IS NOT NULL AND {CATEGORY}),
clipped AS (
  SELECT url, price, lower(name) AS name, lower(description) AS description, date
  FROM base WHERE price > {CLIP}),
prepared AS (
  SELECT *, CAST(date_diff('day', (SELECT min(date) FROM clipped), date) AS INTEGER) AS days_passed,
         {tag_case("name || ' ' || description")} AS phone_model
  FROM clipped),
prompts AS (
  SELECT *, CAST(days_passed AS VARCHAR) || ' days ' || name AS days_passed_name,
         CAST(days_passed AS VARCHAR) || ' days ' || name || ' ' || description AS days_passed_name_desc
  FROM prepared)"""

EXPLORE = f"""explore AS (
  SELECT price, CAST(added_at AS DATE) AS date,
         {tag_case("lower(name) || ' ' || lower(description)")} AS phone_model
  FROM listings WHERE price IS NOT NULL AND {CATEGORY} AND price > {CLIP})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


LISTING_COLS = ["url", "voivodeship", "scrap_time", "name", "price", "brand", "condition",
                "offer_from", "type", "description", "added_at", "views", "user_since"]
LISTING_TYPES = ["string", "string", "timestamp_ntz", "string", "double", "string", "string",
                 "string", "string", "string", "timestamp_ntz", "double", "timestamp_ntz"]

STAGE_ORDER = ["raw", "price_present", "category_match", "price_above_clip"]

ORACLE: dict[str, str] = {}

ORACLE["preprocess"] = with_(LISTINGS, PREPARED) + """
SELECT price, days_passed_name, days_passed_name_desc FROM prompts"""

ORACLE["low_price_audit"] = with_(LISTINGS) + f"""
SELECT name, price, description, CAST(added_at AS DATE) AS date
FROM listings WHERE price IS NOT NULL AND {CATEGORY} AND price < {CLIP}"""

ORACLE["explore_frame"] = with_(LISTINGS, EXPLORE) + "SELECT price, date, phone_model FROM explore"

ORACLE["date_viewport"] = with_(LISTINGS, EXPLORE) + f"""
SELECT price, date, phone_model FROM explore
WHERE date BETWEEN DATE {q(TABLE_DATE_VIEWPORT[0])} AND DATE {q(TABLE_DATE_VIEWPORT[1])}"""

ORACLE["one_model"] = with_(LISTINGS, EXPLORE) + f"""
SELECT price, date FROM explore WHERE phone_model = {q(TABLE_LADDER[0])}"""

ORACLE["phrase_count"] = with_(LISTINGS) + f""",
cd AS (SELECT lower(name) || ' ' || lower(description) AS t
       FROM listings WHERE price IS NOT NULL AND {CATEGORY} AND price > {CLIP})
SELECT p.phrase, CAST(count_if(contains(cd.t, p.phrase)) AS BIGINT) AS n
FROM cd, (VALUES {", ".join(f"({q(p)})" for p in TABLE_LADDER)}) AS p(phrase)
GROUP BY p.phrase"""

ORACLE["concat_description"] = with_(LISTINGS) + """
SELECT url, lower(name) || ' ' || lower(description) AS concatenated_description FROM listings"""

ORACLE["model_tag"] = with_(LISTINGS) + f"""
SELECT url, {tag_case("lower(name) || ' ' || lower(description)")} AS phone_model FROM listings"""

ORACLE["avg_text_length"] = with_(LISTINGS, PREPARED) + """
SELECT round(avg(length(days_passed_name)), 6) AS avg_len_days_passed_name,
       round(avg(length(days_passed_name_desc)), 6) AS avg_len_days_passed_name_desc
FROM prompts"""

ORACLE["preview"] = with_(LISTINGS) + "SELECT * FROM listings ORDER BY url LIMIT 10"

ORACLE["null_counts"] = with_(LISTINGS) + "\nUNION ALL\n".join(
    f"SELECT {q(c)} AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS nulls FROM listings"
    for c in LISTING_COLS)

ORACLE["value_counts"] = with_(LISTINGS) + """
SELECT condition AS value, count(*) AS n FROM listings
WHERE price IS NOT NULL AND condition IS NOT NULL GROUP BY condition"""

ORACLE["added_at_counts"] = with_(LISTINGS) + """
SELECT added_at AS value, count(*) AS n FROM listings WHERE added_at IS NOT NULL GROUP BY added_at"""


def _share(col: str) -> str:
    return with_(LISTINGS) + f""",
g AS (SELECT {col}, count(*) AS n FROM listings WHERE {col} IS NOT NULL GROUP BY {col})
SELECT {col}, n, round(100.0::DOUBLE * n / (SELECT sum(n) FROM g), 6) AS pct FROM g"""


ORACLE["category_share"] = _share("voivodeship")
ORACLE["condition_share"] = _share("condition")

ORACLE["mean_by_date_model"] = with_(LISTINGS, EXPLORE) + """
SELECT date, phone_model, round(avg(price), 6) AS mean_price FROM explore
WHERE date IS NOT NULL AND phone_model IS NOT NULL GROUP BY date, phone_model"""

ORACLE["stage_counts"] = with_(LISTINGS) + f""",
w AS (SELECT count(*) AS raw,
             count_if(price IS NOT NULL) AS price_present,
             count_if(price IS NOT NULL AND {CATEGORY}) AS category_match,
             count_if(price IS NOT NULL AND {CATEGORY} AND price > {CLIP}) AS price_above_clip
      FROM listings)
""" + "\nUNION ALL\n".join(
    f"SELECT {q(s)} AS stage, CAST({s} AS BIGINT) AS n_rows, {i} AS step FROM w" for i, s in enumerate(STAGE_ORDER))

ORACLE["column_profile"] = with_(LISTINGS) + "\nUNION ALL\n".join(
    f"SELECT {q(c)} AS column_name, count({c}) AS non_null, {q(t)} AS data_type FROM listings"
    for c, t in zip(LISTING_COLS, LISTING_TYPES))

ORACLE["model_keys"] = with_(LISTINGS, EXPLORE) + """
SELECT DISTINCT phone_model FROM explore WHERE phone_model IS NOT NULL"""

BIN = repr(float(TABLE_BIN_WIDTH))

TAGGED = """e AS (SELECT phone_model, date, price FROM explore WHERE phone_model IS NOT NULL AND price IS NOT NULL)"""


def _box(keys: list[str]) -> str:
    k = ", ".join(keys)
    nums = ["min", "max", "mean", "q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low", "whisker_high"]
    expr = {
        "min": "min(price)", "max": "max(price)", "mean": "avg(price)",
        "q1": "any_value(q1)", "median": "any_value(median)", "q3": "any_value(q3)",
        "lower_fence": "any_value(lower_fence)", "upper_fence": "any_value(upper_fence)",
        "whisker_low": "min(CASE WHEN price >= lower_fence THEN price END)",
        "whisker_high": "max(CASE WHEN price <= upper_fence THEN price END)",
    }
    sel = ", ".join(f"round({expr[c]}, 6) AS {c}" for c in nums)
    return with_(LISTINGS, EXPLORE, TAGGED) + f""",
qq AS (SELECT {k}, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
              quantile_cont(price, 0.75) AS q3 FROM e GROUP BY {k}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM qq)
SELECT {k}, count(*) AS n, {sel},
       CAST(count_if(price < lower_fence OR price > upper_fence) AS BIGINT) AS n_outliers
FROM e JOIN f USING ({k}) GROUP BY {k}"""


ORACLE["box_by_model"] = _box(["phone_model"])
ORACLE["box_by_date_model"] = _box(["phone_model", "date"])

ORACLE["price_histogram"] = with_(LISTINGS, EXPLORE, TAGGED) + f""",
s AS (SELECT phone_model, min(price) AS st, count(*) AS tot FROM e GROUP BY phone_model),
b AS (SELECT e.phone_model, CAST(floor((price - st) / CAST({BIN} AS DOUBLE)) AS INTEGER) AS bin_index, st, tot
      FROM e JOIN s USING (phone_model))
SELECT phone_model, bin_index, st + bin_index * CAST({BIN} AS DOUBLE) AS bin_start, count(*) AS n,
       count(*) / (tot * CAST({BIN} AS DOUBLE)) AS density
FROM b GROUP BY phone_model, bin_index, st, tot"""

ORACLE["price_kde"] = with_(LISTINGS, EXPLORE, TAGGED) + """,
s AS (SELECT phone_model, count(*) AS n, min(price) AS lo, max(price) AS hi, stddev_samp(price) AS sd
      FROM e GROUP BY phone_model HAVING count(*) >= 2 AND stddev_samp(price) > 0),
s2 AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS h FROM s),
g AS (SELECT phone_model, n, h, CAST(j AS INTEGER) AS grid_index,
             lo + (j * (hi - lo)) / CAST(500 AS DOUBLE) AS x
      FROM s2, range(0, 500) t(j))
SELECT g.phone_model, g.grid_index, round(g.x, 6) AS x,
       round(sum(exp(-0.5 * ((g.x - e.price) / g.h) * ((g.x - e.price) / g.h)))
             / (g.n * g.h * sqrt(2 * pi())), 14) AS density
FROM g JOIN e USING (phone_model) GROUP BY g.phone_model, g.grid_index, g.x, g.n, g.h"""

ORACLE["box_date_viewport"] = f"""SELECT * FROM ({ORACLE["box_by_date_model"]}) t
WHERE date BETWEEN DATE {q(TABLE_DATE_VIEWPORT[0])} AND DATE {q(TABLE_DATE_VIEWPORT[1])}"""
ORACLE["histogram_viewport"] = f"""SELECT * FROM ({ORACLE["price_histogram"]}) t
WHERE bin_start BETWEEN {TABLE_PRICE_VIEWPORT[0]!r} AND {TABLE_PRICE_VIEWPORT[1]!r}"""
ORACLE["kde_viewport"] = f"""SELECT * FROM ({ORACLE["price_kde"]}) t
WHERE x BETWEEN {TABLE_PRICE_VIEWPORT[0]!r} AND {TABLE_PRICE_VIEWPORT[1]!r}"""

# --- modelling: split, scaler, baseline predictions ---------------------------
from pricelens import schema as _S  # noqa: E402

SEED = _S.ORIGINAL_SEED
SPLIT_TRAIN, SPLIT_VAL = 6400, 8000


def split_case(key: str) -> str:
    bucket = f"CAST(('0x' || substr(md5('{SEED}|' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT % 10000 AS INTEGER)"
    return f"CASE WHEN {bucket} < {SPLIT_TRAIN} THEN 'train' WHEN {bucket} < {SPLIT_VAL} THEN 'val' ELSE 'test' END"


MODELLING = PREPARED + f""",
sp AS (SELECT *, {split_case("url")} AS split FROM prompts),
sc AS (SELECT avg(price) AS mean, stddev_pop(price) AS std, count(price) AS n FROM sp WHERE split = 'train'),
z AS (SELECT sp.*, (price - sc.mean) / sc.std AS price_z FROM sp, sc),
nm AS (SELECT name, avg(price_z) AS name_z FROM z WHERE split = 'train' GROUP BY name),
pr AS (SELECT z.*, coalesce(nm.name_z, 0.0) AS pred_z, coalesce(nm.name_z, 0.0) * sc.std + sc.mean AS prediction
       FROM z LEFT JOIN nm USING (name), sc)"""

ORACLE["split_counts"] = with_(LISTINGS, MODELLING) + "SELECT split, count(*) AS n FROM sp GROUP BY split"

ORACLE["scale_label"] = with_(LISTINGS, MODELLING) + "SELECT round(mean, 6) AS mean, round(std, 6) AS std, n FROM sc"

ORACLE["unscale_label"] = with_(LISTINGS, MODELLING) + """
SELECT url, split, round(price_z, 9) AS price_z, round(price_z * sc.std + sc.mean, 6) AS price_restored FROM z, sc"""

METRICS_SEL = """count(price) AS n,
       round(avg((prediction - price) * (prediction - price)), 2) AS mse,
       round(sqrt(avg((prediction - price) * (prediction - price))), 6) AS rmse,
       round(avg(abs(prediction - price)), 6) AS mae,
       round(CASE WHEN var_pop(price) * count(price) > 0
                  THEN 1 - sum((prediction - price) * (prediction - price)) / (var_pop(price) * count(price)) END, 9) AS r2"""

ORACLE["regression_metrics"] = with_(LISTINGS, MODELLING) + f"""
SELECT split, {METRICS_SEL} FROM pr GROUP BY split"""

ORACLE["metrics_long"] = with_(LISTINGS, MODELLING) + f""",
m AS (SELECT split, {METRICS_SEL} FROM pr GROUP BY split)
SELECT split, metric, value FROM m UNPIVOT (value FOR metric IN (mse, rmse, mae, r2))"""

ORACLE["smape"] = with_(LISTINGS, MODELLING) + """
SELECT count(price) AS n,
       round(avg(CASE WHEN abs(price) + abs(prediction) = 0 THEN 0.0
                      ELSE 200.0 * abs(prediction - price) / (abs(price) + abs(prediction)) END), 9) AS smape
FROM pr WHERE split = 'val'"""

ORACLE["test_rmse"] = with_(LISTINGS, MODELLING) + """
SELECT count(*) AS n, round(sqrt(avg((prediction - price) * (prediction - price))), 6) AS rmse
FROM pr WHERE split = 'test'"""

TREND = MODELLING + """,
tr AS (SELECT phone_model, coalesce(regr_slope(price, days_passed), 0.0) AS slope,
              coalesce(regr_intercept(price, days_passed), avg(price)) AS intercept
       FROM sp WHERE split = 'train' AND phone_model IS NOT NULL GROUP BY phone_model),
tags AS (SELECT DISTINCT phone_model FROM sp WHERE phone_model IS NOT NULL),
grid AS (SELECT phone_model, CAST(d AS INTEGER) AS day FROM tags, range(1, 90) t(d)),
fc AS (SELECT grid.phone_model, day, intercept + slope * day AS price FROM grid JOIN tr USING (phone_model))"""

ORACLE["forecast_grid"] = with_(LISTINGS, TREND) + """
SELECT phone_model, day, CAST(day AS VARCHAR) || ' days ' || phone_model AS prompt FROM grid"""

ORACLE["forecast_wide"] = with_(LISTINGS, TREND) + "SELECT day, " + ", ".join(
    f"round(max(CASE WHEN phone_model = {q(p)} THEN price END), 6) AS \"{p}\"" for p in TABLE_LADDER
) + " FROM fc GROUP BY day"

ORACLE["extrapolated_flag"] = with_(LISTINGS, TREND) + """
SELECT phone_model, day, round(price, 6) AS price,
       day > (SELECT max(days_passed) FROM sp WHERE split = 'train' AND phone_model IS NOT NULL) AS extrapolated
FROM fc"""


def _lowess_ctes(points: str, iterations: int = 3) -> list[str]:
    """CTEs up to ``fit<iterations>`` (phone_model, x, y, fit) over ``points`` (phone_model, x, y)."""
    parts = [f"""pts AS ({points}),
cnt AS (SELECT phone_model, greatest(1, (count(*) * 2) // 3) AS k FROM pts GROUP BY phone_model),
pairs AS (SELECT a.phone_model, a.x AS x0, b.x, b.y, abs(b.x - a.x) AS d
          FROM pts a JOIN pts b ON a.phone_model = b.phone_model),
hh AS (SELECT r.phone_model, r.x0, r.d AS h
       FROM (SELECT phone_model, x0, d, row_number() OVER (PARTITION BY phone_model, x0 ORDER BY d) AS rn FROM pairs) r
       JOIN cnt ON cnt.phone_model = r.phone_model AND r.rn = cnt.k),
tw AS (SELECT p.phone_model, p.x0, p.x, p.y,
              CASE WHEN p.d < hh.h THEN (1 - (p.d / hh.h) * (p.d / hh.h) * (p.d / hh.h))
                                      * (1 - (p.d / hh.h) * (p.d / hh.h) * (p.d / hh.h))
                                      * (1 - (p.d / hh.h) * (p.d / hh.h) * (p.d / hh.h)) ELSE 0.0 END AS tri
       FROM pairs p JOIN hh ON hh.phone_model = p.phone_model AND hh.x0 = p.x0),
rw0 AS (SELECT phone_model, x, 1.0::DOUBLE AS rw FROM pts)"""]
    for i in range(iterations + 1):
        parts.append(f"""w{i} AS (SELECT tw.phone_model, tw.x0, tw.x, tw.y, tw.tri * r.rw AS w
       FROM tw JOIN rw{i} r ON r.phone_model = tw.phone_model AND r.x = tw.x),
f{i} AS (SELECT phone_model, x0, sum(w) AS sw, count_if(w > 0) AS c,
               sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w{i} GROUP BY phone_model, x0),
g{i} AS (SELECT f.phone_model, f.x0, any_value(f.sw) AS sw, any_value(f.c) AS c, any_value(f.mx) AS mx,
               any_value(f.my) AS my, sum(t.w * (t.x - f.mx) * (t.x - f.mx)) AS sxx,
               sum(t.w * (t.x - f.mx) * (t.y - f.my)) AS sxy
        FROM w{i} t JOIN f{i} f ON f.phone_model = t.phone_model AND f.x0 = t.x0 GROUP BY f.phone_model, f.x0),
fit{i} AS (SELECT g.phone_model, g.x0 AS x, p.y,
                 CASE WHEN g.sw > 0 THEN (CASE WHEN g.c >= 2 THEN g.my + (g.sxy / g.sxx) * (g.x0 - g.mx) ELSE g.my END)
                      ELSE p.y END AS fit
          FROM g{i} g JOIN pts p ON p.phone_model = g.phone_model AND p.x = g.x0)""")
        if i < iterations:
            parts.append(f"""med{i} AS (SELECT phone_model, median(abs(y - fit)) AS m FROM fit{i} GROUP BY phone_model),
rw{i + 1} AS (SELECT f.phone_model, f.x,
                  CASE WHEN m.m = 0 THEN 1.0
                       WHEN abs((f.y - f.fit) / (6.0 * m.m)) < 1.0
                       THEN (1 - ((f.y - f.fit) / (6.0 * m.m)) * ((f.y - f.fit) / (6.0 * m.m)))
                          * (1 - ((f.y - f.fit) / (6.0 * m.m)) * ((f.y - f.fit) / (6.0 * m.m)))
                       ELSE 0.0 END AS rw
           FROM fit{i} f JOIN med{i} m ON m.phone_model = f.phone_model)""")
    return parts


ROUNDS = _S.ORIGINAL_LOWESS_ITERATIONS
LISTING_POINTS = "SELECT phone_model, days_passed AS x, avg(price) AS y FROM prepared WHERE phone_model IS NOT NULL GROUP BY phone_model, days_passed"
ORACLE["lowess_trend"] = with_(LISTINGS, PREPARED, *_lowess_ctes(LISTING_POINTS, ROUNDS)) + f"""
SELECT phone_model, x AS days_passed, round(y, 4) AS price, round(fit, 4) AS trend FROM fit{ROUNDS}"""


def _tokens(rows: str, key: str) -> str:
    """CTEs that encode and pad the texts of ``rows`` (key, split, t)."""
    return f"""tk AS (SELECT {key}, split, t, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS toks FROM ({rows}) r),
vc AS (SELECT token, count(*) AS freq FROM (SELECT unnest(toks) AS token FROM tk WHERE split = 'train') u GROUP BY token),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token) + 1 AS INTEGER) AS id FROM vc),
d AS (SELECT DISTINCT t, toks FROM tk WHERE t IS NOT NULL),
ex AS (SELECT t, pos, toks[pos] AS token
       FROM (SELECT t, toks, unnest(range(1, least(len(toks), {_S.ORIGINAL_MAX_LENGTH_TRAIN}) + 1)) AS pos FROM d) r),
ids AS (SELECT ex.t, list(coalesce(v.id, 1) ORDER BY ex.pos) AS input_ids
        FROM ex LEFT JOIN vocab v USING (token) GROUP BY ex.t),
enc AS (SELECT tk.{key}, tk.split, tk.toks, coalesce(ids.input_ids, []::INTEGER[]) AS input_ids
        FROM tk LEFT JOIN ids USING (t)),
ln AS (SELECT least({_S.ORIGINAL_MAX_LENGTH_TRAIN}, coalesce(max(len(input_ids)), 0)) AS L FROM enc)
SELECT {key}, split, list_resize(input_ids, L, 0) AS input_ids,
       list_resize(list_transform(input_ids, lambda x: 1), L, 0) AS attention_mask,
       CAST(len(toks) AS INTEGER) AS n_tokens
FROM enc, ln"""


ORACLE["tokens_padded"] = with_(LISTINGS, MODELLING, _tokens("SELECT url, split, days_passed_name_desc AS t FROM sp", "url"))
ORACLE["tokens_documents"] = with_(_tokens(f"SELECT doc_id, {split_case('doc_id')} AS split, text AS t FROM documents", "doc_id"))


# --- files ----------------------------------------------------------------------------
RAW = f"""rb AS (SELECT *, CAST(('0x' || substr(md5('{RAW_SEED}|' || url), 1, 8))::BIGINT % 100 AS INTEGER) AS b
       FROM listings)"""
WRAPPED_IN = ", ".join(str(b) for b in RAW_WRAPPED_BUCKETS)
ALL_COLS = ", ".join(LISTING_COLS)
BAD_IN = ", ".join(map(str, [*RAW_OVERFLOW_COMMAS, *RAW_BAD_PRICE_BUCKETS, *RAW_BAD_DATE_BUCKETS]))

ORACLE["repair_csv"] = with_(LISTINGS, RAW) + f"SELECT {ALL_COLS} FROM rb WHERE b NOT IN ({BAD_IN})"

LONG_CASES = " ".join(f"WHEN {k} THEN {13 + n}" for k, n in RAW_OVERFLOW_COMMAS.items())
ORACLE["scan_quarantine"] = with_(LISTINGS, RAW) + f"""
SELECT url, CAST(CASE b {LONG_CASES} ELSE 13 END AS INTEGER) AS n_fields,
       CASE WHEN b IN ({", ".join(map(str, RAW_BAD_PRICE_BUCKETS))}) THEN 'unreadable price'
            WHEN b IN ({", ".join(map(str, RAW_BAD_DATE_BUCKETS))}) THEN 'unreadable added_at' ELSE 'too many fields' END AS reason
FROM rb WHERE b IN ({BAD_IN})"""

# In byte order a quote sorts before digits: the first lines are wrapped records.
ORACLE["raw_preview"] = with_(LISTINGS, RAW) + f"""
SELECT CASE WHEN b IN ({WRAPPED_IN}) THEN '"' || url ELSE url END AS first_field,
       CAST(CASE WHEN b IN ({WRAPPED_IN}) THEN 1 ELSE (CASE b {LONG_CASES} ELSE 13 END) END AS INTEGER) AS n_fields
FROM rb ORDER BY 1 LIMIT 10"""

ORACLE["repair_audit"] = with_(LISTINGS, RAW) + f""",
w AS (SELECT count(*) AS raw, count_if(b IN ({WRAPPED_IN})) AS wrapped,
             count_if(b IN ({BAD_IN})) AS quarantined, count_if(b NOT IN ({BAD_IN})) AS accepted FROM rb)
""" + "\nUNION ALL\n".join(
    f"SELECT {q(s)} AS stage, CAST({s} AS BIGINT) AS n_rows, {i} AS step FROM w"
    for i, s in enumerate(["raw", "wrapped", "quarantined", "accepted"]))

ORACLE["roundtrip_listings"] = with_(LISTINGS) + f"SELECT {ALL_COLS} FROM listings"

ORACLE["stream_repair"] = ORACLE["repair_csv"]
ORACLE["stream_quarantine"] = ORACLE["scan_quarantine"]

ORACLE["price_viewport"] = with_(LISTINGS, EXPLORE) + f"""
SELECT price, date, phone_model FROM explore
WHERE price BETWEEN {TABLE_PRICE_VIEWPORT[0]!r} AND {TABLE_PRICE_VIEWPORT[1]!r}"""

ORACLE["month_pruned_viewport"] = with_(LISTINGS) + f"""
SELECT url, price, CAST(added_at AS DATE) AS date, strftime(added_at, '%Y-%m') AS month FROM listings
WHERE CAST(added_at AS DATE) BETWEEN DATE {q(TABLE_DATE_VIEWPORT[0])} AND DATE {q(TABLE_DATE_VIEWPORT[1])}"""


# --- text model: shrunken token means ---------------------------------------------
from pricelens.operators.tokenmean import STRENGTHS  # noqa: E402

WORDS = "list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
STRENGTH_ROWS = ", ".join(f"({e}, {float(k)!r}::DOUBLE)" for e, k in enumerate(STRENGTHS))


def _text_run(text: str) -> str:
    """CTEs of one run: token sums, every epoch's fit and its validation metrics in scaled units."""
    return MODELLING + f""",
dl AS (SELECT coalesce(regr_slope(price_z, days_passed), 0.0) AS day_slope, coalesce(regr_intercept(price_z, days_passed), avg(price_z), 0.0) AS day_base,
              coalesce(avg(days_passed), 0.0) AS mean_day FROM z WHERE split = 'train'),
rs AS (SELECT url, split, price, price_z, days_passed, price_z - (day_base + day_slope * days_passed) AS r, {WORDS.format(t=text)} AS toks FROM z, dl),
tt AS (SELECT token, count(*) AS n, sum(r) AS total FROM (SELECT unnest(toks) AS token, r FROM rs WHERE split = 'train') u GROUP BY token),
ks(epoch, k) AS (VALUES {STRENGTH_ROWS}),
sc0 AS (SELECT url, epoch, avg(coalesce(total / (n + k), 0.0)) AS s
        FROM (SELECT url, unnest(toks) AS token FROM rs) u LEFT JOIN tt USING (token) CROSS JOIN ks GROUP BY url, epoch),
sc1 AS (SELECT rs.url, split, price, r, days_passed, price_z, ks.epoch, coalesce(s, 0.0) AS s
        FROM rs CROSS JOIN ks LEFT JOIN sc0 ON sc0.url = rs.url AND sc0.epoch = ks.epoch),
ft AS (SELECT epoch, coalesce(regr_slope(r, s), 0.0) AS gain, coalesce(regr_intercept(r, s), avg(r), 0.0) AS off
       FROM sc1 WHERE split = 'train' GROUP BY epoch),
ev AS (SELECT sc1.epoch, avg((off + gain * s - r) * (off + gain * s - r)) AS mse, avg(abs(off + gain * s - r)) AS mae, var_pop(price_z) AS spread
       FROM sc1 JOIN ft USING (epoch) WHERE split = 'val' GROUP BY sc1.epoch),
hist AS (SELECT epoch, mse, sqrt(mse) AS rmse, mae, CASE WHEN spread > 0 THEN 1 - mse / spread END AS r2 FROM ev),
best AS (SELECT epoch FROM hist ORDER BY rmse, epoch LIMIT 1)"""


def _forecast(prompts: list[str], days: bool = True) -> str:
    """CTE ``fcst`` (prompt, day, price) of the run trained on names."""
    asked = ", ".join(f"({q(p)})" for p in prompts)
    grid = "SELECT p.prompt, CAST(d AS INTEGER) AS day, lower(CAST(d AS VARCHAR) || ' days ' || p.prompt) AS t FROM asked p, range(1, 90) r(d)" if days else \
        "SELECT p.prompt, NULL AS day, lower(p.prompt) AS t FROM asked p"
    return _text_run("days_passed_name") + f""",
asked(prompt) AS (VALUES {asked}),
gr AS ({grid}),
gs AS (SELECT prompt, day, avg(coalesce(total / (n + k), 0.0)) AS s
       FROM (SELECT prompt, day, unnest({WORDS.format(t="t")}) AS token FROM gr) u LEFT JOIN tt USING (token), ks JOIN best USING (epoch) GROUP BY prompt, day),
fcst AS (SELECT prompt, day, round((day_base + day_slope * coalesce(day, mean_day) + off + gain * s) * sc.std + sc.mean, 6) AS price
         FROM gs, dl, sc, ft JOIN best USING (epoch))"""


def _history(mode: str) -> str:
    conv = {"correct": ("mse * sc.std * sc.std", "rmse * sc.std", "mae * sc.std"),
            "affine": ("mse * sc.std + sc.mean", "rmse * sc.std + sc.mean", "mae * sc.std + sc.mean")}[mode]
    return f"SELECT epoch, round({conv[0]}, 2) AS mse, round({conv[1]}, 6) AS rmse, round({conv[2]}, 6) AS mae, round(r2, 9) AS r2 FROM hist, sc"


ORACLE["metric_history"] = with_(LISTINGS, _text_run("days_passed_name_desc")) + _history("correct")
ORACLE["metric_history_affine"] = with_(LISTINGS, _text_run("days_passed_name_desc")) + _history("affine")
ORACLE["best_epoch"] = with_(LISTINGS, _text_run("days_passed_name_desc")) + """
SELECT epoch, round(rmse * sc.std, 6) AS rmse FROM hist JOIN best USING (epoch), sc"""
ORACLE["text_regression_eval"] = with_(LISTINGS, _text_run("days_passed_name_desc")) + f""",
out AS (SELECT split, price, (day_base + day_slope * days_passed + off + gain * s) * sc.std + sc.mean AS prediction
        FROM sc1 JOIN best USING (epoch) JOIN ft USING (epoch), dl, sc)
SELECT split, {METRICS_SEL} FROM out GROUP BY split"""
ORACLE["text_forecast"] = with_(LISTINGS, _forecast(TABLE_LADDER)) + "SELECT prompt, day, price FROM fcst"
ORACLE["forecast_csv"] = ORACLE["text_forecast"]
ORACLE["text_forecast_no_days"] = with_(LISTINGS, _forecast(TABLE_LADDER, days=False)) + "SELECT prompt, price FROM fcst"
ORACLE["forecast_prompts"] = with_(LISTINGS, _forecast(_S.ORIGINAL_PROMPTS)) + f"""
SELECT prompt, day, price, day > {_S.ORIGINAL_LAST_DAY} AS extrapolated FROM fcst"""
ORACLE["forecast_lowess"] = with_(LISTINGS, _forecast(TABLE_LADDER), *_lowess_ctes("SELECT prompt AS phone_model, day AS x, price AS y FROM fcst", ROUNDS)) + f"""
SELECT phone_model AS prompt, x AS day, round(y, 4) AS price, round(fit, 4) AS trend, x > (SELECT max(days_passed) FROM sp) AS extrapolated FROM fit{ROUNDS}"""
ORACLE["metrics_csv"] = " UNION ALL ".join(
    f"SELECT {q(run)} AS run, epoch, mse AS MSE, mae AS MAE, rmse AS RMSE, r2 AS R2 FROM (" + with_(LISTINGS, _text_run(text)) + _history("correct") + ")"
    for run, text in (("days_name", "days_passed_name"), ("days_name_desc", "days_passed_name_desc")))


# --- training by epochs ---------------------------------------------------------------
from pricelens.operators.epochs import EPOCHS, RIDGE, STEP  # noqa: E402
from pricelens.plans.queries import EPOCHS_KEPT  # noqa: E402


def _epochs(text: str = "days_passed_name_desc") -> str:
    """Every epoch written out: weights ``w<e>``, text scores ``p<e>``; ``eh`` has the errors after each."""
    parts = [MODELLING, f"""tx AS (SELECT DISTINCT {text} AS t, {WORDS.format(t=text)} AS toks FROM z),
sh AS (SELECT t, token, count(*) / any_value(len(toks)) AS x FROM (SELECT t, toks, unnest(toks) AS token FROM tx) u GROUP BY t, token),
sm AS (SELECT {text} AS t, count(*) AS n, sum(price_z) AS y FROM z WHERE split = 'train' GROUP BY {text}),
bi AS (SELECT sum(y) / sum(n) AS bias FROM sm),
p0 AS (SELECT t, 0.0::DOUBLE AS score FROM tx)"""]
    for e in range(1, EPOCHS + 1):
        before = f" + coalesce((SELECT weight FROM w{e - 1} b WHERE b.token = g.token), 0.0)" if e > 1 else ""
        parts.append(f"""r{e} AS (SELECT t, n, y - n * (bias + coalesce(score, 0.0)) AS r FROM sm LEFT JOIN p{e - 1} USING (t), bi),
g{e} AS (SELECT token, {STEP!r} * sum(x * r) / (sum(x * n) + {RIDGE!r}) AS move FROM sh JOIN r{e} USING (t) GROUP BY token),
w{e} AS MATERIALIZED (SELECT token, move{before} AS weight FROM g{e} g),
p{e} AS MATERIALIZED (SELECT t, sum(x * weight) AS score FROM sh JOIN w{e} USING (token) GROUP BY t),
v{e} AS (SELECT {e - 1} AS epoch, avg(CASE WHEN split = 'train' THEN d * d END) AS loss, avg(CASE WHEN split = 'val' THEN d * d END) AS mse,
               avg(CASE WHEN split = 'val' THEN abs(d) END) AS mae, var_pop(CASE WHEN split = 'val' THEN price_z END) AS spread
        FROM (SELECT split, price_z, bias + coalesce(score, 0.0) - price_z AS d FROM z LEFT JOIN p{e} ON t = {text}, bi) u)""")
    parts.append("eh AS (" + " UNION ALL ".join(f"SELECT * FROM v{e}" for e in range(1, EPOCHS + 1)) + ")")
    parts.append("eb AS (SELECT epoch AS best FROM eh ORDER BY mse, epoch LIMIT 1)")
    return ",\n".join(parts)


ORACLE["epoch_history"] = with_(LISTINGS, _epochs()) + f"""
SELECT epoch, round(loss, 8) AS loss, round(mse, 8) AS mse, round(sqrt(mse), 8) AS rmse, round(mae, 8) AS mae, round(1 - mse / spread, 8) AS r2,
       epoch = best OR epoch >= (CASE WHEN best >= {EPOCHS - EPOCHS_KEPT} THEN {EPOCHS - EPOCHS_KEPT} ELSE {EPOCHS - EPOCHS_KEPT + 1} END) AS kept FROM eh, eb"""
ORACLE["best_checkpoint"] = with_(LISTINGS, _epochs()) + "\nUNION ALL\n".join(
    f"SELECT token, round(weight, 7) + 0.0::DOUBLE AS weight FROM w{e}, eb WHERE best = {e - 1}" for e in range(1, EPOCHS + 1))
ORACLE["epoch_model_eval"] = with_(LISTINGS, _epochs()) + """,
ps AS (""" + " UNION ALL ".join(f"SELECT t, score FROM p{e}, eb WHERE best = {e - 1}" for e in range(1, EPOCHS + 1)) + f"""),
out AS (SELECT split, price, (bias + coalesce(score, 0.0)) * sc.std + sc.mean AS prediction FROM z LEFT JOIN ps ON t = days_passed_name_desc, bi, sc)
SELECT split, {METRICS_SEL} FROM out GROUP BY split"""


# --- subword tokens --------------------------------------------------------------------
from pricelens.operators.subwords import MAX_WORD  # noqa: E402
from pricelens.plans.queries import subword_file  # noqa: E402


def _subwords(path: str, first: int | None) -> str:
    """CTEs: ``dw`` (doc_id, split, position, word), ``cw`` (word, ids)."""
    limit = "" if first is None else f"[1:{first}]"
    return f"""vc AS (SELECT TRY(decode(from_base64(coded))) AS piece, rank + 2 AS id
  FROM read_csv({q(path)}, delim = ' ', header = false, quote = '', escape = '', columns = {{'coded': 'VARCHAR', 'rank': 'INTEGER'}})),
vo AS (SELECT piece, id FROM vc WHERE piece IS NOT NULL),
td AS (SELECT row_number() OVER () AS row, doc_id, {split_case("doc_id")} AS split, {WORDS.format(t="text")}{limit} AS toks FROM documents),
dw AS (SELECT row, unnest(toks) AS word, unnest(range(len(toks))) AS place FROM td),
wd AS (SELECT word, ' ' || word AS s FROM (SELECT DISTINCT word FROM dw) u),
pl AS (SELECT word, s, unnest(range(1, len(s) + 1)) AS pos FROM wd WHERE len(word) <= {MAX_WORD}),
pn AS (SELECT word, pos, unnest(range(1, least(len(s) - pos + 1, (SELECT max(len(piece)) FROM vo)) + 1)) AS n, s FROM pl),
ma AS (SELECT word, pos, max(n) AS n, arg_max(id, n) AS id FROM pn JOIN vo ON vo.piece = substr(s, pos, n) GROUP BY word, pos),
wk AS (SELECT word, 1 AS pos, []::INTEGER[] AS ids FROM wd UNION ALL
       SELECT wk.word, CAST(wk.pos + ma.n AS INTEGER), list_append(ids, id) FROM wk JOIN ma ON ma.word = wk.word AND ma.pos = wk.pos),
cw AS (SELECT wd.word, coalesce(f.ids, [1]) AS ids FROM wd LEFT JOIN (SELECT word, ids FROM wk WHERE pos = len(word) + 2) f USING (word))"""


def _with_subwords() -> dict[str, str]:
    try:
        path = subword_file()
    except ModuleNotFoundError:  # the vocabulary is not there: its queries can't run either
        return {}
    length = _S.ORIGINAL_MAX_LENGTH_TRAIN
    return {
        "tokens_subword": f"""WITH RECURSIVE {_subwords(path, length)},
en AS (SELECT row, flatten(list(ids ORDER BY place))[1:{length}] AS ids FROM dw JOIN cw USING (word) GROUP BY row),
al AS (SELECT doc_id, split, toks, coalesce(ids, []::INTEGER[]) AS ids FROM td LEFT JOIN en USING (row)),
ln AS (SELECT least({length}, coalesce(max(len(ids)), 0)) AS L FROM al)
SELECT doc_id, split, CASE WHEN toks IS NOT NULL THEN list_resize(ids, L, 0) END AS input_ids,
       CASE WHEN toks IS NOT NULL THEN list_resize(list_transform(ids, lambda x: 1), L, 0) END AS attention_mask FROM al, ln""",
        "subword_unknown_rate": f"""WITH RECURSIVE {_subwords(path, None)}
SELECT count(*) AS n_words, CAST(sum(len(ids)) AS BIGINT) AS n_pieces, CAST(count_if(ids = [1]) AS BIGINT) AS n_unknown,
       round(count_if(ids = [1]) / count(*), 9) AS unknown_rate FROM dw JOIN cw USING (word)""",
    }


ORACLE |= _with_subwords()


# --- a long phrase ladder ---------------------------------------------------------------
from pricelens.plans.queries import LONG_LADDER, LONG_LADDER_LETTERS  # noqa: E402

ORACLE["long_ladder_tag"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, lower(text) AS t FROM documents),
w AS (SELECT word, count(*) AS n FROM (SELECT unnest({WORDS.format(t="t")}) AS word FROM d) u WHERE len(word) >= {LONG_LADDER_LETTERS} GROUP BY word),
top AS (SELECT word FROM w ORDER BY n DESC, word LIMIT {LONG_LADDER}),
ph AS (SELECT word, row_number() OVER (ORDER BY len(word) DESC, word) AS rank FROM top),
hit AS (SELECT row, arg_min(word, rank) AS phrase FROM d JOIN ph ON contains(t, word) GROUP BY row)
SELECT doc_id, phrase FROM d LEFT JOIN hit USING (row)"""


# --- exact split sizes, binned density, observed counts ------------------------------------
ORACLE["split_exact"] = with_(LISTINGS, PREPARED) + f""",
h AS (SELECT url, row_number() OVER (ORDER BY ('0x' || substr(md5('{SEED}|' || url), 1, 15))::BIGINT, url) AS pos FROM prepared),
s AS (SELECT count(*) AS n, CAST(ceil(round(count(*) * 0.2, 9)) AS BIGINT) AS test FROM h),
c AS (SELECT n - test AS rest, CAST(ceil(round((n - test) * 0.2, 9)) AS BIGINT) AS val FROM s)
SELECT url, CASE WHEN pos <= rest - val THEN 'train' WHEN pos <= rest THEN 'val' ELSE 'test' END AS split FROM h, c"""

ORACLE["landing_audit"] = ORACLE["repair_audit"]

from pricelens.operators.distribution import KDE_BINS_PER_POINT, KDE_REACH  # noqa: E402

_POINTS = _S.ORIGINAL_KDE_POINTS
_BINS = _POINTS * KDE_BINS_PER_POINT
ORACLE["price_kde_binned"] = with_(LISTINGS, EXPLORE, TAGGED) + f""",
s AS (SELECT phone_model, count(*) AS n, min(price) AS lo, max(price) AS hi, stddev_samp(price) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h
      FROM e GROUP BY phone_model HAVING count(*) >= 2 AND stddev_samp(price) > 0),
p AS (SELECT phone_model, (price - lo) / (hi - lo) * {float(_BINS)!r}::DOUBLE AS p FROM e JOIN s USING (phone_model)),
b AS (SELECT phone_model, p, least(floor(p), {_BINS - 1}) AS b FROM p),
ed AS (SELECT phone_model, b, sum(w) AS w FROM (SELECT phone_model, b, 1 - (p - b) AS w FROM b UNION ALL SELECT phone_model, b + 1, p - b FROM b) u GROUP BY phone_model, b),
g AS (SELECT s.*, CAST(j AS INTEGER) AS grid_index, lo + (j * (hi - lo)) / {float(_POINTS)!r}::DOUBLE AS x FROM s, range(0, {_POINTS}) t(j)),
k AS (SELECT g.phone_model, grid_index, x, n, h, sum(CASE WHEN abs(b / {float(KDE_BINS_PER_POINT)!r}::DOUBLE - grid_index) <= {float(KDE_REACH)!r}::DOUBLE * h / (hi - lo) * {float(_POINTS)!r}::DOUBLE
        THEN w * exp(-0.5 * ((x - (lo + b * (hi - lo) / {float(_BINS)!r}::DOUBLE)) / h) * ((x - (lo + b * (hi - lo) / {float(_BINS)!r}::DOUBLE)) / h)) ELSE 0.0 END) AS t
      FROM g JOIN ed USING (phone_model) GROUP BY g.phone_model, grid_index, x, n, h)
SELECT phone_model, grid_index, round(x, 6) AS x, round(t / (n * h * sqrt(2 * pi())), 14) AS density FROM k"""


from pricelens.operators.cells import ACCURACY, growth_of  # noqa: E402


def _cells(where: str) -> str:
    """Quartiles from counts per cell; the SQL counts the rows of the wanted days anew."""
    def picks(name, p):
        at = f"((tot - 1) * {p!r}::DOUBLE)"
        def one(rank, what):
            return f"max(CASE WHEN {rank} >= under AND {rank} < under + n THEN {what} END)"
        kinds = {"": "lo + ({r} - under) * step", "_low": "lo", "_high": "hi"}
        return ", ".join(
            f"round({one(f'floor({at})', w.format(r=f'floor({at})'))} + any_value({at} - floor({at})) * "
            f"({one(f'ceil({at})', w.format(r=f'ceil({at})'))} - {one(f'floor({at})', w.format(r=f'floor({at})'))}), 6) AS {name}{end}"
            for end, w in kinds.items())
    return with_(LISTINGS, EXPLORE, TAGGED) + f""",
c AS (SELECT phone_model, floor(ln(price) / ln({growth_of(ACCURACY)!r}::DOUBLE)) AS cell, count(*) AS n, sum(price) AS s, min(price) AS lo, max(price) AS hi
      FROM e WHERE {where} GROUP BY ALL),
r AS (SELECT *, CASE WHEN n > 1 THEN (hi - lo) / (n - 1) ELSE 0.0 END AS step, sum(n) OVER (PARTITION BY phone_model) AS tot,
             coalesce(sum(n) OVER (PARTITION BY phone_model ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM c)
SELECT phone_model, CAST(tot AS BIGINT) AS n, round(min(lo), 6) AS min, round(max(hi), 6) AS max, round(sum(s) / tot, 6) AS mean,
       {picks("q1", 0.25)}, {picks("median", 0.5)}, {picks("q3", 0.75)}
FROM r GROUP BY phone_model, tot"""


ORACLE["box_cells_by_model"] = _cells("price > 0")
ORACLE["box_cells_by_date_range"] = _cells(f"price > 0 AND date BETWEEN DATE {q(TABLE_DATE_VIEWPORT[0])} AND DATE {q(TABLE_DATE_VIEWPORT[1])}")

ALL_POINTS = "SELECT 'all' AS phone_model, days_passed AS x, avg(price) AS y FROM prepared GROUP BY days_passed"
ORACLE["lowess_overall"] = with_(LISTINGS, PREPARED, *_lowess_ctes(ALL_POINTS, ROUNDS)) + f"""
SELECT x AS days_passed, round(y, 6) AS price, round(fit, 4) AS trend FROM fit{ROUNDS}"""
