"""SQL text shared by the oracle queries: the same inputs written independently in ANSI SQL."""

BARS = """bars AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS adj_close,
         sum(l_quantity) AS volume, min(l_extendedprice) AS low, max(l_extendedprice) AS high
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

RETURNS = BARS + """,
rets AS (SELECT * FROM (SELECT ticker, date,
    adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars)
  WHERE ret IS NOT NULL)"""

BENCH = """spy AS (SELECT * FROM (SELECT date, px / lag(px) OVER (ORDER BY date) - 1 AS spy FROM
  (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS px FROM lineitem GROUP BY 1))
  WHERE spy IS NOT NULL),
xbi AS (SELECT * FROM (SELECT date, px / lag(px) OVER (ORDER BY date) - 1 AS xbi FROM
  (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS px FROM lineitem
   WHERE l_returnflag = 'A' GROUP BY 1)) WHERE xbi IS NOT NULL)"""

ALIGNED_ONLY = """aligned AS (SELECT ticker, date, ret, spy, xbi,
    row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS idx,
    count(*) OVER (PARTITION BY ticker) AS len
  FROM rets JOIN spy USING (date) JOIN xbi USING (date))"""

ALIGNED = ",\n".join((RETURNS, BENCH, ALIGNED_ONLY))

EVTS = """evts AS (
  SELECT o_orderkey AS catalyst_id, 'Brand#' || CAST(c_nationkey + 1 AS VARCHAR) AS ticker,
    CAST(o_orderdate AS DATE) AS announcement_date,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS clinical_success,
    c_mktsegment AS drug_name, o_orderpriority AS indication,
    CASE o_orderkey % 4 WHEN 0 THEN 'BMO' WHEN 1 THEN 'AMC' WHEN 2 THEN 'DURING' ELSE 'UNKNOWN' END AS timing,
    o_custkey AS company_id, o_totalprice AS amount, c_acctbal AS acctbal
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

CUTS = EVTS + """,
cuts0 AS (SELECT *, CASE WHEN timing = 'AMC' THEN announcement_date ELSE announcement_date - 1 END
    AS trading_cutoff_date FROM evts),
cuts1 AS (SELECT *, CASE WHEN catalyst_id % 3 <> 0 THEN trading_cutoff_date - 1 END AS entry_cutoff_date
  FROM cuts0),
cuts AS (SELECT *, coalesce(entry_cutoff_date, trading_cutoff_date, announcement_date) AS cutoff,
    CASE WHEN catalyst_id % 11 <> 0 THEN coalesce(entry_cutoff_date, trading_cutoff_date, announcement_date)
      + CAST(catalyst_id % 7 - 3 AS INTEGER) END AS observed_at FROM cuts1)"""

LEDGER = EVTS + """,
ledger AS (SELECT catalyst_id, ticker, drug_name, indication, announcement_date,
    CAST(year(announcement_date) AS INTEGER) AS test_year, clinical_success, p_failure,
    CASE WHEN acctbal <= 0 THEN NULL WHEN acctbal >= 5000 THEN 0.15::DOUBLE
      WHEN acctbal >= 500 THEN 0.45::DOUBLE ELSE 0.85::DOUBLE END AS company_dependency,
    (1e0 - p_failure) * 0.10::DOUBLE + p_failure * (-0.15)::DOUBLE
      + ((catalyst_id * 7919) % 2001 - 1000) / 20000e0 AS expected_car,
    amount / 500000e0 - 0.5::DOUBLE AS realized_car
  FROM (SELECT *, (acctbal + 1000e0) / 11000e0 AS p_failure FROM evts))"""

FACTS = """facts AS (
  SELECT user_id AS cik, event_type AS tag, CAST(ts AS DATE) AS filed,
    CAST(ts AS DATE) - CAST(event_id % 6 AS INTEGER) AS "end", event_id AS pos, value AS val,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""

STUDIES = """studies AS (
  SELECT l_orderkey AS program_id, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
    l_discount AS effect_size, l_tax AS p_value, l_returnflag AS species, p_type AS disease_model,
    CASE WHEN l_linestatus = 'F' THEN 'verified' ELSE 'pending' END AS verification_status,
    CASE WHEN l_linenumber % 5 <> 0 THEN l_linenumber % 2 END AS randomized,
    CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber % 2 END AS blinded,
    CASE l_linenumber WHEN 7 THEN 1 WHEN 6 THEN 0 END AS survival_benefit,
    p_size AS face_validity, CAST(l_shipdate AS DATE) AS publication_date
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def r(expr: str, places: int = 6) -> str:
    """Rounded double without negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {places}) + 0e0)"


def _trial_rows() -> str:
    from eventide.plans.inputs import DESIGNS, PHRASES

    def q(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    d = ", ".join(f"({i}, {', '.join(q(v) for v in row)})" for i, row in enumerate(DESIGNS))
    p = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(PHRASES))
    return f"""designs(k, phase, allocation, masking, intervention) AS (VALUES {d}),
phrases(k, outcome_text) AS (VALUES {p}),
trials AS (SELECT o_orderkey AS catalyst_id, phase, allocation, masking, intervention, outcome_text,
    CASE WHEN o_orderkey % 10 <> 0 THEN CAST(floor(o_totalprice / 1000e0) AS INTEGER) END AS enrollment
  FROM orders JOIN designs d ON d.k = o_orderkey % 5 JOIN phrases p ON p.k = o_orderkey % 8)"""


TRIALS = _trial_rows()

# Word boundaries spelled out for an engine whose \b only knows ASCII letters.
_B, _E = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def words(text: str, *alts: str) -> str:
    """0/1 expression: any alternative occurs as whole words in lower(text)."""
    body = "|".join(alts)
    return f"CAST(regexp_matches(lower(coalesce({text}, '')), '{_B}({body}){_E}') AS INTEGER)"


def endpoint_sql(text: str) -> str:
    return f"""{words(text, 'overall survival', 'os')} AS endpoint_os,
  {words(text, 'progression.free survival', 'pfs', 'progression free')} AS endpoint_pfs,
  {words(text, 'objective response', 'orr', 'response rate', 'overall response')} AS endpoint_orr,
  {words(text, 'safety', 'tolerability', 'adverse event', 'mtb?d')} AS endpoint_safety"""


FEATURES = RETURNS + ",\n" + BENCH + """,
f0 AS (SELECT *, row_number() OVER w AS n, adj_close / lag(adj_close) OVER w - 1 AS ret,
    adj_close / lag(adj_close, 5) OVER w - 1 AS return_5d, adj_close / lag(adj_close, 20) OVER w - 1 AS return_20d,
    adj_close / lag(adj_close, 60) OVER w - 1 AS return_60d, adj_close / lag(adj_close, 120) OVER w - 1 AS return_120d,
    max(adj_close) OVER (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS hi,
    avg(volume) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rec,
    avg(volume) OVER (w ROWS BETWEEN 59 PRECEDING AND 5 PRECEDING) AS b60,
    avg(volume) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING) AS ball
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
feats AS (SELECT *, CASE WHEN n >= 21 THEN stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY date
      ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) END AS realized_vol_20d,
    CASE WHEN hi > 0 THEN adj_close / hi - 1 END AS distance_from_52w_high,
    CASE WHEN n >= 20 AND (CASE WHEN n >= 60 THEN b60 ELSE ball END) > 0
      THEN rec / (CASE WHEN n >= 60 THEN b60 ELSE ball END) END AS volume_ratio_20d FROM f0),
com AS (SELECT ticker, date, ret, xbi, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n
  FROM rets JOIN xbi USING (date)),
abn AS (SELECT ticker, date,
    CASE WHEN n >= 25 THEN product(1 + ret) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
      - product(1 + xbi) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS a20,
    CASE WHEN n >= 60 THEN product(1 + ret) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)
      - product(1 + xbi) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END AS a60
  FROM com WINDOW w AS (PARTITION BY ticker ORDER BY date)),
probe AS (SELECT DISTINCT ticker, cutoff FROM cuts),
mf AS (SELECT p.ticker, p.cutoff, f.date AS as_of_date, f.adj_close AS price_at_cutoff, f.ret AS return_1d,
    f.return_5d, f.return_20d, f.return_60d, f.return_120d, a.a20 AS abnormal_return_20d_xbi,
    a.a60 AS abnormal_return_60d_xbi, f.distance_from_52w_high, f.realized_vol_20d, f.volume_ratio_20d,
    f.return_60d AS pre_catalyst_runup_60d
  FROM probe p ASOF JOIN feats f ON f.ticker = p.ticker AND p.cutoff > f.date
  ASOF LEFT JOIN abn a ON a.ticker = p.ticker AND p.cutoff > a.date WHERE f.n >= 30)"""


def draw(seed: int, b: str, i: str) -> str:
    """The counter-based draw in SQL: four integer steps in a lateral chain."""
    p = 2147483647
    u0 = f"((CAST({i} AS BIGINT) * 48271 + CAST({b} AS BIGINT) * 69621 + {seed * 16807 + 12345}) % {p})"
    u1 = f"(({u0} * {u0} + {i} + 7) % {p})"
    u2 = f"(({u1} * {u1} + {b} * 7919 + 1) % {p})"
    return f"(({u2} * {u2} + {u0}) % {p})"


def student_p(t: str, df: str) -> str:
    """Two-sided p-value of a Student variable: with x = sqrt(df) tan(a) its tail is a ratio of integrals of cos(a)^(df - 1), here
    by the midpoint rule."""
    return (f"(SELECT (pi() / 2 - any_value(p.b)) * sum(pow(cos(p.b + (i + 0.5) * (pi() / 2 - p.b) / 200000), {df} - 1)) "
            f"/ (pi() / 2 * sum(pow(cos((i + 0.5) * (pi() / 2) / 200000), {df} - 1))) "
            f"FROM range(200000) g(i), (SELECT atan(abs({t}) / sqrt({df})) AS b) p)")


def r_wide(expr: str) -> str:
    """Six places, or whole units where the magnitude leaves no room for decimals."""
    return f"CASE WHEN abs({expr}) < 1e5 THEN {r(expr)} ELSE {r(expr, 0)} END"


POISSON_CDF = (
    0.367879441171442, 0.735758882342885, 0.919698602928606, 0.981011843123846,
    0.996340153172656, 0.999405815182418, 0.999916758850712, 0.999989750803325,
)


def fixed(v: str) -> str:
    """A value as a whole multiple of 2^-40, so that sums do not depend on the order of rows."""
    return f"CAST(floor(({v}) * 1099511627776e0) AS HUGEINT)"


def boot(src: str, value: str, order: str, n_boot: int = 500, seed: int = 42, name: str = "boot",
         group: str | None = None) -> str:
    """CTEs `<name>(group, b, mean)`: bootstrap means of `value` over rows of `src` with the integer key `order`."""
    g = group or "1"
    low = 1 << 30
    return f"""{name}_v AS (SELECT {g} AS g, {order} AS i, {fixed(value)} AS v FROM {src} WHERE {value} IS NOT NULL),
{name}_u AS (SELECT g, ((v % {low}) + {low}) % {low} AS lo, v, b, {draw(seed, 'b', 'i')} / 2147483647e0 AS u
    FROM {name}_v, (SELECT unnest(range({n_boot})) AS b)),
{name}_w AS (SELECT g, b, (v - lo) // {low} AS hi, lo, {' + '.join(f'CAST(u >= {c!r}::DOUBLE AS INTEGER)' for c in POISSON_CDF)} AS w FROM {name}_u),
{name} AS (SELECT g, b, (CAST(sum(hi * w) AS DOUBLE) * {low}e0 + CAST(sum(lo * w) AS DOUBLE)) / 1099511627776e0 / sum(w) AS mean
  FROM {name}_w GROUP BY 1, 2 HAVING sum(w) > 0)"""


SIGNALS = LEDGER + """,
pct AS (SELECT *, (rank() OVER (PARTITION BY test_year ORDER BY expected_car)
    + (count(*) OVER (PARTITION BY test_year, expected_car) - 1) / 2e0) / count(*) OVER (PARTITION BY test_year)
    AS expected_car_pct FROM ledger),
sig AS (SELECT *, expected_car AS expected_car_adj, CASE WHEN expected_car_pct >= 0.90::DOUBLE THEN 'STRONG LONG'
    WHEN expected_car_pct >= 0.75::DOUBLE THEN 'LONG' WHEN expected_car_pct <= 0.10::DOUBLE THEN 'STRONG SHORT'
    WHEN expected_car_pct <= 0.25::DOUBLE THEN 'SHORT' ELSE 'NO TRADE' END AS trade_signal FROM pct),
sided AS (SELECT *, CASE WHEN trade_signal IN ('LONG', 'STRONG LONG') THEN 1
    WHEN trade_signal IN ('SHORT', 'STRONG SHORT') THEN -1 ELSE 0 END AS side FROM sig),
traded AS (SELECT *, side * realized_car AS gross_return, side * realized_car - 2e0 * (25e0 / 10000e0) AS net_return
  FROM sided WHERE side <> 0)"""

_COST = "2e0 * (25e0 / 10000e0) - (300e0 / 10000e0) * (3e0 / 252e0)"

SHORT = LEDGER + f""",
short AS (SELECT *, -expected_car - {_COST} AS nesr, -realized_car - {_COST} AS rsr,
    p_failure AS p_major_drop, 0.35::DOUBLE + (test_year % 5) * 0.1::DOUBLE AS major_drop_threshold,
    CASE WHEN clinical_success = 0 THEN 1 ELSE 0 END AS clinical_failure,
    CASE WHEN realized_car <= (-0.20)::DOUBLE THEN 1 ELSE 0 END AS major_negative_event FROM ledger),
top20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_year ORDER BY nesr DESC, catalyst_id) AS rn,
    count(*) OVER (PARTITION BY test_year) AS cnt FROM short) WHERE rn <= greatest(1, ceil(cnt * 0.2::DOUBLE))),
top10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_year ORDER BY nesr DESC, catalyst_id) AS rn,
    count(*) OVER (PARTITION BY test_year) AS cnt FROM short) WHERE rn <= greatest(1, ceil(cnt * 0.1::DOUBLE)))"""
