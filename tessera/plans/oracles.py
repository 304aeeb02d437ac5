"""The SQL that each panel query is checked against, written for DuckDB on the driver's tables."""

from __future__ import annotations

#: Common table expressions; a query takes those that it names and theirs.
CTE: dict[str, tuple[list[str], str]] = {
    "price": ([], """
        SELECT n_name AS ticker, CAST(l_shipdate AS DATE) AS date, any_value(r_name) AS sector,
               arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, arg_max(px, k) AS p, sum(q) AS v
        FROM (SELECT n_name, r_name, l_shipdate, l_extendedprice / l_quantity AS px, l_quantity AS q,
                     row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        GROUP BY ALL"""),
    "filing": ([], """
        SELECT n_name AS ticker, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 60 + 30 AS INTEGER) AS fiscal_period_end, CAST(o_orderdate AS DATE) AS acc,
               CASE WHEN o_orderstatus = 'F' THEN '10-K' ELSE '10-Q' END AS form_type, o_orderkey AS filing,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS revenue, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice * 0.1::DOUBLE - 500 END AS net_income,
               CASE WHEN o_orderkey % 11 <> 0 THEN c_acctbal END AS operating_cash_flow, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice * 3 END AS total_assets,
               o_totalprice * 1.25::DOUBLE AS total_liabilities, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice * 1.75::DOUBLE END AS stockholders_equity
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""),
    "xs": ([], """
        SELECT s_suppkey AS ticker, last_day(CAST(l_shipdate AS DATE)) AS date, any_value(r_name) AS sector, any_value(s_acctbal) AS size,
               CASE WHEN s_suppkey % 13 <> 0 THEN avg(l_extendedprice / l_quantity) END AS px, sum(l_quantity) AS qty, avg(l_discount) AS disc
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""),
    "step": (["price"], """
        SELECT *, ln(p / lag(p) OVER t) AS r, p - lag(p) OVER t AS delta, row_number() OVER t - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n
        FROM price WINDOW t AS (PARTITION BY ticker ORDER BY date)"""),
    "feat0": (["step"], """
        SELECT date, ticker, p, v, r, delta,
          ln(p / lag(p, 21) OVER t) AS ret_21d, ln(p / lag(p, 63) OVER t) AS ret_63d, ln(p / lag(p, 126) OVER t) AS ret_126d,
          ln(p / lag(p, 252) OVER t) - ln(p / lag(p, 21) OVER t) AS ret_252d,
          CASE WHEN count(r) OVER w20 = 20 THEN stddev_samp(r) OVER w20 END * sqrt(252) AS vol_20d,
          CASE WHEN count(r) OVER w60 = 60 THEN stddev_samp(r) OVER w60 END * sqrt(252) AS vol_60d,
          (p - max(p) OVER w126) / max(p) OVER w126 AS mdd_126d,
          CASE WHEN count(*) OVER w20 = 20 THEN avg(0.5 * ln(high / low) * ln(high / low) - (2 * ln(2) - 1) * ln(close / open) * ln(close / open)) OVER w20 END AS gk,
          CASE WHEN count(*) OVER w60 = 60 AND stddev_samp(v) OVER w60 >= 1e-12 THEN (v - avg(v) OVER w60) / stddev_samp(v) OVER w60 END AS volume_zscore,
          CASE WHEN count(r) OVER w60 = 60 THEN avg(abs(r) / (p * v)) OVER w60 END * 1e6 AS amihud,
          CASE WHEN count(*) OVER w50 = 50 AND count(r) OVER w20 = 20 AND stddev_samp(r) OVER w20 * p >= 1e-12 THEN (p - avg(p) OVER w50) / (stddev_samp(r) OVER w20 * p) END AS ma_gap_50d,
          CASE WHEN count(*) OVER w200 = 200 AND count(r) OVER w20 = 20 AND stddev_samp(r) OVER w20 * p >= 1e-12 THEN (p - avg(p) OVER w200) / (stddev_samp(r) OVER w20 * p) END AS ma_gap_200d,
          CASE WHEN count(delta) OVER w14 = 14 THEN avg(greatest(delta, 0)) OVER w14 END AS gain, CASE WHEN count(delta) OVER w14 = 14 THEN avg(greatest(-delta, 0)) OVER w14 END AS loss,
          CASE WHEN count(*) OVER w20 = 20 AND stddev_samp(p) OVER w20 >= 1e-13 THEN (p - (avg(p) OVER w20 - 2 * stddev_samp(p) OVER w20)) / (4 * stddev_samp(p) OVER w20) END AS bb_pctb,
          CASE WHEN delta IS NOT NULL THEN sum(sign(delta) * v) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) END AS obv
        FROM step WINDOW t AS (PARTITION BY ticker ORDER BY date),
          w14 AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), w50 AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING),
          w60 AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING), w126 AS (PARTITION BY ticker ORDER BY date ROWS 125 PRECEDING), w200 AS (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING)"""),
    "feat": (["feat0"], """
        SELECT *, CASE WHEN gk >= 0 THEN sqrt(gk) END * sqrt(252) AS gk_vol_20d, CASE WHEN loss >= 1e-12 THEN 100 - 100 / (1 + gain / loss) END AS rsi_14,
          CASE WHEN count(obv) OVER w60 = 60 AND stddev_samp(obv) OVER w60 >= 1e-12 THEN (obv - avg(obv) OVER w60) / stddev_samp(obv) OVER w60 END AS obv_zscore
        FROM feat0 WINDOW w60 AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)"""),
    "ewma": (["step"], """
        SELECT a.ticker, a.date, CASE WHEN count(b.r) >= 50 THEN sum(abs(b.r) * pow(1 - 2.0 / 51, a.i - b.i)) / sum(CASE WHEN b.r IS NOT NULL THEN pow(1 - 2.0 / 51, a.i - b.i) END) END AS ewma
        FROM step a JOIN step b ON a.ticker = b.ticker AND b.i <= a.i GROUP BY ALL"""),
    "ewma30": (["step"], """
        SELECT a.ticker, a.date, CASE WHEN count(b.r) >= 30 THEN sum(abs(b.r) * pow(1 - 2.0 / 31, a.i - b.i)) / sum(CASE WHEN b.r IS NOT NULL THEN pow(1 - 2.0 / 31, a.i - b.i) END) END AS vol
        FROM step a JOIN step b ON a.ticker = b.ticker AND b.i <= a.i WHERE a.date = last_day(a.date) OR dayofweek(a.date) = 5 GROUP BY ALL"""),
    "annual": (["filing"], "SELECT ticker, acc, arg_max(struct_pack(a := acc, r := revenue, n := net_income, o := operating_cash_flow), row(fiscal_period_end, form_type, filing)) AS s FROM filing WHERE form_type = '10-K' GROUP BY ALL"),
    "anyform": (["filing"], "SELECT ticker, acc, arg_max(struct_pack(a := total_assets, l := total_liabilities, e := stockholders_equity), row(fiscal_period_end, form_type, filing)) AS s FROM filing GROUP BY ALL"),
    "joined": (["price", "annual", "anyform"], """
        SELECT price.date, price.ticker, annual.s.a AS sec_acceptance_date, annual.s.r AS revenue, annual.s.n AS net_income, annual.s.o AS operating_cash_flow,
               anyform.s.a AS total_assets, anyform.s.l AS total_liabilities, anyform.s.e AS stockholders_equity
        FROM price ASOF LEFT JOIN annual ON price.ticker = annual.ticker AND price.date >= annual.acc ASOF LEFT JOIN anyform ON price.ticker = anyform.ticker AND price.date >= anyform.acc"""),
    "pit": (["joined"], """
        SELECT date, ticker, sec_acceptance_date, """ + ", ".join(f"last_value({c} IGNORE NULLS) OVER h AS {c}" for c in ("revenue", "net_income", "operating_cash_flow", "total_assets", "total_liabilities", "stockholders_equity")) + """
        FROM joined WINDOW h AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"""),
    "long": (["xs"], "SELECT date, ticker, 'px' AS feature, px AS x FROM xs UNION ALL SELECT date, ticker, 'qty', qty FROM xs UNION ALL SELECT date, ticker, 'disc', disc FROM xs"),
    "z": (["long"], """
        SELECT date, ticker, feature, CASE WHEN s IS NULL OR s < 1e-12 THEN 0.0 WHEN x IS NULL THEN NULL ELSE greatest(-3.0, least(3.0, (x - m) / s)) END AS z FROM (
          SELECT *, avg(c) OVER d AS m, stddev_pop(c) OVER d AS s FROM (
            SELECT *, CASE WHEN x IS NOT NULL THEN greatest(lo, least(hi, x)) END AS c FROM (
              SELECT *, min(CASE WHEN i = k + 1 THEN x END) OVER d AS lo, min(CASE WHEN i = n - k THEN x END) OVER d AS hi FROM (
                SELECT *, row_number() OVER (PARTITION BY date, feature ORDER BY x NULLS LAST, ticker) AS i, count(x) OVER d AS n, CAST(floor(count(x) OVER d * 0.01::DOUBLE) AS BIGINT) AS k
                FROM long WINDOW d AS (PARTITION BY date, feature)) WINDOW d AS (PARTITION BY date, feature)))
          WINDOW d AS (PARTITION BY date, feature))"""),
    "score": (["xs", "z"], "SELECT xs.date, xs.ticker, sector, size, disc, z.z AS score FROM xs JOIN z ON xs.date = z.date AND xs.ticker = z.ticker AND z.feature = 'px'"),
    "bet": ([], """
        SELECT event_id, user_id, ts, abs(value) / (SELECT max(abs(value)) FROM events) AS prob, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS direction, CAST(event_id % 3 = 0 AS INTEGER) AS label FROM events"""),
    "entry": (["step", "ewma30"], """
        SELECT step.ticker, step.date, step.i, p, vol, p * (1 + 2 * vol * sqrt(20)) AS hi, p * (1 - 2 * vol * sqrt(20)) AS lo
        FROM step JOIN ewma30 ON step.ticker = ewma30.ticker AND step.date = ewma30.date WHERE n >= 60 AND i >= 30 AND i + 20 < n AND vol > 0"""),
    "touch": (["entry"], """
        SELECT e.ticker, e.date, e.p, e.vol, e.hi, e.lo, min(CASE WHEN s.p >= e.hi OR s.p <= e.lo THEN s.i END) AS hit, max(s.i) AS final
        FROM entry e JOIN step s ON e.ticker = s.ticker AND s.i BETWEEN e.i + 1 AND e.i + 20 GROUP BY ALL"""),
    "lab0": (["touch"], """
        SELECT t.ticker, t.date AS entry_date, CAST(CASE WHEN hit IS NULL THEN sign(s.p - t.p) WHEN s.p >= t.hi THEN 1 ELSE -1 END AS INTEGER) AS label, s.date AS t_barrier, (s.p - t.p) / t.p AS return_at_touch,
               CASE WHEN hit IS NULL THEN 'vertical' WHEN s.p >= t.hi THEN 'upper' ELSE 'lower' END AS barrier_type, vol AS ewma_vol, hi AS upper_barrier, lo AS lower_barrier, t.p AS entry_price
        FROM touch t JOIN step s ON t.ticker = s.ticker AND s.i = coalesce(hit, final)"""),
    "lab": (["lab0"], "SELECT *, CAST(label = 1 AS INTEGER) AS label_binary FROM lab0 WHERE entry_date = last_day(entry_date)"),
    "grp": (["lab"], "SELECT ticker, entry_date, t_barrier, place, CAST(((place + 1) * 10 - 1) // n AS INTEGER) AS g FROM (SELECT *, row_number() OVER (ORDER BY entry_date, ticker) - 1 AS place, count(*) OVER () AS n FROM lab)"),
    "edge": (["grp"], "SELECT g, arg_min(entry_date, place) AS start, arg_max(entry_date, place) AS until FROM grp GROUP BY g"),
    "combo": (["edge"], "SELECT row_number() OVER (ORDER BY a.g, b.g) AS c, a.g AS g1, b.g AS g2, least(a.start, b.start) AS first, a.until AS u1, b.until AS u2 FROM edge a JOIN edge b ON a.g < b.g"),
    "role": (["combo"], """
        SELECT * FROM (SELECT c, ticker, entry_date, t_barrier, CASE WHEN g IN (g1, g2) THEN 'test'
          WHEN coalesce(t_barrier >= first, false) OR (entry_date > u1 AND entry_date <= u1 + 5) OR (entry_date > u2 AND entry_date <= u2 + 5) THEN NULL ELSE 'train' END AS role FROM grp CROSS JOIN combo) WHERE role IS NOT NULL"""),
    "fold": (["role"], """
        SELECT dense_rank() OVER (ORDER BY c) - 1 AS fold, ticker, entry_date, t_barrier, role FROM role WHERE c IN (SELECT c FROM role GROUP BY c HAVING count(*) FILTER (role = 'train') > 0 AND count(*) FILTER (role = 'test') > 0)"""),
    "named": (["xs"], "SELECT 'S.' || ticker AS name, ticker, min(date) AS a, arg_min(sector, date) AS sector FROM xs GROUP BY ticker"),
    "change": (["named"], "SELECT replace(name, '.', '-') AS ticker, last_day(last_day(a) + to_months(CAST(ticker % 24 + 6 AS INTEGER))) AS month, ticker % 2 = 0 AS removal FROM named WHERE last_day(a + to_months(CAST(ticker % 24 + 6 AS INTEGER))) <= (SELECT last_day(CAST(max(l_shipdate) AS DATE)) FROM lineitem)"),
    "month": (["xs"], "SELECT last_day(CAST(d AS DATE)) AS date FROM (SELECT unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS d FROM xs)"),
    "member": (["named", "change", "month"], """
        SELECT month.date, replace(name, '.', '-') AS ticker, CASE WHEN named.ticker % 2 = 1 THEN sector ELSE 'Unknown' END AS sector
        FROM month CROSS JOIN named LEFT JOIN change ON change.ticker = replace(name, '.', '-') AND change.month > month.date
        WHERE CASE WHEN change.month IS NOT NULL THEN change.removal ELSE named.ticker % 2 = 1 END"""),
    "eq": (["score"], """
        SELECT date, ticker, sector, score, (rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date) AS pct
        FROM (SELECT date, ticker, sector, round(score, 9) AS score FROM score WHERE score IS NOT NULL)"""),
    "hold0": (["feat", "price"], """
        SELECT f.date, f.ticker, (rank() OVER (PARTITION BY f.date ORDER BY s) + (count(*) OVER (PARTITION BY f.date, s) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY f.date) AS pct
        FROM (SELECT date, ticker, round(ret_21d, 9) AS s FROM feat WHERE ret_21d IS NOT NULL AND date = last_day(date)) f"""),
    "hold": (["hold0"], """
        SELECT date, ticker, CASE WHEN w > 0 THEN w / sum(w) OVER (PARTITION BY date) ELSE 0.0 END AS w FROM (
          SELECT date, ticker, CASE WHEN pct >= 0.8 THEN least(0.5::DOUBLE, 1.0::DOUBLE / count(*) FILTER (pct >= 0.8) OVER (PARTITION BY date)) ELSE 0.0 END AS w FROM hold0)"""),
    "ret": (["price"], "SELECT date, ticker, p / lag(p) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM price"),
    "cal": (["price"], "SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM price)"),
    "reb": (["hold", "cal"], "SELECT date, i, row_number() OVER (ORDER BY date) AS k, coalesce(lead(i) OVER (ORDER BY date), (SELECT max(i) + 1 FROM cal)) AS nxt FROM (SELECT DISTINCT date FROM hold) JOIN cal USING (date)"),
    "day": (["reb", "cal"], "SELECT cal.date, reb.k, reb.date AS reb, cal.i - reb.i - 1 AS d, CASE WHEN cal.i - reb.i - 1 < 5 AND k > 1 THEN (cal.i - reb.i) / 5.0::DOUBLE ELSE 1.0 END AS f FROM cal JOIN reb ON cal.i > reb.i AND cal.i < reb.nxt"),
    "kw": (["hold", "reb"], "SELECT k, ticker, w FROM hold JOIN reb USING (date)"),
    "gross": (["day", "kw", "ret"], """
        SELECT a.date, sum(w * f * coalesce(ret, 0)) AS gross FROM (SELECT date, k, f FROM day UNION ALL SELECT date, k - 1, 1 - f FROM day WHERE f < 1) a
        JOIN kw ON a.k = kw.k LEFT JOIN ret ON ret.date = a.date AND ret.ticker = kw.ticker GROUP BY a.date"""),
    "turn": (["kw", "reb"], "SELECT reb.date, sum(abs(n.w - coalesce(o.w, 0))) AS turnover FROM kw n JOIN reb ON n.k = reb.k LEFT JOIN kw o ON o.k = n.k - 1 AND o.ticker = n.ticker GROUP BY reb.date"),
    "paid": (["gross", "turn"], """
        SELECT date, sum(c) AS cost FROM (SELECT g.date, t.turnover * 7.5 / 10000 / count(*) OVER (PARTITION BY t.date) AS c FROM turn t JOIN gross g ON g.date >= t.date AND g.date < t.date + INTERVAL 1 MONTH) GROUP BY date"""),
    "level": (["price"], "SELECT date, sum(p * v) / sum(v) AS l FROM price GROUP BY date"),
    "mkt": (["level"], "SELECT * FROM (SELECT date, pow(l / lag(l) OVER (ORDER BY date), 0.02::DOUBLE) - 1 AS ret FROM level) WHERE ret IS NOT NULL"),
    "wealth": (["mkt"], "SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM mkt"),
    "dd": (["wealth"], "SELECT *, wealth / max(wealth) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM wealth"),
    "deal": (["hold", "price"], """
        SELECT r.date AS reb_date, min(price.date) AS entry_date, max(price.date) AS exit_date, r.ticker, r.w, arg_min(p, price.date) AS entry_price, arg_max(p, price.date) AS exit_price
        FROM hold r JOIN (SELECT date, coalesce(lead(date) OVER (ORDER BY date), (SELECT max(date) FROM price)) AS x FROM (SELECT DISTINCT date FROM hold)) n ON r.date = n.date
        JOIN price ON price.ticker = r.ticker AND price.date > r.date AND price.date <= n.x GROUP BY r.date, r.ticker, r.w"""),
    "trade": (["deal"], "SELECT *, (exit_price - entry_price) / entry_price AS ret FROM deal"),
    "held": (["trade"], "SELECT * FROM trade WHERE w > 1e-12"),
    "grid": ([], """
        SELECT CAST(row_number() OVER (ORDER BY a, lo, cap) - 1 AS INTEGER) AS config_id, method, lo AS least, cap
        FROM (VALUES (0, 'meta_prob'), (1, 'half_kelly'), (2, 'equal')) m(a, method) CROSS JOIN (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) l(lo) CROSS JOIN (VALUES (0.02::DOUBLE), (0.05::DOUBLE)) c(cap)"""),
    "swept": (["grid", "bet"], """
        SELECT config_id, method, least, cap, sum(gain) AS total, coalesce(CASE WHEN stddev_samp(gain) <> 0 THEN avg(gain) / stddev_samp(gain) END, 0.0) AS sharpe, count(*) AS days FROM (
          SELECT config_id, method, least, cap, CAST(ts AS DATE) AS date, sum(b * CASE WHEN label = 1 THEN 1.0 ELSE -0.5 END) AS gain FROM (
            SELECT *, CASE WHEN prob < least THEN 0.0 ELSE greatest(-cap, least(cap, CASE method WHEN 'meta_prob' THEN direction * prob WHEN 'half_kelly' THEN direction * 0.5::DOUBLE * greatest(2 * prob - 1, 0.0) ELSE direction * 1.0::DOUBLE END)) END AS b
            FROM bet CROSS JOIN grid) GROUP BY ALL) GROUP BY ALL"""),
}


def sql(body: str, *names: str) -> str:
    """``body`` behind the common table expressions that it needs."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in CTE[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return ("WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order) + "\n" if order else "") + body


def _r(*columns: str) -> str:
    """Rounded columns by their own names."""
    return ", ".join(f"round({c}, 6) + 0.0 AS {c.split('.')[-1]}" for c in columns)


def _bet(method: str) -> str:
    raw = {"meta_prob": "direction * prob", "half_kelly": "direction * 0.5::DOUBLE * greatest(2 * prob - 1, 0.0)", "equal": "direction * 1.0::DOUBLE"}[method]
    return sql(f"SELECT event_id, round(CASE WHEN prob < 0.3 THEN 0.0 ELSE greatest(-0.05::DOUBLE, least(0.05::DOUBLE, {raw})) END, 6) + 0.0 AS bet FROM bet", "bet")


_REPORTED = ["ret_21d", "vol_20d", "ma_gap_50d", "rsi_14", "bb_pctb"]
_METRICS = ["revenue", "net_income", "operating_cash_flow", "total_assets", "total_liabilities", "stockholders_equity"]
_RATIOS = {
    "earnings_yield": ("net_income", "total_assets"), "book_to_assets": ("stockholders_equity", "total_assets"), "roe": ("net_income", "stockholders_equity"), "roa": ("net_income", "total_assets"), "debt_equity": ("total_liabilities", "stockholders_equity"),
    "net_margin": ("net_income", "revenue"), "ocf_to_assets": ("operating_cash_flow", "total_assets"), "ocf_to_debt": ("operating_cash_flow", "total_liabilities"), "leverage": ("total_assets", "stockholders_equity"),
}
_PERFORMANCE = """
    round(exp(l) - 1, 6) + 0.0 AS total_return, round(a, 6) + 0.0 AS annualized_return, round(vol, 6) + 0.0 AS annualized_volatility, round(CASE WHEN vol > 1e-12 THEN a / vol ELSE 0.0 END, 6) + 0.0 AS sharpe_ratio,
    round(CASE WHEN down > 1e-12 THEN a / down ELSE 0.0 END, 6) + 0.0 AS sortino_ratio, round(mdd, 6) + 0.0 AS max_drawdown, round(CASE WHEN abs(mdd) > 1e-12 THEN a / abs(mdd) ELSE 0.0 END, 6) + 0.0 AS calmar_ratio,
    round(hit, 6) + 0.0 AS daily_hit_rate, round(pos, 6) + 0.0 AS monthly_positive_pct, n AS n_days"""


def _performance(source: str, key: str) -> str:
    """Figures of the returns in ``source`` (key, date, ret)."""
    return f"""SELECT * EXCLUDE (l, a, vol, down, mdd, hit, n, pos), {_PERFORMANCE} FROM (
      SELECT {key}, sum(ln(1 + ret)) AS l, exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 AS a, stddev_samp(ret) * sqrt(252) AS vol, stddev_samp(ret) FILTER (ret < 0) * sqrt(252) AS down, min(w / top - 1) AS mdd, avg(CAST(ret > 0 AS DOUBLE)) AS hit, count(*) AS n
      FROM (SELECT *, max(w) OVER (PARTITION BY {key} ORDER BY date ROWS UNBOUNDED PRECEDING) AS top FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY {key} ORDER BY date ROWS UNBOUNDED PRECEDING)) AS w FROM {source})) GROUP BY {key}) JOIN (
      SELECT {key}, CAST(count(*) FILTER (s > 0) AS DOUBLE) / (max(m) - min(m) + 1) AS pos FROM (SELECT {key}, year(date) * 12 + month(date) AS m, sum(ret) AS s FROM {source} GROUP BY ALL) GROUP BY {key}) USING ({key})"""


def _side(long: str, short: str | None, name: float, sector: float) -> str:
    """Weights of ``eq``: legs, scaled, cut, scaled by sector and scaled again."""
    legs = f"CASE WHEN {'pct <= 0.1 THEN ' + short + ' WHEN ' if short else ''}pct >= 0.9 THEN {long} ELSE 0.0 END"
    scale = "CASE WHEN w > 0 THEN w / sum(w) FILTER (w > 0) OVER (PARTITION BY date) " + ("WHEN w < 0 THEN -w / sum(w) FILTER (w < 0) OVER (PARTITION BY date) " if short else "") + "ELSE w END"
    over = f"CASE WHEN ({'w <> 0' if short else 'w > 0'}) AND sum(abs(w)) OVER (PARTITION BY date, sign(w), sector) > {sector}::DOUBLE THEN w * {sector}::DOUBLE / sum(abs(w)) OVER (PARTITION BY date, sign(w), sector) ELSE w END"
    return f"""SELECT date, ticker, {scale} AS weight FROM (SELECT date, ticker, {over} AS w FROM (SELECT date, ticker, sector, greatest(-{name}::DOUBLE, least({name}::DOUBLE, w)) AS w FROM (
      SELECT date, ticker, sector, {scale} AS w FROM (SELECT *, {legs} AS w FROM eq))))"""


_EQUAL, _SHORT = "1.0::DOUBLE / count(*) FILTER (pct >= 0.9) OVER (PARTITION BY date)", "-1.0::DOUBLE / count(*) FILTER (pct <= 0.1) OVER (PARTITION BY date)"
# 0 / 0 counts as 0: DuckDB would give NaN, which is above any number there
_CONVICTION = "coalesce(score / nullif(sum(abs(score)) FILTER (pct >= 0.9) OVER (PARTITION BY date), 0), 0.0)"

ORACLES: dict[str, str] = {
    "scan_filter_project": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) + 0.0 AS net FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' AND l_discount >= 0.05",
    "blacklist_anti": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey >= 2",
    "dim_lookup_default": sql("SELECT s_suppkey AS ticker, coalesce(arg_min(sector, date), 'Unknown') AS sector FROM supplier LEFT JOIN (SELECT * FROM xs WHERE ticker % 7 <> 0) x ON s_suppkey = ticker GROUP BY s_suppkey", "xs"),
    "ewma_abs_return": sql(f"SELECT date, ticker, {_r('ewma')} FROM ewma", "ewma"),
    "asof_backward": sql(
        f"""SELECT p.date, p.ticker, b.s.d AS sec_acceptance_date, b.s.f AS form_type, round(b.s.r, 6) + 0.0 AS revenue, round(b.s.a, 6) + 0.0 AS total_assets FROM price p ASOF LEFT JOIN
        (SELECT ticker, acc, arg_max(struct_pack(d := acc, f := form_type, r := revenue, a := total_assets), row(fiscal_period_end, form_type, filing)) AS s FROM filing GROUP BY ALL) b ON p.ticker = b.ticker AND p.date >= b.acc""", "price", "filing"),
    "pit_two_leg_join": sql(f"SELECT date, ticker, sec_acceptance_date, {_r(*_METRICS)} FROM pit", "pit"),
    "pit_compliance": sql("""SELECT ticker, count(*) AS n, round(avg(date - sec_acceptance_date), 6) + 0.0 AS mean_lag, round(CAST(median(date - sec_acceptance_date) AS DOUBLE), 6) + 0.0 AS median_lag, CAST(min(date - sec_acceptance_date) AS INTEGER) AS min_lag,
        count(*) FILTER (date < sec_acceptance_date) AS violations FROM pit WHERE sec_acceptance_date IS NOT NULL GROUP BY ticker""", "pit"),
    "ffill_metrics": sql("""SELECT ticker, date, round(revenue, 6) + 0.0 AS revenue, round(last_value(revenue IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS filled
        FROM (SELECT ticker, acc AS date, arg_max(struct_pack(r := revenue), filing).r AS revenue FROM filing GROUP BY ALL)""", "filing"),
    "fundamental_ratios": sql("SELECT date, ticker, " + ", ".join(f"round({a} / nullif({b}, 0), 6) + 0.0 AS {n}" for n, (a, b) in _RATIOS.items()) + " FROM pit", "pit"),
    "growth_pct_change": sql("SELECT date, ticker, " + ", ".join(f"round({c} / nullif(lag({c}) OVER (PARTITION BY ticker ORDER BY date), 0) - 1, 6) + 0.0 AS {c}_growth_yoy" for c in ("revenue", "net_income")) + " FROM pit", "pit"),
    "xs_zscore_winsor": sql(f"SELECT date, ticker, feature, {_r('z')} FROM z", "z"),
    "pct_rank_avg_ties": sql("""SELECT date, ticker, CASE WHEN c IS NOT NULL THEN round((rank() OVER (PARTITION BY date ORDER BY c NULLS LAST) + (count(c) OVER (PARTITION BY date, c) - 1) / 2.0::DOUBLE) / count(c) OVER (PARTITION BY date), 6) + 0.0 END AS pct
        FROM (SELECT date, ticker, round(px, -2) AS c FROM xs)""", "xs"),
    "month_end_entries": sql("SELECT date, ticker FROM price WHERE date = last_day(date)", "price"),
    "triple_barrier": sql(f"SELECT ticker, entry_date, label, t_barrier, barrier_type, label_binary, {_r('return_at_touch', 'ewma_vol', 'upper_barrier', 'lower_barrier', 'entry_price')} FROM lab", "lab"),
    "weekly_entries": sql("SELECT ticker, barrier_type, count(*) AS n FROM lab0 WHERE dayofweek(entry_date) = 5 GROUP BY ALL", "lab0"),
    "label_summary": sql("SELECT barrier_type, count(*) FILTER (label = -1) AS down, count(*) FILTER (label = 0) AS flat, count(*) FILTER (label = 1) AS up FROM lab GROUP BY ALL", "lab"),
    "holding_stats": sql("""SELECT barrier_type, count(*) AS n, round(avg(d), 6) + 0.0 AS mean, round(stddev_samp(d), 6) + 0.0 AS std, CAST(min(d) AS INTEGER) AS min, CAST(max(d) AS INTEGER) AS max,
        round(quantile_cont(CAST(d AS DOUBLE), 0.25), 6) + 0.0 AS q25, round(quantile_cont(CAST(d AS DOUBLE), 0.5), 6) + 0.0 AS q50, round(quantile_cont(CAST(d AS DOUBLE), 0.75), 6) + 0.0 AS q75 FROM (SELECT barrier_type, t_barrier - entry_date AS d FROM lab) GROUP BY barrier_type""", "lab"),
    "label_rate_by_year": sql("SELECT CAST(year(entry_date) AS INTEGER) AS year, count(*) AS n, round(avg(label_binary), 6) + 0.0 AS rate FROM lab GROUP BY ALL", "lab"),
    "meta_label_target": sql("SELECT event_id, CAST(CAST(direction > 0 AS INTEGER) = label AS INTEGER) AS meta_label FROM bet", "bet"),
    "universe_rebuild": sql("SELECT date, ticker, sector FROM member", "member"),
    "survivorship": sql("SELECT date, count(DISTINCT ticker) AS members, count(*) FILTER (CAST(split_part(ticker, '-', 2) AS INTEGER) % 2 = 0) AS gone FROM member GROUP BY date", "member"),
    "dedup_best_row": sql("""SELECT ticker, acc AS sec_acceptance_date, form_type, filing, n_known FROM (SELECT *, row_number() OVER (PARTITION BY ticker, acc, form_type ORDER BY n_known DESC, filing) AS r FROM (SELECT *, CAST(""" + " + ".join(f"CAST({m} IS NOT NULL AS INTEGER)" for m in _METRICS) + """ AS INTEGER) AS n_known FROM filing)) WHERE r = 1""", "filing"),
    "facts_flatten": sql("""SELECT ticker, fiscal_period_end, form_type, greatest(arg_min(acc, row(acc, filing)) FILTER (revenue IS NOT NULL), arg_min(acc, row(acc, filing)) FILTER (total_assets IS NOT NULL)) AS sec_acceptance_date,
        round(arg_min(revenue, row(acc, filing)), 6) + 0.0 AS revenue, round(arg_min(total_assets, row(acc, filing)), 6) + 0.0 AS total_assets FROM filing WHERE revenue IS NOT NULL OR total_assets IS NOT NULL GROUP BY ALL""", "filing"),
    "cpcv_groups": sql("SELECT ticker, entry_date, t_barrier, place, g FROM grp", "grp"),
    "cpcv_folds": sql("SELECT CAST(fold AS INTEGER) AS fold, ticker, entry_date, t_barrier, role FROM fold", "fold"),
    "cpcv_fold_counts": sql("SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test FROM fold GROUP BY fold", "fold"),
    "oof_folds": sql("SELECT ticker, entry_date, place, CAST(least(place // (n // 5), 4) AS INTEGER) AS oof_fold FROM (SELECT *, row_number() OVER (ORDER BY entry_date, ticker) - 1 AS place, count(*) OVER () AS n FROM lab)", "lab"),
    "three_way_split": sql("""SELECT ticker, entry_date, CASE WHEN entry_date <= a THEN 'train' WHEN entry_date <= b THEN 'validation' ELSE 'test' END AS part FROM lab CROSS JOIN (
        SELECT max(entry_date) FILTER (place = CAST(floor(n * 0.8::DOUBLE) AS BIGINT)) AS a, max(entry_date) FILTER (place = CAST(floor(n * 0.85::DOUBLE) AS BIGINT)) AS b FROM (SELECT entry_date, row_number() OVER (ORDER BY entry_date, ticker) - 1 AS place, count(*) OVER () AS n FROM lab))""", "lab"),
    **{f"bet_size_{m}": _bet(m) for m in ("meta_prob", "half_kelly", "equal")},
    "neutralize_sector": sql("""SELECT date, ticker, round(CASE WHEN s >= 1e-12 THEN e / s ELSE e END, 6) + 0.0 AS neutral FROM (SELECT *, stddev_pop(e) OVER (PARTITION BY date) AS s FROM (
        SELECT date, ticker, CASE WHEN sector = min(sector) OVER (PARTITION BY date) THEN score ELSE score - avg(score) OVER (PARTITION BY date, sector) END AS e FROM score WHERE score IS NOT NULL))""", "score"),
    "neutralize_single_factor": sql("""SELECT date, ticker, round(CASE WHEN s >= 1e-12 THEN e / s ELSE e END, 6) + 0.0 AS neutral FROM (SELECT *, stddev_pop(e) OVER (PARTITION BY date) AS s FROM (
        SELECT date, ticker, score - coalesce(sum(disc * score) OVER (PARTITION BY date) / nullif(sum(disc * disc) OVER (PARTITION BY date), 0), 0) * disc AS e FROM score WHERE score IS NOT NULL))""", "score"),
    "validate_slopes": sql("""SELECT v.exposure, round(CASE v.exposure WHEN 'disc' THEN a ELSE b END, 6) + 0.0 AS slope, round(CASE v.exposure WHEN 'disc' THEN ra ELSE rb END, 6) + 0.0 AS r2, n FROM (SELECT regr_slope(neutral, disc) AS a, regr_slope(neutral, size) AS b, regr_r2(neutral, disc) AS ra, regr_r2(neutral, size) AS rb, count(*) AS n FROM (
        SELECT disc, size, CASE WHEN s >= 1e-12 THEN e / s ELSE e END AS neutral FROM (SELECT *, stddev_pop(e) OVER (PARTITION BY date) AS s FROM (
        SELECT *, score - coalesce(sum(disc * score) OVER (PARTITION BY date) / nullif(sum(disc * disc) OVER (PARTITION BY date), 0), 0) * disc AS e FROM score WHERE score IS NOT NULL)))) CROSS JOIN (VALUES ('disc'), ('size')) v(exposure)""", "score"),
    "portfolio_equal": sql(f"SELECT date, ticker, {_r('weight')} FROM ({_side(_EQUAL, None, 0.05, 0.3)})", "eq"),
    "portfolio_conviction_capped": sql(f"SELECT date, ticker, {_r('weight')} FROM ({_side(_CONVICTION, None, 0.2, 0.3)})", "eq"),
    "portfolio_long_short": sql(f"SELECT date, ticker, {_r('weight')} FROM ({_side(_EQUAL, _SHORT, 0.2, 0.3)})", "eq"),
    "turnover_costs": sql(f"""SELECT n.date, round(sum(abs(n.weight - coalesce(o.weight, 0))), 6) + 0.0 AS turnover, round(sum(abs(n.weight - coalesce(o.weight, 0))) * 7.5::DOUBLE / 10000, 6) + 0.0 AS cost
        FROM (SELECT *, dense_rank() OVER (ORDER BY date) AS k FROM ({_side(_EQUAL, None, 0.05, 0.3)})) n LEFT JOIN (SELECT *, dense_rank() OVER (ORDER BY date) AS k FROM ({_side(_EQUAL, None, 0.05, 0.3)})) o ON o.k = n.k - 1 AND o.ticker = n.ticker GROUP BY n.date""", "eq"),
    "market_impact": sql("SELECT date, round(sum(abs(disc / 10) * coalesce(disc, 0) * sqrt(abs(disc / 10) * 1e8 / coalesce(nullif(qty * px, 0), 1e12))), 6) + 0.0 AS impact FROM xs GROUP BY date", "xs"),
    "backtest_daily": sql("SELECT g.date, round(gross, 6) + 0.0 AS gross, round(coalesce(cost, 0), 6) + 0.0 AS cost, round(gross - coalesce(cost, 0), 6) + 0.0 AS ret FROM gross g LEFT JOIN paid USING (date)", "paid"),
    "performance_metrics": sql("SELECT * EXCLUDE (one) FROM (" + _performance("(SELECT 1 AS one, * FROM mkt)", "one") + ")", "mkt"),
    "regime_metrics": sql("SELECT * FROM (" + _performance("""(SELECT CASE WHEN t <= 0.005 THEN 'bear' WHEN t <= 0.02 THEN 'sideways' ELSE 'bull' END AS regime, date, ret FROM (
        SELECT date, ret, CASE WHEN count(*) OVER w = 126 THEN sum(ret) OVER w END AS t FROM mkt WINDOW w AS (ORDER BY date ROWS 125 PRECEDING)) WHERE t IS NOT NULL)""", "regime") + ") WHERE n_days >= 10", "mkt"),
    "monthly_returns_spine": sql("""SELECT m.month, round(coalesce(s, 0.0), 6) + 0.0 AS ret FROM (SELECT last_day(CAST(d AS DATE)) AS month FROM (SELECT unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS d FROM mkt WHERE month(date) <> 5)) m
        LEFT JOIN (SELECT last_day(date) AS month, sum(ret) AS s FROM mkt WHERE month(date) <> 5 GROUP BY 1) USING (month)""", "mkt"),
    "rolling_sharpe": sql("SELECT date, CASE WHEN count(*) OVER w = 63 AND stddev_samp(ret) OVER w >= 1e-12 THEN round(avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(252), 6) + 0.0 END AS sharpe FROM mkt WINDOW w AS (ORDER BY date ROWS 62 PRECEDING)", "mkt"),
    "equity_drawdown": sql(f"SELECT date, {_r('ret', 'wealth', 'drawdown')} FROM dd", "dd"),
    "trade_ledger": sql(f"SELECT reb_date, entry_date, exit_date, ticker, CASE WHEN w > 0 THEN 'Long' ELSE 'Short' END AS direction, round(w, 6) + 0.0 AS weight, {_r('entry_price', 'exit_price', 'ret')}, ret > 0 AS won FROM trade", "trade"),
    "trade_stats": sql("""SELECT count(*) AS n, round(avg(CAST(ret > 0 AS DOUBLE)), 6) + 0.0 AS win_rate, round(avg(ret), 6) + 0.0 AS mean_ret, round(median(ret), 6) + 0.0 AS median_ret, round(avg(ret) FILTER (ret > 0), 6) + 0.0 AS mean_win, round(avg(ret) FILTER (ret < 0), 6) + 0.0 AS mean_loss,
        round(sum(ret) FILTER (ret > 0) / nullif(abs(sum(ret) FILTER (ret < 0)), 0), 6) + 0.0 AS profit_factor, arg_max(ticker, row(ret, ticker, reb_date)) AS best, arg_max(ticker, row(-ret, ticker, reb_date)) AS worst FROM held""", "held"),
    "trades_by_month": sql("SELECT last_day(reb_date) AS month, count(*) AS n, round(avg(ret), 6) + 0.0 AS mean_ret, round(avg(CAST(ret > 0 AS DOUBLE)), 6) + 0.0 AS win_rate FROM held GROUP BY 1", "held"),
    "trades_by_ticker": sql("SELECT ticker, count(*) AS n, round(sum(ret), 6) + 0.0 AS total_ret, round(avg(CAST(ret > 0 AS DOUBLE)), 6) + 0.0 AS win_rate FROM held GROUP BY 1", "held"),
    "sweep_grid": sql(f"SELECT config_id, method, {_r('least', 'cap', 'total', 'sharpe')}, days FROM swept", "swept"),
    "sweep_param_means": sql("SELECT method, round(least, 6) + 0.0 AS least, round(cap, 6) + 0.0 AS cap, round(avg(sharpe), 6) + 0.0 AS mean_sharpe, count(*) AS n FROM swept GROUP BY GROUPING SETS ((method), (least), (cap))", "swept"),
    "sweep_top10": sql("SELECT config_id, round(s, 6) + 0.0 AS sharpe FROM (SELECT config_id, round(sharpe, 9) AS s FROM swept) ORDER BY s DESC, config_id LIMIT 10", "swept"),
    "corr_pairs": sql(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM feat" for i, a in enumerate(_REPORTED) for b in _REPORTED[i + 1 :]), "feat"),
    "missing_rate": sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(CAST({c} IS NULL AS DOUBLE)), 6) + 0.0 AS missing FROM feat" for c in _REPORTED), "feat"),
    "coverage_by_month": sql(" UNION ALL ".join(f"SELECT last_day(date) AS month, '{c}' AS feature, round(avg(CAST({c} IS NOT NULL AS DOUBLE)), 6) + 0.0 AS share FROM feat GROUP BY 1" for c in _REPORTED), "feat"),
    "never_known": sql(" UNION ALL ".join(f"SELECT c_custkey || ':' || year(o_orderdate) AS ticker, '{m}' AS metric FROM filing JOIN orders ON filing = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count({m}) = 0" for m in _METRICS), "filing"),
    "histogram_bins": sql("SELECT CAST(CASE WHEN rsi_14 < 0 THEN 0 WHEN rsi_14 >= 100 THEN 21 ELSE floor(rsi_14 / 5) + 1 END AS BIGINT) AS bin, count(*) AS n FROM feat WHERE rsi_14 IS NOT NULL GROUP BY 1", "feat"),
    "integrity_describe": sql("SELECT count(*) AS dates, round(avg(n), 6) + 0.0 AS mean, round(stddev_samp(n), 6) + 0.0 AS std, min(n) AS min, max(n) AS max FROM (SELECT count(DISTINCT ticker) AS n FROM price GROUP BY date)", "price"),
    "zscore_sanity": sql("SELECT date, feature, round(avg(z), 6) + 0.0 AS mean, round(stddev_pop(z), 6) + 0.0 AS std, count(z) AS n FROM z GROUP BY ALL", "z"),
    "label_entries_joined": sql(f"SELECT feat.date, feat.ticker, {_r('ret_21d', 'vol_20d')}, label_binary FROM feat JOIN lab ON feat.ticker = lab.ticker AND feat.date = entry_date", "feat", "lab"),
    "pm_ledger": sql("SELECT event_id, round(prob, 6) + 0.0 AS meta_conviction, CASE WHEN direction > 0 THEN 'Long' ELSE 'Short' END AS direction, CAST(row_number() OVER (ORDER BY prob DESC, event_id) AS INTEGER) AS rank FROM bet ORDER BY prob DESC, event_id LIMIT 20", "bet"),
    "confusion_matrix": sql("""SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) + 0.0 AS "precision", round(tp / (tp + fn), 6) + 0.0 AS recall, round(2 * tp / (2 * tp + fp + fn), 6) + 0.0 AS f1 FROM (
        SELECT count(*) FILTER (prob > 0.2 AND label = 1) AS tp, count(*) FILTER (prob > 0.2 AND label = 0) AS fp, count(*) FILTER (prob <= 0.2 AND label = 1) AS fn, count(*) FILTER (prob <= 0.2 AND label = 0) AS tn FROM bet)""", "bet"),
    "probability_scores": sql("""SELECT round(brier, 6) + 0.0 AS brier, round(climatology, 6) + 0.0 AS climatology, round(logloss, 6) + 0.0 AS logloss, round(ece, 6) + 0.0 AS ece, round(auc, 6) + 0.0 AS auc FROM
        (SELECT avg(pow(p - label, 2)) AS brier, avg(label) * (1 - avg(label)) AS climatology, -avg(label * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - label) * ln(1 - greatest(1e-15, least(1 - 1e-15, p)))) AS logloss FROM (SELECT prob AS p, label FROM bet)),
        (SELECT sum(n * abs(a - b)) / sum(n) AS ece FROM (SELECT count(*) AS n, avg(p) AS a, avg(label) AS b FROM (SELECT prob AS p, label FROM bet) GROUP BY least(floor(p * 10), 9))),
        (SELECT (sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)) AS auc FROM (
          SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS k FROM (SELECT prob AS p, label FROM bet)))""", "bet"),
    "bollinger_population": sql("""SELECT date, ticker, CASE WHEN count(*) OVER w = 20 AND 4 * stddev_pop(p) OVER w >= 1e-12 THEN round((p - (avg(p) OVER w - 2 * stddev_pop(p) OVER w)) / (4 * stddev_pop(p) OVER w), 6) + 0.0 END AS pctb
        FROM price WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)""", "price"),
    # changes up to the seed's last one weigh the same; the common factor of the later ones cancels out
    "rsi_wilder": sql("""SELECT date, ticker, CASE WHEN i >= 14 THEN round(100 * up / nullif(all_of, 0), 6) + 0.0 END AS rsi FROM (
        SELECT date, ticker, i, sum(pow(14.0::DOUBLE / 13, greatest(i, 14)) * greatest(delta, 0)) OVER t AS up, sum(pow(14.0::DOUBLE / 13, greatest(i, 14)) * abs(delta)) OVER t AS all_of
        FROM step WINDOW t AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING))""", "step"),
    "beta_size_exposures": sql("SELECT date, ticker, round(vol_20d, 6) + 0.0 AS beta, round(ln(1 + p * v), 6) + 0.0 AS log_market_cap FROM feat", "feat"),
    "id_lookup": "SELECT upper(n_name) AS ticker, CASE WHEN n_nationkey % 6 <> 0 THEN lpad(CAST(n_nationkey AS VARCHAR), 10, '0') END AS id FROM nation",
    "equity_vs_benchmark": sql("SELECT date, round(exp(sum(ln(1 + ret)) OVER w), 6) + 0.0 AS wealth, round(exp(sum(ln(1 + CASE WHEN month(date) <> 3 THEN ret / 2 ELSE 0 END)) OVER w), 6) + 0.0 AS benchmark_wealth FROM mkt WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)", "mkt"),
    "strategy_and_benchmark": sql("SELECT figure, max(x) FILTER (who = 's') AS strategy, max(x) FILTER (who = 'b') AS benchmark FROM (UNPIVOT (SELECT who, * EXCLUDE (who, n_days), CAST(n_days AS DOUBLE) AS n_days FROM (" + _performance("(SELECT 's' AS who, date, ret FROM mkt UNION ALL SELECT 'b', date, ret / 2 FROM mkt)", "who") + ")) ON COLUMNS(* EXCLUDE (who)) INTO NAME figure VALUE x) GROUP BY figure", "mkt"),
    "strong_correlations": sql("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM feat" for i, a in enumerate(_REPORTED) for b in _REPORTED[i + 1 :]) + ") WHERE abs(r) > 0.3", "feat"),
    "split_summary": sql("""SELECT part, count(*) AS n, min(entry_date) AS first, max(entry_date) AS last, round(avg(label_binary), 6) + 0.0 AS rate FROM (SELECT entry_date, label_binary, CASE WHEN entry_date <= a THEN 'train' WHEN entry_date <= b THEN 'validation' ELSE 'test' END AS part FROM lab CROSS JOIN (
        SELECT max(entry_date) FILTER (place = CAST(floor(n * 0.8::DOUBLE) AS BIGINT)) AS a, max(entry_date) FILTER (place = CAST(floor(n * 0.85::DOUBLE) AS BIGINT)) AS b FROM (SELECT entry_date, row_number() OVER (ORDER BY entry_date, ticker) - 1 AS place, count(*) OVER () AS n FROM lab))) GROUP BY part""", "lab"),
    "early_stop_rows": sql("""SELECT entry_date > a AS monitor, count(*) AS n, max(entry_date) AS last FROM lab CROSS JOIN (SELECT max(entry_date) FILTER (place = CAST(floor(n * 0.9::DOUBLE) AS BIGINT)) AS a FROM (SELECT entry_date, row_number() OVER (ORDER BY entry_date, ticker) - 1 AS place, count(*) OVER () AS n FROM lab)) GROUP BY 1""", "lab"),
    "bet_filter_rate": "SELECT count(*) AS n, count(*) FILTER (bet <> 0) AS kept, round(CAST(count(*) FILTER (bet <> 0) AS DOUBLE) / count(*), 6) + 0.0 AS rate FROM (" + _bet("half_kelly") + ")",
    "fold_report": sql("""SELECT figure, count(x) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) + 0.0 AS std, round(min(x), 6) + 0.0 AS min, round(max(x), 6) + 0.0 AS max, round(max(x) / avg(x), 6) + 0.0 AS best_to_mean FROM (UNPIVOT (
        SELECT fold, avg(CAST(CAST(prob > 0.5 AS INTEGER) = label AS DOUBLE)) AS accuracy, -avg(label * ln(greatest(1e-15, least(1 - 1e-15, prob))) + (1 - label) * ln(1 - greatest(1e-15, least(1 - 1e-15, prob)))) AS logloss,
          (sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)) AS auc
        FROM (SELECT event_id % 8 AS fold, prob, label, rank() OVER (PARTITION BY event_id % 8 ORDER BY prob) + (count(*) OVER (PARTITION BY event_id % 8, prob) - 1) / 2.0::DOUBLE AS k FROM bet) GROUP BY fold) ON accuracy, logloss, auc INTO NAME figure VALUE x) GROUP BY figure""", "bet"),
    "top_k_drivers": "SELECT vec_id, list_aggregate(list_transform(list_sort(list_transform(range(1, len(embedding) + 1), lambda i: {'s': -abs(embedding[i]), 'i': i - 1}))[1:3], lambda s: 'f' || s.i || '(' || printf('%+.3f', CAST(embedding[s.i + 1] AS DOUBLE)) || ')'), 'string_agg', ' | ') AS top_drivers FROM embeddings",
    "rebalance_listing": sql("SELECT date, ticker, CASE WHEN w > 0 THEN 'Long' ELSE 'Short' END AS direction, round(w * 100, 6) + 0.0 AS weight_pct FROM hold", "hold"),
    "stratified_sample": "SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey) LIMIT 50",
    "union_intersect": "SELECT k, 'both' AS part FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'any' FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)",
    "flagship_decile_portfolio": sql("""SELECT date, ticker, sector, round(score, 6) + 0.0 AS score, round(weight, 6) + 0.0 AS weight FROM (SELECT e.*, x.weight FROM eq2 e JOIN (""" + _side(_CONVICTION, None, 0.05, 0.3).replace("FROM eq)", "FROM eq2)") + """) x USING (date, ticker)) WHERE weight <> 0""", "feat", "price"),
}

_Z = """SELECT date, ticker, CASE WHEN s IS NULL OR s < 1e-12 THEN 0.0 WHEN x IS NULL THEN NULL ELSE greatest(-3.0, least(3.0, (x - m) / s)) END AS z FROM (SELECT *, avg(x) OVER (PARTITION BY date) AS m, stddev_pop(x) OVER (PARTITION BY date) AS s FROM (SELECT date, ticker, {x} AS x FROM feat))"""
# a date has fewer than 100 nations, so winsorisation leaves values as they are
_EQ2 = f""", eq2 AS (SELECT date, ticker, sector, score, (rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date) AS pct FROM (
    SELECT a.date, a.ticker, price.sector, round(a.z - 0.5::DOUBLE * b.z, 9) AS score FROM ({_Z.format(x="ret_21d")}) a JOIN ({_Z.format(x="vol_20d")}) b USING (date, ticker) JOIN price USING (date, ticker)) WHERE score IS NOT NULL)
"""
_flag = ORACLES["flagship_decile_portfolio"]
_cut = _flag.index("\nSELECT date, ticker, sector, round(score")
ORACLES["flagship_decile_portfolio"] = _flag[:_cut] + _EQ2 + _flag[_cut:]

_SERIES = ["click", "error", "purchase", "signup", "view"]
ORACLES["macro_panel"] = "SELECT date, " + ", ".join(f"round(last_value({c} IGNORE NULLS) OVER w, 6) + 0.0 AS {c}" for c in _SERIES) + " FROM (SELECT CAST(ts AS DATE) AS date, " + ", ".join(f"avg(value) FILTER (event_type = '{c}') AS {c}" for c in _SERIES) + " FROM events GROUP BY 1) WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)"

_WEIGHTS = [1.0]
while abs(_w := -_WEIGHTS[-1] * (0.4 - len(_WEIGHTS) + 1) / len(_WEIGHTS)) >= 1e-2:
    _WEIGHTS.append(_w)
ORACLES["fractional_difference"] = sql(f"""SELECT date, ticker, round(x, 6) + 0.0 AS x, CASE WHEN len(h) = {len(_WEIGHTS)} THEN round(list_dot_product(h, {_WEIGHTS[::-1]}::DOUBLE[]), 6) + 0.0 END AS fd FROM (
    SELECT date, ticker, ln(p) AS x, list(ln(p)) OVER (PARTITION BY ticker ORDER BY date ROWS {len(_WEIGHTS) - 1} PRECEDING) AS h FROM price)""", "price")

for _name, _columns in {
    "log_returns_multi": ["ret_21d", "ret_63d", "ret_126d"], "skip_month_momentum": ["ret_252d"], "realized_vol": ["vol_20d", "vol_60d"], "trailing_drawdown": ["mdd_126d"], "garman_klass": ["gk_vol_20d"], "volume_zscore": ["volume_zscore"],
    "amihud": ["amihud"], "obv": ["obv", "obv_zscore"], "ma_gap": ["ma_gap_50d", "ma_gap_200d"], "rsi_simple": ["rsi_14"], "bollinger_pctb": ["bb_pctb"],
}.items():
    ORACLES[_name] = sql(f"SELECT date, ticker, {_r(*_columns)} FROM feat", "feat")


_RANK = "(rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0::DOUBLE)"
_IC = """SELECT date, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS ic, count(*) AS n
    FROM (SELECT date, {a} AS a, {b} AS b FROM (SELECT date, {x} AS x, {y} AS y FROM xs) WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY date"""
_ranked = lambda x, y: _IC.format(a=_RANK.format(x="x"), b=_RANK.format(x="y"), x=x, y=y)
ORACLES["information_coefficient"] = sql(f"SELECT date, round(ic, 6) + 0.0 AS ic, n FROM ({_ranked('round(px, -2)', 'qty')})", "xs")
ORACLES["coefficient_summary"] = sql(f"SELECT dates, {_r('mean', 'std', 'ratio', 'positive')} FROM (SELECT count(ic) AS dates, avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / nullif(stddev_samp(ic), 0) AS ratio, avg(CAST(ic > 0 AS DOUBLE)) AS positive FROM ({_ranked('round(disc, 9)', 'qty')}))", "xs")
ORACLES["sweep_heatmap"] = sql("SELECT round(least, 6) + 0.0 AS least, round(max(sharpe) FILTER (cap = 0.02), 6) + 0.0 AS cap_2, round(max(sharpe) FILTER (cap = 0.05), 6) + 0.0 AS cap_5 FROM swept GROUP BY least", "swept")
ORACLES["roc_points"] = sql("""SELECT round(prob, 6) + 0.0 AS threshold, round(sum(t) OVER w / sum(t) OVER (), 6) + 0.0 AS tpr, round(sum(f) OVER w / sum(f) OVER (), 6) + 0.0 AS fpr
    FROM (SELECT prob, CAST(sum(label) AS DOUBLE) AS t, CAST(sum(1 - label) AS DOUBLE) AS f FROM bet GROUP BY prob) WINDOW w AS (ORDER BY prob DESC)""", "bet")
ORACLES["stratified_dummy"] = sql("SELECT round(r, 6) + 0.0 AS rate, round(r * r + (1 - r) * (1 - r), 6) + 0.0 AS accuracy, round(2 * r * (1 - r), 6) + 0.0 AS brier FROM (SELECT avg(label) AS r FROM bet)", "bet")
ORACLES["valuation_ratios"] = sql(f"SELECT filing, {_r('eps', 'price_earnings', 'price_book', 'price_sales')} FROM (SELECT filing, net_income / nullif(total_assets / 100.0::DOUBLE, 0) AS eps, 20.0::DOUBLE * total_assets / 100.0::DOUBLE / nullif(net_income, 0) AS price_earnings, 20.0::DOUBLE * total_assets / 100.0::DOUBLE / nullif(stockholders_equity, 0) AS price_book, 20.0::DOUBLE * total_assets / 100.0::DOUBLE / nullif(revenue, 0) AS price_sales FROM filing)", "filing")

_DF = """SELECT ticker, CASE WHEN count(*) >= 4 THEN regr_slope(d, l) / nullif(sqrt(greatest(regr_syy(d, l) * (1 - regr_r2(d, l)), 0.0) / nullif((count(*) - 2) * regr_sxx(d, l), 0)), 0) END AS statistic, count(*) AS n
    FROM (SELECT ticker, l, x - l AS d FROM (SELECT ticker, x, lag(x) OVER (PARTITION BY ticker ORDER BY date) AS l FROM ({series}) WHERE x IS NOT NULL) WHERE l IS NOT NULL) GROUP BY ticker"""


def _differenced(d: float) -> str:
    weights = [1.0]
    while abs(w := -weights[-1] * (d - len(weights) + 1) / len(weights)) >= 1e-2:
        weights.append(w)
    return f"""SELECT date, ticker, CASE WHEN len(h) = {len(weights)} THEN list_dot_product(h, {weights[::-1]}::DOUBLE[]) END AS x
        FROM (SELECT date, ticker, list(ln(p)) OVER (PARTITION BY ticker ORDER BY date ROWS {len(weights) - 1} PRECEDING) AS h FROM price)"""


ORACLES["dickey_fuller"] = sql("SELECT ticker, round(statistic, 6) + 0.0 AS statistic, n FROM (" + _DF.format(series="SELECT date, ticker, ln(p) AS x FROM price") + ")", "price")
ORACLES["least_order"] = sql("SELECT ticker, d, round(statistic, 6) + 0.0 AS statistic FROM (SELECT DISTINCT ticker FROM price) LEFT JOIN (SELECT ticker, min(d) AS d, arg_min(statistic, d) AS statistic FROM (" + " UNION ALL ".join(f"SELECT ticker, {d}::DOUBLE AS d, statistic FROM ({_DF.format(series=_differenced(d))})" for d in (0.0, 0.2, 0.4)) + ") WHERE statistic < -2.8615 GROUP BY ticker) USING (ticker)", "price")
ORACLES["except_all"] = "SELECT k, 'all' AS part FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'distinct' FROM (SELECT c_nationkey AS k FROM customer WHERE c_nationkey % 2 = 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey % 3 = 0)"
ORACLES["html_tables"] = "SELECT n_regionkey, n_name || ' & co' AS name, CAST(n_nationkey AS VARCHAR) AS id FROM nation"
