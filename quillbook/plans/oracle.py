"""The same queries as independent SQL text for the tables of a data folder.

Each text is a chain of common table expressions that ends in one of the queries'
SELECT.  Chains of replacements are followed by recursion here, the top of book by
a range join: other ways than the DataFrame plans take.
"""

from __future__ import annotations

import re


def _events(touch: bool) -> str:
    price = (
        "CASE WHEN side = 'B' THEN 500000 - 100 * (1 + floor(value)::BIGINT % 2) ELSE 500000 + 100 * (1 + floor(value)::BIGINT % 2) END"
        if touch
        else "round(value * 100)::BIGINT * 100"
    )
    inherits = "WHEN type = 'U' AND root IS NOT NULL THEN CASE WHEN root % 2 = 0 THEN 'B' ELSE 'S' END" if touch else ""
    return f"""
raw AS (
  SELECT event_id AS idx, ts::DATE AS session, (epoch_us(ts) % 86400000000) * 1000 AS ts_ns, user_id::INT AS locate, value,
         CASE WHEN k >= 97 THEN 'H' WHEN k = 96 THEN 'P' WHEN event_type = 'click' THEN 'A' WHEN event_type = 'view' THEN 'E'
              WHEN event_type = 'purchase' THEN 'X' WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS type
  FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)
), placed AS (
  SELECT *, max(CASE WHEN type IN ('A', 'U') THEN idx END) OVER w AS made, max(CASE WHEN type = 'A' THEN idx END) OVER w AS root
  FROM raw WINDOW w AS (PARTITION BY locate ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), sided AS (
  SELECT *, CASE {inherits} WHEN idx % 2 = 0 THEN 'B' ELSE 'S' END AS side FROM placed
), m AS (
  SELECT idx, session, ts_ns, type, locate,
         CASE WHEN type = 'A' THEN idx WHEN type IN ('E', 'X', 'D', 'U') THEN made END AS ref,
         CASE WHEN type = 'U' THEN idx END AS new_ref,
         CASE WHEN type IN ('A', 'U') THEN side END AS side,
         CASE WHEN type IN ('A', 'U') THEN 100 + 10 * (idx % 7) WHEN type IN ('E', 'X') THEN 30 + 20 * (idx % 5) WHEN type = 'D' THEN 0 END AS shares,
         CASE WHEN type IN ('A', 'U') THEN {price} END AS price,
         CASE WHEN type = 'H' THEN ['T', 'H', 'P', 'Q'][idx % 4 + 1] END AS state
  FROM sided
)"""


ORDERS = """
raw AS (
  SELECT o_orderdate AS ts, 0 AS rnk, o_orderkey AS ref, 0 AS line, 0 AS part, 0 AS supp, 'A' AS type, (o_custkey % 64)::INT AS locate,
         100::BIGINT AS shares, round(o_totalprice * 100)::BIGINT * 100 AS price FROM orders
  UNION ALL
  SELECT l_shipdate, 1, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE l_returnflag WHEN 'A' THEN 'E' WHEN 'N' THEN 'X' ELSE 'D' END, (o_custkey % 64)::INT, l_quantity::BIGINT, NULL
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), m AS (
  SELECT row_number() OVER (ORDER BY ts, rnk, ref, line, part, supp) - 1 AS idx, ts::DATE AS session, (epoch_us(ts) % 86400000000) * 1000 AS ts_ns,
         type, locate, ref, NULL::BIGINT AS new_ref, CASE WHEN type = 'A' THEN CASE WHEN ref % 2 = 0 THEN 'B' ELSE 'S' END END AS side,
         shares, price, NULL AS state
  FROM raw
)"""

#: Days of their own, folded message by message: ``live`` is a list of what is live.
DAILY = """
m AS (
  SELECT event_id AS idx, ts::DATE AS session, (epoch_us(ts) % 86400000000) * 1000 AS ts_ns,
         CASE WHEN k < 4 THEN 'A' WHEN k = 4 THEN 'F' WHEN k = 5 THEN 'E' WHEN k = 6 THEN 'X' WHEN k = 7 THEN 'D' WHEN k = 8 THEN 'U' ELSE 'C' END AS type,
         (CASE WHEN event_id % 53 = 0 THEN 70000 ELSE (event_id // 20) % 7 END)::INT AS locate,
         CASE WHEN k < 5 THEN event_id % 997 ELSE (event_id - 3 - (event_id // 10) % 4 + 997) % 997 END AS ref, CASE WHEN k = 8 THEN event_id * 3 % 997 END AS new_ref,
         CASE WHEN k < 5 THEN CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'S' END END AS side,
         CASE WHEN event_id % 29 = 0 THEN 0 ELSE 10 + event_id % 13 * 5 END AS shares, CASE WHEN k < 5 OR k = 8 THEN 100 * (500 + event_id % 9) END AS price
  FROM (SELECT *, event_id % 10 AS k FROM events)
), line AS (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY idx) AS k, CASE WHEN type IN ('E', 'C', 'X') THEN shares ELSE 0 END AS red FROM m
), walk AS (
  SELECT session, 0::BIGINT AS k, NULL::BIGINT AS idx, [{'ref': NULL::BIGINT, 'root': NULL::BIGINT, 'locate': NULL::INT, 'side': NULL::VARCHAR, 'price': NULL::BIGINT, 'qty0': NULL::BIGINT, 'qty': NULL::BIGINT, 'born': NULL::BIGINT}][1:0] AS live,
         NULL::BIGINT AS hit, false AS gone, false AS over, false AS moved, false AS made, NULL::VARCHAR AS rejected
  FROM (SELECT DISTINCT session FROM m)
  UNION ALL
  SELECT session, k, idx, CASE WHEN made THEN list_append(rest, {'ref': own, 'root': CASE WHEN type = 'U' THEN h.root ELSE own END, 'locate': CASE WHEN type = 'U' THEN h.locate ELSE locate END,
           'side': CASE WHEN type = 'U' THEN h.side ELSE side END, 'price': price, 'qty0': shares, 'qty': shares, 'born': idx}) ELSE rest END,
         h.born, gone, coalesce(gone AND red > h.qty, false), coalesce(h.locate <> locate, false), made,
         CASE WHEN type IN ('A', 'F') AND locate > 65535 THEN 'bad_locate' WHEN type IN ('A', 'F', 'U') AND (type <> 'U' OR h IS NOT NULL) AND shares = 0 THEN 'zero_qty'
              WHEN type IN ('A', 'F', 'U') AND (type <> 'U' OR h IS NOT NULL) AND NOT made THEN 'duplicate_ref' WHEN type IN ('E', 'C', 'X', 'D', 'U') AND h IS NULL THEN 'unknown_ref' END
  FROM (
    SELECT *, CASE WHEN type = 'U' THEN h IS NOT NULL ELSE type IN ('A', 'F') AND locate <= 65535 END AND shares > 0 AND len(list_filter(rest, lambda x: x.ref = own)) = 0 AS made FROM (
      SELECT *, CASE WHEN type = 'U' THEN new_ref ELSE ref END AS own,
             CASE WHEN h IS NULL THEN live WHEN gone THEN list_filter(live, lambda x: x.ref <> ref)
                  ELSE list_transform(live, lambda x: {'ref': x.ref, 'root': x.root, 'locate': x.locate, 'side': x.side, 'price': x.price, 'qty0': x.qty0, 'qty': CASE WHEN x.ref = ref THEN x.qty - red ELSE x.qty END, 'born': x.born}) END AS rest
      FROM (
        SELECT *, h IS NOT NULL AND (type IN ('D', 'U') OR red >= h.qty) AS gone FROM (
          SELECT l.*, w.live, CASE WHEN l.type IN ('E', 'C', 'X', 'D', 'U') THEN list_filter(w.live, lambda x: x.ref = l.ref)[1] END AS h
          FROM walk w JOIN line l ON l.session = w.session AND l.k = w.k + 1))))
)"""

_LIFE = """
cand AS (
  SELECT CASE WHEN type = 'A' THEN ref ELSE new_ref END AS ref, CASE WHEN type = 'U' THEN ref END AS prev, idx AS born, ts_ns AS born_ns, session,
         locate, side, shares AS qty0, price, type = 'A' AS is_add
  FROM m WHERE type IN ('A', 'U') AND shares > 0
), ends AS (
  SELECT *, sum(red) OVER (PARTITION BY ref ORDER BY idx) AS cum FROM (
    SELECT c.ref, r.idx, r.ts_ns, r.type, r.locate AS msg_locate, CASE WHEN r.type IN ('E', 'X') THEN r.shares ELSE 0 END AS red, c.qty0
    FROM m r JOIN cand c ON r.ref = c.ref AND r.idx > c.born WHERE r.type IN ('E', 'X', 'D', 'U'))
), dead AS (
  SELECT ref, min(idx) AS died, arg_min(type, idx) AS end_type, arg_min(ts_ns, idx) AS died_ns, arg_min(cum, idx) AS end_cum
  FROM ends WHERE type IN ('D', 'U') OR cum >= qty0 GROUP BY ref
), chain AS (
  SELECT ref, ref AS root, locate, side FROM cand WHERE is_add
  UNION ALL
  SELECT c.ref, p.root, p.locate, p.side FROM chain p JOIN dead d ON d.ref = p.ref JOIN cand c ON c.prev = p.ref AND c.born = d.died AND NOT c.is_add
), life AS (
  SELECT c.ref, root, h.locate, h.side, price, qty0, session, born, born_ns, died, died_ns,
         CASE end_type WHEN 'E' THEN 'executed' WHEN 'X' THEN 'cancelled' WHEN 'D' THEN 'deleted' WHEN 'U' THEN 'replaced' END AS end_kind, end_cum
  FROM cand c JOIN chain h ON c.ref = h.ref LEFT JOIN dead d ON d.ref = c.ref
), eff AS (
  SELECT e.idx, e.ts_ns, e.type, e.msg_locate, e.ref, l.locate, l.side, l.price, l.qty0 - e.cum + e.red AS before, e.red, coalesce(e.idx = l.died, false) AS dies, l.born_ns
  FROM ends e JOIN life l ON e.ref = l.ref AND (l.died IS NULL OR e.idx <= l.died)
), rem AS (
  SELECT l.*, qty0 - coalesce(taken, 0) AS rem FROM life l
  LEFT JOIN (SELECT ref, sum(red) AS taken FROM eff WHERE NOT dies GROUP BY ref) t ON l.ref = t.ref WHERE died IS NULL
), dep AS (
  SELECT locate, side, row_number() OVER (PARTITION BY locate, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS rank, price,
         sum(rem)::BIGINT AS qty, count(*) AS orders
  FROM rem GROUP BY locate, side, price
), steps AS (
  SELECT locate, side, price, idx, sum(dq) AS dq FROM (
    SELECT locate, side, price, born AS idx, qty0 AS dq FROM life
    UNION ALL SELECT locate, side, price, idx, CASE WHEN dies THEN -before ELSE -red END FROM eff) GROUP BY ALL
), seg AS (
  SELECT * FROM (
    SELECT locate, side, price, idx AS a, lead(idx, 1, 9000000000000) OVER w AS b, sum(dq) OVER w AS qty
    FROM steps WINDOW w AS (PARTITION BY locate, side, price ORDER BY idx)) WHERE qty > 0
), book AS (
  SELECT idx, locate, type, ts_ns, session FROM m WHERE type IN ('A', 'E', 'X', 'D', 'U')
), post AS (
  SELECT k.*, coalesce(bid_px, 0) AS bid_px, coalesce(bid_qty, 0)::BIGINT AS bid_qty, coalesce(ask_px, 0) AS ask_px, coalesce(ask_qty, 0)::BIGINT AS ask_qty
  FROM book k LEFT JOIN (
    SELECT k.idx, max(s.price) FILTER (WHERE side = 'B') AS bid_px, arg_max(qty, s.price) FILTER (WHERE side = 'B') AS bid_qty,
           min(s.price) FILTER (WHERE side = 'S') AS ask_px, arg_min(qty, s.price) FILTER (WHERE side = 'S') AS ask_qty
    FROM book k JOIN seg s ON k.locate = s.locate AND s.a <= k.idx AND k.idx < s.b GROUP BY k.idx) t ON k.idx = t.idx
), pre AS (
  SELECT k.*, coalesce(bid_px, 0) AS bid_px, coalesce(bid_qty, 0)::BIGINT AS bid_qty, coalesce(ask_px, 0) AS ask_px, coalesce(ask_qty, 0)::BIGINT AS ask_qty
  FROM book k LEFT JOIN (
    SELECT k.idx, max(s.price) FILTER (WHERE side = 'B') AS bid_px, arg_max(qty, s.price) FILTER (WHERE side = 'B') AS bid_qty,
           min(s.price) FILTER (WHERE side = 'S') AS ask_px, arg_min(qty, s.price) FILTER (WHERE side = 'S') AS ask_qty
    FROM book k JOIN seg s ON k.locate = s.locate AND s.a < k.idx AND k.idx <= s.b GROUP BY k.idx) t ON k.idx = t.idx
), running AS (
  SELECT k.idx, k.type, (sum(coalesce(d, 0)) OVER (ORDER BY k.idx))::BIGINT AS live FROM book k LEFT JOIN (
    SELECT idx, sum(d) AS d FROM (SELECT born AS idx, 1 AS d FROM life UNION ALL SELECT died, -1 FROM life WHERE died IS NOT NULL) GROUP BY idx) s ON k.idx = s.idx
), stated AS (
  SELECT idx, locate, type, session, ts_ns, last_value(state IGNORE NULLS) OVER (PARTITION BY locate ORDER BY idx ROWS UNBOUNDED PRECEDING) AS state FROM m
), bucketed AS (
  SELECT p.*, a.state, CASE WHEN p.ts_ns < 34200000000000 OR p.ts_ns >= 57600000000000 THEN 0 WHEN a.state = 'T' THEN 1 ELSE 2 END AS bucket,
         bid_qty <> 0 AND ask_qty <> 0 AND bid_px > ask_px AS crossed, bid_qty <> 0 AND ask_qty <> 0 AND bid_px = ask_px AS locked
  FROM post p JOIN stated a ON p.idx = a.idx
), asked AS (
  SELECT m.idx, m.locate, 'add' AS kind, m.side, m.price FROM m WHERE type = 'A'
  UNION ALL SELECT e.idx, e.msg_locate, 'replace_new', e.side, m.price FROM eff e JOIN m ON e.idx = m.idx WHERE e.type = 'U'
  UNION ALL SELECT idx, msg_locate, CASE type WHEN 'E' THEN 'executed' WHEN 'X' THEN 'cancelled' WHEN 'D' THEN 'deleted' ELSE 'replaced' END, side, price FROM eff
), dist AS (
  SELECT kind, CASE WHEN best IS NULL THEN 'no_best' WHEN diff >= 0 THEN 'behind' ELSE 'improve' END AS way,
         (abs(diff) // CASE WHEN best >= 10000 THEN 100 ELSE 1 END)::BIGINT AS ticks
  FROM (SELECT kind, best, CASE WHEN side = 'B' THEN best - price ELSE price - best END AS diff
        FROM (SELECT q.*, CASE WHEN side = 'B' THEN CASE WHEN bid_qty <> 0 THEN bid_px END ELSE CASE WHEN ask_qty <> 0 THEN ask_px END END AS best
              FROM asked q JOIN pre p ON q.idx = p.idx))
), sig AS (
  SELECT * FROM (
    SELECT idx, locate, CASE WHEN bid_qty >= 4 * ask_qty THEN 1 WHEN ask_qty >= 4 * bid_qty THEN 2 END AS action,
           CASE WHEN bid_qty >= 4 * ask_qty THEN ask_px ELSE bid_px END AS price, 100 AS qty
    FROM post WHERE bid_qty <> 0 AND ask_qty <> 0 AND ask_px > bid_px AND ask_px - bid_px <= 500) WHERE action IS NOT NULL
)"""

RUNS = """
runs AS (SELECT l_returnflag || l_linestatus AS variant, l_orderkey % 10 AS run, round(l_extendedprice)::BIGINT AS sample FROM lineitem)"""
PINGS = """
pings AS (
  SELECT l_suppkey % 8 AS cpu_a, l_partkey % 8 AS cpu_b, l_orderkey % 10 AS run, 0::BIGINT AS t0, (l_quantity * 10)::BIGINT AS tb,
         (1000 + round(round(l_extendedprice) % 500))::BIGINT AS t3 FROM lineitem
)"""


def on_events(select: str, touch: bool = False, more: str = "") -> str:
    return f"WITH RECURSIVE {_events(touch)}, {_LIFE}{',' + more if more else ''}\n{select}"


_NAMES = "m cand ends dead chain life eff rem dep steps seg book post pre running stated bucketed asked dist sig".split()


def twice(mutation: str) -> str:
    """A second chain over the messages that ``mutation`` keeps; its tables end in ``_2``."""
    renamed = re.sub(rf"\b({'|'.join(_NAMES)})\b", r"\1_2", _LIFE)
    return f" m_2 AS (SELECT * FROM m WHERE {mutation}), {renamed}"


def on_orders(select: str) -> str:
    return f"WITH RECURSIVE {ORDERS}, {_LIFE}\n{select}"


def on_days(select: str) -> str:
    return f"WITH RECURSIVE {DAILY}\n{select}"


def on_runs(select: str, more: str = "") -> str:
    return f"WITH {RUNS}, {PINGS}{',' + more if more else ''}\n{select}"


def bucket(value: str) -> str:
    shift = f"greatest(length(bin({value})) - 8, 0)"
    return f"({shift} * 128 + ({value} >> ({shift})::INT))::BIGINT"


def highest(b: str) -> str:
    shift = f"greatest({b} // 128 - 1, 0)"
    return f"((({b} - {shift} * 128) << ({shift})::INT) + (1::BIGINT << ({shift})::INT) - 1)"


def lowest(b: str) -> str:
    shift = f"greatest({b} // 128 - 1, 0)"
    return f"(({b} - {shift} * 128) << ({shift})::INT)"


def quantiles(source: str, value: str, keys: str, shares: dict[str, float]) -> str:
    """``keys, n, <name>..., max, mean`` of a table's values, through the histogram."""
    by = f"PARTITION BY {keys} " if keys else ""
    head = f"{keys}, " if keys else ""
    found = ", ".join(
        f"least(min({highest('b')}) FILTER (WHERE upto >= greatest(1, ceil({q} * alln))), max(top))::BIGINT AS {name}" for name, q in shares.items()
    )
    return f"""
SELECT {head}sum(n)::BIGINT AS n, {found}, max(top) AS max, sum(total)::BIGINT / sum(n)::BIGINT AS mean FROM (
  SELECT *, sum(n) OVER ({by}ORDER BY b) AS upto, sum(n) OVER ({by.strip()}) AS alln, max(most) OVER ({by.strip()}) AS top FROM (
    SELECT {head}{bucket(value)} AS b, count(*) AS n, sum({value}) AS total, max({value}) AS most FROM {source} GROUP BY {head}2{'' if keys else ''}))
{'GROUP BY ' + keys if keys else ''}"""
