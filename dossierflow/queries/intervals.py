"""Intervals, recency and date functions."""
from pyspark.sql import functions as F

from dossierflow.catalog import query
from dossierflow.functions import dates as dt
from dossierflow.functions import text as tx
from dossierflow.functions.text import q_str
from dossierflow.operators import intervals as iv
from dossierflow.operators.scale import join_small
from dossierflow.tables import Q_ORDER_ROLES

TODAY = 2001 * 12 + 11  # December 2001

Q_ISLANDS = f"""WITH {Q_ORDER_ROLES}, s AS (SELECT o_custkey, from_ix, max(to_ix) AS to_ix FROM order_roles GROUP BY ALL),
m AS (SELECT *, CASE WHEN from_ix <= max(to_ix) OVER (PARTITION BY o_custkey ORDER BY from_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new_ FROM s),
i AS (SELECT *, sum(new_) OVER (PARTITION BY o_custkey ORDER BY from_ix)::INT AS island FROM m),
islands AS (SELECT o_custkey, island, min(from_ix) AS from_ix, max(to_ix) AS to_ix FROM i GROUP BY ALL)"""


@query("f4_merge_intervals", Q_ISLANDS + " SELECT * FROM islands")
def _(t):
    return iv.merge_intervals(t.order_roles, "o_custkey")


@query("f5_timeline_gaps", Q_ISLANDS + f""", n AS (SELECT *, lead(from_ix) OVER (PARTITION BY o_custkey ORDER BY from_ix) AS nx FROM islands),
o AS (SELECT o_custkey, bool_or(o_orderstatus = 'O') AS op FROM order_roles GROUP BY 1),
g AS (SELECT o_custkey, to_ix + 1 AS gap_from, (CASE WHEN nx IS NOT NULL THEN nx - 1 WHEN NOT op AND {TODAY} - to_ix >= 6 THEN {TODAY} END)::INT AS gap_to, nx IS NULL AS trailing FROM n JOIN o USING (o_custkey))
SELECT *, gap_to - gap_from + 1 AS months, CASE WHEN gap_to - gap_from + 1 > 12 THEN 'med' ELSE 'low' END AS sev FROM g WHERE gap_to - gap_from + 1 >= 6""")
def _(t):
    return iv.timeline_gaps(t.order_roles, "o_custkey", TODAY, is_open=F.col("o_orderstatus") == "O")


Q_RECENCY = f"""WITH {Q_ORDER_ROLES}, r0 AS (SELECT o_custkey, o_orderkey, n_lines, CASE WHEN o_orderkey % 7 <> 0 THEN from_ix END AS from_ix, CASE WHEN o_orderkey % 7 <> 0 THEN to_ix END AS to_ix FROM order_roles),
r1 AS (SELECT *, coalesce(CASE WHEN from_ix IS NOT NULL THEN o_orderkey END, last_value(CASE WHEN from_ix IS NOT NULL THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS p FROM r0),
r2 AS (SELECT r1.*, q.to_ix AS pt, q.from_ix AS pf FROM r1 LEFT JOIN r0 q ON r1.p = q.o_orderkey),
ranked AS (SELECT o_custkey, o_orderkey, n_lines, from_ix, to_ix, (row_number() OVER (PARTITION BY o_custkey ORDER BY p IS NOT NULL, pt DESC, pf DESC, p, from_ix IS NULL, CASE WHEN from_ix IS NULL THEN -o_orderkey END) - 1)::INT AS recency FROM r2)"""


def _ranked(t):
    roles = t.order_roles.select("o_custkey", "o_orderkey", "n_lines", *[
        F.when(F.col("o_orderkey") % 7 != 0, F.col(c)).alias(c) for c in ("from_ix", "to_ix")])
    return iv.recency_rank(roles, "o_custkey", "o_orderkey")


@query("f6_recency_rank", Q_RECENCY + " SELECT o_custkey, o_orderkey, recency FROM ranked")
def _(t):
    return _ranked(t).select("o_custkey", "o_orderkey", "recency")


@query("f7_out_of_order_pairs", """SELECT user_id, event_id, above FROM (SELECT user_id, event_id, e, lag(e) OVER w AS pe, lag(event_id) OVER w AS above
  FROM (SELECT *, epoch(ts)::BIGINT // 3600 + floor(value)::BIGINT AS e FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE pe < e""")
def _(t):
    """Stored order is ``event_id``; an event's end is its hour plus ``value`` hours."""
    end = F.floor(F.unix_timestamp("ts") / 3600) + F.floor("value")
    return iv.out_of_order(t.events, ["user_id"], "event_id", end).select("user_id", "event_id", "above")


@query("f8_count_band_by_rank", Q_RECENCY + """ SELECT o_custkey, o_orderkey, recency, n_lines, CASE WHEN recency <= 2 AND n_lines = 0 THEN 'med' ELSE 'low' END AS sev FROM ranked
WHERE NOT (CASE WHEN recency = 0 THEN n_lines BETWEEN 4 AND 6 WHEN recency <= 2 THEN n_lines BETWEEN 2 AND 4 ELSE n_lines <= 3 END)""")
def _(t):
    return iv.count_band(_ranked(t), "recency", "n_lines").select("o_custkey", "o_orderkey", "recency", "n_lines", "sev")


@query("f11_weakest_lines", Q_RECENCY + """, l AS (SELECT o_custkey, recency, o_orderkey * 100 + l_linenumber AS pos, (l_discount = 0)::INT + (l_tax = 0)::INT + (l_quantity < 10)::INT AS n_reasons
  FROM ranked JOIN lineitem ON o_orderkey = l_orderkey WHERE recency < 3)
SELECT o_custkey, recency, n_reasons, pos, rk::INT AS rk FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY recency, n_reasons DESC, pos) AS rk FROM l WHERE n_reasons > 0) WHERE rk <= 3""")
def _(t):
    reasons = ((F.col("l_discount") == 0).cast("int") + (F.col("l_tax") == 0).cast("int") + (F.col("l_quantity") < 10).cast("int"))
    lines = (_ranked(t).where("recency < 3").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
             .select("o_custkey", "recency", reasons.alias("n_reasons"), (F.col("o_orderkey") * 100 + F.col("l_linenumber")).alias("pos")))
    return iv.weakest_lines(lines, "o_custkey")


@query("f13_first_by_priority", """SELECT s_nationkey, coalesce(max(CASE WHEN k = 0 THEN s_name END), max(CASE WHEN k = 1 THEN s_name END)) AS headline FROM (
  SELECT s_nationkey, s_name, CASE WHEN s_acctbal > 9000 THEN 0 ELSE 1 END AS k, row_number() OVER (PARTITION BY s_nationkey, s_acctbal > 9000 ORDER BY s_suppkey) AS rn FROM supplier WHERE s_acctbal > 0) WHERE rn = 1 GROUP BY 1""")
def _(t):
    rows = t.supplier.select("s_nationkey", F.when(F.col("s_acctbal") > 0, F.col("s_name")).otherwise(" ").alias("headline"),
                             F.struct((F.col("s_acctbal") <= 9000).alias("a"), F.col("s_suppkey").alias("b")).alias("priority"))
    return iv.first_by_priority(rows, ["s_nationkey"], "headline", "priority")


@query("f14_trailing_rate_flag", """SELECT event_id, user_id, n::INT AS n_before, n >= 3 AS rejected FROM (
  SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW) - row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS n FROM events)""")
def _(t):
    return iv.trailing_rate(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id", 3, 86400).drop("ts")


SPAN_TERMS = ["the", "and the", "in the", "of", "of the", "the on", "le", "de la", "la"]


def _spans_sql():
    """Terms by length, the longest first; none of these can overlap more than one earlier one of its own length."""
    sizes = sorted({len(p) for p in SPAN_TERMS}, reverse=True)
    pats = ", ".join(f"({q_str(p)}, {i})" for i, p in enumerate(SPAN_TERMS))
    over = "k.doc_id = h.doc_id AND h.start < k.end AND k.start < h.end"
    parts, kept = [], []
    for n in sizes:
        free = " AND ".join(f"NOT EXISTS (SELECT 1 FROM k{m} k WHERE {over})" for m in kept) or "true"
        parts.append(f"c{n} AS MATERIALIZED (SELECT h.* FROM hits h WHERE h.end - h.start = {n} AND {free}), "
                     f"k{n} AS MATERIALIZED (SELECT h.* FROM c{n} h WHERE NOT EXISTS (SELECT 1 FROM c{n} k WHERE {over} AND k.start < h.start))")
        kept.append(n)
    return (f"""WITH low AS (SELECT doc_id, string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), ' ') AS ws FROM documents), pats(p, rank) AS (VALUES {pats}),
w AS (SELECT doc_id, w, lead(w) OVER o AS following, (sum(length(w) + 1) OVER o - length(w) - 1)::INT AS s FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM low) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hits AS MATERIALIZED (SELECT doc_id, s AS start, s + length(p) AS end, rank FROM w JOIN pats ON p = w OR p = w || ' ' || following),
""" + ",\n".join(parts) + " SELECT doc_id, start::INT AS start, \"end\"::INT AS \"end\", rank FROM (" + " UNION ALL ".join(f"SELECT * FROM k{n}" for n in sizes) + ")").replace("h.end", 'h."end"').replace("k.end", 'k."end"').replace(" AS end,", ' AS "end",').replace("\\\\", "\\")


@query("f15_strongest_span", _spans_sql())
def _(t):
    return iv.strongest_in(t.documents, "doc_id", "text", SPAN_TERMS)


@query("d8_overlapping_intervals", f"""WITH {Q_ORDER_ROLES}, l AS (SELECT * FROM order_roles WHERE to_ix - from_ix >= 1)
SELECT a.o_custkey, a.o_orderkey, a.from_ix, a.to_ix, count(*) AS n_overlaps FROM l a JOIN l b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey
WHERE least(a.to_ix, b.to_ix) - greatest(a.from_ix, b.from_ix) + 1 >= 2 GROUP BY ALL""")
def _(t):
    return iv.overlap_counts(t.order_roles, "o_custkey", "o_orderkey")


_NOTE = "CASE o.o_orderkey % 7 WHEN 0 THEN 'in parallel with high priority work' WHEN 1 THEN 'concurrently for the low desk' WHEN 2 THEN 'part-time' ELSE '' END"


@query("d8_unexplained_overlaps", rf"""WITH {Q_ORDER_ROLES}, r AS (SELECT r.o_custkey, r.o_orderkey, CASE WHEN r.o_orderkey % 5 = 0 THEN from_ix // 12 * 12 + 11 ELSE from_ix END AS from_ix,
  CASE WHEN r.o_orderkey % 5 = 1 THEN (to_ix // 12 + 1) * 12 ELSE to_ix + r.o_orderkey % 9 END AS to_ix, lower(regexp_replace(o_orderpriority, '[0-9]-', '')) || ' desk' AS title, n_name AS employer, {_NOTE} AS note
  FROM order_roles r JOIN orders o ON r.o_orderkey = o.o_orderkey JOIN nation ON n_nationkey = r.o_orderkey % 25 WHERE r.o_orderkey % 13 <> 0),
x AS (SELECT *, {tx.q_norm("note || ' ' || title")} AS said, note <> '' AND NOT note LIKE 'x%' AS noted, {tx.q_norm('employer')} AS firm, list_filter(regexp_split_to_array(lower(title), '[^\p{{L}}]+'), lambda w: length(w) >= 4) AS ws FROM r WHERE to_ix > from_ix),
p AS (SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, (a.noted AND (contains(' ' || a.said || ' ', ' ' || b.firm || ' ') OR len(list_filter(b.ws, lambda w: contains(' ' || a.said || ' ', ' ' || w || ' '))) > 0))
  OR (b.noted AND (contains(' ' || b.said || ' ', ' ' || a.firm || ' ') OR len(list_filter(a.ws, lambda w: contains(' ' || b.said || ' ', ' ' || w || ' '))) > 0)) AS explained
  FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey WHERE least(a.to_ix, b.to_ix) - greatest(a.from_ix, b.from_ix) >= 1)
SELECT x.o_custkey, x.o_orderkey, x.from_ix::INT AS from_ix, x.to_ix::INT AS to_ix, count(*) AS n_overlaps, min(b) AS partner FROM p JOIN x ON x.o_orderkey = p.a WHERE NOT explained GROUP BY ALL""")
def _(t):
    """Orders as roles; a fifth each has a bare start or end year, read as its last or first month; three kinds of note."""
    k = F.col("o_orderkey")
    note = F.when(k % 7 == 0, "in parallel with high priority work").when(k % 7 == 1, "concurrently for the low desk").when(k % 7 == 2, "part-time").otherwise("")
    year = lambda ix: F.floor(F.col(ix) / 12)
    bare = lambda y: F.struct(y.cast("int").alias("y"), F.lit(None).cast("int").alias("m"), F.lit(False).alias("is_open"))
    start, end = dt.generous_bounds(bare(year("from_ix")), bare(year("to_ix") + 1), 0)
    roles = (t.order_roles.join(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey").join(t.nation, F.col("n_nationkey") == k % 25).where(k % 13 != 0)
             .select("o_custkey", "o_orderkey", F.when(k % 5 == 0, start).otherwise(F.col("from_ix")).cast("int").alias("from_ix"),
                     F.when(k % 5 == 1, end).otherwise(F.col("to_ix") + k % 9).cast("int").alias("to_ix"),
                     F.concat(F.lower(F.regexp_replace("o_orderpriority", "[0-9]-", "")), F.lit(" desk")).alias("title"), F.col("n_name").alias("employer"), note.alias("note")))
    return iv.unexplained_overlaps(roles, "o_custkey", "o_orderkey")


@query("e15_covered_months", f"""WITH {Q_ORDER_ROLES} SELECT o_custkey, m::INT AS months, (m // 12)::INT AS years FROM (
  SELECT o_custkey, greatest(0, CASE WHEN bool_or(o_orderstatus = 'O') THEN {TODAY} ELSE max(to_ix) END - min(from_ix)) AS m FROM order_roles GROUP BY 1)""")
def _(t):
    return iv.covered_years(t.order_roles, "o_custkey", TODAY, F.col("o_orderstatus") == "O")


def _printed(t):
    """Order dates printed in the forms the readers know."""
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"),
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(d, "MM/yyyy"))
        .when(F.col("o_orderkey") % 5 == 1, F.date_format(d, "yyyy-MM"))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.date_format(d, "MMM"), F.lit(". "), F.date_format(d, "yyyy")))
        .when(F.col("o_orderkey") % 5 == 3, F.date_format(d, "yyyy")).otherwise("bis heute").alias("side"))


Q_SIDE = """CASE o_orderkey % 5 WHEN 0 THEN 'MM/YYYY' WHEN 1 THEN 'MM/YYYY' WHEN 2 THEN 'Mon YYYY' WHEN 3 THEN 'YYYY' ELSE 'open' END AS fmt,
  CASE WHEN o_orderkey % 5 < 4 THEN year(o_orderdate) END::INT AS y, CASE WHEN o_orderkey % 5 < 3 THEN month(o_orderdate) END::INT AS m, o_orderkey % 5 = 4 AS is_open"""


@query("t1_parse_month_side", f"SELECT o_orderkey, {Q_SIDE} FROM orders")
def _(t):
    return _printed(t).select("o_orderkey", dt.parse_side("side").alias("s")).select("o_orderkey", "s.*")


@query("t2_parse_range", """SELECT o_orderkey, year(o_orderdate)::INT AS from_y, CASE WHEN o_orderkey % 5 <> 3 THEN month(o_orderdate) END::INT AS from_m, CASE WHEN o_orderkey % 5 = 3 THEN year(o_orderdate) END::INT AS to_y,
  CASE o_orderkey % 5 WHEN 0 THEN '–' WHEN 1 THEN 'to' WHEN 2 THEN 'seit' WHEN 3 THEN NULL ELSE '-' END AS sep, CASE WHEN o_orderkey % 5 = 0 THEN 'part time' ELSE '' END AS note, o_orderkey % 5 = 3 AS single FROM orders""")
def _(t):
    d = F.col("o_orderdate")
    raw = (F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.date_format(d, "MM/yyyy"), F.lit(" – present (part time)")))
           .when(F.col("o_orderkey") % 5 == 1, F.concat(F.date_format(d, "MMM yyyy"), F.lit(" to now")))
           .when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("seit "), F.date_format(d, "MM.yyyy")))
           .when(F.col("o_orderkey") % 5 == 3, F.date_format(d, "yyyy"))
           .otherwise(F.concat(F.date_format(d, "MM/yyyy"), F.lit("-today"))))
    r = t.orders.select("o_orderkey", dt.parse_range(raw).alias("r"))
    return r.select("o_orderkey", F.col("r.from.y").alias("from_y"), F.col("r.from.m").alias("from_m"), F.col("r.to.y").alias("to_y"), "r.sep", "r.note", "r.single")


@query("t3_month_bounds", f"""SELECT o_orderkey, CASE WHEN is_open THEN {TODAY} ELSE y * 12 + coalesce(m, 1) - 1 END::INT AS early, CASE WHEN is_open THEN {TODAY} ELSE y * 12 + coalesce(m, 12) - 1 END::INT AS late
FROM (SELECT o_orderkey, {Q_SIDE} FROM orders)""")
def _(t):
    s = _printed(t).select("o_orderkey", dt.parse_side("side").alias("s"))
    return s.select("o_orderkey", dt.early_ix(F.col("s"), TODAY).alias("early"), dt.late_ix(F.col("s"), TODAY).alias("late"))


@query("t4_latest_past_date", """SELECT o_orderkey, CASE WHEN make_date(1999, month(o_orderdate), least(day(o_orderdate), 28)) > DATE '1999-07-15' THEN make_date(1998, month(o_orderdate), least(day(o_orderdate), 28)) ELSE make_date(1999, month(o_orderdate), least(day(o_orderdate), 28)) END AS posted FROM orders""")
def _(t):
    raw = F.concat(F.least(F.day("o_orderdate"), F.lit(28)).cast("string"), F.lit(" "), F.date_format("o_orderdate", "MMM"))
    return t.orders.select("o_orderkey", dt.latest_past(raw, F.lit("1999-07-15").cast("date")).alias("posted"))


@query("t5_export_month", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN year(o_orderdate)::VARCHAR WHEN 4 THEN 'bis heute' ELSE strftime(o_orderdate, '%b %Y') END AS shown FROM orders")
def _(t):
    return _printed(t).select("o_orderkey", dt.export_month("side").alias("shown"))


@query("t6_end_year", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 9999 ELSE year(o_orderdate) END::INT AS end_year FROM orders")
def _(t):
    return _printed(t).select("o_orderkey", dt.end_year("side").alias("end_year"))


@query("t7_read_horizon", """SELECT o_custkey, greatest(least(coalesce(min(o_orderdate)::DATE - 1, DATE '2001-08-01' - 30), DATE '2001-08-01' - 30), DATE '2001-08-01' - 120) AS read_from FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""")
def _(t):
    today = F.lit("2001-08-01").cast("date")
    return (t.orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("oldest"))
            .select("o_custkey", dt.read_horizon(F.col("oldest"), today).alias("read_from")))


@query("t8_follow_up_due", "SELECT o_orderkey, o_orderdate::DATE + 4 AS due FROM orders")
def _(t):
    return t.orders.select("o_orderkey", dt.follow_up_due(F.col("o_orderdate")).alias("due"))


@query("t9_market_display", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%m/%Y') || ' – ' || strftime(o_orderdate + INTERVAL 14 MONTH, '%m/%Y') ELSE strftime(o_orderdate, '%b %Y') || ' – ' || strftime(o_orderdate + INTERVAL 14 MONTH, '%b %Y') END AS shown FROM orders""")
def _(t):
    market = F.when(F.col("o_orderkey") % 2 == 0, "dach").otherwise("gulf")
    return t.orders.select("o_orderkey", dt.display_range(F.col("o_orderdate"), F.add_months("o_orderdate", 14), market).alias("shown"))


@query("t10_range_flags", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'unreadable' WHEN l_shipdate < o_orderdate THEN 'reversed' WHEN o_orderdate > TIMESTAMP '2001-01-01' THEN 'future' END AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 7 OR l_shipdate < o_orderdate OR o_orderdate > TIMESTAMP '2001-01-01'""")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    shipped = F.when(F.col("l_linenumber") != 7, F.col("l_shipdate"))
    flag = dt.range_flag(F.col("o_orderdate"), shipped, F.lit("2001-01-01").cast("timestamp"))
    return j.select("l_orderkey", "l_linenumber", flag.alias("flag")).where("flag IS NOT NULL")


@query("t11_older_roles", Q_RECENCY + " SELECT o_custkey, o_orderkey, recency FROM ranked WHERE recency >= 4 AND to_ix // 12 <= 2012 - 15")
def _(t):
    """Roles past the fourth newest that ended 15 or more years before the given year."""
    return iv.older_roles(_ranked(t), 2012).select("o_custkey", "o_orderkey", "recency")
