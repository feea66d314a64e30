"""Messages, record state and streams (batch form; the stream forms run in the tests)."""
import uuid

from pyspark.sql import functions as F

from dossierflow.catalog import query
from dossierflow.functions import dates as dt
from dossierflow.functions import text as tx
from dossierflow.functions.text import q_list, q_str
from dossierflow.operators import ledger as lg
from dossierflow.operators import listings as ls
from dossierflow.operators import messages as ms
from dossierflow.queries.listings import _event_rows, _runs
from dossierflow.operators.scale import shared_folder
from dossierflow.streaming import jobs, tracker

CLS = """CASE WHEN event_type = 'error' AND value >= 50 THEN 'rejection' WHEN event_type = 'error' THEN 'bounce' WHEN event_type = 'view' THEN 'read' WHEN event_type = 'click' THEN 'ack' WHEN event_type = 'signup' THEN 'info' ELSE 'offer' END"""
# Patterns made of words that occur in the given conversations.
W = lambda *ws: r"(?i)(?:^|[^\p{L}])(?:" + "|".join(ws) + r")(?:[^\p{L}]|$)"
NEVER = r"$^"
RULES = ms.MessageRules(
    bounce=ms.Cue(W("system")), delay=ms.Cue(NEVER), receipt_subject=ms.Cue(r"^read:"), away=ms.Cue(W("thou", "sur")), away_subject=ms.Cue(r"^auto"),
    offer=ms.Cue(W("ble", "elle"), veto_before=W("the", "la")), rejection=ms.Cue(W("hein", "pas"), veto_before=W("of", "de")),
    weak_rejection=ms.Cue(W("from", "dans")), interview=ms.Cue(W("lyand", "aux", "sie"), veto_before=W("the", "und"), veto_after=W("that", "les")),
    info=ms.Cue(W("ing", "oi")), ack=ms.Cue(W("with", "avec", "mit")))


def _user_day(t):
    return t.events.select("event_id", "user_id", F.to_date("ts").alias("day"), "ts", F.expr(CLS).alias("cls"))


def _sent(cue):
    """First sentence with a hit that no veto rules out: hits are marked, and each is judged by what stands before and after it."""
    parts = f"string_split(regexp_replace(s, {q_str(f'({cue.pattern})')}, chr(1) || '\\1' || chr(2), 'g'), chr(1))"
    pre = "replace(array_to_string(list_slice(ps, 1, k), ''), chr(2), '')"
    post = "array_to_string(list_slice(string_split(array_to_string(list_slice(ps, k + 1, len(ps)), ''), chr(2)), 2, 2000000000), '')"
    vetoes = " AND ".join(f"NOT regexp_matches({x}, {q_str(v)})" for x, v in ((pre, cue.veto_before), (post, cue.veto_after)) if v != "(?!)") or "true"
    free = f"len(list_filter(list_transform([{parts}], lambda ps: len(list_filter(range(1, len(ps)), lambda k: {vetoes})) > 0), lambda x: x)) > 0"
    return f"list_filter(ss, lambda s: regexp_matches(s, {q_str(cue.pattern)}) AND {free})[1]"


def _classify_sql():
    cols = ", ".join(f"{_sent(getattr(RULES, n))} AS {n}" for n in ("away", "offer", "rejection", "weak_rejection", "interview", "info", "ack"))
    return f"""WITH m AS (SELECT conv_id, turn, role = 'system' AS auto, regexp_split_to_array(role || chr(10) || {tx.q_strip('text')}, '[.!?\\n]+') AS ss, role FROM conversations),
c AS (SELECT conv_id, turn, auto, role, {cols} FROM m)
SELECT conv_id, turn, CASE WHEN regexp_matches(role, {q_str(RULES.bounce.pattern)}) THEN 'bounce' WHEN auto AND away IS NOT NULL THEN 'auto_reply' WHEN offer IS NOT NULL AND rejection IS NULL THEN 'offer'
  WHEN rejection IS NOT NULL AND interview IS NOT NULL THEN 'interview' WHEN rejection IS NOT NULL THEN 'rejection' WHEN interview IS NOT NULL THEN 'interview' WHEN info IS NOT NULL THEN 'info' WHEN away IS NOT NULL THEN 'auto_reply'
  WHEN weak_rejection IS NOT NULL THEN 'rejection' WHEN ack IS NOT NULL THEN 'ack' WHEN auto THEN 'auto_reply' ELSE 'other' END AS cls,
 CASE WHEN regexp_matches(role, {q_str(RULES.bounce.pattern)}) THEN 95 WHEN auto AND away IS NOT NULL THEN 85 WHEN offer IS NOT NULL AND rejection IS NULL THEN 80
  WHEN rejection IS NOT NULL AND interview IS NOT NULL THEN 45 WHEN rejection IS NOT NULL THEN 85 WHEN interview IS NOT NULL THEN CASE WHEN ack IS NOT NULL OR weak_rejection IS NOT NULL THEN 45 ELSE 85 END
  WHEN info IS NOT NULL THEN 75 WHEN away IS NOT NULL THEN 70 WHEN weak_rejection IS NOT NULL THEN 45 WHEN ack IS NOT NULL THEN 80 WHEN auto THEN 60 ELSE 30 END::INT AS conf FROM c"""


@query("k1_dedupe_messages", "SELECT event_id, user_id, key FROM (SELECT event_id, user_id, md5(user_id::VARCHAR || '|' || event_type || '|' || (ts::DATE)::VARCHAR) AS key, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def _(t):
    key = F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.to_date("ts").cast("string")))
    return ms.dedupe(t.events, key, [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "key")


@query("k2_classify_messages", _classify_sql())
def _(t):
    m = t.conversations.select("conv_id", "turn", F.col("role").alias("subject"), "text", (F.col("role") == "system").alias("auto_submitted"),
                               F.lit(False).alias("is_report"), F.lit(False).alias("is_receipt"))
    return ms.classify(m, RULES).select("conv_id", "turn", "cls", F.round(F.col("conf") * 100).cast("int").alias("conf"))


Q_FOLD = """SELECT user_id, day, CASE WHEN bool_or(cls = 'rejection') THEN 'rejected' WHEN max(CASE cls WHEN 'ack' THEN 4 WHEN 'info' THEN 5 WHEN 'offer' THEN 7 END) = 7 THEN 'offer'
  WHEN max(CASE cls WHEN 'ack' THEN 4 WHEN 'info' THEN 5 WHEN 'offer' THEN 7 END) = 5 THEN 'info' WHEN bool_or(cls = 'ack') THEN 'ack' WHEN bool_or(cls = 'bounce') THEN 'bounced' ELSE 'applied' END AS stage FROM {src} GROUP BY ALL"""
Q_ITEMS = f"WITH items AS (SELECT event_id, user_id, ts::DATE AS day, ts, {CLS} AS cls FROM events)"


@query("k3_fold_stage", Q_ITEMS + " " + Q_FOLD.format(src="items"))
def _(t):
    return ms.fold_stage(_user_day(t), ["user_id", "day"], "cls", "ts", F.lit("applied"))


@query("k4_fold_dates", f"""SELECT user_id, max(CASE WHEN dir = 'in' AND cls <> 'read' THEN day END) AS last_inbound, min(CASE WHEN dir = 'in' AND cls = 'read' THEN day END) AS opened, min(CASE WHEN dir = 'out' THEN day END) AS sent
FROM (SELECT user_id, ts::DATE AS day, {CLS} AS cls, CASE WHEN event_type = 'purchase' THEN 'out' ELSE 'in' END AS dir FROM events) GROUP BY 1""")
def _(t):
    items = t.events.select("user_id", F.expr(CLS).alias("cls"), "event_type", F.to_date("ts").alias("day"))
    return ms.fold_dates(items, ["user_id"], "cls", F.when(F.col("event_type") == "purchase", "out").otherwise("in"), F.col("day"))


@query("k5_replay", Q_ITEMS + ", kept AS (SELECT * FROM items WHERE event_id % 9 <> 0) " + Q_FOLD.format(src="kept"))
def _(t):
    items = _user_day(t)
    return ms.fold_stage(ms.replay(items, items.where("event_id % 9 = 0"), "event_id"), ["user_id", "day"], "cls", "ts", F.lit("applied"))


# The twin of the ledger is a plain recursion: one message of every record at a time.
def _stage_after(stage, out, cls):
    rank = lambda x: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ms.STAGE_RANK.items()) + " END"
    return f"""CASE WHEN {out} THEN CASE WHEN {stage} IN {q_list(lg.UNSENT)} THEN 'applied' ELSE {stage} END WHEN {stage} IN ('withdrawn', 'rejected') THEN {stage}
  WHEN {cls} = 'rejection' THEN 'rejected' WHEN {cls} = 'bounce' THEN CASE WHEN {stage} IN ('prepared', 'applied') THEN 'bounced' ELSE {stage} END
  WHEN {cls} IN {q_list(tuple(ms.FORWARD_RANK))} THEN CASE WHEN {rank(cls)} > {rank(stage)} THEN {cls} ELSE {stage} END
  WHEN {stage} = 'prepared' OR ({stage} = 'silent' AND {cls} <> 'read') THEN 'applied' ELSE {stage} END"""


def _states(name, items, first):
    return f"""{name} AS (SELECT user_id, 0 AS i, stage, sent, last_inbound, opened, prepared, NULL::BIGINT AS item FROM {first}
  UNION ALL SELECT e.user_id, e.i, {_stage_after('r.stage', 'e.out', 'e.cls')},
    CASE WHEN e.out AND (r.stage IN {q_list(lg.UNSENT)} OR r.sent IS NULL OR e.day < r.sent) THEN e.day WHEN NOT e.out AND r.stage = 'prepared' AND r.sent IS NULL THEN coalesce(r.prepared, e.day) ELSE r.sent END,
    CASE WHEN NOT e.out AND e.cls <> 'read' AND (r.last_inbound IS NULL OR e.day > r.last_inbound) THEN e.day ELSE r.last_inbound END,
    CASE WHEN NOT e.out AND e.cls = 'read' AND (r.opened IS NULL OR e.day < r.opened) THEN e.day ELSE r.opened END, r.prepared, e.item
  FROM {name} r JOIN {items} e ON e.user_id = r.user_id AND e.i = r.i + 1)"""


def _writes(name, states):
    one = lambda f: f"SELECT user_id, i, item, '{f}' AS field, lag({f}) OVER o::VARCHAR AS was, {f}::VARCHAR AS became FROM {states} WINDOW o AS (PARTITION BY user_id ORDER BY i)"
    return f"{name} AS (SELECT * FROM (" + " UNION ALL ".join(one(f) for f in lg.FIELDS) + ") WHERE i > 0 AND was IS DISTINCT FROM became)"


Q_LEDGER = f"""WITH RECURSIVE items AS (SELECT event_id, user_id, ts::DATE AS day, ts, {CLS} AS cls, event_type = 'purchase' AS out FROM events),
e AS (SELECT user_id, event_id AS item, day, cls, out, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM items),
first AS (SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'prepared' WHEN 1 THEN 'draft' WHEN 2 THEN 'silent' ELSE 'applied' END AS stage, CASE WHEN user_id % 4 = 3 THEN DATE '2024-01-05' END AS sent,
  NULL::DATE AS last_inbound, NULL::DATE AS opened, CASE WHEN user_id % 8 = 0 THEN DATE '2023-12-30' END AS prepared FROM (SELECT DISTINCT user_id FROM events)),
{_states('states', 'e', 'first')}, {_writes('writes', 'states')}"""


def _ledger_inputs(t):
    rows = t.events.select("user_id", F.col("event_id").alias("item"), F.expr(CLS).alias("cls"), F.when(F.col("event_type") == "purchase", "out").otherwise("in").alias("dir"),
                           F.to_date("ts").alias("day"), "ts")
    items = ms.ordered_replay(rows, ["user_id"], "ts", "item", F.unix_date("day").cast("long")).drop("ts")
    u = F.col("user_id")
    none = F.lit(None).cast("date")
    records = t.events.select("user_id").distinct().select(
        "user_id", F.element_at(F.array(*map(F.lit, ("prepared", "draft", "silent", "applied"))), (u % 4 + 1).cast("int")).alias("stage"),
        F.when(u % 4 == 3, F.lit("2024-01-05").cast("date")).alias("sent"), none.alias("last_inbound"), none.alias("opened"), F.when(u % 8 == 0, F.lit("2023-12-30").cast("date")).alias("prepared"))
    return items, records


@query("k5_field_ledger", Q_LEDGER + " SELECT user_id, i::INT AS seq, item, field, was, became FROM writes")
def _(t):
    """Every event is a message of its user's record; what each of them changed."""
    return lg.field_ledger(*_ledger_inputs(t), "user_id")


@query("k5_undo_confirm", Q_LEDGER + f""", d AS (SELECT item, user_id, CASE WHEN item % 9 = 7 THEN 'confirm' WHEN item % 9 = 4 THEN 'ignore' ELSE 'undo' END AS action, user_id + 1 AS to_user FROM e WHERE item % 9 IN (0, 4, 7)),
taken AS (SELECT * FROM d WHERE action <> 'confirm' OR to_user IN (SELECT user_id FROM first)),
kept AS (SELECT *, lag(became) OVER (PARTITION BY user_id, field ORDER BY i) AS before FROM writes WHERE item NOT IN (SELECT item FROM taken)),
last AS (SELECT user_id, field, arg_max(became, i) AS v FROM kept GROUP BY ALL),
receipts AS (SELECT user_id, min(day) AS day FROM e WHERE NOT out AND cls = 'read' AND item NOT IN (SELECT item FROM taken) GROUP BY 1),
mid AS (SELECT f.user_id, coalesce(s.v, f.stage) AS stage, coalesce(n.v::DATE, f.sent) AS sent, l.v::DATE AS last_inbound, r.day AS opened, prepared FROM first f
  LEFT JOIN last s ON s.user_id = f.user_id AND s.field = 'stage' LEFT JOIN last n ON n.user_id = f.user_id AND n.field = 'sent' LEFT JOIN last l ON l.user_id = f.user_id AND l.field = 'last_inbound' LEFT JOIN receipts r ON r.user_id = f.user_id),
e2 AS (SELECT t.to_user AS user_id, e.item, day, cls, out, row_number() OVER (PARTITION BY t.to_user ORDER BY e.item) AS i FROM taken t JOIN e USING (item) WHERE action = 'confirm'),
{_states('states2', 'e2', 'mid')}, {_writes('writes2', 'states2')},
n AS (SELECT user_id, count(*) AS n FROM (SELECT user_id FROM kept UNION ALL SELECT user_id FROM writes2) GROUP BY 1)
SELECT user_id, stage, sent, last_inbound, opened, coalesce(n, 0) AS n_writes FROM (SELECT * FROM states2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1) LEFT JOIN n USING (user_id)""")
def _(t):
    """A ninth of the messages each is undone, ignored, or confirmed for the next user's record instead."""
    items, records = _ledger_inputs(t)
    action = F.when(F.col("item") % 9 == 7, "confirm").when(F.col("item") % 9 == 4, "ignore").otherwise("undo")
    decisions = items.where((F.col("item") % 9).isin(0, 4, 7)).select("item", action.alias("action"), (F.col("user_id") + 1).alias("to"), F.col("item").alias("at"))
    state, ledger = lg.decided(records, items, decisions, "user_id")
    n = ledger.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_writes"))
    return state.join(n, "user_id", "left").select("user_id", "stage", "sent", "last_inbound", "opened", F.coalesce("n_writes", F.lit(0)).alias("n_writes"))


@query("k8_stream_records", Q_LEDGER.replace("e AS (SELECT user_id, event_id AS item, day, cls, out, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM items),",
  """e AS (SELECT user_id, event_id AS item, day, cls, out, row_number() OVER (PARTITION BY user_id ORDER BY ms, message) AS i FROM (
  SELECT * FROM (SELECT *, epoch_ms(ts) AS ms, cls || '|' || day::VARCHAR || '|' || (event_id % 3)::VARCHAR AS message FROM items WHERE event_id % 7 <> 3)
  QUALIFY row_number() OVER (PARTITION BY user_id, message ORDER BY ms) = 1)),""") + """
SELECT user_id, stage, sent::VARCHAR AS sent, last_inbound::VARCHAR AS last_inbound, opened::VARCHAR AS opened FROM states
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1 AND (max(i) OVER (PARTITION BY user_id)) > 0""")
def _(t):
    """The events as a stream of messages over the users' records, from the first to the last state: what it wrote, read back. Class, day and a
    third of the ids make a message's key; every seventh is left unmatched and read again when it comes again."""
    _, records = _ledger_inputs(t)
    key = F.concat_ws("|", F.expr(CLS), F.to_date("ts").cast("string"), (F.col("event_id") % 3).cast("string"))
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parquet*")
    stream = events.select("user_id", key.alias("message"), F.when(F.col("event_type") == "purchase", "out").otherwise("in").alias("dir"), F.expr(CLS).alias("cls"),
                           F.when(F.col("event_id") % 7 == 3, "unmatched").otherwise("auto").alias("decision"), F.col("ts").cast("timestamp").alias("ts"))
    folder = f"{shared_folder(t.spark)}/tracker-{uuid.uuid4().hex}"
    tracker.run_available(stream, records, "user_id", "ts", folder).awaitTermination()
    return tracker.latest(t.spark, f"{folder}/records").select(F.col("key").cast("long").alias("user_id"), "stage", "sent", "last_inbound", "opened")


_IN_WINDOW = "list_filter(r.times, lambda x: e.t - x < 86400000000)"


@query("k6_admit_requests", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, true AS accepted, [t] AS times FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, len({_IN_WINDOW}) < 3, CASE WHEN len({_IN_WINDOW}) < 3 THEN list_append({_IN_WINDOW}, e.t) ELSE {_IN_WINDOW} END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, accepted FROM r""")
def _(t):
    """Accepted-only limiter; a test also compares it with a plain loop."""
    return jobs.admit_batch(t.events, "user_id", "ts", "event_id", 3, 86400)


@query("k7_ordered_replay", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 10 = 0, CASE WHEN event_id % 10 <> 0 THEN ts END, event_id)::INT AS seq FROM events")
def _(t):
    """Every tenth event is undated and comes last."""
    items = t.events.select("user_id", "event_id", F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("d"))
    bucket = F.coalesce(F.unix_date(F.to_date("d")).cast("long"), F.floor(F.col("event_id") / 4096))
    return ms.ordered_replay(items, ["user_id"], "d", "event_id", bucket).select("user_id", "event_id", "seq")


@query("k8_merge_back", Q_ITEMS + """, f AS (SELECT user_id, CASE WHEN bool_or(cls = 'rejection') THEN 'rejected' WHEN bool_or(cls = 'offer') THEN 'offer' WHEN bool_or(cls = 'info') THEN 'info' WHEN bool_or(cls = 'ack') THEN 'ack' WHEN bool_or(cls = 'bounce') THEN 'bounced' ELSE 'applied' END AS stage,
  max(CASE WHEN cls <> 'read' THEN day END) AS last_inbound FROM items GROUP BY 1), r AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'rejected' ELSE 'ack' END AS stage, CASE WHEN user_id % 3 = 0 THEN DATE '2024-01-30' ELSE DATE '2024-01-02' END AS last_inbound FROM (SELECT DISTINCT user_id FROM events)),
j AS (SELECT r.user_id, CASE WHEN f.stage IS DISTINCT FROM r.stage THEN f.stage END AS stage, CASE WHEN f.last_inbound IS NOT NULL AND f.last_inbound IS DISTINCT FROM r.last_inbound THEN f.last_inbound END AS last_inbound FROM r JOIN f ON r.user_id = f.user_id)
SELECT * FROM j WHERE stage IS NOT NULL OR last_inbound IS NOT NULL""")
def _(t):
    items = _user_day(t)
    dates = ms.fold_dates(items, ["user_id"], "cls", F.lit("in"), F.col("day")).select("user_id", "last_inbound")
    folded = ms.fold_stage(items, ["user_id"], "cls", "ts", F.lit("applied")).join(dates, "user_id")
    records = t.events.select("user_id").distinct().select("user_id", F.when(F.col("user_id") % 2 == 0, "rejected").otherwise("ack").alias("stage"), F.when(
        F.col("user_id") % 3 == 0, F.lit("2024-01-30").cast("date")).otherwise(F.lit("2024-01-02").cast("date")).alias("last_inbound"))
    return ms.merge_back(records, folded, "user_id", ["stage", "last_inbound"])


@query("k9_daily_refresh", """WITH per_day AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT DISTINCT user_id FROM events), l AS (SELECT max(ts)::DATE AS d FROM events), today AS (SELECT user_id, n FROM per_day WHERE day = (SELECT d FROM l)),
prev AS (SELECT user_id, n, day, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rk FROM per_day WHERE day BETWEEN (SELECT d - 7 FROM l) AND (SELECT d - 1 FROM l))
SELECT u.user_id, e.event_id, t.n IS NULL AS stale, CASE WHEN t.n IS NULL THEN p.day END AS stale_since FROM u LEFT JOIN today t ON u.user_id = t.user_id LEFT JOIN prev p ON u.user_id = p.user_id AND p.rk = 1
JOIN events e ON e.user_id = u.user_id AND e.ts::DATE = CASE WHEN t.n IS NULL THEN p.day ELSE (SELECT d FROM l) END""")
def _(t):
    """The last day's collection over the snapshots before it."""
    today = _runs(t).agg(F.max("day").alias("day"))  # one row
    return ls.carry_rows(_event_rows(t), _runs(t), "user_id", "day").join(today, "day", "left_semi").drop("day")


@query("k10_incremental_since", """SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 2 DAY""")
def _(t):
    """Last check on 20 January with two days of overlap, read twice and deduplicated."""
    twice = t.events.unionByName(t.events)
    got = jobs.incremental_since(twice, "ts", F.lit("2024-01-18 00:00:00").cast("timestamp_ntz"), "event_id")
    return got.select("event_id", "user_id", "event_type")


@query("k11_pending_followups", "SELECT o_orderkey, o_orderdate::DATE + 4 AS due FROM orders WHERE o_orderdate::DATE + 4 <= DATE '1999-06-01' AND o_orderstatus = 'O'")
def _(t):
    records = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("sent"), F.when(F.col("o_orderstatus") != "O", F.to_date("o_orderdate")).alias("last_inbound"))
    return ms.pending_follow_ups(records, "sent", "last_inbound", F.lit("1999-06-01").cast("date")).select("o_orderkey", "due")


@query("s23_strip_quoted", f"SELECT conv_id, turn, {tx.q_strip('text')} AS reply FROM conversations")
def _(t):
    """Every message gets a quoted original appended, and loses it again."""
    quoted = F.concat("text", F.lit("\n> older line\nOn Monday someone wrote:\n"), "text")
    return t.conversations.select("conv_id", "turn", ms.strip_quoted(quoted).alias("reply"))


@query("s24_normal_subject", r"SELECT conv_id, turn, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[\s—–-]+', ' ', 'g')) AS subject FROM conversations")
def _(t):
    raw = F.concat(F.lit("RE: AW: [ext] Fwd: "), F.substring_index("text", "\n", 1))
    return t.conversations.select("conv_id", "turn", ms.normal_subject(raw).alias("subject"))


@query("s25_snippet", r"""SELECT conv_id, turn, trim(regexp_extract(text, '((?:^|\s).{0,40}?(?:lyand|tion|lich).{0,60}(?:\s|$)|(?:lyand|tion|lich))', 1)) AS evidence FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", ms.snippet(F.col("text"), "lyand|tion|lich").alias("evidence"))


@query("s26_content_key", r"""SELECT conv_id, turn, 'c:' || md5(role || '|' || trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[\s—–-]+', ' ', 'g')) || '|' || trim(regexp_replace(""" + tx.q_strip("text") + r""", '\s+', ' ', 'g'))) AS key FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", ms.content_key("role", F.concat(F.lit("Re: "), F.substring_index("text", "\n", 1)), "text").alias("key"))
