"""What each message did to its record: running stages, a ledger of field writes, and taking messages back.

A record's stage is a fold over its messages in order. Each message is a step from one of twelve stages to another, and steps compose, so a
block of messages is one array of twelve numbers; blocks are composed, each gets the stage it begins in, and its messages follow from
there. A record may have any number of messages: no task holds more than a block of them.

The ledger has a row for every field that a message changed: what it was and what it became. Taking a message back removes its rows; a field
still holding what the message set falls back to what it replaced, and a later message that started from it now starts from that.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossierflow.operators.intervals import bucketed_last
from dossierflow.operators.messages import FORWARD_RANK, STAGE_RANK
from dossierflow.operators.scale import saved

STAGES = (*STAGE_RANK, "rejected", "withdrawn")
#: Stages in which a sent copy is the first one.
UNSENT = ("none", "draft", "prepared", "bounced")
#: Messages of a block, and blocks of a group.
BLOCK = 256
FIELDS = ("stage", "sent", "last_inbound", "opened")


def step(stage: str, kind: str) -> str:
    """The stage after a message: ``sent`` for an own one, else the class of a reply. Forward only; a rejection from anywhere; a bounce only
    before any answer; being opened, or any other reply, only proves that the mail went out; a withdrawn record never moves."""
    if kind == "sent":
        return "applied" if stage in UNSENT else stage
    if stage in ("withdrawn", "rejected"):
        return stage
    if kind == "rejection":
        return "rejected"
    if kind == "bounce":
        return "bounced" if stage in ("prepared", "applied") else stage
    if kind in FORWARD_RANK:
        return kind if FORWARD_RANK[kind] > STAGE_RANK[stage] else stage
    return "applied" if stage == "prepared" or (stage == "silent" and kind != "read") else stage


KINDS = ("sent", "rejection", "bounce", "read", *FORWARD_RANK, "other")


def _effects(n: int) -> tuple:
    """How a run of messages acts on the sent day, given the stage it begins in: ``reset`` (the day no longer depends on what it was), ``low`` (the
    least day, from the last reset on) and ``fill`` (the day if there was none). Returns the step of one message and the joining of two runs."""
    table = F.array(*[F.lit(STAGES.index(step(s, k))) for k in KINDS for s in STAGES])
    unsent = F.array(*[F.lit(s in UNSENT) for s in STAGES])
    prepared = STAGES.index("prepared")

    def effect(stage, reset, low, fill) -> Column:
        return F.struct(stage.alias("stage"), reset.alias("reset"), low.alias("low"), fill.alias("fill"))

    def after(state: Column, x: Column) -> Column:
        """The state after message ``x`` (code, out, day, prepared)."""
        own = x["out"] & x["day"].isNotNull()
        anew = own & F.get(unsent, state["stage"])
        low = F.when(anew, x["day"]).when(own, F.least(state["low"], x["day"])).otherwise(state["low"])
        proves = ~x["out"] & (state["stage"] == prepared) & state["fill"].isNull()
        fill = F.when(anew, x["day"]).when(own, F.least(state["fill"], x["day"])).when(proves, F.coalesce(x["prepared"], x["day"])).otherwise(state["fill"])
        return effect(F.get(table, x["code"] * n + state["stage"]), state["reset"] | anew, low, fill)

    def joined(a: Column, b: Column) -> Column:
        """Run ``a``, then run ``b`` from the stage that ``a`` ends in."""
        low = F.when(b["reset"], b["low"]).otherwise(F.least(a["low"], b["low"]))
        fill = F.when(b["reset"], b["low"]).when(a["fill"].isNull(), b["fill"]).otherwise(F.least(a["fill"], b["low"]))
        return effect(b["stage"], a["reset"] | b["reset"], low, fill)

    return effect, after, joined


def field_ledger(items: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """``key, seq, item, field, was, became`` (values as text) of every field that a message changed.

    ``items``: key, seq, item, dir (``in`` or ``out``), cls, day (may be null); ``seq`` ascends from 0 or 1, unique and dense in the key.
    ``records``: key, stage, sent, last_inbound, opened, prepared: the state before the messages. ``sent`` is the day of the first sent copy, set
    anew by one in an unsent stage; a reply to a prepared record without it proves it sent when prepared. ``last_inbound`` is the last reply's
    day, ``opened`` the first receipt's. Messages of a key that is in no record change nothing."""
    n = len(STAGES)
    effect, after, joined = _effects(n)
    out, read = F.col("dir") == "out", F.col("cls") == "read"
    kind = F.when(out, "sent").otherwise(F.col("cls"))
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), kind), F.lit(KINDS.index("other")))
    message = F.struct(F.col("seq").cast("long").alias("seq"), "item", code.alias("code"), out.alias("out"), "day", "prepared",
                       F.when(~out & ~F.coalesce(read, F.lit(False)), F.col("day")).alias("reply"), F.when(~out & read, F.col("day")).alias("receipt"))
    rows = items.join(records.select(key, "prepared"), key).select(
        F.col(key).alias("k"), F.floor(F.col("seq") / BLOCK ** 2).alias("group"), F.floor(F.col("seq") / BLOCK).alias("block"), message.alias("x"))
    none = F.lit(None).cast("date")
    every = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: effect(s, F.lit(False), none, none))
    blocks = (rows.groupBy("k", "group", "block").agg(F.array_sort(F.collect_list("x")).alias("xs"),  # at most BLOCK messages
                                                      F.max("x.reply").alias("reply"), F.min("x.receipt").alias("receipt"))
              .withColumn("runs", F.transform(every, lambda s: F.aggregate("xs", s, after))))
    through = lambda parts: F.transform(every, lambda s: F.aggregate(parts, s, lambda a, p: joined(a, F.get(p["runs"], a["stage"]))))
    part = lambda name: F.array_sort(F.collect_list(F.struct(name, "runs", "reply", "receipt"))).alias("parts")
    groups = (blocks.groupBy("k", "group").agg(part("block"), F.max("reply").alias("reply"), F.min("receipt").alias("receipt"))  # at most BLOCK blocks
              .withColumn("runs", through("parts")))
    number = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, s in enumerate(STAGES) for x in (s, i)]), F.col("stage")), F.lit(0))
    first = records.select(F.col(key).alias("k"), F.struct(number.alias("stage"), "sent", "last_inbound", "opened").alias("now"))
    whole = groups.groupBy("k").agg(part("group")).join(first, "k")  # one group is 65,536 messages
    state = "struct<stage:int,sent:date,last_inbound:date,opened:date>"

    def ahead(now: Column, p: Column) -> Column:
        """The record's state after a part."""
        run = F.get(p["runs"], now["stage"])
        sent = F.when(run["reset"], run["low"]).when(now["sent"].isNull(), run["fill"]).otherwise(F.least(now["sent"], run["low"]))
        return F.struct(run["stage"].alias("stage"), sent.alias("sent"), F.greatest(now["last_inbound"], p["reply"]).alias("last_inbound"),
                        F.least(now["opened"], p["receipt"]).alias("opened"))

    def starts(name: str) -> Column:
        """The state that each part begins in."""
        begin = F.struct(F.col("now"), F.array().cast(f"array<struct<at:bigint,now:{state}>>").alias("out"))
        add = lambda a, p: F.struct(ahead(a["now"], p).alias("now"), F.concat(a["out"], F.array(F.struct(p[name].alias("at"), a["now"].alias("now")))).alias("out"))
        return F.explode(F.aggregate("parts", begin, add)["out"]).alias("s")

    by_group = whole.select("k", starts("group")).select("k", F.col("s.at").alias("group"), "s.now")
    by_block = groups.select("k", "group", "parts").join(by_group, ["k", "group"]).select("k", "group", starts("block")).select("k", "group", F.col("s.at").alias("block"), "s.now")

    def following(now: Column, x: Column) -> Column:
        run = after(effect(now["stage"], F.lit(False), none, none), x)
        sent = F.when(run["reset"], run["low"]).when(now["sent"].isNull(), run["fill"]).otherwise(F.least(now["sent"], run["low"]))
        return F.struct(run["stage"].alias("stage"), sent.alias("sent"), F.greatest(now["last_inbound"], x["reply"]).alias("last_inbound"),
                        F.least(now["opened"], x["receipt"]).alias("opened"))

    begin = F.struct(F.col("now"), F.array().cast(f"array<struct<seq:bigint,item:{items.schema['item'].dataType.simpleString()},was:{state},became:{state}>>").alias("out"))
    add = lambda a, x: F.struct(following(a["now"], x).alias("now"), F.concat(a["out"], F.array(F.struct(
        x["seq"].alias("seq"), x["item"].alias("item"), a["now"].alias("was"), following(a["now"], x).alias("became")))).alias("out"))
    done = (blocks.select("k", "group", "block", "xs").join(by_block, ["k", "group", "block"])
            .select("k", F.explode(F.filter(F.aggregate("xs", begin, add)["out"], lambda y: ~y["was"].eqNullSafe(y["became"]))).alias("y")))
    names = F.array(*[F.lit(s) for s in STAGES])
    text = lambda side, f: F.get(names, F.col(f"y.{side}.stage")) if f == "stage" else F.col(f"y.{side}.{f}").cast("string")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), text("was", f).alias("was"), text("became", f).alias("became")) for f in FIELDS])
    changed = F.filter(fields, lambda f: ~f["was"].eqNullSafe(f["became"]))
    return done.select(F.col("k").alias(key), "y.seq", "y.item", F.explode(changed).alias("f")).select(key, "seq", "item", "f.*")


def take_back(ledger: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """The ledger without the rows of the items in ``taken`` (column ``item``). Rows that started from a value taken back start from what that
    one replaced (``relinked``)."""
    gone = taken.select("item").distinct().withColumn("_gone", F.lit(True))
    marked = ledger.join(gone, "item", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    # the value before a run of removed rows is what the first of them replaced
    kept = F.when(~F.col("_gone"), F.struct(F.col("became").alias("v")))
    with_last = bucketed_last(marked, [key, "field"], "seq", kept, "_last", BLOCK)
    opening = marked.groupBy(key, "field").agg(F.min_by(F.struct(F.col("was").alias("v")), "seq").alias("_first"))
    rest = with_last.join(opening, [key, "field"]).where(~F.col("_gone")).withColumn("_was", F.coalesce("_last", "_first")["v"])
    return rest.select(key, "seq", "item", "field", F.col("_was").alias("was"), "became", (~F.col("_was").eqNullSafe(F.col("was"))).alias("relinked"))


def current(records: DataFrame, ledger: DataFrame, key: str, receipts: DataFrame | None = None) -> DataFrame:
    """``records`` with the fields as the ledger's last rows leave them. ``receipts`` (key, day): receipts that still count; an opened field that
    the ledger no longer explains takes the earliest of them."""
    held = ledger.groupBy(key).agg(*[F.max_by(F.when(F.col("field") == f, F.struct(F.col("became").alias("v"))), F.when(F.col("field") == f, F.col("seq"))).alias(f"_{f}")
                                     for f in FIELDS])
    joined = records.join(held, key, "left")
    if receipts is not None:
        joined = joined.join(receipts.groupBy(key).agg(F.min("day").alias("_receipt")), key, "left")
    kinds = dict(records.dtypes)

    def field(f: str) -> Column:
        own = F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v").cast(kinds[f])).otherwise(F.col(f))
        return F.coalesce(F.least(F.col("_receipt"), F.col(f)), own) if f == "opened" and receipts is not None else own

    return joined.select(*[field(c).alias(c) if c in FIELDS else F.col(c) for c in records.columns])


def decided(records: DataFrame, items: DataFrame, decisions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Records and ledger after decisions on applied items: everything taken back first, then confirmations in their order.

    ``decisions``: item, action (``undo``, ``ignore`` or ``confirm``), to (the record of a confirmation), at. A confirmation takes the item back
    where it was and applies it to the chosen record, after all that was applied before; one to a record that is not there changes nothing. The
    last decision on an item counts. Ledger and states are written to the shared folder on the way, since each is read several times."""
    last = decisions.groupBy("item").agg(F.max_by(F.struct("action", "to", "at"), "at").alias("d")).select("item", "d.*")
    last = last.join(records.select(F.col(key).alias("to"), F.lit(True).alias("_there")), "to", "left").where((F.col("action") != "confirm") | F.col("_there")).drop("_there")
    last = saved(last, "decisions")
    ledger = saved(take_back(saved(field_ledger(items, records, key), "ledger"), last, key), "ledger")
    receipts = items.join(last.select("item"), "item", "left_anti").where((F.col("dir") == "in") & (F.col("cls") == "read") & F.col("day").isNotNull()).select(key, "day")
    state = saved(current(records, ledger, key, receipts), "records")
    again = items.drop(key, "seq").join(last.where("action = 'confirm'").select("item", F.col("to").alias(key), "at"), "item")
    order = W.partitionBy(key).orderBy("at", "item")  # decisions are made by hand, so a record has few
    again = again.withColumn("seq", F.row_number().over(order).cast("long")).drop("at")
    after = saved(field_ledger(again, state, key), "ledger")
    shift = ledger.groupBy(key).agg(F.max("seq").alias("_s"))
    late = after.join(shift, key, "left").withColumn("seq", F.col("seq") + F.coalesce("_s", F.lit(0))).drop("_s").withColumn("relinked", F.lit(False))
    return current(state, after, key), ledger.unionByName(late.select(ledger.columns))
