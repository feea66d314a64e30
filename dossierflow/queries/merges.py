"""Overlays, upserts, merges and diffs."""
from pyspark.sql import functions as F

from dossierflow.catalog import query
from dossierflow.functions import text as tx
from dossierflow.operators import matching as mt
from dossierflow.operators import merge as mg
from dossierflow.operators import roles as rl
from dossierflow.queries.joins import Q_JOBS, job_roles
from dossierflow.tables import Q_LEXICON, Q_PARAGRAPHS


@query("h1_merge_overlay", """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 1 THEN upper(s_name) ELSE s_name END AS s_name, CASE WHEN s_suppkey % 5 = 2 THEN 0.0 ELSE s_acctbal END AS s_acctbal, false AS own, s_suppkey % 5 IN (1, 2) AS changed FROM supplier WHERE s_suppkey % 7 <> 0
UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal, true, false FROM supplier WHERE s_suppkey % 10 = 0""")
def _(t):
    base = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    k = F.col("s_suppkey") % 5
    changed = base.where(k.isin(1, 2)).select("s_suppkey", F.when(k == 1, F.upper("s_name")).alias("s_name"), F.when(k == 2, F.lit(0.0)).alias("s_acctbal"))
    added = base.where("s_suppkey % 10 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 1000000)
    return mg.merge_overlay(base, changed, base.where("s_suppkey % 7 = 0").select("s_suppkey"), added, "s_suppkey")


@query("h2_minimal_overlay", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name || '!' END AS s_name, CASE WHEN s_suppkey % 4 = 0 AND s_acctbal <> 1.5 THEN 1.5::DOUBLE END AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0 OR (s_suppkey % 4 = 0 AND s_acctbal <> 1.5)")
def _(t):
    base = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    edited = base.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")).alias("s_name"),
                         F.when(F.col("s_suppkey") % 4 == 0, F.lit(1.5)).otherwise(F.col("s_acctbal")).alias("s_acctbal"))
    return mg.minimal_overlay(base, edited, "s_suppkey")


def _pair(t, odd: int):
    """Consecutive documents are two tellings of one profile."""
    ws = F.array_distinct(F.filter(tx.words("text"), lambda w: F.length(w) >= 9))
    return t.documents.where(F.col("doc_id") % 2 == odd).select(
        F.floor(F.col("doc_id") / 2).alias("profile"), F.when(F.col("doc_id") % 6 != 0, F.col("source")).otherwise("").alias("headline"),
        F.col("text").alias("summary"), ws.alias("skills"), tx.lines("text").alias("lines"))


def merged(t):
    return mg.merge_profiles(_pair(t, 0), _pair(t, 1), "profile", ["headline"], ["summary"], "skills", "lines")


_SAME = r"""(b_ = {n} OR (length(b_) >= 40 AND length({n}) >= 40 AND (contains(b_, {n}) OR contains({n}, b_))))""".format(n=tx.q_norm("a_"))
Q_MERGED = rf"""WITH d AS (SELECT doc_id // 2 AS profile, doc_id % 2 AS odd, CASE WHEN doc_id % 6 <> 0 THEN source ELSE '' END AS headline, text, {tx.q_lines('text')} AS ls FROM documents),
w AS (SELECT profile, odd, p, w FROM (SELECT profile, odd, {tx.q_words('text')} AS ws FROM d) x, unnest(x.ws) WITH ORDINALITY AS u(w, p) WHERE length(w) >= 9),
f AS (SELECT profile, w, min(odd) AS odd FROM w GROUP BY ALL), sk AS (SELECT profile, count(*) FILTER (WHERE odd = 0) AS base_n, count(*) AS n FROM f GROUP BY 1),
j AS (SELECT coalesce(a.profile, b.profile) AS profile, coalesce(nullif(a.headline, ''), b.headline, '') AS headline, CASE WHEN length(coalesce(b.text, '')) > length(coalesce(a.text, '')) THEN b.text ELSE coalesce(a.text, '') END AS summary,
    coalesce(a.ls, []) AS al, list_transform(coalesce(a.ls, []), lambda z: {tx.q_norm('z')}) AS an, coalesce(b.ls, []) AS bl FROM (SELECT * FROM d WHERE odd = 0) a FULL JOIN (SELECT * FROM d WHERE odd = 1) b ON a.profile = b.profile),
g AS (SELECT *, list_filter(bl, lambda a_: {tx.q_norm('a_')} <> '' AND len(list_filter(an, lambda b_: {_SAME})) = 0) AS fresh FROM j),
m AS (SELECT profile, headline, summary, list_concat(al, fresh) AS ls, len(al) AS nl FROM g),
merged AS (SELECT m.profile, headline, md5(summary) AS summary_key, coalesce(n, 0)::INT AS n_skills, len(ls)::INT AS n_lines, md5(array_to_string(ls, chr(10))) AS lines_key,
  greatest(0, coalesce(n, 0) - coalesce(base_n, 0))::INT AS gained_skills, (len(ls) - nl)::INT AS gained_lines FROM m LEFT JOIN sk USING (profile))"""


@query("h3_merge_profiles", Q_MERGED + " SELECT * FROM merged")
def _(t):
    m = merged(t)
    return m.select("profile", "headline", F.md5("summary").alias("summary_key"), F.size("skills").alias("n_skills"), F.size("lines").alias("n_lines"),
                    F.md5(F.array_join("lines", "\n")).alias("lines_key"), "gained_skills", "gained_lines")


@query("e20_added_summary", Q_MERGED + " SELECT profile % 20 AS slot, count(*) FILTER (WHERE gained_lines > 0) AS n_profiles, sum(gained_skills)::BIGINT AS skills, sum(gained_lines)::BIGINT AS lines FROM merged GROUP BY 1")
def _(t):
    return merged(t).groupBy((F.col("profile") % 20).alias("slot")).agg(
        F.sum((F.col("gained_lines") > 0).cast("int")).cast("long").alias("n_profiles"), F.sum("gained_skills").alias("skills"), F.sum("gained_lines").alias("lines"))


@query("h4_combine_multi_source", rf"""WITH d AS (SELECT doc_id // 2 AS profile, doc_id % 2 AS odd, {tx.q_sentences('text')} AS ss, source FROM documents)
SELECT profile, CASE WHEN a.source = b.source OR b.source IS NULL THEN a.source WHEN a.source IS NULL THEN b.source ELSE a.source || ' | ' || b.source END AS headline,
  md5(array_to_string(list_concat(coalesce(a.ss, []), list_filter(coalesce(b.ss, []), lambda s: NOT list_contains(coalesce(a.ss, []), s))), ' ')) AS summary_key
FROM (SELECT * FROM d WHERE odd = 0) a FULL JOIN (SELECT * FROM d WHERE odd = 1) b USING (profile)""")
def _(t):
    """Looser merge: headline segments of both sources, a summary of all distinct sentences."""
    side = lambda odd: t.documents.where(F.col("doc_id") % 2 == odd).select(
        F.floor(F.col("doc_id") / 2).alias("profile"), F.col("source").alias("headline"), tx.sentences("text").alias("summary"))
    both = mg.combine_sources(side(0), side(1), "profile", "headline", "summary")
    return both.select("profile", "headline", F.md5(F.array_join("summary", " ")).alias("summary_key"))


@query("h5_upsert_listings", """WITH d AS (SELECT doc_id, md5(text) AS k, source FROM documents), tg AS (SELECT * FROM d WHERE doc_id % 2 = 0 OR doc_id % 10 = 5), bt AS (SELECT * FROM d WHERE doc_id % 2 = 1),
r AS (SELECT b.*, coalesce((SELECT t.doc_id FROM tg t WHERE t.doc_id = b.doc_id), (SELECT min(t.doc_id) FROM tg t WHERE t.k = b.k), (SELECT min(c.doc_id) FROM bt c WHERE c.k = b.k)) AS id FROM bt b),
l AS (SELECT id, k, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) AS rn FROM r) WHERE rn = 1)
SELECT doc_id, k, source, 'target' AS origin FROM tg WHERE doc_id NOT IN (SELECT id FROM l) UNION ALL SELECT id, k, source, 'batch' FROM l""")
def _(t):
    d = t.documents.select("doc_id", F.md5("text").alias("k"), "source", F.col("doc_id").alias("pos"))
    target = d.where("doc_id % 2 = 0 OR doc_id % 10 = 5").withColumn("origin", F.lit("target"))
    batch = d.where("doc_id % 2 = 1").withColumn("origin", F.lit("batch"))
    return mg.upsert(target, batch, "doc_id", "k", "pos").drop("pos")


Q_VERSIONS = f"""{Q_PARAGRAPHS}, old AS (SELECT doc_id, line_ix // 4 AS parent, line_ix AS pos, {tx.q_norm('line')} AS k FROM paragraphs),
new AS (SELECT doc_id, CASE WHEN line_ix % 11 = 4 THEN line_ix // 4 + 1 ELSE line_ix // 4 END AS parent, line_ix AS pos, {tx.q_norm("CASE WHEN line_ix % 7 = 2 THEN line || ' edited' ELSE line END")} AS k FROM paragraphs WHERE line_ix % 5 <> 3
  UNION ALL SELECT doc_id, 99, 100000 + line_ix, 'new line ' || line_ix::VARCHAR FROM paragraphs WHERE line_ix % 13 = 0)"""


@query("h6_diff_versions", f"""WITH {Q_VERSIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY parent, pos) AS i FROM new), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY parent, pos) AS i FROM old),
j AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, n.parent AS np, n.pos AS npos, o.parent AS op, o.pos AS opos FROM n FULL JOIN o ON n.doc_id = o.doc_id AND n.k = o.k AND n.i = o.i),
pl AS (SELECT doc_id, np AS parent, npos AS pos FROM j WHERE op IS NULL), mi AS (SELECT doc_id, op AS parent, opos AS pos FROM j WHERE np IS NULL)
SELECT doc_id, 'moved' AS change, np AS parent, npos AS pos FROM j WHERE np <> op
UNION ALL SELECT coalesce(pl.doc_id, mi.doc_id), CASE WHEN pl.doc_id IS NULL THEN 'removed' WHEN mi.doc_id IS NULL THEN 'added' ELSE 'edited' END, coalesce(pl.parent, mi.parent), coalesce(pl.pos, mi.pos) FROM pl FULL JOIN mi ON pl.doc_id = mi.doc_id AND pl.parent = mi.parent AND pl.pos = mi.pos""")
def _(t):
    """A derived new version drops, edits, moves and adds lines of every document."""
    p = t.paragraphs
    section = F.floor(F.col("line_ix") / 4).cast("int")
    old = p.select("doc_id", section.alias("parent"), F.col("line_ix").alias("pos"), F.col("line").alias("text"))
    new = p.where("line_ix % 5 <> 3").select("doc_id", F.when(F.col("line_ix") % 11 == 4, section + 1).otherwise(section).alias("parent"), F.col("line_ix").alias("pos"),
                                             F.when(F.col("line_ix") % 7 == 2, F.concat("line", F.lit(" edited"))).otherwise(F.col("line")).alias("text"))
    extra = p.where("line_ix % 13 = 0").select("doc_id", F.lit(99).alias("parent"), (F.col("line_ix") + 100000).alias("pos"), F.concat(F.lit("new line "), F.col("line_ix").cast("string")).alias("text"))
    return mg.diff_versions(new.unionByName(extra), old, "doc_id")


@query("h7_apply_swaps", f"""WITH {Q_PARAGRAPHS}, a AS (SELECT *, strpos(line, 'the') - 1 AS p FROM paragraphs)
SELECT doc_id, line_ix, CASE WHEN p < 0 OR p = 0 AND false THEN 'XX' || substring(line, 3) WHEN p = 0 THEN 'XX' || substring(line, 3) WHEN p < 2 THEN substring(line, 1, p) || 'THE' || substring(line, p + 4)
  ELSE 'XX' || substring(line, 3, p - 2) || 'THE' || substring(line, p + 4) END AS after FROM a WHERE length(line) >= 2""")
def _(t):
    """Two swaps per line (first 'the', first two characters) and one stale swap that must not apply."""
    lines = t.paragraphs.where(F.length("line") >= 2).select("doc_id", "line_ix", "line")
    at = (F.instr("line", "the") - 1).cast("int")
    cols = ["doc_id", "line_ix"]
    one = lines.where(at >= 0).select(*cols, at.alias("at"), F.lit("the").alias("synonym"), F.lit("THE").alias("to"), F.col("line").alias("before"))
    two = lines.select(*cols, F.lit(0).alias("at"), F.left("line", F.lit(2)).alias("synonym"), F.lit("XX").alias("to"), F.col("line").alias("before"))
    stale = lines.select(*cols, F.lit(1).alias("at"), F.substring("line", 2, 1).alias("synonym"), F.lit("?").alias("to"), F.concat("line", F.lit(" ")).alias("before"))
    return mt.apply_swaps(lines, one.unionByName(two).unionByName(stale), cols, "line").select("doc_id", "line_ix", "after")


@query("h10_orphan_rows", "SELECT l.doc_id, quality FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.n_chars >= 400)")
def _(t):
    return mg.orphan_rows(t.labels, t.documents.where("n_chars >= 400"), "doc_id").select("doc_id", "quality")


@query("h11_drop_unmatched", "SELECT conv_id, turn FROM conversations WHERE md5(role || text) NOT IN (SELECT md5(role || text) FROM conversations WHERE role = 'system' OR turn % 5 = 3)")
def _(t):
    """Keys of unmatched items are forgotten, so their messages may match again."""
    key = F.md5(F.concat("role", "text"))
    msgs = t.conversations.select("conv_id", "turn", key.alias("key"), ((F.col("role") == "system") | (F.col("turn") % 5 == 3)).alias("unmatched"))
    return mg.forget_unmatched(msgs, "key", F.col("unmatched")).select("conv_id", "turn")


@query("h12_document_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1")
def _(t):
    return mg.document_text(t.conversations, "conv_id", "turn", "text")


_DUTY = "'handled shipments of kind ' || l_returnflag || ' and state ' || l_linestatus || ' for this account'"
Q_MERGED_ROLES = f"""WITH {Q_JOBS}, ln AS (SELECT l_orderkey AS id, list({_DUTY} || CASE WHEN l_linenumber = 1 THEN ' and its branches' ELSE '' END ORDER BY l_linenumber, l_returnflag, l_linestatus) AS ls FROM lineitem GROUP BY 1),
r AS (SELECT owner, id, employer, title, end_year, ls, t || '|' || {tx.q_norm('employer')} AS k, CASE WHEN id % 2 = 1 THEN 0 ELSE 1 END AS src FROM keyed JOIN ln USING (id)),
g AS (SELECT owner, k, min(id) FILTER (src = 0) AS bid, min(id) FILTER (src = 1) AS aid FROM r GROUP BY ALL),
j AS (SELECT g.owner, bid, aid, coalesce(b.title, a.title) AS title, coalesce(b.employer, a.employer) AS employer, CASE WHEN bid IS NULL THEN a.end_year WHEN bid % 3 = 0 THEN a.end_year ELSE b.end_year END AS end_year, coalesce(b.ls, []) AS bl, coalesce(a.ls, []) AS al
  FROM g LEFT JOIN r b ON b.id = bid LEFT JOIN r a ON a.id = aid),
f AS (SELECT *, CASE WHEN bid IS NOT NULL AND aid IS NOT NULL THEN list_filter(al, lambda x, i: len(list_filter(bl, lambda y: contains(x, y) OR contains(y, x))) = 0 AND len(list_filter(al[1:i - 1], lambda y: contains(x, y) OR contains(y, x))) = 0)
  WHEN bid IS NULL THEN al ELSE [] END AS fresh FROM j)
SELECT owner, (row_number() OVER (PARTITION BY owner ORDER BY coalesce(end_year, 0) DESC, bid IS NULL, coalesce(bid, aid)))::INT AS ix, title, employer, coalesce(end_year, 0) AS end_year, len(bl) + len(fresh) AS n_lines,
  md5(array_to_string(list_concat(bl, fresh), chr(10))) AS lines_key, CASE WHEN bid IS NULL THEN 'add' WHEN aid IS NULL THEN 'base' ELSE 'both' END AS origin, CASE WHEN bid IS NULL THEN 0 ELSE len(fresh) END AS gained FROM f"""


@query("h3_merge_roles", Q_MERGED_ROLES)
def _(t):
    """Odd orders are the base's roles and even ones the second source's; every third has no dates of its own."""
    text = F.concat(F.lit("handled shipments of kind "), "l_returnflag", F.lit(" and state "), "l_linestatus", F.lit(" for this account"),
                    F.when(F.col("l_linenumber") == 1, " and its branches").otherwise(""))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", text.alias("x")))).alias("ls"))
    undated = (F.col("id") % 3 == 0) & (F.col("id") % 2 == 1)
    roles = job_roles(t).join(lines, "id").select("owner", F.col("id").alias("pos"), "title", "employer", F.when(undated, "").otherwise(F.col("end_year").cast("string")).alias("dates"),
                                                  "end_year", F.transform("ls", lambda l: l["x"]).alias("lines"))
    merged = rl.merged_roles(roles.where("pos % 2 = 1"), roles.where("pos % 2 = 0"), "owner")
    return merged.select("owner", "ix", "title", "employer", "end_year", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("lines_key"), "origin",
                         F.col("gained").cast("long").alias("gained"))


_SHIFT = "parent + (parent * 7 + doc_id) % 5"


@query("h6_moved_parents", f"""WITH RECURSIVE {Q_PARAGRAPHS}, old AS (SELECT DISTINCT doc_id, line_ix // 4 AS parent FROM paragraphs), kept AS (SELECT * FROM old WHERE (parent * 3 + doc_id) % 7 <> 0),
v AS (SELECT doc_id, list(parent ORDER BY {_SHIFT}, parent) AS vs FROM kept GROUP BY 1),
r AS (SELECT doc_id, vs, 0 AS i, []::INT[] AS ls FROM v UNION ALL SELECT doc_id, vs, i + 1, list_append(ls, 1 + coalesce(list_max(list_filter(ls, lambda l, j: vs[j] < vs[i + 1])), 0)) FROM r WHERE i < len(vs))
SELECT doc_id, len(vs) AS n_parents, len(vs) - list_max(ls) AS n_moved FROM r WHERE i = len(vs)""")
def _(t):
    """Sections of four lines as roles; the new version drops a seventh of them and pushes others back."""
    section = F.floor(F.col("line_ix") / 4).cast("int")
    old = t.paragraphs.select("doc_id", section.alias("parent")).distinct()
    p = F.col("parent")
    new = old.where((p * 3 + F.col("doc_id")) % 7 != 0).withColumn("pos", (p + (p * 7 + F.col("doc_id")) % 5) * 1000000 + p)
    moved = mg.moved_parents(new, old.withColumn("pos", p), "doc_id", "parent", "pos")
    return moved.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_parents"), F.sum(F.col("moved").cast("long")).alias("n_moved"))
