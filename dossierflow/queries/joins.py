"""Linking and evidence joins."""
from pyspark.sql import functions as F

from dossierflow.catalog import query
from dossierflow.functions import text as tx
from dossierflow.functions.text import q_list, q_str
from dossierflow.operators import lexicon as lx
from dossierflow.operators import links as lk
from dossierflow.operators import roles as rl
from dossierflow.operators.scale import join_small, keep_first
from dossierflow.tables import Q_LEXICON, Q_ORDER_ROLES, Q_PARAGRAPHS


def lex(t):
    return t.lexicon.select("concept", F.col("concept").alias("form"))


def _long_words(c):
    return F.array_distinct(F.filter(tx.words(c), lambda w: F.length(w) >= 8))


def _scored(t):
    items = t.benchmark.select("item_id", F.col("text").alias("passage"))
    whole = lk.whole_phrase(t.documents, "doc_id", "text", items, "item_id", "passage")
    first = items.select("item_id", tx.norm(F.get(tx.sentences("passage"), F.lit(0))).alias("s")).where("s <> ''")
    freq = first.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    subject = t.sentences.select("doc_id", tx.norm("sentence").alias("s"))  # the same sentence twice counts once in the scores
    same = join_small(subject, first.join(freq, "s"), "s")
    words = items.select("item_id", _long_words("passage").alias("words")).where(F.size("words") > 0)
    roles = lk.words_overlap(t.documents, "doc_id", "text", words, "item_id", "words", 60)
    return lk.evidence_scores([("passage", whole, F.lit(100)), ("subject", same, F.when(F.col("n") == 1, 70).otherwise(20)),
                               ("words", roles, F.lit(20))], "doc_id", "item_id")


Q_SCORED = rf"""WITH b AS (SELECT item_id, {tx.q_norm('text')} AS p, {tx.q_norm(tx.q_sentences('text') + '[1]')} AS s1, list_distinct(list_filter({tx.q_words('text')}, lambda x: length(x) >= 8)) AS ws FROM benchmark),
d AS (SELECT doc_id, {tx.q_norm('text')} AS n, list_distinct({tx.q_words('text')}) AS tw FROM documents),
ds AS (SELECT DISTINCT doc_id, {tx.q_norm('s')} AS s FROM (SELECT doc_id, unnest({tx.q_sentences('text')}) AS s FROM documents)),
sig AS (SELECT doc_id, item_id, 100 AS points, 'passage' AS signal FROM d, b WHERE contains(' ' || n || ' ', ' ' || p || ' ')
  UNION ALL SELECT DISTINCT doc_id, item_id, CASE WHEN (SELECT count(*) FROM b c WHERE c.s1 = b.s1) = 1 THEN 70 ELSE 20 END, 'subject' FROM ds JOIN b ON ds.s = b.s1 WHERE s1 <> ''
  UNION ALL SELECT doc_id, item_id, 20, 'words' FROM d, b WHERE len(ws) > 0 AND len(list_intersect(ws, tw)) >= ceil(len(ws) * 60 / 100)),
scored AS (SELECT doc_id, item_id, sum(points)::INT AS score, string_agg(DISTINCT signal, '+' ORDER BY signal) AS signals FROM sig GROUP BY ALL)"""


@query("d1_evidence_link", Q_SCORED + " SELECT * FROM scored")
def _(t):
    return _scored(t)


@query("d1_message_signals", """WITH m AS (SELECT o_orderkey AS message_id, 'Re: Order ' || (o_orderkey % 40)::VARCHAR AS subject, CASE WHEN o_orderkey % 3 = 0 THEN 'from Supplier#' || lpad((o_orderkey % 100 + 1)::VARCHAR, 9, '0') || ' today' ELSE 'ref S' || (o_orderkey % 90)::VARCHAR END AS text,
  CASE WHEN o_orderkey % 4 = 0 THEN 'gmail.example' WHEN o_orderkey % 4 = 1 THEN 'ats.example' ELSE 'x.mail' || (o_orderkey % 60)::VARCHAR || '.example.com' END AS dom, o_orderkey - 1 AS thread, o_orderdate::DATE AS day FROM orders),
r AS (SELECT s_suppkey AS record_id, 'S' || s_suppkey::VARCHAR AS ref, 'order ' || (s_suppkey % 50)::VARCHAR AS subject, 'mail' || (s_suppkey % 60)::VARCHAR || '.example.com' AS dom, lower(replace(s_name, '#', ' ')) AS company, s_suppkey * 7 AS mid, DATE '1994-01-01' + s_suppkey::INT AS since FROM supplier),
s AS (SELECT message_id, record_id, 100 AS points, 'ref' AS signal FROM m JOIN r ON m.text = 'ref ' || r.ref UNION ALL SELECT message_id, record_id, 90, 'thread' FROM m JOIN r ON thread = mid
  UNION ALL SELECT message_id, record_id, CASE WHEN n = 1 THEN 70 ELSE 20 END, CASE WHEN n = 1 THEN 'subject' ELSE 'shared subject' END FROM m JOIN (SELECT *, count(*) OVER (PARTITION BY subject) AS n FROM r) r ON lower(m.subject) = 're: ' || r.subject
  UNION ALL SELECT message_id, record_id, 40, 'domain' FROM m JOIN r ON m.dom = 'x.' || r.dom
  UNION ALL SELECT message_id, record_id, unnest([25, 30]), unnest(['company', CASE WHEN m.dom = 'ats.example' THEN 'recruiting system' END]) FROM m JOIN r ON m.text = 'from Supplier#' || lpad(r.record_id::VARCHAR, 9, '0') || ' today')
SELECT message_id, record_id, sum(points)::INT AS score, string_agg(DISTINCT signal, '+' ORDER BY signal) AS signals FROM s JOIN m USING (message_id) JOIN r USING (record_id) WHERE signal IS NOT NULL AND day >= since - 1 GROUP BY ALL""")
def _(t):
    """Orders as messages, suppliers as records: references, threads, subjects, domains below the record's, firms, shared mail systems."""
    k, n = F.col("o_orderkey"), F.col("s_suppkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("from Supplier#"), F.lpad((k % 100 + 1).cast("string"), 9, "0"), F.lit(" today"))).otherwise(F.concat(F.lit("ref S"), (k % 90).cast("string")))
    domain = F.when(k % 4 == 0, "gmail.example").when(k % 4 == 1, "ats.example").otherwise(F.concat(F.lit("x.mail"), (k % 60).cast("string"), F.lit(".example.com")))
    messages = t.orders.select(k.alias("message_id"), F.concat(F.lit("Re: Order "), (k % 40).cast("string")).alias("subject"), text.alias("text"), domain.alias("from_domain"),
                               F.array((k - 1).cast("string")).alias("threads"), F.to_date("o_orderdate").alias("at"))
    records = t.supplier.select(n.alias("record_id"), F.concat(F.lit("S"), n.cast("string")).alias("ref"), F.concat(F.lit("order "), (n % 50).cast("string")).alias("subject"),
                                F.concat(F.lit("mail"), (n % 60).cast("string"), F.lit(".example.com")).alias("domain"), F.col("s_name").alias("company"), F.lit("").alias("role"),
                                F.array((n * 7).cast("string")).alias("msg_ids"), F.date_add(F.lit("1994-01-01").cast("date"), n.cast("int")).alias("since"))
    return lk.message_signals(messages, records, r"^gmail\.", r"^ats\.")


@query("f12_top_two_margin", Q_SCORED + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rk FROM scored),
m AS (SELECT doc_id, max(CASE WHEN rk = 1 THEN item_id END) AS item_id, max(CASE WHEN rk = 1 THEN score END) AS score, max(CASE WHEN rk = 1 THEN signals END) AS signals,
  max(CASE WHEN rk = 1 THEN score END) - coalesce(max(CASE WHEN rk = 2 THEN score END), 0) AS lead FROM r WHERE rk <= 2 GROUP BY 1)
SELECT *, CASE WHEN score >= 60 AND lead >= 20 THEN 'auto' WHEN score >= 35 THEN 'suggested' ELSE 'unmatched' END AS decision FROM m""")
def _(t):
    return lk.link_decision(lk.top_two_margin(_scored(t), "doc_id", "item_id"))


@query("d2_company_hit", rf"""WITH b AS (SELECT item_id, array_to_string({tx.q_words('text')}[1:3], ' ') AS p FROM benchmark)
SELECT doc_id, item_id FROM (SELECT doc_id, {tx.q_norm('text')} AS n FROM documents), b WHERE contains(' ' || n || ' ', ' ' || p || ' ')""")
def _(t):
    names = t.benchmark.select("item_id", F.array_join(F.slice(tx.words("text"), 1, 3), " ").alias("name"))
    return lk.whole_phrase(t.documents, "doc_id", "text", names, "item_id", "name", key_words=3)


Q_KINDS = f"""{Q_LEXICON}, {Q_PARAGRAPHS}, n AS (SELECT doc_id, max(line_ix) AS last_ix FROM paragraphs GROUP BY 1),
kinds AS (SELECT doc_id, line_ix, last_ix, (CASE WHEN line_ix = last_ix AND line_ix > 0 THEN 0 WHEN line_ix = 0 THEN 2 ELSE 1 END)::INT AS kind_rank, unnest({tx.q_words('line')}) AS concept FROM paragraphs JOIN n USING (doc_id))"""


def _kinds(t):
    ls = t.documents.select("doc_id", tx.lines("text").alias("ls"), F.size(tx.lines("text")).alias("n"))
    rows = ls.select("doc_id", "n", F.posexplode("ls").alias("line_ix", "line"))
    last = (F.col("line_ix") == F.col("n") - 1) & (F.col("line_ix") > 0)
    return rows.withColumn("kind_rank", F.when(last, 0).when(F.col("line_ix") == 0, 2).otherwise(1))


@query("d4_requirement_evidence", f"""WITH {Q_KINDS} SELECT doc_id, concept, b.kind_rank AS kind_rank, b.line_ix AS line_ix FROM (
  SELECT doc_id, concept, min({{'kind_rank': kind_rank, 'line_ix': line_ix}}) AS b FROM kinds JOIN bench_lex USING (concept) GROUP BY ALL)""")
def _(t):
    """Reading order: the last line (competencies), the body, the first line (header)."""
    return lk.requirement_evidence(_kinds(t), "doc_id", lex(t))


@query("d5_missing_evidence", f"""WITH {Q_LEXICON} SELECT concept FROM bench_lex WHERE {tx.q_stem('concept')} NOT IN (
  SELECT {tx.q_stem('w')} FROM (SELECT unnest({tx.q_words('text')}) AS w FROM documents))""")
def _(t):
    tokens = t.documents.select(F.explode(F.array_distinct(tx.words("text"))).alias("token"))
    return lk.missing_evidence(t.lexicon, tokens)


def _q_figures(x):
    printed = "regexp_replace(regexp_extract(ch, '^([0-9][0-9,.]*)', 1), '[,.]+$', '')"
    digits = f"regexp_replace({printed}, '[,.]', '', 'g')"
    unit = r"trim(lower(regexp_extract(ch, '(?i)^[0-9][0-9,.]*\s?(%|(?:k|mn|m|bn|mio|mrd|million)(?:[^\p{L}]|$))', 1)))"
    zeros = "CASE regexp_extract(" + unit + ", '^([a-z]+)', 1) " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in lk.SCALES.items()) + " ELSE 0 END"
    chunk_value = (f"CASE WHEN {zeros} > 0 THEN regexp_replace({digits} || repeat('0', {zeros} - length(regexp_extract({printed}, '[,.]([0-9]{{1,2}})$', 1))), '^0+([0-9])', '\\1') "
                   f"ELSE {digits} END")
    nxt = (f"list_transform(list_filter({tx.q_letter_words(chr(39).join(['regexp_replace(ch, ', '^[0-9][0-9,.]*', ', ', '', ')']))}, "
           f"lambda w2: w2 NOT IN {q_list(lk.FIGURE_STOP)})[1:2], lambda w3: {tx.q_stem('w3')})")
    return rf"""SELECT *, {chunk_value} AS value, {unit} AS unit, {nxt} AS nxt, regexp_extract(ch, '^[0-9][0-9,.]*(\p{{L}}?)', 1) AS glued FROM (
      SELECT doc_id, line_ix, (ix - 2)::INT AS raw_ix, ch FROM {x}, unnest(string_split(regexp_replace(' ' || line, '([^\p{{L}}0-9,.])([0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))) WITH ORDINALITY AS u(ch, ix) WHERE ix >= 2)"""


@query("d6_orphan_numbers", rf"""WITH {Q_PARAGRAPHS}, n AS (SELECT doc_id, max(line_ix) AS last_ix FROM paragraphs GROUP BY 1),
f AS (SELECT f.*, last_ix FROM ({_q_figures('paragraphs')}) f JOIN n USING (doc_id) WHERE (glued = '' OR unit <> '') AND NOT regexp_matches(value, '^(?:19[5-9]\d|20[0-3]\d)$'))
SELECT c.doc_id, c.value, c.unit FROM f c WHERE c.line_ix = c.last_ix AND c.last_ix > 0 AND NOT EXISTS (
  SELECT 1 FROM f s WHERE s.doc_id = c.doc_id AND s.line_ix < s.last_ix AND s.value = c.value AND (c.unit <> '' OR len(list_intersect(c.nxt, s.nxt)) > 0))""")
def _(t):
    """Claims are the last line of a document, sources its other lines."""
    k = _kinds(t).withColumn("text", F.col("line"))
    claims = k.where("kind_rank = 0").select("doc_id", "text")
    sources = k.where("kind_rank <> 0").select("doc_id", "text")
    return lk.orphan_numbers(claims, sources, "doc_id").select("doc_id", "value", "unit")


@query("d7_orphan_places", """WITH c AS (SELECT c_custkey, c_custkey % 10 AS owner, n_nationkey, n_regionkey, c_custkey % 3 = 0 AS meta, CASE WHEN c_custkey % 3 = 0 THEN r_name ELSE n_name END AS place
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT s_suppkey % 10 AS owner, n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT owner, c_custkey AS claim_id, place FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.owner = c.owner AND CASE WHEN c.meta THEN s.n_regionkey = c.n_regionkey ELSE s.n_nationkey = c.n_nationkey END)""")
def _(t):
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    alias = geo.select(F.col("n_name").alias("place"), F.col("n_name").alias("country"), F.lit(None).cast("string").alias("meta")).unionByName(
        t.region.select(F.col("r_name").alias("place"), F.lit(None).cast("string").alias("country"), F.col("r_name").alias("meta")))
    members = geo.select(F.col("r_name").alias("meta"), F.col("n_name").alias("country"))
    claims = join_small(t.customer, geo, F.col("c_nationkey") == F.col("n_nationkey")).select(
        (F.col("c_custkey") % 10).alias("owner"), F.col("c_custkey").alias("claim_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("r_name")).otherwise(F.col("n_name")).alias("place"))
    lines = join_small(t.supplier, t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") % 10).alias("owner"), F.col("n_name").alias("place"))
    return lk.orphan_places(claims, lines, alias, members, "owner").select("owner", "claim_id", "place")


def q_near(tables: str, lines: str, line: str) -> str:
    """Check SQL of the near-duplicate lines of ``lines`` (doc_id, line_ix and the text ``line``)."""
    return rf"""WITH {tables}, r AS (SELECT doc_id, line_ix, {tx.q_norm(line)} AS n FROM {lines}), r1 AS (SELECT * FROM r WHERE n <> ''),
f AS (SELECT doc_id, n, min(line_ix) AS ix FROM r1 GROUP BY ALL),
s AS (SELECT doc_id, ix, list_distinct(list_filter({tx.q_letter_words('n')}, lambda x: length(x) >= 4)) AS s FROM f)
SELECT r1.doc_id, line_ix, ix AS partner_ix, 'exact' AS kind FROM r1 JOIN f ON r1.doc_id = f.doc_id AND r1.n = f.n WHERE line_ix > ix
UNION ALL SELECT a.doc_id, b.ix, min(a.ix), 'near' FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.ix < b.ix
WHERE len(a.s) >= 5 AND len(b.s) >= 5 AND least(len(a.s), len(b.s)) * 10 >= greatest(len(a.s), len(b.s)) * 8
  AND len(list_intersect(a.s, b.s)) * 10 >= (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) * 8 GROUP BY a.doc_id, b.ix"""


Q_NEAR = q_near(Q_PARAGRAPHS, "paragraphs", "line")


@query("d9_near_duplicate_lines", Q_NEAR)
def _(t):
    return lk.repeated_lines(t.documents.select("doc_id", tx.lines("text").alias("ls")), "doc_id", "ls")


@query("d10_contained_lines", rf"""WITH {Q_PARAGRAPHS}, a AS (SELECT doc_id, line_ix, {tx.q_norm('line')} AS a FROM paragraphs), b AS (SELECT item_id, b_ix, {tx.q_norm('line')} AS b FROM (
  SELECT item_id, (ix - 1)::INT AS b_ix, line FROM benchmark, unnest({tx.q_lines('text')}) WITH ORDINALITY AS u(line, ix)))
SELECT DISTINCT doc_id, line_ix, item_id, b_ix FROM a, b WHERE a <> '' AND b <> '' AND (a = b OR (length(a) >= 40 AND length(b) >= 40 AND (contains(' ' || a || ' ', ' ' || b || ' ') OR contains(' ' || b || ' ', ' ' || a || ' '))))""")
def _(t):
    b = t.benchmark.select("item_id", F.posexplode(tx.lines("text")).alias("b_ix", "b_line"))
    return lk.contained_lines(t.paragraphs, ["doc_id", "line_ix"], "line", b, ["item_id", "b_ix"], "b_line")


@query("d11_resolve_same_role", f"""WITH {Q_ORDER_ROLES}, r AS (SELECT r.o_custkey, from_ix // 12 AS y, o_orderpriority AS title, r.o_orderkey AS id FROM order_roles r JOIN orders o ON r.o_orderkey = o.o_orderkey),
a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, y, title ORDER BY id) AS n FROM r WHERE id % 2 = 1), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, y, title ORDER BY id) AS n FROM r WHERE id % 2 = 0),
one AS (SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b USING (o_custkey, y, title, n)),
ra AS (SELECT o_custkey, y, count(*) AS c, min(id) AS a_id FROM a WHERE id NOT IN (SELECT a_id FROM one) GROUP BY ALL), rb AS (SELECT o_custkey, y, count(*) AS c, min(id) AS b_id FROM b GROUP BY ALL)
SELECT a_id, b_id, 'title' AS pass FROM one UNION ALL SELECT a_id, b_id, 'only' FROM ra JOIN rb USING (o_custkey, y) WHERE ra.c = 1 AND rb.c = 1 AND b_id NOT IN (SELECT b_id FROM one)""")
def _(t):
    r = t.order_roles.join(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey").select(
        "o_custkey", F.floor(F.col("from_ix") / 12).alias("y"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("id"))
    a, b = r.where("id % 2 = 1").withColumnRenamed("id", "a_id"), r.where("id % 2 = 0").withColumnRenamed("id", "b_id")
    return lk.resolve_same_role(a, b, ["o_custkey", "y"], "title")


Q_JOBS = f"""{Q_ORDER_ROLES}, jobs AS (SELECT r.o_custkey AS owner, r.o_orderkey AS id, n_name || CASE (r.o_orderkey // 16) % 4 WHEN 0 THEN '' WHEN 1 THEN ' Trading' WHEN 2 THEN ' Holding LLC' ELSE ' Services — Dubai' END AS employer,
  o_orderpriority AS title, CASE WHEN r.o_orderkey % 11 = 0 THEN 0 ELSE from_ix // 24 END AS year, to_ix // 12 AS end_year FROM order_roles r JOIN orders o ON r.o_orderkey = o.o_orderkey JOIN nation ON n_nationkey = (r.o_orderkey // 2) % 4),
keyed AS (SELECT *, trim(regexp_replace(regexp_replace({tx.q_norm("split_part(employer, ' — ', 1)")}, '\\b(?:holdings|holding|limited|group|llc|ltd)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS key, {tx.q_norm('title')} AS t FROM jobs)"""


def job_roles(t):
    """Orders as roles: a nation with a legal form or a line of business as employer, the priority as title; every eleventh has no dates."""
    form = F.element_at(F.array(*map(F.lit, ("", " Trading", " Holding LLC", " Services — Dubai"))), (F.floor(F.col("o_orderkey") / 16) % 4 + 1).cast("int"))
    return (t.order_roles.join(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey")
            .join(t.nation, F.col("n_nationkey") == F.floor(F.col("o_orderkey") / 2) % 4)
            .select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.concat("n_name", form).alias("employer"), F.col("o_orderpriority").alias("title"),
                    F.when(F.col("o_orderkey") % 11 != 0, F.floor(F.col("from_ix") / 24).cast("int")).alias("year"), F.floor(F.col("to_ix") / 12).cast("int").alias("end_year")))


def _halves(t):
    jobs = job_roles(t)
    return jobs.where("id % 2 = 1").withColumnRenamed("id", "a_id"), jobs.where("id % 2 = 0").withColumnRenamed("id", "b_id")


@query("d11_role_candidates", f"""WITH {Q_JOBS}, c AS (SELECT owner, id % 2 AS side, key, year, t, count(*) AS n, min(id) AS first FROM keyed WHERE key <> '' GROUP BY ALL)
SELECT a.owner, a.first AS a_first, b.first AS b_first, a.n * b.n AS n_pairs FROM c a JOIN c b ON a.owner = b.owner AND a.side = 1 AND b.side = 0
WHERE (a.key = b.key OR (length(a.key) >= 4 AND length(b.key) >= 4 AND (contains(a.key, b.key) OR contains(b.key, a.key)))) AND CASE WHEN a.year <> 0 AND b.year <> 0 THEN a.year = b.year ELSE a.t = b.t END""")
def _(t):
    a, b = _halves(t)
    pairs = rl.role_candidates(rl.classes(a, "owner", "a_id"), rl.classes(b, "owner", "b_id"), "owner")
    return pairs.select("owner", F.col("first").alias("a_first"), F.col("b_first"), (F.col("n") * F.col("b_n")).alias("n_pairs"))


@query("d11_match_roles")
def _(t):
    """One to one by rounds; no SQL twin, a test compares it with plain loops."""
    return rl.match_roles(*_halves(t), "owner")


Q_STEMS = "list_transform({w}, lambda z_: " + tx.q_stem("z_") + ")"


@query("d12_trace_source", rf"""WITH {Q_PARAGRAPHS}, n AS (SELECT doc_id, max(line_ix) AS last_ix FROM paragraphs GROUP BY 1),
l AS (SELECT doc_id, (six - 1)::INT AS line_ix, {tx.q_words('s')} AS ws FROM (SELECT doc_id, line FROM paragraphs JOIN n USING (doc_id) WHERE line_ix = last_ix AND last_ix > 0), unnest({tx.q_sentences('line')}) WITH ORDINALITY AS u(s, six)),
p AS (SELECT doc_id, line_ix AS pool_ix, list_distinct({Q_STEMS.format(w=tx.q_words('line'))}) AS st FROM paragraphs JOIN n USING (doc_id) WHERE line_ix < last_ix),
lt AS (SELECT doc_id, line_ix, unnest({Q_STEMS.format(w='ws')}) AS s FROM l), pt AS (SELECT doc_id, pool_ix, len(st) AS ns, unnest(st) AS s FROM p),
sh AS (SELECT doc_id, line_ix, pool_ix, ns, count(*)::INT AS shared FROM lt JOIN pt USING (doc_id, s) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_ix ORDER BY shared DESC, ns, pool_ix) AS rk FROM sh) WHERE rk = 1)
SELECT doc_id, line_ix, pool_ix, coalesce(shared, 0) AS shared, len(list_filter(ws[2:], lambda w: w NOT IN {q_list(lk.TRACE_FREE)} AND NOT list_contains(coalesce(st, []), {tx.q_stem('w')})))::INT AS n_added
FROM l LEFT JOIN best USING (doc_id, line_ix) LEFT JOIN p USING (doc_id, pool_ix)""")
def _(t):
    """Sentences of a document's last line traced to its other lines."""
    k = _kinds(t)
    lines = k.where("kind_rank = 0").select("doc_id", F.posexplode(tx.sentences("line")).alias("line_ix", "line"))
    pool = k.where("kind_rank <> 0").select("doc_id", F.col("line_ix").alias("pool_ix"), F.col("line").alias("pool_line"))
    return lk.trace_source(lines, pool, "doc_id")


@query("d13_subset_pairs", """WITH i AS (SELECT p_name AS item FROM part UNION SELECT p_name || ' ' || lower(p_type) FROM part WHERE p_partkey % 7 = 0),
s AS (SELECT list_sort(list_distinct(list_filter(string_split(item, ' '), lambda w: length(w) >= 3))) AS s, min(item) AS item FROM i GROUP BY 1)
SELECT a.item, count(*) AS n_supersets, min(b.item) AS first_superset FROM s a, s b WHERE len(b.s) > len(a.s) AND len(list_intersect(a.s, b.s)) = len(a.s) GROUP BY 1""")
def _(t):
    items = t.part.select(F.col("p_name").alias("item")).unionByName(
        t.part.where("p_partkey % 7 = 0").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("item")))
    return lk.subset_items(items, "item")


@query("d14_apply_alias_dimension", "SELECT c_custkey, n_name AS country, r_name AS meta FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    dim = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return lk.apply_alias(t.customer, "c_nationkey", dim, "n_nationkey", "n_name", "r_name").select("c_custkey", "country", "meta")


@query("d15_restriction_gate", """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND n_regionkey <> 4 THEN 'blocker' WHEN o_orderpriority = '2-HIGH' AND c_nationkey NOT IN (3, 7) THEN 'blocker' ELSE 'info' END AS state
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    """Order priority as the restriction of a posting: it admits the nations of one region, or two nations, or all."""
    admits = t.nation.select(F.col("n_nationkey").alias("nation"), F.explode(F.array_compact(F.array(
        F.when(F.col("n_regionkey") == 4, "1-URGENT"), F.when(F.col("n_nationkey").isin(3, 7), "2-HIGH")))).alias("restriction"))
    req = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_orderpriority").alias("restriction"), F.col("c_nationkey").alias("nation"))
    return lk.restriction_gate(req, admits, "restriction", "nation", F.col("restriction").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "state")


@query("d16_language_level_join", """WITH have AS (SELECT p_brand, max(p_size % 5 + 1) AS lvl FROM part WHERE p_type = 'PROMO' GROUP BY 1)
SELECT p_partkey, coalesce(lvl >= p_size % 7 + 1, false) AS proven FROM part LEFT JOIN have USING (p_brand)""")
def _(t):
    """Brand as the language, size as the level: required by every part, held by PROMO parts."""
    have = t.part.where("p_type = 'PROMO'").select("p_brand", (F.col("p_size") % 5 + 1).alias("level"))
    req = t.part.select("p_partkey", "p_brand", (F.col("p_size") % 7 + 1).alias("need"))
    return lk.language_level(req, have, "p_brand", "need", "level").select("p_partkey", "proven")


@query("d17_contradictions", """SELECT user_id, day, first_a, first_b FROM (SELECT user_id, ts::DATE AS day, min(CASE WHEN event_type = 'click' THEN event_id END) AS first_a, min(CASE WHEN event_type = 'error' THEN event_id END) AS first_b
  FROM events GROUP BY ALL) WHERE first_a IS NOT NULL AND first_b IS NOT NULL""")
def _(t):
    return lk.contradictions(t.events.withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type", "click", "error", "event_id")


Q_TAGS = f"WITH {Q_KINDS}, hits AS (SELECT doc_id, concept, count(*) AS n_hits, bool_or(line_ix = 0) AS tagged FROM kinds JOIN bench_lex USING (concept) GROUP BY ALL)"


@query("d18_suggest_missing_tags", Q_TAGS + " SELECT doc_id, concept, n_hits FROM hits WHERE NOT tagged")
def _(t):
    """A document's own tags are the concepts of its first line."""
    k = _kinds(t)
    occ = lx.concept_occurrences(k, ["doc_id", "kind_rank"], "line", lex(t))
    hits = occ.groupBy("doc_id", "concept").agg(F.count(F.lit(1)).alias("n_hits"))
    tags = t.documents.select("doc_id", F.explode(F.array_distinct(tx.words(F.get(tx.lines("text"), F.lit(0))))).alias("concept"))
    return lk.suggest_missing_tags(hits, tags, "doc_id")


@query("d19_primary_field", f"""WITH {Q_LEXICON}, h AS (SELECT doc_id, w AS concept, pos FROM (SELECT doc_id, {tx.q_words("array_to_string(" + tx.q_lines('text') + "[1:3], ' ')")} AS ws FROM documents) d, unnest(d.ws) WITH ORDINALITY AS u(w, pos))
SELECT doc_id, arg_min(concept, pos) AS field FROM h JOIN bench_lex USING (concept) WHERE length(concept) >= 9 GROUP BY 1""")
def _(t):
    """Sector concepts are the long lexicon words; title and first two duties are the first three lines."""
    head = t.documents.select("doc_id", F.array_join(F.slice(tx.lines("text"), 1, 3), " ").alias("head"))
    occ = lx.concept_occurrences(head, ["doc_id"], "head", lex(t).where(F.length("concept") >= 9))
    return occ.groupBy("doc_id").agg(F.min_by("concept", "pos").alias("field"))
