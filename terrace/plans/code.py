"""Queries over source code that is made of the tables' rows, along time, and with subtotals, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import go_refs, parsers, strict_json, table_functions
from ..operators import history, incremental, packages, rollups, source_graph, timeline
from ..staging import stage
from ..streaming import sessions

MODULE = "example.com/m"


def go_files(spark: SparkSession, d: str) -> DataFrame:
    """path, source: a file for each document, in a package for each language.

    Each declares a type and calls its Step. Documents in English have that method;
    a type embeds the one of the document before where that is longer, so it may be
    lent from afar, and across packages.
    """
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("lang", F.lit("xx")).alias("lang"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("lang").alias("b_lang"), F.col("size").alias("b_size"))
    rows = docs.join(before, "doc_id", "left").withColumn("lends", F.coalesce(F.col("b_size") > F.col("size"), F.lit(False)))
    abroad = F.col("lends") & (F.col("b_lang") != F.col("lang"))
    number, other = F.col("doc_id").cast("string"), (F.col("doc_id") - 1).cast("string")
    text = F.concat(
        F.lit("package "), "lang", F.lit("\n\n"),
        F.when(abroad, F.concat(F.lit(f'import "{MODULE}/src/'), "b_lang", F.lit('"\n\n'))).otherwise(""),
        F.lit("type D"), number, F.lit(" struct {\n"),
        F.when(F.col("lends"), F.concat(F.lit("\t"), F.when(abroad, F.concat("b_lang", F.lit("."))).otherwise(""), F.lit("D"), other, F.lit("\n"))).otherwise(""),
        F.lit("}\n\n"),
        F.when(F.col("lang") == "en", F.concat(F.lit("func (d *D"), number, F.lit(") Step() *D"), number, F.lit(" { return d }\n\n"))).otherwise(""),
        F.lit("func New"), number, F.lit("() (*D"), number, F.lit(", error) { return &D"), number, F.lit("{}, nil }\n\n"),
        F.lit("func Run"), number, F.lit("() {\n\tif x, err := New"), number, F.lit("(); err == nil {\n\t\tx.Step().Step()\n\t}\n}\n"),
    )
    return rows.select(F.concat(F.lit("src/"), "lang", F.lit("/d"), number, F.lit(".go")).alias("path"), text.alias("source"))


def method_calls(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, provider, first, last: calls of methods on values, of the graph of a file for each document."""
    files = stage(go_files(spark, d), "files")
    units, refs = stage(parsers.parse_units(files), "units"), stage(go_refs.reference_table(files), "refs")
    _, edges = source_graph.build(files, units, refs, MODULE)
    return edges.filter((F.col("kind") == "calls") & F.col("dst").contains(":method ")).select("src", "dst", "provider", "first", "last")


def package_order(spark: SparkSession, d: str) -> DataFrame:
    """id, component, level: documents as packages that import their neighbours, in the order in which they can be read.

    A document imports the one before where that is longer, and is imported by the
    one two before where these are alike in language and source, which closes rings.
    """
    docs = stage(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "lang", "source", F.length("text").alias("size")), "packages")
    back = lambda n: docs.select((F.col("id") + n).alias("to"), F.col("lang").alias("b_lang"), F.col("source").alias("b_source"), F.col("size").alias("b_size"))
    longer = docs.join(back(1), F.col("id") == F.col("to")).filter("b_size > size").select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    alike = docs.join(back(2), F.col("id") == F.col("to")).filter("b_lang = lang AND b_source = source").select((F.col("id") - 2).alias("src"), F.col("id").alias("dst"))
    return packages.package_order(docs, stage(longer.unionByName(alike), "imports"))


#: Turns in which an answer is looked for, and turns of a unit.
ANSWERED, TURNS = 4, 3


def turn_versions(spark: SparkSession, d: str) -> DataFrame:
    """file, n, commit, source: a version of each conversation for each of its turns.

    A turn has two lines, and the first says whether a later one of its role has come
    within ANSWERED turns; so a turn's lines change when that one does.
    """
    turns = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("n"), "role")
    later = turns.select("file", "role", F.explode(F.transform(F.sequence(F.lit(1), F.lit(ANSWERED)), lambda k: F.struct((F.col("n") - k).alias("n"), F.col("n").alias("by")))).alias("x")).select("file", "role", "x.n", "x.by")
    told = turns.join(later.groupBy("file", "role", "n").agg(F.min("by").alias("by")), ["file", "role", "n"], "left")
    # A conversation has a few turns, so each goes to every version from its own on.
    last = turns.groupBy("file").agg(F.max("n").alias("last"))
    shown = told.join(last, "file").withColumn("at", F.explode(F.sequence("n", "last")))
    state = F.when(F.col("by") <= F.col("at"), "answered").otherwise("open")
    line = F.concat(F.col("n").cast("string"), F.lit(" "), "role", F.lit(" "), state, F.lit("\n"), F.col("n").cast("string"), F.lit(" end\n"))
    whole = shown.groupBy("file", F.col("at").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "").alias("source"))
    return whole.select("file", "n", F.concat(F.lit("c"), F.col("n").cast("string")).alias("commit"), "source")


def unit_history(spark: SparkSession, d: str) -> DataFrame:
    """file, unit, rank, commit: the newest commits of every three turns of a conversation."""
    versions = stage(turn_versions(spark, d), "versions")
    last = versions.groupBy("file").agg((2 * F.max("n")).alias("lines"))
    first = F.explode(F.sequence(F.lit(1).cast("long"), "lines", F.lit(2 * TURNS).cast("long")))
    units = last.select("file", "lines", first.alias("start")).select("file", F.col("start").alias("unit"), "start", F.least("lines", F.col("start") + 2 * TURNS - 1).alias("end"))
    return history.unit_history(history.version_edits(versions), units)


def _events(spark: SparkSession, d: str, kind: str, *names: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").filter(F.col("event_type") == kind).select("user_id", *(F.col(c).alias(n) for c, n in zip(("ts", "event_id"), names)))


def last_view(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's latest view before it."""
    return timeline.as_of(_events(spark, d, "purchase", "ts", "event_id"), _events(spark, d, "view", "view_ts", "view_id"), ["user_id"], "ts", "view_ts", ["view_id"])


def views_before(spark: SparkSession, d: str) -> DataFrame:
    """event_id, views: the user's views within six hours before a purchase, where there are any."""
    met = timeline.within(_events(spark, d, "purchase", "ts", "event_id"), _events(spark, d, "view", "view_ts", "view_id"), ["user_id"], "ts", "view_ts", 6 * 3600)
    return met.groupBy("event_id").agg(F.count(F.lit(1)).alias("views"))


def subtotals(spark: SparkSession, d: str) -> DataFrame:
    """Documents and their characters by language and source with subtotals; distinct texts by sketch, and whether that is within five percent."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("lang", "source", F.length("text").cast("long").alias("size"), F.xxhash64("text").alias("text"))
    keys = ["lang", "source"]
    told = rollups.rolled_up(rollups.sketched(docs, keys, "text", "size"), keys)
    exact = docs.rollup(*keys).agg(F.grouping_id().alias("g"), F.count_distinct("text").alias("texts")).select(F.col("lang").alias("e_lang"), F.col("source").alias("e_source"), (2 - F.bit_count("g")).alias("e_depth"), "texts")
    met = told.join(exact, F.col("lang").eqNullSafe(F.col("e_lang")) & F.col("source").eqNullSafe(F.col("e_source")) & (F.col("depth") == F.col("e_depth")))
    return met.select(*keys, "depth", "n", "amount", "texts", (F.abs(F.col("distinct") - F.col("texts")) <= 0.05 * F.col("texts")).alias("near"))


def edges_after_change(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, kind, n: uses of names between documents, brought up to date where labels say that a document changed.

    A document defines f and its id and uses the names of the next, the one after and
    the one at twice its id. One labelled good comes to define another name, one labelled
    bad comes to define the name of the document before as well, a toxic one goes.
    """
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("i"))
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy(F.col("doc_id").alias("i")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = stage(docs.join(labels, "i", "left"), "labelled")
    file, name = F.concat(F.lit("d"), F.col("i").cast("string")), lambda n: F.concat(F.lit("f"), n.cast("string"))
    uses = rows.select("toxic", file.alias("file"), file.alias("src"), F.explode(F.array(name(F.col("i") + 1), name(F.col("i") + 2), name(F.col("i") * 2))).alias("name"), F.lit("calls").alias("kind"))
    now = F.when(F.col("quality") == 1, F.array(F.concat(name(F.col("i")), F.lit("b")))).when(F.col("quality") == 0, F.array(name(F.col("i")), name(F.col("i") - 1))).otherwise(F.array(name(F.col("i"))))
    before, after = rows.select(file.alias("file"), name(F.col("i")).alias("name"), file.alias("target")), rows.filter("toxic IS NULL OR toxic = 0").select(file.alias("file"), F.explode(now).alias("name"), file.alias("target"))
    changed = rows.filter("quality IS NOT NULL OR toxic = 1").select(file.alias("file"))
    old = uses.drop("toxic")
    edges = stage(incremental.edge_counts(old, before), "edges")
    return incremental.changed_counts(edges, (old, uses.filter("toxic IS NULL OR toxic = 0").drop("toxic")), (before, after), changed)


def strict_props(spark: SparkSession, d: str) -> DataFrame:
    """event_id, k, reason: the properties of events as JSON with one known key; some kinds of event have a key more, text for a number, or no whole object."""
    events = spark.read.parquet(f"{d}/events.parquet")
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    text = F.when(kind == "purchase", F.concat(F.lit('{"k": '), number, F.lit(', "more": [1, {"k": 2}]}'))).when(kind == "view", F.concat(F.lit('{"k": "'), number, F.lit('"}'))).when(kind == "click", F.concat(F.lit('{"k": '), number)).when(kind == "error", F.concat(F.lit("["), number, F.lit("]"))).otherwise(F.concat(F.lit('{"k": '), number, F.lit("}")))
    got = strict_json.strictly(events.select("event_id", text.alias("t")), "t", {"k": "bigint"}, ("k",))
    return got.select("event_id", F.col("value.k").alias("k"), "reason")


def role_runs(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, run, value, rows, first_turn: stretches of turns of one role, by a table function called from SQL."""
    table_functions.register(spark)
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role")
    return spark.sql("SELECT first_conv_id AS conv_id, run, value, rows, first_turn FROM runs(TABLE({turns}) PARTITION BY conv_id ORDER BY (turn), 'role', 'conv_id', 'turn')", turns=turns)


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """user_id, start, end, events: sessions of users, parted by three hours without an event."""
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = sessions.sessions(events, "user_id", "ts", "3 hours")
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "events")


QUERIES = {"strict_props": strict_props, "role_runs": role_runs, "event_sessions": event_sessions, "edges_after_change": edges_after_change, "method_calls": method_calls, "package_order": package_order, "unit_history": unit_history, "last_view": last_view, "views_before": views_before, "subtotals": subtotals}

ORACLE_SQL = {
    "method_calls": """
        WITH d AS (
            SELECT doc_id, coalesce(lang, 'xx') AS lang, length(coalesce(text, '')) AS size FROM documents),
        l AS (
            SELECT *, lag(doc_id) OVER o = doc_id - 1 AND lag(size) OVER o > size AS lends, lag(lang) OVER o <> lang AS abroad FROM d WINDOW o AS (ORDER BY doc_id)),
        r AS (
            SELECT *, sum(CASE WHEN lends THEN 0 ELSE 1 END) OVER (ORDER BY doc_id) AS run FROM l),
        s AS (
            SELECT *, last_value(CASE WHEN lang = 'en' THEN doc_id END IGNORE NULLS) OVER (PARTITION BY run ORDER BY doc_id) AS of FROM r)
        SELECT 'unit:src/' || lang || '/d' || doc_id || '.go:func Run' || doc_id AS src, 'unit:src/en/d' || of || '.go:method D' || of || '.Step' AS dst, 'go types' AS provider,
            CAST(l.n + 3 AS BIGINT) AS first, CAST(l.n + 3 AS BIGINT) AS last
        FROM (SELECT *, 5 + CASE WHEN lends AND abroad THEN 2 ELSE 0 END + CASE WHEN lends THEN 1 ELSE 0 END + CASE WHEN lang = 'en' THEN 2 ELSE 0 END + 2 AS n FROM s) l
        WHERE of IS NOT NULL""",
    "package_order": """
        WITH RECURSIVE d AS (
            SELECT doc_id AS id, lang, source, length(text) AS size FROM documents),
        e AS (
            SELECT a.id AS src, b.id AS dst FROM d a JOIN d b ON b.id = a.id - 1 AND b.size > a.size
            UNION ALL SELECT a.id, b.id FROM d a JOIN d b ON b.id = a.id + 2 AND a.lang = b.lang AND a.source = b.source),
        reach(a, b) AS (
            SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON r.b = e.src),
        c AS (
            SELECT d.id, least(d.id, coalesce(min(x.b), d.id)) AS component FROM d LEFT JOIN (SELECT r.a, r.b FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a) x ON d.id = x.a GROUP BY d.id),
        ce AS (
            SELECT DISTINCT s.component AS src, t.component AS dst FROM e JOIN c s ON e.src = s.id JOIN c t ON e.dst = t.id WHERE s.component <> t.component),
        walk(c, n) AS (
            SELECT DISTINCT component, 0 FROM c UNION SELECT ce.src, w.n + 1 FROM walk w JOIN ce ON ce.dst = w.c)
        SELECT c.id, c.component, l.level FROM c JOIN (SELECT c, max(n) AS level FROM walk GROUP BY c) l ON c.component = l.c""",
    "unit_history": """
        WITH t AS (
            SELECT conv_id AS file, turn + 1 AS n, role FROM conversations),
        a AS (
            SELECT t.file, t.n, min(b.n) AS later FROM t LEFT JOIN t b ON b.file = t.file AND b.role = t.role AND b.n > t.n AND b.n <= t.n + 4 GROUP BY t.file, t.n),
        c AS (
            SELECT file, n - (n - 1) % 3 AS turn, n AS commit FROM a UNION SELECT file, n - (n - 1) % 3, later FROM a WHERE later IS NOT NULL)
        SELECT file, 2 * turn - 1 AS unit, CAST(row_number() OVER w AS INTEGER) AS rank, 'c' || commit AS commit FROM c
        WINDOW w AS (PARTITION BY file, turn ORDER BY commit DESC) QUALIFY row_number() OVER w <= 5""",
    "last_view": """
        WITH v AS (
            SELECT user_id, ts AS view_ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
        SELECT p.user_id, p.ts, p.event_id, v.view_ts, v.view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.view_ts""",
    "views_before": """
        SELECT p.event_id, count(*) AS views FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 6 HOURS
        WHERE p.event_type = 'purchase' AND v.event_type = 'view' GROUP BY p.event_id""",
    "subtotals": """
        SELECT lang, source, CAST(2 - grouping(lang) - grouping(source) AS INTEGER) AS depth, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS amount, count(DISTINCT text) AS texts, TRUE AS near
        FROM documents GROUP BY ROLLUP (lang, source)""",
    "edges_after_change": """
        WITH l AS (
            SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
        a AS (
            SELECT d.doc_id AS i, l.quality FROM documents d LEFT JOIN l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0),
        f AS (
            SELECT i, 'f' || i || CASE WHEN quality = 1 THEN 'b' ELSE '' END AS name FROM a UNION ALL SELECT i, 'f' || (i - 1) FROM a WHERE quality = 0),
        o AS (
            SELECT name, min(i) AS i FROM f GROUP BY name HAVING count(*) = 1),
        u AS (
            SELECT i, 'f' || unnest([i + 1, i + 2, 2 * i]) AS name FROM a)
        SELECT 'd' || u.i AS src, 'd' || o.i AS dst, 'calls' AS kind, count(*) AS n FROM u JOIN o USING (name) GROUP BY u.i, o.i""",
    "strict_props": """
        WITH t AS (
            SELECT event_id, CASE event_type WHEN 'purchase' THEN '{"k": ' || event_id || ', "more": [1, {"k": 2}]}' WHEN 'view' THEN '{"k": "' || event_id || '"}' WHEN 'click' THEN '{"k": ' || event_id WHEN 'error' THEN '[' || event_id || ']' ELSE '{"k": ' || event_id || '}' END AS t FROM events),
        r AS (
            SELECT event_id, t, CASE WHEN NOT json_valid(t) THEN 'no JSON' WHEN json_type(t) <> 'OBJECT' THEN 'no object' WHEN len(list_filter(json_keys(t), lambda x: x <> 'k')) > 0 THEN 'unknown key ' || list_min(list_filter(json_keys(t), lambda x: x <> 'k'))
                WHEN json_type(t, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN 'k is no bigint' END AS reason FROM t)
        SELECT event_id, CASE WHEN reason IS NULL THEN CAST(json_extract(t, '$.k') AS BIGINT) END AS k, reason FROM r""",
    "role_runs": """
        WITH f AS (
            SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS fresh FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        r AS (
            SELECT *, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM f)
        SELECT conv_id, run, any_value(role) AS value, count(*) AS rows, min(turn) AS first_turn FROM r GROUP BY conv_id, run""",
    "event_sessions": """
        WITH f AS (
            SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 3 HOURS THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        s AS (
            SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM f)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 3 HOURS, '%Y-%m-%d %H:%M:%S') AS end, count(*) AS events FROM s GROUP BY user_id, n""",
}
