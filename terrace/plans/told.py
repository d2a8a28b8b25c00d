"""Queries of narration, of the model boundary and of the parsers; they join the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsers
from ..operators import evidence, explain, narration, presentation, review
from ..operators.relational import top_k
from ..settings import Settings
from . import tables
from .catalogue import _stops, query
from .tables import GRAPH_SQL, SNAPSHOTS_SQL, table

# Narration

#: Lists of names in SQL: all but the last joined by commas, the last by "and".
LISTED = "CASE WHEN len({0}) < 2 THEN array_to_string({0}, '') ELSE array_to_string({0}[1:len({0}) - 1], ', ') || ' and ' || {0}[-1] END"


@query(f"""WITH {GRAPH_SQL}, tests AS (SELECT DISTINCT src AS id, dst AS other FROM edges WHERE kind = 'tested-by'),
    called AS (SELECT dst AS id, src AS other FROM edges e WHERE kind = 'calls' AND NOT EXISTS (SELECT 1 FROM tests t WHERE t.id = e.dst AND t.other = e.src)),
    told AS (SELECT src AS id, 0 AS place, dst AS other FROM edges WHERE kind IN ('calls', 'local-module-source') UNION ALL SELECT id, 1, other FROM called UNION ALL SELECT id, 2, other FROM tests),
    first AS (SELECT *, row_number() OVER (PARTITION BY id, place ORDER BY other) AS spot, count(*) OVER (PARTITION BY id, place) AS n FROM told),
    few AS (SELECT f.id, place, max(n) AS n, list(regexp_replace(o.name, '^(type|data|class) ', '') ORDER BY spot) AS names FROM first f JOIN nodes o ON o.id = f.other WHERE spot <= 4 GROUP BY f.id, place)
    SELECT s.id, place, CASE WHEN place = 0 THEN 'Relies on ' WHEN place = 2 THEN 'Checked by ' WHEN n = 1 THEN 'One caller: ' ELSE n || ' callers: ' END
        || {LISTED.format("names")} || CASE WHEN n > 4 THEN ' and ' || (n - 4) || ' more' ELSE '' END || CASE WHEN place = 0 THEN ' of this tree.' ELSE '.' END AS sentence FROM few s JOIN nodes u ON u.id = s.id AND u.is_unit
    UNION ALL SELECT id, 1, 'No known caller.' FROM nodes WHERE is_unit AND NOT list_contains(roles, 'entry point') AND NOT list_contains(roles, 'test') AND id NOT IN (SELECT id FROM called)""")
def connections(spark, d):
    return narration.connections(*tables.keyed_graph(spark, d), name=tables.named_key).withColumn("id", tables.named_key())


REASONS = ("Called by func 0", "Tests func 1", "Has a test", "Is a test", "In a file of recent commits", "Aside", "Begins")


def _told_stops(spark, d):
    pick = F.element_at(F.array(*map(F.lit, REASONS)), ((F.col("conv_id") + F.col("n")) % len(REASONS) + 1).cast("int"))
    roles = F.when(F.col("n") % 2 == 0, F.array(F.lit("entry point"), F.lit("configuration"))).otherwise(F.array().cast("array<string>"))
    return _stops(spark, d).select("conv_id", "n", F.concat(F.lit("func "), F.col("n").cast("string")).alias("name"), F.col("role").alias("path"), pick.alias("reason"), roles.alias("roles"))


TOLD_SQL = f"""s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n, role AS path FROM conversations),
    t AS (SELECT *, {list(REASONS)}[(conv_id + n) % {len(REASONS)} + 1] AS reason FROM s)"""


@query(f"""WITH {TOLD_SQL} SELECT conv_id, n, CASE (conv_id + n) % 7
        WHEN 0 THEN '0 calls ' || n || CASE WHEN n = 1 THEN ': one level below the stop before.' ELSE '; still below 0.' END
        WHEN 1 THEN 'A test of 1; what it asserts is meant to hold.'
        WHEN 2 THEN n || ' has a test of its own, shown next.'
        WHEN 3 THEN 'A test; its assertions say what must stay true.'
        WHEN 4 THEN n || ' in ' || path || ', a file of recent commits.'
        WHEN 5 THEN 'Aside: ' || n || ' in ' || path || '.' ELSE n || ' in ' || path || '.' END
        || CASE WHEN n % 2 = 1 THEN '' ELSE CASE WHEN reason LIKE 'Tests %' OR reason = 'Is a test' THEN '' ELSE ' The program begins with it.' END || ' It looks up settings in the environment.' END AS sentence,
        CASE WHEN lead(n) OVER w IS NULL THEN '' ELSE (n + 1) || '' END AS next_name, coalesce(lead(path) OVER w, '') AS next_path FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY n)""")
def tour_narration(spark, d):
    return narration.narrate_stops(_told_stops(spark, d), ["conv_id"])


@query(f"""WITH {TOLD_SQL}, k AS (SELECT conv_id, n, CASE (conv_id + n) % 7 WHEN 0 THEN 'from:func 0' WHEN 1 THEN 'pairs' WHEN 2 THEN 'pairs' WHEN 5 THEN 'more' ELSE 'start' END AS chapter FROM t),
    f AS (SELECT *, CASE WHEN lag(chapter) OVER w = chapter THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
    c AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY n) AS BIGINT) AS chapter_no FROM f)
    SELECT conv_id, chapter_no, any_value(chapter) AS chapter, count(*) AS stops, CASE any_value(chapter) WHEN 'from:func 0' THEN 'Below 0' WHEN 'pairs' THEN 'Code beside its tests' WHEN 'more' THEN 'Other parts worth a look' ELSE 'What is tested' END AS title FROM c GROUP BY conv_id, chapter_no""")
def tour_chapters(spark, d):
    found = presentation.chapters(_told_stops(spark, d), ["conv_id"], [F.col("n")], narration.chapter_key(F.col("reason")))
    return found.withColumn("title", narration.chapter_title(F.col("chapter"), "testing"))


@query(f"""WITH {SNAPSHOTS_SQL}, c AS (SELECT id, status, coalesce(after_path, before_path) AS path, length(coalesce(after_source, '')) AS added, length(coalesce(before_source, '')) AS removed, coalesce(after_start, before_start) AS start FROM changes),
    k AS (SELECT *, added || ' line' || CASE WHEN added = 1 THEN '' ELSE 's' END AS a, removed || ' line' || CASE WHEN removed = 1 THEN '' ELSE 's' END AS r, start || '' AS me FROM c)
    SELECT id, CASE status WHEN 'added' THEN 'New: ' || me || ', ' || a || '.' WHEN 'removed' THEN 'Gone: ' || me || ', ' || r || '.' ELSE 'Edited: ' || me || '; ' || a || ' in, ' || removed || ' out.' END || CASE WHEN start % 3 = 0 THEN ' Nothing but blanks differs.' ELSE '' END AS sentence FROM k""")
def change_narration(spark, d):
    changes = review.compare(tables.orders_before(spark, d), tables.orders_after(spark, d), "id", ["path", "kind", "start", "source"])
    size, start = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))), F.coalesce("after_start", "before_start")
    rows = changes.select("id", "status", F.concat(F.lit("method "), start.cast("string")).alias("name"), F.coalesce("after_path", "before_path").alias("path"), size("after_source").alias("added"), size("before_source").alias("removed"), F.lit("").alias("old_name"), F.col("before_path").alias("old_path"), (start % 3 == 0).alias("whitespace_only"))
    return rows.select("id", narration.change_sentence(rows).alias("sentence"))


@query(f"""WITH l AS (SELECT DISTINCT 'o:' || l_orderkey AS id, CASE WHEN l_returnflag = 'R' THEN 'tested-by' WHEN l_returnflag = 'A' THEN 'calls' ELSE 'imports' END AS kind, CASE WHEN l_quantity > 25 THEN 'added' ELSE 'removed' END AS change, 'unit:x:func ' || l_suppkey AS dst, l_orderkey FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY id, kind, change ORDER BY dst) AS spot, count(*) OVER (PARTITION BY id, kind, change) AS total FROM l WHERE NOT (kind = 'tested-by' AND change = 'added' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))),
    g AS (SELECT id, change, kind, max(total) AS total, list(substr(dst, 13) ORDER BY spot) AS names FROM r WHERE spot <= 2 GROUP BY id, change, kind)
    SELECT id, change, kind, CASE WHEN kind = 'tested-by' THEN CASE change WHEN 'added' THEN 'Newly tested by ' ELSE 'No longer tested by ' END ELSE CASE change WHEN 'added' THEN 'Newly: ' ELSE 'No longer: ' END || kind || ' ' END
        || {LISTED.format("names")} || CASE WHEN total > 2 THEN ' and ' || (total - 2) || ' more' ELSE '' END || '.' AS sentence FROM g""")
def relation_narration(spark, d):
    """Two names a sentence, so that "and more" occurs."""
    flag = F.col("l_returnflag")
    kind = F.when(flag == "R", "tested-by").when(flag == "A", "calls").otherwise("imports")
    delta = table(spark, d, "lineitem").select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("src"), kind.alias("kind"), F.when(F.col("l_quantity") > 25, "added").otherwise("removed").alias("change"), F.concat(F.lit("unit:x:func "), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    tested = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"))
    return narration.relation_sentences(delta, tested, 2)


SIGNAL_KINDS = ("unchanged-callers", "tests-changed", "tests-unchanged", "no-known-test")


@query(f"""WITH s AS (SELECT c_custkey AS id, {list(SIGNAL_KINDS)}[c_custkey % 4 + 1] AS kind, CASE WHEN c_nationkey % 2 = 0 THEN 'removed' ELSE 'modified' END AS status, string_split(c_name, '#') AS names FROM customer)
    SELECT id, CASE WHEN kind = 'no-known-test' THEN 'No known test.' ELSE CASE kind WHEN 'tests-changed' THEN 'Tests changed too: ' WHEN 'tests-unchanged' THEN 'Tests left as they were: '
        ELSE CASE status WHEN 'removed' THEN 'Had been called, and still is in the text, from ' ELSE 'Callers left as they were: ' END END || {LISTED.format("names")} || '.' END AS sentence FROM s""")
def signal_narration(spark, d):
    kind = F.element_at(F.array(*map(F.lit, SIGNAL_KINDS)), (F.col("c_custkey") % 4 + 1).cast("int"))
    status = F.when(F.col("c_nationkey") % 2 == 0, "removed").otherwise("modified")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), narration.signal_sentence(kind, status, F.split("c_name", "#", -1)).alias("sentence"))


@query("""WITH e AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') || ' “' || event_type || '”' AS dated, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events),
    f AS (SELECT 'u:' || user_id AS node, 1 AS p, 'Last commit here, ' || day || ': “' || event_type || '”.' AS sentence FROM e WHERE n = 1
        UNION ALL SELECT 'u:' || user_id, 2, 'Earlier: ' || string_agg(dated, ' and ' ORDER BY n) || '.' FROM e WHERE n IN (2, 3) GROUP BY user_id)
    SELECT node, row_number() OVER (PARTITION BY node ORDER BY p) AS place, sentence FROM f""")
def brief_narration(spark, d):
    events = table(spark, d, "events").withColumn("node", F.concat(F.lit("u:"), F.col("user_id").cast("string")))
    newest = top_k(events, ["node"], [F.col("ts").desc(), F.col("event_id")], evidence.MAX_COMMITS, "n")
    return narration.narrate_brief(newest.select(*evidence.fact("commit", "dated-history", n=F.col("n"), text=F.col("event_type"), date=F.date_format("ts", "yyyy-MM-dd"))))


# The model boundary

MODEL = Settings(provider="openai", model="m", max_input_tokens=600)


@query(f"""WITH p AS (SELECT doc_id, octet_length(encode(text)) AS size, '{explain.ASK_SOURCE.replace("'", "''")}' || chr(10) || 'Path: ' || source || chr(10) || 'Unit: ' || doc_id || chr(10) || 'Around it in the module: ' || chr(10) || 'Source:' || chr(10) || '```' || chr(10) || text || chr(10) || '```' AS prompt FROM documents),
    e AS (SELECT doc_id, size, prompt, CAST(ceil(octet_length(encode(prompt)) / 3.0) AS BIGINT) AS estimated_tokens FROM p)
    SELECT doc_id, estimated_tokens, sha256('openai' || chr(0) || 'm' || chr(0) || prompt || chr(0)) AS digest, CASE WHEN estimated_tokens > 600 OR size > 18000 THEN 'too_large' ELSE 'ready' END AS status FROM e""")
def explain_payloads(spark, d):
    """A limit of 600 tokens, so that both outcomes occur; the product's own is 6,000."""
    docs = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("size"), explain.source_prompt(F.col("source"), F.col("doc_id").cast("string"), F.lit(""), F.col("text")).alias("prompt"))
    return explain.payloads(docs, MODEL, F.col("size")).select("doc_id", "estimated_tokens", "digest", "status")


@query("""WITH h AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, '@@' || chr(10) || '+' || text || chr(10) AS part FROM conversations),
    r AS (SELECT *, sum(octet_length(encode(part))) OVER (PARTITION BY conv_id ORDER BY n) AS used FROM h)
    SELECT conv_id, sha256(coalesce(string_agg(part, '' ORDER BY n) FILTER (WHERE used <= 400), '')) AS text_sha256, CAST(count(*) FILTER (WHERE used > 400) AS INTEGER) AS omitted FROM r GROUP BY conv_id""")
def change_diff_text(spark, d):
    """Each turn of a conversation as a hunk of one line, in 400 bytes."""
    hunk = F.array(F.struct(F.lit("+").alias("op"), "text"))
    whole = _stops(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", hunk.alias("lines")))), lambda x: x["lines"]).alias("hunks"))
    return whole.withColumn("diff", explain.diff_text(F.col("hunks"), 400)).select("conv_id", F.sha2("diff.text", 256).alias("text_sha256"), F.col("diff.omitted").alias("omitted"))


@query("""WITH e AS (SELECT user_id AS id, event_type || ' ' || event_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'view'),
    t AS (SELECT id, string_agg('- ' || CASE WHEN n = 41 THEN '(and more)' ELSE line END, chr(10) ORDER BY n) || chr(10) AS facts FROM e WHERE n <= 41 GROUP BY id)
    SELECT c_custkey AS id, coalesce(facts, '- nothing is known' || chr(10)) AS facts FROM customer LEFT JOIN t ON t.id = c_custkey""")
def change_facts(spark, d):
    facts = table(spark, d, "events").filter("event_type <> 'view'").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("line"))
    return explain.fact_text(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), facts)


@query("""WITH m AS (SELECT 'env/' || p_brand || '/' || p_type || '/' || p_partkey AS path, p_partkey AS ord, p_name || '; ' AS part, ['env/' || p_brand, 'env/' || p_brand || '/' || p_type, 'env'] AS dirs FROM part),
    l AS (SELECT s_suppkey AS id, 'env/Brand#' || (s_suppkey % 25 + 1) AS module FROM supplier),
    r AS (SELECT id, path, ord, part, sum(octet_length(encode(part))) OVER (PARTITION BY id ORDER BY path, ord) AS used FROM l JOIN m ON list_contains(m.dirs, l.module))
    SELECT l.id, coalesce(t.context, '') AS context FROM l LEFT JOIN (SELECT id, string_agg(part, '' ORDER BY path, ord) AS context FROM r WHERE used <= 1800 GROUP BY id) t USING (id)""")
def module_context(spark, d):
    units = table(spark, d, "part").select(F.concat_ws("/", F.lit("env"), "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))
    return explain.module_context(units, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("env/Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string"), F.lit("/")).alias("module")))


SENDING_SQL = """r AS (SELECT conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, CAST(ceil(octet_length(encode(text)) / 3.0) AS BIGINT) AS estimate, turn % 4 = 3 AS cached, turn % 3 = 1 AS failed, CASE WHEN turn % 2 = 0 THEN length(text) // 4 ELSE 0 END AS actual FROM conversations),
    f AS (SELECT session, CAST(0 AS BIGINT) AS n, '' AS status, CAST(0 AS BIGINT) AS used FROM r WHERE n = 1
        UNION ALL SELECT r.session, r.n, CASE WHEN r.cached THEN 'cached' WHEN f.used + r.estimate > 120 THEN 'refused' WHEN r.failed THEN 'failed' ELSE 'sent' END,
            f.used + CASE WHEN r.cached OR f.used + r.estimate > 120 OR r.failed THEN 0 WHEN r.actual > 0 THEN r.actual ELSE r.estimate END FROM f JOIN r ON r.session = f.session AND r.n = f.n + 1)"""


def _sending(spark, d):
    from ..functions.text import token_estimate

    requests = _stops(spark, d).select(F.col("conv_id").alias("session"), (F.col("n") + 1).alias("n"), token_estimate(F.col("text")).alias("estimate"), (F.col("turn") % 4 == 3).alias("cached"), (F.col("turn") % 3 == 1).alias("failed"), F.when(F.col("turn") % 2 == 0, F.floor(F.length("text") / 4)).otherwise(0).alias("actual"))
    return explain.sending(requests, 120)


@query(f"WITH RECURSIVE {SENDING_SQL} SELECT session, n, status, used FROM f WHERE n > 0")
def sending(spark, d):
    return _sending(spark, d)


@query(f"""WITH RECURSIVE {SENDING_SQL} SELECT session, count(*) FILTER (WHERE status = 'sent') AS sent, count(*) FILTER (WHERE status = 'cached') AS cached, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'refused') AS refused,
    arg_max(used, n) AS used, CAST(least(100, round(100 * arg_max(used, n) / 120)) AS INTEGER) AS share FROM f WHERE n > 0 GROUP BY session""")
def request_counts(spark, d):
    return explain.request_counts(_sending(spark, d), 120)


@query("""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n, role, text FROM conversations)
    SELECT conv_id, string_agg(text, chr(10) ORDER BY n) FILTER (WHERE role = 'assistant' AND trim(text) <> '') AS text, count(*) AS input_tokens, CAST(max(n) AS BIGINT) AS output_tokens,
        CASE WHEN count(*) FILTER (WHERE role = 'assistant' AND trim(text) <> '') = 0 THEN substr('no answer in ' || conv_id, 1, 240) END AS error FROM c GROUP BY conv_id""")
def chat_answers(spark, d):
    """Each conversation as one answer, its assistant's turns the parts."""
    content = F.when(F.col("role") == "assistant", F.col("text")).otherwise(" ")
    told = _stops(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", content.alias("content")))), lambda x: F.struct(F.struct(x["content"].alias("content")).alias("message"))).alias("choices"), F.count(F.lit(1)).alias("prompt_tokens"), F.max("n").alias("completion_tokens"))
    raw = told.select("conv_id", F.to_json(F.struct("choices", F.struct("prompt_tokens", "completion_tokens").alias("usage"), F.struct(F.concat(F.lit("no answer in "), F.col("conv_id").cast("string")).alias("message")).alias("error"))).alias("json"))
    return explain.answers(raw, "chat").select("conv_id", "text", "input_tokens", "output_tokens", "error")


@query("""SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS back, substr(event_type, 1, 4) AS note FROM events QUALIFY back <= 3""")
def kept_notes(spark, d):
    notes = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "ts", F.col("event_type").alias("note"))
    return presentation.kept_notes(notes, ["user_id"], [F.col("ts").desc(), F.col("id")], 3, 4)


@query("""WITH h AS (SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS hunk_no, text FROM conversations)
    SELECT id, CAST(hunk_no AS INTEGER) AS hunk_no, 0 AS row_no, '' AS op, '@@ −' || (hunk_no + 1) || ' +' || (hunk_no + 2) || ' @@' AS text, 0 AS before, 0 AS after FROM h
    UNION ALL SELECT id, hunk_no, 1, '+', text, 0, hunk_no + 2 FROM h UNION ALL SELECT id, hunk_no, 2, '-', text, hunk_no + 1, 0 FROM h""")
def review_rows(spark, d):
    """Each turn as a hunk: one line added and one removed."""
    n = F.col("n").cast("int")
    line = lambda op, before, after: F.struct(F.lit(op).alias("op"), F.col("text"), before.cast("int").alias("before"), after.cast("int").alias("after"))
    hunk = F.array(line("+", F.lit(0), n + 2), line("-", n + 1, F.lit(0)))
    whole = _stops(spark, d).groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", hunk.alias("lines")))), lambda x: x["lines"]).alias("hunks"))
    return presentation.review_rows(whole, "id")


# Parsers

#: Of each language: name of a file, what a comment line starts with, code that follows the document's comment lines
#: (or goes before them, in playbooks, which are told by how a file begins), kind of file, and its units: kind, name,
#: first and last line of the code.
LANGUAGES = [
    ("a.py", "# ", "def f():\n    pass\n\nclass C:\n    x = 1\n", "python", [("function", "func f", 1, 3), ("type", "class C", 4, 6)]),
    ("b.sh", "# ", "f() {\n  : \"}\"\n}\nfunction g {\n  cat <<E\n}\nE\n}\n", "shell", [("function", "function f", 1, 3), ("function", "function g", 4, 8)]),
    ("c.go", "// ", "package a\n\nfunc One() {\n}\n\nfunc (t *T) Run() {\n}\n\ntype T struct {\n\tx int\n}\n", "go", [("function", "func One", 3, 4), ("function", "method T.Run", 6, 7), ("type", "type T", 9, 11)]),
    ("d.tf", "# ", 'resource "k" "n" {\n  a = "}"\n}\nlocals {\n}\n', "terraform", [("resource", "resource k.n", 1, 3), ("locals", "locals", 4, 5)]),
    ("e.yml", "# ", "- hosts: web\n  tasks:\n    - ping:\n- name: two\n  hosts: db\n", "ansible", [("play", "play web", 1, 3), ("play", "play two", 4, 5)]),
    ("f.yaml", "# ", "a: 1\n", "yaml", [("yaml", "f.yaml", 0, 2)]),
    ("g.js", "// ", "f();\n", "frontend", [("frontend", "g.js", 0, 2)]),
    ("h.md", "", "", "document", [("document", "h.md", 0, 1)]),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


UNITS_SQL = ", ".join(f"({i}, {_quoted(name)}, {_quoted(kind)}, {_quoted(unit_kind)}, {_quoted(unit)}, {first}, {last})" for i, (name, _, _, kind, units) in enumerate(LANGUAGES) for unit_kind, unit, first, last in units)


@query(f"""WITH u(language, file, file_kind, kind, name, first, last) AS (VALUES {UNITS_SQL}),
    f AS (SELECT doc_id % {len(LANGUAGES)} AS language, source || '/' || doc_id AS dir, strlen(text) - strlen(replace(text, chr(10), '')) + 1 AS n FROM documents)
    SELECT dir || '/' || file AS path, file_kind, dir || '/' || file || ':' || name AS unit_id, kind, name, CAST(CASE WHEN first = 0 THEN 1 WHEN file_kind = 'ansible' THEN first ELSE n + first END AS INTEGER) AS start, CAST(CASE WHEN file_kind = 'ansible' THEN last ELSE n + last END AS INTEGER) AS "end" FROM f JOIN u USING (language)""")
def parse_units(spark, d):
    """Each document as the comment above a source file, in a language by the remainder of its id."""
    files = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(mark).alias("mark"), F.lit(code).alias("code")) for name, mark, code, _, _ in LANGUAGES))
    docs = table(spark, d, "documents").withColumn("file", F.element_at(files, (F.col("doc_id") % len(LANGUAGES) + 1).cast("int")))
    comment = F.concat("file.mark", F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), "file.mark")), F.lit("\n"))
    source = F.when(F.col("file.name") == "e.yml", F.concat("file.code", comment)).otherwise(F.concat(comment, "file.code"))
    return parsers.parse_units(docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string"), "file.name").alias("path"), source.alias("source"))).drop("links")
