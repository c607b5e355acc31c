"""The same answers as plain SQL over the supplied tables.

Nothing here decodes anything: each statement works out what the engine should
find from the columns of ``events`` and the templates of the lines.
"""

from __future__ import annotations

from .adapter import BLOCK_MANAGER, BODIES, JVM_BODIES, LEVEL, OWN, SPAN, Leaf, Tree, envelope, json_sql, node

TEXT = "CAST({} AS VARCHAR)"
K, USER = "CAST(k AS VARCHAR)", "CAST(user_id AS VARCHAR)"

RAW = {name: body for name, _c, body in BODIES} | {name: body for name, _t, body in JVM_BODIES}
FUNCTIONS = {
    "scheduler": node("'org.apache.spark.scheduler.DAGSchedulerEventProcessLoop.doOnReceive'", "'org.apache.spark.scheduler.DAGSchedulerEvent'"),
    "update": node("'org.apache.spark.storage.BlockManagerMaster.updateBlockInfo'", "'org.apache.spark.storage.BlockManagerId'", "'long'"),
    "env": node("'org.apache.spark.SparkContext.createSparkEnv'", "'org.apache.spark.SparkConf'", "'boolean'"),
    "submit": node("'org.apache.spark.deploy.yarn.Client.submitApplication'", "'int'"),
    "run": node("'a.b.C.run'", "'int'", "'java.util.Map(x)'"),
}
MANAGER = node("'BlockManagerId'", USER, f"'10.0.0.' || {USER}", K)
STORAGE = node("'StorageLevel'", "'memory'", f"'deserialized(' || {K} || ')'", "'1 replicas'")
TASK = node("'Task'", TEXT.format("k % 7"), TEXT.format("user_id % 50"))


def replaced(tree, path: tuple[int, ...], new):
    """A template with one subtree replaced."""
    if not path:
        return new
    children = list(tree.children)
    children[path[0] - 1] = replaced(children[path[0] - 1], path[1:], new)
    return Tree(tree.name, tuple(children))


def at(tree, *path: int):
    for i in path:
        if not isinstance(tree, Tree) or i > len(tree.children):
            return None
        tree = tree.children[i - 1]
    return tree


PARSED = dict(RAW)
for tag in ("begin", "complete", "job", "executor"):
    PARSED[tag] = replaced(PARSED[tag], (1,), FUNCTIONS["scheduler"])
for tag in ("begin", "complete"):
    PARSED[tag] = replaced(PARSED[tag], (2, 1, 1), TASK)
PARSED["block"] = replaced(replaced(replaced(RAW["block"], (1,), FUNCTIONS["update"]), (2, 1), MANAGER), (2, 3), STORAGE)
PARSED["variable"] = replaced(RAW["variable"], (1,), node("'a.b.C.run'", "'int'"))
for tag, function in (("span_env", "env"), ("span_submit", "submit"), ("span_other", "run")):
    PARSED[tag] = replaced(RAW[tag], (2, 1), FUNCTIONS[function])
PARSED["rpc_block"] = replaced(RAW["rpc_block"], (3,), MANAGER)
PARSED["rpc_update"] = replaced(RAW["rpc_update"], (3, 3), STORAGE)

KIND = {tag: body.name for tag, body in RAW.items()}
HEARTBEAT = "tag != 'heartbeat'"


# ---------------------------------------------------------------- templates to SQL


def name(tree) -> str:
    if tree is None:
        return "''"
    if isinstance(tree, Tree):
        return tree.name
    return "'null'" if tree.sql is None else f"({tree.sql})"


def defined(tree) -> bool:
    if tree is None or (isinstance(tree, Leaf) and tree.sql == "''"):
        return False
    return True


def text(tree) -> str:
    if isinstance(tree, Tree) and tree.children:
        return f"{name(tree)} || '(' || " + " || ', ' || ".join(map(text, tree.children)) + " || ')'"
    return name(tree)


def nodes(tree, path=()) -> list[tuple[tuple[int, ...], str, bool]]:
    children = tree.children if isinstance(tree, Tree) else ()
    below = [n for i, child in enumerate(children) for n in nodes(child, (*path, i + 1))]
    return [(path, name(tree), bool(children)), *below]


def dump(tree) -> str:
    lines = []
    for path, label, parent in nodes(tree):
        shown = ".".join(map(str, (*path, 0) if parent else path))
        lines.append(f"'{shown}' || repeat('.', {8 + 2 * len(path) - len(shown)}) || {label}")
    return " || chr(10) || ".join(lines)


def by_tag(make, trees=RAW, type_: str | None = None) -> str:
    whens = " ".join(f"WHEN '{tag}' THEN {make(tree)}" for tag, tree in trees.items())
    return f"(CASE tag {whens} END)"


def named(*path: int, trees=RAW) -> str:
    return f"NULLIF({by_tag(lambda t: name(at(t, *path)), trees)}, '')"


def rendered(*path: int, trees=RAW) -> str:
    return by_tag(lambda t: text(at(t, *path)), trees)


# ---------------------------------------------------------------- shared tables


def lines_cte(where: str = "true") -> str:
    tags = " ".join(f"WHEN {condition} THEN '{tag}'" for tag, condition, _b in BODIES)
    lives = " ".join(
        f"UNION ALL SELECT trace_id, uuid, {time}, '{tag}', NULL, user_id, NULL, NULL, lo, hi FROM jvm" for tag, time, _b in JVM_BODIES
    )
    return f"""ev AS (
  SELECT event_id, user_id, CAST(user_id % 2 AS INTEGER) AS trace_id, 'u' || user_id AS uuid,
         epoch_us(ts) // 1000 AS ms, event_type, props, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
  FROM events WHERE {where}),
jvm AS (SELECT trace_id, user_id, uuid, min(ms) AS lo, max(ms) AS hi FROM ev GROUP BY ALL),
t0 AS (SELECT trace_id, min(ms) AS t0 FROM ev GROUP BY ALL),
l AS (SELECT trace_id, uuid, ms AS t, CASE {tags} END AS tag, event_id, user_id, k, props, NULL AS lo, NULL AS hi FROM ev {lives}),
r AS (SELECT l.*, t AS ms, t - t0 AS ts FROM l JOIN t0 USING (trace_id))"""


SERVICES = f""",
reg AS (
  SELECT trace_id, uuid, '10.0.0.' || user_id AS host, CAST(40000 + event_id % 2 AS INTEGER) AS port,
         {at(RAW['service'], 1).sql} AS name, min(ts) AS start
  FROM r WHERE tag = 'service' GROUP BY ALL),
svc AS (SELECT *, host || ' ' || port || ' ' || name AS service_id, name = 'driverPropsFetcher' AS removed FROM reg),
mains AS (
  SELECT trace_id, uuid, service_id AS service, name AS service_kind FROM svc WHERE NOT removed
  QUALIFY row_number() OVER (PARTITION BY trace_id, uuid ORDER BY start, port, host, name) = 1),
ends AS (
  SELECT trace_id, host, port, start, service_id, removed,
         CASE WHEN lag(start) OVER w IS NOT NULL THEN start END AS since, lead(start) OVER w AS until
  FROM svc WINDOW w AS (PARTITION BY trace_id, host, port ORDER BY start, uuid, name))"""


def select(columns: str, where: str = "true", rest: str = "") -> str:
    return f"WITH {lines_cte()} SELECT {columns} FROM r WHERE {where} {rest}"


def kept(verdict: str) -> str:
    return select(f"uuid, ts, {by_tag(lambda t: t.name)} AS kind", verdict)


def in_force(end: str) -> str:
    return f"({end}.since IS NULL OR r.ts >= {end}.since) AND ({end}.until IS NULL OR r.ts < {end}.until)"


def with_services(query: str) -> str:
    return f"WITH {lines_cte()}{SERVICES}{query}"


def tags(*names: str) -> str:
    return "tag IN (" + ", ".join(f"'{n}'" for n in names) + ")"


SPANS_START = tags("span_env", "span_submit", "span_other", "jvm_start")
SPANS_END = tags("span_end", "jvm_started")
MESSAGES = tags("rpc", "rpc_block", "rpc_update")
NOT_EVENTS = "tag NOT IN ('service', 'heartbeat', 'rpc', 'rpc_block', 'rpc_update', 'span_env', 'span_submit', 'span_other', 'jvm_start', 'span_end', 'jvm_started')"

LABELS = {tag: text(tree) for tag, tree in PARSED.items()}
for tag in ("begin", "complete", "job", "executor"):
    argument = at(PARSED[tag], 2, 1)
    LABELS[tag] = f"'DAGSchedulerEvent(' || {argument.name} || '(' || {text(argument.children[0])} || '))'"
LABELS["block"] = "'UpdateBlockInfo(' || " + " || ', ' || ".join(text(at(PARSED["block"], 2, i)) for i in (1, 2, 3)) + " || ')'"
LABEL = "(CASE tag " + " ".join(f"WHEN '{tag}' THEN {sql}" for tag, sql in LABELS.items()) + " END)"
SPAN_LABEL = f"""(CASE tag WHEN 'span_env' THEN 'CreateSparkEnv' WHEN 'span_submit' THEN 'SubmitApplication(app' || k || ')'
  WHEN 'span_other' THEN {text(at(PARSED['span_other'], 2))} WHEN 'jvm_start' THEN 'JVMStart' END)"""
SPAN_ID = f"(CASE WHEN tag IN ('jvm_start', 'jvm_started') THEN 'jvm' || user_id ELSE {SPAN} END)"

TASKS = """,
task AS (
  SELECT trace_id, CAST(k % 7 AS VARCHAR) AS stage, CAST(user_id % 50 AS VARCHAR) AS part,
         max(CASE WHEN tag = 'begin' THEN ts END) AS s, max(CASE WHEN tag = 'complete' THEN ts END) AS e
  FROM r WHERE tag IN ('begin', 'complete') GROUP BY ALL HAVING s IS NOT NULL AND e IS NOT NULL)"""

VALUES = {
    "JVM start time": """SELECT trace_id, service AS key, (max(CASE WHEN tag = 'jvm_started' THEN ts END) - max(CASE WHEN tag = 'jvm_start' THEN ts END)) / 1000e0 AS value
      FROM r JOIN mains USING (trace_id, uuid) WHERE tag IN ('jvm_start', 'jvm_started') GROUP BY ALL""",
    "Executor lifetime": """SELECT trace_id, service AS key, (hi + 1 - lo) / 1000e0 AS value
      FROM jvm JOIN mains USING (trace_id, uuid) WHERE service_kind = 'sparkExecutor'""",
    "Task duration": "SELECT trace_id, '(' || stage || ',' || part || ')' AS key, (e - s) / 1000e0 AS value FROM task",
    "RPCs sent": f"SELECT trace_id, service AS key, CAST(count(*) AS DOUBLE) AS value FROM r JOIN mains USING (trace_id, uuid) WHERE {MESSAGES} GROUP BY ALL",
    "Instr Overhead": "SELECT trace_id, service AS key, (user_id % 17) / 1000e0 AS value FROM jvm JOIN mains USING (trace_id, uuid)",
    "JVMs": "SELECT trace_id, '()' AS key, 0e0 AS value FROM jvm",
    "Executors": "SELECT trace_id, '()' AS key, 0e0 AS value FROM r WHERE tag = 'executor'",
    "Jobs": "SELECT trace_id, '()' AS key, 0e0 AS value FROM r WHERE tag = 'job'",
    "Tasks": "SELECT trace_id, '(' || stage || ',' || part || ')' AS key, (e - s) / 1000e0 AS value FROM task",
    "Block updates": "SELECT trace_id, CAST(ts AS VARCHAR) AS key, 0e0 AS value FROM r WHERE tag = 'block'",
}
COUNTS = ("JVMs", "Executors", "Jobs", "Tasks", "Block updates")
DISTRIBUTIONS = ("JVM start time", "Executor lifetime", "Task duration", "RPCs sent", "Instr Overhead")


def values(names) -> str:
    union = " UNION ALL ".join(f"SELECT '{n}' AS stat, * FROM ({VALUES[n]})" for n in names)
    grid = ", ".join(f"('{n}')" for n in names)
    return f""",
vals AS ({union}),
grid AS (SELECT trace_id AS trace, s.stat FROM (SELECT DISTINCT trace_id FROM svc), (VALUES {grid}) s(stat))"""


def statistic(name_: str) -> str:
    return with_services(TASKS + f" SELECT trace_id, key, value FROM ({VALUES[name_]})")


def rank(p: float, value: str = "value") -> str:
    return f"list_extract(list_sort(list({value})), CAST(greatest(ceil({p / 100.0!r}e0 * count({value})), 1) AS BIGINT))"


def columns(*pairs: str) -> str:
    return ", ".join(["uuid", "ts", *pairs])


SUBTREE2 = by_tag(lambda t: dump(at(t, 2)) if at(t, 2) is not None else "'........'")
DECODED = by_tag(
    lambda t: "[" + ", ".join(
        f"{{'path': '{'.'.join(map(str, p))}', 'name': {n}}}" for p, n, _ in nodes(envelope(t, "t"))
    ) + "]"
)
JSON = by_tag(lambda t: json_sql(envelope(t)), {tag: RAW[tag] for tag in ("heartbeat", "rpc_block", "rpc_update", "rpc")})
DOC_SPLIT = r"regexp_replace(text, '([0-9]+)', '|\1|', 'g')"
STAT_COUNT = f"SELECT trace, stat, count(value) AS n FROM grid LEFT JOIN vals ON trace = trace_id AND grid.stat = vals.stat GROUP BY trace, grid.stat"
STAT_COUNT = STAT_COUNT.replace("SELECT trace, stat,", "SELECT trace, grid.stat AS stat,")

ORACLES = {
    "trace_decode": f"""WITH {lines_cte()}, n AS (SELECT trace_id, uuid, t AS ts, unnest({DECODED}) AS n FROM r)
      SELECT trace_id, uuid, ts, n.path AS path, n.name AS name FROM n""",
    "deep_decode": """SELECT s_suppkey, CAST(901 AS BIGINT) AS nodes, s_name AS name, rtrim(repeat('2.1.', 300), '.') AS path FROM supplier""",
    "trace_path_get": select(
        columns(
            f"{named()} AS kind",
            f"{named(1)} AS first",
            f"{named(2, 1)} AS \"function\"",
            f"{named(2, 2, 1)} AS argument",
            f"{named(3)} AS payload",
            "CAST(NULL AS VARCHAR) AS beyond",
        )
    ),
    "trace_render": select(
        columns(f"{rendered()} AS body", f"{rendered(2)} AS second", f"{rendered(3)} AS third", "'' AS missing")
    ),
    "trace_subtree": select(columns(f"{SUBTREE2} AS text")),
    "trace_is_defined": select(
        columns(
            "true AS body",
            f"{by_tag(lambda t: str(defined(at(t, 2, 1))).lower())} AS second",
            f"{by_tag(lambda t: str(defined(at(t, 3, 2))).lower())} AS state",
            f"{by_tag(lambda t: str(bool(t.children)).lower())} AS parent",
            f"{by_tag(lambda t: str(t.name in (chr(39) + 'Fn' + chr(39), chr(39) + 'SpanStart' + chr(39))).lower())} AS call",
        )
    ),
    "tree_update": select(
        columns(
            f"{by_tag(lambda t: text(replaced(t, (1,), Leaf(chr(39) + 'X' + chr(39))) if t.children else t))} AS leaf",
            f"{rendered(2)} AS lifted",
            f"{rendered()} AS out_of_range",
        )
    ),
    "debug_dump": select(f"uuid, {by_tag(lambda t: dump(envelope(t, 'ts')), PARSED)} AS text", HEARTBEAT),
    "case_parse": select(
        columns(
            f"{rendered(trees=PARSED)} AS body",
            f"{named(1, trees=PARSED)} AS \"function\"",
            f"{named(2, 1, 1, 2, trees=PARSED)} AS task",
            f"{named(3, 3, 2, trees=PARSED)} AS level",
        )
    ),
    "paren_parse": f"""WITH {lines_cte()} SELECT event_id, 'Outer(' || event_type || ', Inner(' || user_id || ', (' || event_id || ')), , ' || k || ')' AS text,
      'Inner' AS "inner", CAST(event_id AS VARCHAR) AS id, false AS blank, CAST(k AS VARCHAR) AS k FROM ev""",
    "paren_parse_shallow": f"""WITH {lines_cte()} SELECT event_id, CAST(5 AS INTEGER) AS nodes, 'Outer' AS name, event_type AS first,
      'Inner(' || user_id || ',(' || event_id || '))' AS second FROM ev""",
    "paren_reject": f"WITH {lines_cte()} SELECT event_id, k % 4 = 0 AS ok FROM ev",
    "document_lines": "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS digest FROM documents",
    "tokenize_documents": f"""SELECT doc_id, CAST(2 * len(regexp_extract_all(text, '[0-9]+')) + 1 AS BIGINT) AS pieces,
      md5({DOC_SPLIT}) AS digest FROM documents""",
    "quarantine": f"""WITH {lines_cte()} SELECT trace_id, CAST(sum(CASE WHEN {JSON} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS events,
      count({JSON}) AS corrupt, CAST(sum(length({JSON}) - 2) AS BIGINT) AS chars FROM r GROUP BY trace_id""",
    "relative_time": select("trace_id, uuid, ts"),
    "trace_start": f"WITH {lines_cte()} SELECT trace_id, t0 AS trace_start FROM t0",
    "diagnose": with_services(
        f""", msgs AS (
      SELECT r.trace_id, a.service_id IS NULL OR b.service_id IS NULL AS unknown, coalesce(a.removed, false) OR coalesce(b.removed, false) AS gone
      FROM r LEFT JOIN ends a ON a.trace_id = r.trace_id AND a.host = '10.0.0.' || ((user_id * 7 + event_id) % 150) AND a.port = 40000 + event_id % 2 AND {in_force("a")}
      LEFT JOIN ends b ON b.trace_id = r.trace_id AND b.host = '10.0.0.' || user_id AND b.port = 40000 + event_id % 2 AND {in_force("b")}
      WHERE {MESSAGES}),
    lost AS (SELECT trace_id, sum(CASE WHEN unknown THEN 1 ELSE 0 END) AS unknown_address, sum(CASE WHEN NOT unknown AND gone THEN 1 ELSE 0 END) AS removed_address FROM msgs GROUP BY trace_id),
    cut AS (SELECT trace_id, count({JSON}) AS corrupt_lines FROM r GROUP BY trace_id)
    SELECT r.trace_id, count(*) AS events, CAST(sum(CASE WHEN service IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_service,
      CAST(0 AS BIGINT) AS with_rule_faults, CAST(any_value(unknown_address) AS BIGINT) AS unknown_address, CAST(any_value(removed_address) AS BIGINT) AS removed_address,
      CAST(0 AS BIGINT) AS bad_registration, any_value(corrupt_lines) AS corrupt_lines
    FROM r LEFT JOIN mains USING (trace_id, uuid) JOIN lost ON lost.trace_id = r.trace_id JOIN cut ON cut.trace_id = r.trace_id GROUP BY r.trace_id"""
    ),
    "filter_default": kept(HEARTBEAT),
    "filter_cascade": kept("NOT (tag IN ('heartbeat', 'rpc_block', 'rpc_update') OR (tag = 'rpc' AND k % 2 = 1))"),
    "filter_in": kept(tags("main_end", "service", "span_end", "jvm_started")),
    "filter_regex": kept(f"(tag = 'rpc_block' AND CAST(user_id AS VARCHAR) LIKE '1%') OR regexp_matches({rendered(1, trees=PARSED)}, '5$')"),
    "filter_exists": kept(
        f"NOT {by_tag(lambda t: str(defined(at(t, 3, 3)) and not defined(at(t, 2, 1))).lower(), PARSED)} AND NOT coalesce({rendered(3, trees=PARSED)} = 'null', false)"
    ),
    "condition_columns": select(
        columns("tag = 'rpc' AND coalesce(k, 0) = 4 AS compound", "tag != 'variable' AS other", "true AS constant")
    ),
    "format_events": select(f"uuid, ts, {by_tag(lambda t: t.name)} AS kind, {LABEL} AS label", HEARTBEAT),
    "service_dim": with_services(" SELECT trace_id, uuid, host, port, name, start, service_id, removed FROM svc"),
    "service_fallback": f"""WITH {lines_cte("event_type != 'signup'")}, first AS (SELECT trace_id, uuid, min(ts) AS start FROM r GROUP BY ALL)
      SELECT trace_id, uuid, '' AS host, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY start, uuid) - 1 AS INTEGER) AS port,
      uuid AS name, start, uuid AS service_id, false AS removed FROM first""",
    "main_service": with_services(" SELECT trace_id, uuid, service, service_kind FROM mains"),
    "endpoint_dim": with_services(" SELECT trace_id, host, port, start, service_id, removed, coalesce(since, -1) AS since, coalesce(until, -1) AS until FROM ends"),
    "time_delta_tasks": with_services(
        TASKS + ' SELECT trace_id, stage, part, s AS start, e AS "end", e - s AS delta FROM task'
    ),
    "time_delta_first": f"""WITH {lines_cte()}, d AS (SELECT user_id, min(CASE WHEN event_type = 'view' THEN ms END) AS start,
      min(CASE WHEN event_type = 'purchase' THEN ms END) AS "end" FROM ev GROUP BY user_id)
      SELECT *, "end" - start AS delta FROM d WHERE start IS NOT NULL AND "end" IS NOT NULL""",
    "span_length_jvm": f"""WITH {lines_cte()} SELECT jvm.trace_id, 'jvm' || user_id AS key, lo - t0 AS start, lo - t0 + (user_id % 50 + 1) * 100 AS "end",
      (user_id % 50 + 1) * 100 AS delta FROM jvm JOIN t0 USING (trace_id)""",
    "span_length_calls": f"""WITH {lines_cte()}, d AS (SELECT trace_id, {SPAN} AS key, max(CASE WHEN tag != 'span_end' THEN ts END) AS start,
      max(CASE WHEN tag = 'span_end' THEN ts END) AS "end" FROM r
      WHERE {tags("span_env", "span_submit", "span_other", "span_end")} GROUP BY ALL)
      SELECT *, "end" - start AS delta FROM d WHERE start IS NOT NULL AND "end" IS NOT NULL""",
    "span_pair": f"""WITH {lines_cte()} SELECT s.trace_id, s.span_id, s.uuid, s.ts AS start, e.ts AS "end" FROM
      (SELECT *, {SPAN_ID} AS span_id FROM r WHERE {SPANS_START}) s JOIN
      (SELECT *, {SPAN_ID} AS span_id FROM r WHERE {SPANS_END}) e USING (trace_id, span_id)""",
    "order_ship_delta": """WITH d AS (SELECT o_orderkey AS orderkey, max(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) AS start,
      max(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS "end" FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
      SELECT *, "end" - start AS delta FROM d""",
    "axes": with_services(" SELECT service_id AS name FROM (SELECT DISTINCT trace_id, service_id FROM svc WHERE NOT removed)"),
    "axes_ordered": with_services(
        """ SELECT trace_id AS trace, row_number() OVER (PARTITION BY trace_id ORDER BY min(start), service_id) - 1 AS place, service_id AS name
      FROM svc WHERE NOT removed GROUP BY trace_id, service_id"""
    ),
    "rpcs": with_services(
        f""" SELECT r.ts AS time, a.service_id AS origin, b.service_id AS destination, {rendered(3, trees=PARSED)} AS content
      FROM r JOIN ends a ON a.trace_id = r.trace_id AND a.host = '10.0.0.' || ((user_id * 7 + event_id) % 150) AND a.port = 40000 + event_id % 2 AND {in_force("a")}
      JOIN ends b ON b.trace_id = r.trace_id AND b.host = '10.0.0.' || user_id AND b.port = 40000 + event_id % 2 AND {in_force("b")}
      WHERE {MESSAGES} AND NOT a.removed AND NOT b.removed"""
    ),
    "events_block": with_services(
        f" SELECT ts AS time, service AS location, {LABEL} AS content FROM r JOIN mains USING (trace_id, uuid) WHERE {NOT_EVENTS}"
    ),
    "spans": with_services(
        f""" SELECT s.ts AS start, e.ts AS "end", service AS location, content FROM
      (SELECT *, {SPAN_ID} AS span_id, {SPAN_LABEL} AS content FROM r WHERE {SPANS_START}) s JOIN
      (SELECT trace_id, ts, {SPAN_ID} AS span_id FROM r WHERE {SPANS_END}) e USING (trace_id, span_id)
      JOIN mains USING (trace_id, uuid)"""
    ),
    "timerange": with_services(
        f""", known AS (SELECT ts FROM r JOIN mains USING (trace_id, uuid) WHERE {HEARTBEAT})
      SELECT min(ts) AS time FROM known UNION ALL SELECT max(ts) FROM known"""
    ),
    "stat_jvm_start": statistic("JVM start time"),
    "stat_overhead": statistic("Instr Overhead"),
    "stat_rpcs_sent": statistic("RPCs sent"),
    "stat_executor_lifetime": statistic("Executor lifetime"),
    "stat_task_duration": statistic("Task duration"),
    "stat_jvms": statistic("JVMs"),
    "stat_executors": statistic("Executors"),
    "stat_jobs": statistic("Jobs"),
    "stat_tasks": statistic("Tasks"),
    "stat_block_updates": statistic("Block updates"),
    "stat_count": with_services(TASKS + values(COUNTS) + " " + STAT_COUNT),
    "stat_dist": with_services(
        TASKS
        + values(DISTRIBUTIONS)
        + f""" SELECT trace, grid.stat AS stat, {", ".join(f"coalesce({rank(p)}, 0e0) AS p{p}" for p in (0, 25, 50, 75, 100))},
      coalesce(arg_min(key, (value, key)), '') AS min_at, coalesce(arg_max(key, (value, key)), '') AS max_at
      FROM grid LEFT JOIN vals ON trace = trace_id AND grid.stat = vals.stat GROUP BY trace, grid.stat"""
    ),
    "stat_dist_ordered": with_services(
        TASKS
        + values(DISTRIBUTIONS)
        + f""" SELECT trace, CAST(list_position([{", ".join(f"'{n}'" for n in DISTRIBUTIONS)}], grid.stat) - 1 AS INTEGER) AS place, grid.stat AS stat, coalesce(max(value), 0e0) AS largest
      FROM grid LEFT JOIN vals ON trace = trace_id AND grid.stat = vals.stat GROUP BY trace, grid.stat"""
    ),
    "stat_compare": with_services(
        TASKS
        + values(COUNTS)
        + f""" SELECT stat, max(CASE WHEN trace = 0 THEN n END) AS trace_0, max(CASE WHEN trace = 1 THEN n END) AS trace_1
      FROM ({STAT_COUNT}) GROUP BY stat"""
    ),
    "registry_custom_stat": f"""SELECT CAST(user_id % 2 AS INTEGER) AS trace, event_type AS stat, count(*) AS n,
      {", ".join(f"{rank(p)} AS p{p}" for p in (0, 25, 50, 75, 100))}, max(value) - min(value) AS spread FROM events GROUP BY ALL""",
    "result_text": with_services(
        TASKS
        + values(COUNTS)
        + f""", known AS (SELECT ts FROM r JOIN mains USING (trace_id, uuid) WHERE {HEARTBEAT}),
      head(block_no, section, line) AS (VALUES (0, 0, 'timerange'), (0, 0, 'time'), (0, 0, 'time'), (0, 2, '%'),
        (1, 0, 'axes'), (1, 0, 'name'), (1, 0, 'string'), (1, 2, '%'),
        (2, 0, 'stat:count'), (2, 0, 'trace' || chr(9) || 'stat' || chr(9) || 'Count'),
        (2, 0, 'num' || chr(9) || 'string' || chr(9) || 'num'), (2, 2, '%'))
      SELECT * FROM head UNION ALL SELECT 0, 1, CAST(min(ts) AS VARCHAR) FROM known
      UNION ALL SELECT 0, 1, CAST(max(ts) AS VARCHAR) FROM known
      UNION ALL SELECT 1, 1, service_id FROM (SELECT DISTINCT trace_id, service_id FROM svc WHERE NOT removed)
      UNION ALL SELECT 2, 1, trace || chr(9) || stat || chr(9) || n FROM ({STAT_COUNT})"""
    ),
}

ORACLES["result_read_back"] = with_services(
    TASKS
    + values(COUNTS)
    + f""", known AS (SELECT ts FROM r JOIN mains USING (trace_id, uuid) WHERE {HEARTBEAT})
      SELECT 'timerange' AS block, min(ts) AS n, CAST(NULL AS VARCHAR) AS c0, CAST(NULL AS VARCHAR) AS c1, CAST(NULL AS VARCHAR) AS c2 FROM known
      UNION ALL SELECT 'timerange', max(ts), NULL, NULL, NULL FROM known
      UNION ALL SELECT 'axes', NULL, service_id, NULL, NULL FROM (SELECT DISTINCT trace_id, service_id FROM svc WHERE NOT removed)
      UNION ALL SELECT 'rpcs', r.ts, a.service_id, b.service_id, {rendered(3, trees=PARSED)}
      FROM r JOIN ends a ON a.trace_id = r.trace_id AND a.host = '10.0.0.' || ((user_id * 7 + event_id) % 150) AND a.port = 40000 + event_id % 2 AND {in_force("a")}
      JOIN ends b ON b.trace_id = r.trace_id AND b.host = '10.0.0.' || user_id AND b.port = 40000 + event_id % 2 AND {in_force("b")}
      WHERE {MESSAGES} AND NOT a.removed AND NOT b.removed
      UNION ALL SELECT 'stat:count', n, CAST(trace AS VARCHAR), stat, NULL FROM ({STAT_COUNT})"""
)
