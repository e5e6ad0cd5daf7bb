"""The library's queries over the driver's tables, and the SQL that gives the same rows.

The tables hold no workflow artefacts, so each operator runs on a table of the same structure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import excluded, front_matter_fields, id_prefixes
from weftline.operators import automaton, board, census, config_merge, documents, events, frontmatter, grams, mirror, search, selection, waves
from weftline.plans import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ORDER = ["ts", "event_id"]
STATES = ["view", "click", "signup", "purchase", "error", "archived"]


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LATEST = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id"


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.latest(table(spark, sf_dir, "events"), "user_id", ORDER, ["event_type", "ts"])


@query(f"SELECT s AS event_type, position::INT AS position, count(user_id) AS n FROM (SELECT unnest({STATES}) AS s, unnest(range({len(STATES)})) AS position) LEFT JOIN ({LATEST}) ON s = event_type GROUP BY ALL")
def board_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = events.latest(table(spark, sf_dir, "events"), "user_id", ORDER, ["event_type"])
    return board.columns(latest, "event_type", STATES)


@query("SELECT user_id, event_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS position FROM events")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.timeline(table(spark, sf_dir, "events"), "user_id", ORDER).select("user_id", "event_id", "event_type", "position")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{s}') AS \"{s}\"" for s in STATES[:5]) + " FROM events GROUP BY user_id")
def activity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.activity(table(spark, sf_dir, "events"), "user_id", "event_type", STATES[:5])


@query("SELECT event_id, user_id, next_status, next_status IS NULL AS is_open FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_status FROM events) WHERE event_type = 'view'")
def open_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = events.next_status(table(spark, sf_dir, "events"), "user_id", ORDER, "event_type").where("event_type = 'view'")
    return n.select("event_id", "user_id", "next_status", F.col("next_status").isNull().alias("is_open"))


@query("SELECT user_id, a < b AS passed FROM (SELECT user_id, min(ts) FILTER (event_type = 'view') AS a, min(ts) FILTER (event_type = 'purchase') AS b FROM events GROUP BY user_id) WHERE a IS NOT NULL AND b IS NOT NULL")
def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return events.gate(table(spark, sf_dir, "events"), "user_id", "ts", kind == "view", kind == "purchase")


@query("WITH s AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER w AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS streak FROM s) SELECT user_id, event_type, streak::BIGINT AS streak, count(*) AS length FROM r GROUP BY ALL HAVING count(*) > 1")
def rework_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.streaks(table(spark, sf_dir, "events"), "user_id", ORDER, "event_type").where("length > 1")


@query("SELECT event_id, user_id, date_diff('second', date_trunc('second', ts), date_trunc('second', lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS seconds FROM events")
def phase_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.durations(table(spark, sf_dir, "events"), "user_id", ORDER).select("event_id", "user_id", "seconds")


JUMPS = [(None, "view"), (None, "click"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("signup", "view")]


@query("WITH a(before, after) AS (VALUES " + ", ".join(f"({'NULL' if b is None else repr(b)}, {a!r})" for b, a in JUMPS) + "), e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, before, event_type FROM e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.before IS NOT DISTINCT FROM e.before AND a.after = e.event_type)")
def illegal_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame(JUMPS, "before string, after string")
    return events.illegal_jumps(table(spark, sf_dir, "events"), "user_id", ORDER, "event_type", allowed).select("event_id", "before", "event_type")


SAYS = {
    "review": (automaton.REVIEW, {"view": "spec_passed", "click": "spec_changes", "purchase": "quality_passed", "error": "quality_changes", "signup": "new_slice"}),
    "worktree": (automaton.WORKTREE, {"view": "created", "click": "baseline_passed", "signup": "baseline_failed", "purchase": "merged", "error": "discarded"}),
    "dispatch": (automaton.DISPATCH, {"view": "dispatched", "click": "note", "purchase": "completed", "error": "failed", "signup": "blocked"}),
}


def _run_sql(name: str, key: str = "user_id") -> str:
    """The events of every key, called user_id, one after the other."""
    machine, says = SAYS[name]
    steps = ", ".join(f"('{s}', '{event}', '{machine.steps[s, a]}')" for s in machine.states for event, a in says.items() if (s, a) in machine.steps)
    return f"""WITH RECURSIVE t(before, event_type, state) AS (VALUES {steps}),
e AS MATERIALIZED (SELECT * EXCLUDE (user_id), {key} AS user_id, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS event_type, NULL::VARCHAR AS before, '{machine.start}' AS state, NULL::BOOLEAN AS legal, 0::BIGINT AS step FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, e.event_id, e.event_type, r.state, coalesce(t.state, r.state), t.state IS NOT NULL, r.step + (t.state IS NOT NULL)::BIGINT
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1 LEFT JOIN t ON t.before = r.state AND t.event_type = e.event_type)
"""


def _ran(spark: SparkSession, sf_dir: str, name: str, key: Column | None = None) -> DataFrame:
    machine, says = SAYS[name]
    said = F.create_map(*[F.lit(x) for pair in says.items() for x in pair])[F.col("event_type")]
    rows = table(spark, sf_dir, "events").select((F.col("user_id") if key is None else key).alias("user_id"), "ts", "event_id", "event_type", said.alias("said"))
    return automaton.run(rows, "user_id", ORDER, "said", machine)


@query(_run_sql("review") + "SELECT user_id, event_id, before, state, legal, step FROM r WHERE n > 0")
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ran(spark, sf_dir, "review").select("user_id", "event_id", "before", "state", "legal", "step")


@query(_run_sql("review") + "SELECT user_id, arg_max(state, n) AS state, arg_max(state, n) = 'passed' AS passed, count(*) FILTER (NOT legal) AS n_illegal, count(*) FILTER (legal AND state IN ('spec_again', 'quality_again')) AS n_repeats FROM r WHERE n > 0 GROUP BY user_id")
def review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = automaton.outcomes(_ran(spark, sf_dir, "review"), "user_id", ORDER, ["spec_again", "quality_again"])
    return found.withColumn("passed", F.col("state") == "passed")


@query(_run_sql("dispatch", "user_id || '/' || event_id % 4") + "SELECT user_id AS dispatch, arg_max(event_id, n) FILTER (legal AND before = 'idle' AND state = 'open') AS event_id, count(*) FILTER (legal AND before = 'open' AND state = 'idle') AS n_returned, count(*) FILTER (NOT legal) AS n_unpaired FROM r WHERE n > 0 GROUP BY user_id HAVING arg_max(state, n) = 'open'")
def open_dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a user's event numbers modulo 4 stand for the subagents of a change
    ran = _ran(spark, sf_dir, "dispatch", F.concat_ws("/", "user_id", F.col("event_id") % 4))
    sent = F.col("legal") & (F.col("before") == "idle") & (F.col("state") == "open")
    back = F.col("legal") & (F.col("before") == "open") & (F.col("state") == "idle")
    place = F.struct(*ORDER)
    found = ran.groupBy(F.col("user_id").alias("dispatch")).agg(F.max_by("state", place).alias("state"), F.max_by("event_id", F.when(sent, place)).alias("event_id"), F.count(F.when(back, 1)).alias("n_returned"), F.count(F.when(~F.col("legal"), 1)).alias("n_unpaired"))
    return found.where("state = 'open'").drop("state")


@query(_run_sql("worktree") + "SELECT user_id, step, state, arg_min(event_id, n) AS first_event, count(*) AS length, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS event_types FROM r WHERE NOT legal GROUP BY user_id, step, state")
def worktree_illegal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = automaton.illegal_runs(_ran(spark, sf_dir, "worktree"), "user_id", ORDER, "event_type")
    return runs.select("user_id", "step", "state", F.col("first.event_id").alias("first_event"), "length", F.array_join("symbols", ",").alias("event_types"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id")
def blocked_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.activity(table(spark, sf_dir, "events"), "user_id", "event_type", ["error"])


@query("SELECT l_orderkey AS change_id, sum(n)::BIGINT AS n_artifacts, count(*) AS n_distinct FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS a, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def artifact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("change_id"), F.array(F.concat("l_returnflag", "l_linestatus")).alias("artifacts"))
    return events.artifact_counts(named, "change_id")


@query("SELECT o_custkey, count(*) AS n_reports, count(DISTINCT o_orderstatus) = 1 AS agrees FROM orders GROUP BY o_custkey")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.agreement(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


PHASES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


@query(f"SELECT o_orderkey, o_orderpriority, (coalesce(list_position({PHASES}, o_orderpriority) - 1, {len(PHASES)}))::INT AS phase_position, CASE o_orderstatus WHEN 'O' THEN 'todo' WHEN 'F' THEN 'done' END AS phase FROM orders")
def phase_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = spark.createDataFrame([("O", "todo"), ("F", "done")], "o_orderstatus string, phase string")
    rows = board.with_lookup(table(spark, sf_dir, "orders"), F.broadcast(phases), "o_orderstatus")
    return board.phase_position(rows, "o_orderpriority", PHASES).select("o_orderkey", "o_orderpriority", "phase_position", "phase")


@query("WITH p AS (SELECT p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48) AS present FROM part) SELECT 'installed' AS state, count(*) FILTER (present) AS n FROM p UNION ALL SELECT 'missing', count(*) FILTER (NOT present) FROM p")
def census_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("present")).distinct()
    return census.counts(table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left").fillna(False, ["present"]))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 2, 3) OR s_acctbal > 9000")
def census_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = spark.createDataFrame([(1,), (2,), (3,)], "s_nationkey int")
    return census.wanted(table(spark, sf_dir, "supplier"), chosen, "s_nationkey", also="s_acctbal > 9000").select("s_suppkey")


@query("SELECT CASE WHEN p_size % 5 = 0 THEN 'brew' WHEN p_size % 3 = 0 THEN 'npm' WHEN p_size % 2 = 0 THEN 'pip' ELSE 'manual' END AS manager, count(*) AS n, min(p_name) AS first_package FROM part GROUP BY 1")
def manager_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = lambda n: F.when(F.col("p_size") % n == 0, F.col("p_name")).otherwise("")
    deps = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), when(5).alias("brew"), when(3).alias("npm"), when(2).alias("pip"))
    return deps.select(census.manager().alias("manager"), "name").groupBy("manager").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_package"))


@query("SELECT 4::BIGINT AS n_checks, (SELECT count(*) FROM (SELECT min(l_quantity) >= 1 AS ok FROM lineitem UNION ALL SELECT max(l_discount) <= 0.05 FROM lineitem UNION ALL SELECT count(*) = count(c_name) FROM customer UNION ALL SELECT min(o_totalprice) > 0 FROM orders) WHERE NOT ok) AS n_failed, false AS passed")
def sanity_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    item, customer, orders = (table(spark, sf_dir, t) for t in ("lineitem", "customer", "orders"))
    checks = [item.agg((F.min("l_quantity") >= 1).alias("ok")), item.agg((F.max("l_discount") <= 0.05).alias("ok")), customer.agg((F.count(F.lit(1)) == F.count("c_name")).alias("ok")), orders.agg((F.min("o_totalprice") > 0).alias("ok"))]
    return mirror.verdict(checks[0].union(checks[1]).union(checks[2]).union(checks[3]))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror.orphans(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


def _mirrored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    copy = rows.where("s_suppkey % 10 <> 5").withColumn("s_name", F.when(F.col("s_suppkey") % 7 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))
    return rows.where("s_suppkey % 10 <> 3"), copy


DRIFT_SQL = "SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 5 THEN 'MISSING' WHEN s_suppkey % 10 = 3 THEN 'ORPHAN' WHEN s_suppkey % 7 = 0 THEN 'DRIFT' ELSE 'OK' END AS action FROM supplier"


@query(DRIFT_SQL)
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror.drift(*_mirrored(spark, sf_dir), "s_suppkey", "s_name")


def _plan_sql(gone: str) -> str:
    return f"SELECT s_suppkey, CASE action WHEN 'MISSING' THEN 'COPY' WHEN 'DRIFT' THEN 'UPDATE' WHEN 'ORPHAN' THEN '{gone}' ELSE 'KEEP' END AS action FROM ({DRIFT_SQL})"


@query(_plan_sql("KEEP"))
def upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror.sync_plan(*_mirrored(spark, sf_dir), delete=False, key="s_suppkey", value="s_name")


@query(_plan_sql("DELETE"))
def mirror_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror.sync_plan(*_mirrored(spark, sf_dir), delete=True, key="s_suppkey", value="s_name")


@query("""WITH l AS (SELECT split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS lang FROM pages), h AS (SELECT DISTINCT host FROM l),
  m AS (SELECT host || '/' || lang AS folder, lang <> 'de' AS reported FROM h, (SELECT unnest(['es', 'zz', 'de']) AS lang)),
  c AS (SELECT host || '/' || lang AS folder, count(*) AS n FROM l GROUP BY ALL)
  SELECT folder, CASE WHEN n > 0 THEN 'REMOVE' ELSE 'SKIP' END AS action, coalesce(n, 0) AS n_files FROM m LEFT JOIN c USING (folder) WHERE reported OR n > 0""")
def uninstall_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pages are files below a host and a language; languages are targets
    part = lambda i: F.split_part(F.col("url"), F.lit("/"), F.lit(i))
    listing = table(spark, sf_dir, "pages").select(part(3).alias("host"), F.concat_ws("/", part(3), part(4), F.col("page_id").cast("string")).alias("path"))
    known = {"es": True, "zz": True, "de": False, "fr": True}
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(r).alias("reported")) for t, r in known.items()])).alias("t")
    managed = listing.select("host").distinct().select("host", each).select("t.target", F.concat_ws("/", "host", "t.target").alias("folder"), "t.reported")
    targets = spark.createDataFrame([(t,) for t in known], "target string")
    return mirror.uninstall_plan(managed, targets.where("target <> 'fr'"), listing)


@query("SELECT r_regionkey, target FROM region, (VALUES ('cursor'), ('vscode'), ('kilo')) t(target)")
def fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.createDataFrame([("cursor",), ("vscode",), ("kilo",)], "target string")
    return mirror.fan_out(table(spark, sf_dir, "region").select("r_regionkey"), targets)


@query("SELECT p_brand, (row_number() OVER (ORDER BY p_brand DESC))::INT AS rank FROM (SELECT DISTINCT p_brand FROM part)")
def distinct_keys_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"mcpServers":{"'), "p_brand", F.lit('":{}}}'))
    fragments = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), text.alias("text"))
    return config_merge.server_names(fragments).withColumnRenamed("server", "p_brand")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER))
    e = table(spark, sf_dir, "events").withColumn("ord", place)
    # an error event resets what came before it
    return e.select("ord", F.col("user_id").alias("server"), F.lit("k").alias("field"), F.get_json_object("props", "$.k").alias("value"), (F.col("event_type") != "error").alias("is_object"))


PROPS_SQL = "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM events), r AS (SELECT user_id, max(ord) FILTER (event_type = 'error') AS reset FROM e GROUP BY user_id) SELECT e.user_id AS server, 'k' AS field, arg_max(json_extract_string(props, '$.k'), ord) AS value FROM e JOIN r USING (user_id) WHERE event_type <> 'error' AND (reset IS NULL OR ord > reset) {} GROUP BY e.user_id"


@query(PROPS_SQL.format(""))
def props_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_merge.last_values(_fields(spark, sf_dir))


@query(PROPS_SQL.format("AND e.user_id IN (1, 2, 3, 5, 8, 13)"))
def props_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8, 13)], "server long")
    return config_merge.last_values(_fields(spark, sf_dir).join(keep, "server", "left_semi"))


@query("""SELECT event_id AS ord, CASE WHEN event_type IN ('click', 'error') THEN 'local' WHEN event_type = 'view' THEN 'remote' ELSE 'passthrough' END AS transport,
  CASE WHEN event_type IN ('click', 'error') THEN '{"type":"stdio","command":"' || event_type || '","args":[]}' WHEN event_type = 'view' THEN '{"type":"http","url":"' || user_id || '"}' ELSE '{"note":"' || event_type || '"}' END AS shape FROM events""")
def emit_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    text = F.when(kind.isin("click", "error"), F.to_json(F.struct(kind.alias("command"), F.col("user_id").cast("string").alias("url")))).when(kind == "view", F.to_json(F.struct(F.col("user_id").cast("string").alias("url"), F.lit(1).alias("cwd")))).otherwise(F.to_json(F.struct(kind.alias("note"))))
    defs = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("server"), F.col("event_id").alias("ord"), text.alias("def"))
    return config_merge.emitted(defs, "vscode").select("ord", "transport", "shape")


SHAPES_SQL = """SELECT event_id AS ord, t AS target, CASE
  WHEN event_type NOT IN ('click', 'error', 'view') THEN '{"note":"' || event_type || '"}'
  WHEN t = 'cursor' AND event_type = 'view' THEN '{"url":"' || user_id || '"}'
  WHEN t = 'opencode' AND event_type = 'view' THEN '{"enabled":true,"type":"remote","url":"' || user_id || '"}'
  WHEN t = 'antigravity' AND event_type = 'view' THEN '{"serverUrl":"' || user_id || '"}'
  WHEN t = 'cursor' THEN '{"type":"stdio","command":"' || event_type || '","args":["a"],"env":{"K":"v"},"cwd":"c"}'
  WHEN t = 'opencode' THEN '{"enabled":true,"type":"local","command":["' || event_type || '","a"],"environment":{"K":"v"}}'
  ELSE '{"command":"' || event_type || '","args":["a"],"env":{"K":"v"},"cwd":"c"}' END AS shape FROM events, (SELECT unnest(['cursor', 'opencode', 'antigravity']) AS t)"""


@query(SHAPES_SQL)
def emit_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, url = F.col("event_type"), F.concat(F.lit('{"url":"'), "user_id", F.lit('"}'))
    local = F.concat(F.lit('{"command":"'), kind, F.lit('","args":["a"],"env":{"K":"v"},"cwd":"c"}'))
    text = F.when(kind.isin("click", "error"), local).when(kind == "view", url).otherwise(F.concat(F.lit('{"note":"'), kind, F.lit('"}')))
    defs = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("server"), F.col("event_id").alias("ord"), text.alias("def"))
    shapes = [config_merge.emitted(defs, t).select("ord", F.lit(t).alias("target"), "shape") for t in ("cursor", "opencode", "antigravity")]
    return shapes[0].union(shapes[1]).union(shapes[2])


# what each event says of its user's server: members of env at two depths, an array, nulls, an env that is no object, and a server that is none
MERGE_SQL = """
WITH e AS (SELECT user_id, event_id AS id, event_type AS t, event_id % 4 = 0 AS fourth, event_id % 3 AS third FROM events),
gone AS (SELECT user_id, max(id) FILTER (t = 'signup' AND fourth) AS s, max(id) AS last FROM e GROUP BY user_id),
live AS (SELECT e.* FROM e JOIN gone USING (user_id) WHERE id > coalesce(s, -1)),
reset AS (SELECT user_id, max(id) FILTER (t = 'error') AS r, max(id) FILTER (t IN ('view', 'click', 'purchase', 'error')) AS env, min(id) FILTER (t IN ('view', 'click', 'purchase', 'error')) AS first_env FROM live GROUP BY user_id),
within AS (SELECT live.* FROM live JOIN reset USING (user_id) WHERE id > coalesce(r, -1)),
ks AS (SELECT user_id, third, min(id) AS pos, max(id) AS last FROM within WHERE t = 'purchase' GROUP BY ALL),
inner_members AS (
  SELECT user_id, min(id) AS pos, '"view":"' || max(id) || '"' AS x FROM within WHERE t = 'view' GROUP BY user_id
  UNION ALL SELECT user_id, min(id), '"click":{"last":' || max(id) || ',"none":null}' FROM within WHERE t = 'click' GROUP BY user_id
  UNION ALL SELECT user_id, min(pos), '"purchase":{' || string_agg('"k' || third || '":' || last, ',' ORDER BY pos) || '}' FROM ks GROUP BY user_id),
env AS (SELECT user_id, '{' || string_agg(x, ',' ORDER BY pos) || '}' AS x FROM inner_members GROUP BY user_id),
members AS (
  SELECT user_id, first_env AS pos, 0 AS place, '"env":' || CASE WHEN env = r THEN r::VARCHAR ELSE env.x END AS x FROM reset LEFT JOIN env USING (user_id) WHERE reset.env IS NOT NULL
  UNION ALL SELECT user_id, min(id), 1, '"args":["' || max(id) || '",{"n":null}]' FROM live WHERE t = 'view' GROUP BY user_id
  UNION ALL SELECT user_id, min(id), 0, '"cwd":null' FROM live WHERE t = 'signup' GROUP BY user_id)
SELECT 'u' || user_id AS server, coalesce('{' || string_agg(x, ',' ORDER BY pos, place) || '}', 'null') AS def FROM gone LEFT JOIN members USING (user_id) GROUP BY user_id
"""


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind, own = F.col("event_type"), F.col("event_id").cast("string")
    j = lambda *parts: F.concat(*[(own if p == "@" else F.lit(p)) if isinstance(p, str) else p for p in parts])
    said = (
        F.when(kind == "view", j('{"env":{"view":"', "@", '"},"args":["', "@", '",{"n":null}]}'))
        .when(kind == "click", j('{"env":{"click":{"last":', "@", ',"none":null}}}'))
        .when(kind == "purchase", j('{"env":{"purchase":{"k', (F.col("event_id") % 3).cast("string"), '":', "@", "}}}"))
        .when(kind == "error", j('{"env":', "@", "}"))
        .otherwise(F.when(F.col("event_id") % 4 == 0, "null").otherwise('{"cwd":null}'))
    )
    user = j('"u', F.col("user_id").cast("string"), '":', said)
    # half of the fragments wrap their servers
    text = F.when(F.col("event_id") % 2 == 0, j('{"mcpServers":{', user, '},"x":1}')).otherwise(j("{", user, "}"))
    return e.select(F.col("event_id").alias("ord"), text.alias("text"))


@query(MERGE_SQL)
def deep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_merge.merged(_fragments(spark, sf_dir)).select("server", "def")


@query("SELECT page_id, regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1) AS lang, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title FROM pages")
def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1).alias("lang"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


@query("SELECT c_custkey, 'Customer: ' || c_name AS first, c_mktsegment AS segment, 2::INT AS n FROM customer")
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("segment: old\nno colon here\ntitle: Customer: "), F.col("c_name"), F.lit("\n segment :"), F.col("c_mktsegment"), F.lit(" "))
    rows = table(spark, sf_dir, "customer").select("c_custkey", front_matter_fields(head).alias("f"))
    return rows.select("c_custkey", F.col("f.title").alias("first"), F.col("f.segment").alias("segment"), F.size("f").alias("n"))


@query("SELECT doc_id::VARCHAR AS name, array_to_string(list_filter(['License', '@', 'the'], lambda s: NOT contains(text, s)), ',') AS missing, CASE WHEN contains(text, 'License') AND contains(text, '@') AND contains(text, 'the') THEN 0 ELSE 2 END AS severity FROM documents")
def required_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.lit(True).alias("has_header"), F.create_map(F.lit("name"), F.lit("x")).alias("fields"), F.col("text").alias("body"))
    return frontmatter.contract(docs, ["name"], ["License", "@", "the"]).select("name", F.concat_ws(",", "missing_sections").alias("missing"), "severity")


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS first_part FROM pages")
def path_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1).alias("first_part"))


@query("SELECT page_id FROM pages WHERE NOT list_has_any(string_split(url, '/'), ['es', 'fr'])")
def exclude_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(~excluded("url", ["es", "fr"])).select("page_id")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tasks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    k = F.col("id")
    blockers = F.explode(F.array_distinct(F.array(F.floor(k / 2), F.floor(k / 3)))).alias("blocker")
    return tasks, tasks.where("id > 1").select("id", blockers).where("blocker >= 1").select("id", F.col("blocker").cast("long").alias("blocker"))


EDGES_SQL = "e AS (SELECT DISTINCT p_partkey AS id, unnest([p_partkey // 2, p_partkey // 3]) AS blocker FROM part WHERE p_partkey > 1), g AS (SELECT * FROM e WHERE blocker >= 1 AND blocker IN (SELECT p_partkey FROM part))"


@query(f"WITH RECURSIVE {EDGES_SQL}, w(id, level) AS (SELECT p_partkey, 1 FROM part UNION SELECT g.id, w.level + 1 FROM w JOIN g ON g.blocker = w.id) SELECT id, max(level)::INT AS wave, false AS in_cycle FROM w GROUP BY id")
def waves_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.waves(*_graph(spark, sf_dir))


@query("WITH e AS (SELECT DISTINCT p_partkey AS id, unnest([p_partkey // 2, p_partkey // 3]) AS blocker FROM part WHERE p_partkey > 1) SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.id = p_partkey AND blocker >= 1 AND blocker % 2 = 1)")
def ready_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, edges = _graph(spark, sf_dir)
    return waves.ready(tasks, edges, tasks.where("id % 2 = 0").union(spark.createDataFrame([(0,)], "id long")))


@query("WITH e AS (SELECT DISTINCT p_partkey AS id, unnest([p_partkey // 2, p_partkey // 3]) AS blocker FROM part WHERE p_partkey > 1) SELECT min(p_partkey) AS id FROM part WHERE p_partkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.id = p_partkey AND blocker >= 1 AND blocker % 2 = 1)")
def next_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, edges = _graph(spark, sf_dir)
    return waves.next_unit(tasks, edges, tasks.where("id % 2 = 0"), ["id"])


@query(f"WITH RECURSIVE {EDGES_SQL}, r(id) AS (SELECT 7 UNION SELECT g.id FROM r JOIN g ON g.blocker = r.id) SELECT id::BIGINT AS id FROM r")
def failure_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.failed_and_blocked(_graph(spark, sf_dir)[1], spark.createDataFrame([(7,)], "id long"))


@query(f"WITH RECURSIVE {EDGES_SQL}, r(id) AS (SELECT 15 UNION SELECT g.id FROM r JOIN g ON g.blocker = r.id) SELECT id::BIGINT AS id FROM r")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.impact(_graph(spark, sf_dir)[1], spark.createDataFrame([(15,)], "id long"))


@query(f"WITH RECURSIVE {EDGES_SQL}, r(id) AS (SELECT 150 UNION SELECT g.blocker FROM r JOIN g ON g.id = r.id) SELECT id::BIGINT AS id FROM r")
def needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.needs(_graph(spark, sf_dir)[1], spark.createDataFrame([(150,)], "id long"))


# halves, chains of 31, and rings of four above 200, so that tasks stand on cycles, behind them and apart
CYCLIC_SQL = """g AS (
  SELECT k AS id, unnest(CASE WHEN k % 50 IN (1, 2, 3) AND k > 200 THEN [k + 1] WHEN k % 50 = 4 AND k > 200 THEN [k - 3] ELSE [] END || CASE WHEN k % 100 BETWEEN 61 AND 91 THEN [k - 1] ELSE [] END || CASE WHEN k % 3 <> 0 AND k > 1 THEN [k // 2] ELSE [] END) AS blocker FROM (SELECT p_partkey AS k FROM part)),
e AS (SELECT DISTINCT id, blocker FROM g WHERE blocker IN (SELECT p_partkey FROM part)),
r(a, b) AS (SELECT id, blocker FROM e UNION SELECT r.a, e.blocker FROM r JOIN e ON e.id = r.b)"""


def _cyclic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tasks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    k, none = F.col("id"), F.array().cast("array<bigint>")
    ring = F.when((k > 200) & (k % 50).isin(1, 2, 3), F.array(k + 1)).when((k > 200) & (k % 50 == 4), F.array(k - 3)).otherwise(none)
    chain = F.when((k % 100).between(61, 91), F.array(k - 1)).otherwise(none)
    half = F.when((k % 3 != 0) & (k > 1), F.array(F.floor(k / 2))).otherwise(none)
    return tasks, tasks.select("id", F.explode(F.concat(ring, chain, half)).alias("blocker"))


@query(f"WITH RECURSIVE {CYCLIC_SQL}, c AS (SELECT x.a AS id, min(x.b) AS cycle_id FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a), w AS (SELECT DISTINCT r.a AS id FROM r JOIN c ON c.id = r.b) SELECT p_partkey AS id, c.cycle_id, c.id IS NOT NULL AS on_cycle, w.id IS NOT NULL AND c.id IS NULL AS behind FROM part LEFT JOIN c ON c.id = p_partkey LEFT JOIN w ON w.id = p_partkey")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.cycles(*_cyclic(spark, sf_dir))


@query("WITH n AS (SELECT max(p_partkey) AS m FROM part), a AS (SELECT p_partkey AS id, p_partkey // 2 AS blocker FROM part WHERE p_partkey > 1), b AS (SELECT 2 * p_partkey AS id, p_partkey AS blocker FROM part WHERE p_partkey % 5 <> 0 AND p_partkey >= 1) SELECT *, 'blockedBy' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'unblocks' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def edge_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    blocked = tasks.where("id > 1").select("id", F.floor(F.col("id") / 2).cast("long").alias("blocker"))
    unblocks = tasks.where("id % 5 <> 0 and id >= 1").select((F.col("id") * 2).alias("id"), F.col("id").alias("blocker"))
    return waves.inverse_gaps(blocked, unblocks)


@query("SELECT DISTINCT a.l_orderkey AS a, b.l_orderkey AS b FROM lineitem a JOIN lineitem b USING (l_partkey, l_suppkey) WHERE a.l_orderkey < b.l_orderkey")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat_ws("/", "l_partkey", "l_suppkey").alias("file"))
    return waves.overlaps(owned)


# orders are tasks, the parts of suppliers are files, and every 50th order owns one file that all of these own
TURNS_SQL = """RECURSIVE o AS (SELECT DISTINCT l_orderkey AS id, l_partkey || '/' || l_suppkey AS file FROM lineitem UNION SELECT o_orderkey, 'hot' FROM orders WHERE o_orderkey % 50 = 0),
n AS (SELECT id, lag(id) OVER (PARTITION BY id % 3, file ORDER BY id) AS before FROM o),
w(id, turn) AS (SELECT o_orderkey, 1 FROM orders UNION SELECT n.id, w.turn + 1 FROM w JOIN n ON n.before = w.id),
t AS (SELECT id, (id % 3)::INT AS wave, max(turn)::BIGINT AS turn FROM w GROUP BY id)"""


def _dispatch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    owned = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat_ws("/", "l_partkey", "l_suppkey").alias("file"))
    owned = owned.union(orders.where("id % 50 = 0").select("id", F.lit("hot")))
    return waves.serialised(orders.select("id", (F.col("id") % 3).cast("int").alias("wave")), owned), owned


@query(f"WITH {TURNS_SQL} SELECT id, wave, turn FROM t")
def dispatch_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dispatch(spark, sf_dir)[0]


@query(f"""WITH {TURNS_SQL}, g AS (SELECT t.*, o_custkey AS goal, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey || '-' || o_orderkey % 2 END AS output, length(o_orderpriority) AS packet, EXISTS (SELECT 1 FROM o WHERE o.id = o_orderkey) AS owns FROM t JOIN orders ON o_orderkey = t.id),
  c AS (SELECT *, count(*) OVER (PARTITION BY wave, turn, goal) = 1 AS one_goal, output IS NOT NULL AND count(*) OVER (PARTITION BY wave, turn, output) = 1 AS one_output FROM g)
  SELECT id, wave, turn, concat_ws(',', CASE WHEN NOT one_goal THEN 'goal' END, CASE WHEN NOT one_output THEN 'output' END, CASE WHEN packet > 8 THEN 'packet' END, CASE WHEN NOT owns THEN 'ownership' END) AS failed, one_goal AND one_output AND packet <= 8 AND owns AS passed FROM c""")
def dispatch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, owned = _dispatch(spark, sf_dir)
    key = F.col("o_orderkey")
    output = F.when(key % 11 > 0, F.concat_ws("-", "o_custkey", key % 2))
    tasks = table(spark, sf_dir, "orders").select(key.alias("id"), F.col("o_custkey").alias("goal"), output.alias("output"), F.col("o_orderpriority").alias("packet"))
    return waves.dispatch_gate(tasks, turns, owned, 8).withColumn("failed", F.array_join("failed", ","))


def _communities_sql(rounds: int) -> str:
    """Customers (even numbers) and suppliers (odd ones), linked by the quantities delivered."""
    steps = "".join(f""", l{i + 1} AS MATERIALIZED (SELECT id, arg_min(c, (-w, c)) AS c FROM (SELECT id, c, sum(weight) AS w FROM (SELECT b.id, l.c, b.weight FROM bw b JOIN l{i} l ON l.id = b.other UNION ALL SELECT o.id, l.c, o.weight FROM own o JOIN l{i} l USING (id)) GROUP BY id, c) GROUP BY id)""" for i in range(rounds))
    return f"""WITH e AS (SELECT 2 * o_custkey AS a, 2 * l_suppkey + 1 AS b, sum(l_quantity::DECIMAL(20, 6)) AS weight FROM lineitem JOIN (SELECT DISTINCT o_orderkey, o_custkey FROM orders) ON o_orderkey = l_orderkey GROUP BY ALL),
bw AS MATERIALIZED (SELECT a AS id, b AS other, weight FROM e UNION ALL SELECT b, a, weight FROM e), own AS MATERIALIZED (SELECT id, max(weight) AS weight FROM bw GROUP BY id), l0 AS (SELECT id, id AS c FROM own){steps} SELECT id, c AS community FROM l{rounds}"""


@query(_communities_sql(4))
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") * 2).alias("a")).distinct()
    edges = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select("a", (F.col("l_suppkey") * 2 + 1).alias("b"), F.col("l_quantity").alias("weight"))
    return waves.communities(edges, 4)


@query("SELECT md5(lower(trim(text))) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.duplicated(table(spark, sf_dir, "documents").select(F.md5(F.lower(F.trim("text"))).alias("digest")), "digest")


@query("WITH t AS (SELECT conv_id, turn FROM conversations WHERE role <> 'system') SELECT a.conv_id, a.turn, b.turn IS NOT NULL AS has_before FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def turn_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("has_before"))
    return t.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("has_before", F.lit(False)).alias("has_before"))


@query("WITH d AS (SELECT 'r.' || r_regionkey || '.' || n_nationkey AS id, 'r.' || r_regionkey AS p, c_acctbal > 0 AS done FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), x AS (SELECT unnest(['r', p, id]) AS ancestor, done FROM d) SELECT ancestor, count(*) AS n, count(*) FILTER (done) AS n_done FROM x GROUP BY ancestor")
def rollup_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat_ws(".", F.lit("r"), "n_regionkey", "n_nationkey").alias("id"))
    items = table(spark, sf_dir, "customer").join(nation, "c_nationkey").select("id", (F.col("c_acctbal") > 0).alias("done"))
    return board.rollup(items, "id", "done")


@query("WITH v AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS name FROM customer) SELECT min(name) AS canonical, count(DISTINCT name) AS n_variants, count(*) AS n FROM v GROUP BY lower(name)")
def name_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    return search.consolidated(table(spark, sf_dir, "customer").select(name.alias("name")), "name")


# every 9th part's type lacks a letter, every 31st has one twice, every 11th another, and even ones are in capitals with blanks around
DRIFTED_SQL = """t AS (SELECT p_partkey AS k, p_type AS t, 1 + p_partkey % length(p_type) AS i FROM part),
d AS (SELECT CASE WHEN k % 9 = 0 THEN t[:i - 1] || t[i + 1:] WHEN k % 31 = 0 THEN t[:i] || t[i:] WHEN k % 11 = 0 THEN t[:i - 1] || 'q' || t[i + 1:] ELSE t END AS t, k FROM t),
c AS (SELECT regexp_replace(lower(CASE WHEN k % 2 = 0 THEN '  ' || upper(t) || chr(9) ELSE t END), '^\\s+|\\s+$', '', 'g') AS name, count(*) AS n FROM d GROUP BY 1)"""


@query(f"WITH RECURSIVE {DRIFTED_SQL}, up AS (SELECT a.name, arg_min(b.name, (-b.n, b.name)) AS next FROM c a JOIN c b ON a.name <> b.name AND abs(length(a.name) - length(b.name)) <= 1 AND length(a.name) >= 4 AND length(b.name) >= 4 AND (b.n > a.n OR (b.n = a.n AND b.name < a.name)) AND levenshtein(a.name, b.name) <= 1 AND regexp_replace(a.name, '[^0-9]', '', 'g') = regexp_replace(b.name, '[^0-9]', '', 'g') GROUP BY a.name), w(name, at_name) AS (SELECT name, name FROM c UNION SELECT w.name, up.next FROM w JOIN up ON up.name = w.at_name) SELECT c.name, w.at_name AS canonical, c.n FROM c JOIN w USING (name) WHERE w.at_name NOT IN (SELECT name FROM up)")
def name_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i = F.col("p_partkey"), F.expr("cast(1 + p_partkey % length(p_type) as int)")
    part = lambda start, end=None: F.substring("p_type", start, (end if end is not None else F.length("p_type")) - start + 1)
    one = F.lit(1)
    text = F.when(k % 9 == 0, F.concat(part(one, i - 1), part(i + 1))).when(k % 31 == 0, F.concat(part(one, i), part(i))).when(k % 11 == 0, F.concat(part(one, i - 1), F.lit("q"), part(i + 1))).otherwise(F.col("p_type"))
    rows = table(spark, sf_dir, "part").select(k.alias("k"), text.alias("t"))
    drifted = rows.select(F.when(F.col("k") % 2 == 0, F.concat(F.lit("  "), F.upper("t"), F.lit("\t"))).otherwise(F.col("t")).alias("name"))
    return search.spelled_alike(drifted, "name")


@query("SELECT doc_id FROM documents WHERE contains(text, 'License')")
def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact(table(spark, sf_dir, "documents"), "text", "License").select("doc_id")


@query("SELECT 'literal' AS how, doc_id FROM documents WHERE contains(text, 'License') UNION ALL SELECT 'pattern', doc_id FROM documents WHERE regexp_matches(text, 'mail[0-9]\\.example\\.com')")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = grams.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = [(how, grams.search(index, **by)) for how, by in (("literal", {"literal": "License"}), ("pattern", {"regex": "mail[0-9]\\.example\\.com"}))]
    rows = [x.select(F.lit(how).alias("how"), F.col("key").alias("doc_id")) for how, x in found]
    return rows[0].unionByName(rows[1])


@query("SELECT doc_id, length(text) AS n_full FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def preview_then_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ids = search.top(docs.select("doc_id", "n_chars", F.substring("text", 1, 80).alias("preview")), "n_chars", "doc_id", 10)
    return search.full(F.broadcast(ids), docs, "doc_id").select("doc_id", F.length("text").cast("long").alias("n_full"))


@query("WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id AS hit, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS score FROM embeddings, q) SELECT query, hit, round(score, 4) AS score, (row_number() OVER (PARTITION BY query ORDER BY s.score DESC, hit))::INT AS rank FROM s QUALIFY rank <= 10")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = search.top_per_query(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    return found.withColumn("score", F.round("score", 4))


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'both' WHEN quality = 1 THEN 'left' ELSE 'right' END AS side FROM labels WHERE quality = 1 OR toxic = 1")
def findings_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return search.overlap(labels.where("quality = 1").select("doc_id"), labels.where("toxic = 1").select("doc_id"))


@query("SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 0 WHEN d.lang = 'en' THEN 1 ELSE 2 END::INT AS layer FROM documents d LEFT JOIN labels l USING (doc_id)")
def layered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("x").alias("value"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit("x").alias("value"))
    return search.first_layer([labels, docs.where("lang = 'en'"), docs], "doc_id", "value").select("doc_id", "layer")


@query("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 1000 THEN NULL ELSE 'price' END, CASE WHEN o_orderstatus <> 'P' THEN NULL ELSE 'status' END, CASE WHEN year(o_orderdate) >= 1994 THEN NULL ELSE 'date' END], lambda x: x IS NOT NULL), ',') AS failed, o_totalprice > 1000 AND o_orderstatus <> 'P' AND year(o_orderdate) >= 1994 AS passed FROM orders")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"price": "o_totalprice > 1000", "status": "o_orderstatus <> 'P'", "date": "year(o_orderdate) >= 1994"}
    return board.failed_rules(table(spark, sf_dir, "orders"), rules).select("o_orderkey", F.concat_ws(",", "failed").alias("failed"), "passed")


@query("SELECT n_nationkey, s FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = s AND c_acctbal > 9000)")
def missing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").withColumnsRenamed({"c_nationkey": "n_nationkey", "c_mktsegment": "s"})
    expected = mirror.fan_out(table(spark, sf_dir, "nation").select("n_nationkey"), customer.select("s").distinct())
    return board.missing(expected, customer.where("c_acctbal > 9000"), ["n_nationkey", "s"])


@query("SELECT c_custkey AS change_id, coalesce(n_orders, 0) AS n_orders, n_orders IS NOT NULL AS has_orders, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) AS has_supplier FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def session_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("change_id"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("change_id")).agg(F.count(F.lit(1)).alias("n_orders"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("change_id"))
    return board.change_view(changes, {"orders": orders, "supplier": supplier}).select("change_id", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "has_orders", "has_supplier")


@query("SELECT s_suppkey, field, value FROM (SELECT s_suppkey, s_name, CASE WHEN s_nationkey > 12 THEN s_nationkey::VARCHAR END AS nation FROM supplier) UNPIVOT (value FOR field IN (s_name, nation))")
def placement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_nationkey") > 12, F.col("s_nationkey").cast("string")).alias("nation"))
    return board.unpivoted(wide, "s_suppkey", "field", "value")


@query("WITH i AS (SELECT DISTINCT 'r.' || n_regionkey AS id FROM nation UNION SELECT 'r.' || n_regionkey || '.' || n_nationkey FROM nation WHERE n_regionkey <> 2) SELECT i.id, CASE WHEN contains(i.id, '.') THEN regexp_replace(i.id, '\\.[^.]+$', '') END AS parent, EXISTS (SELECT 1 FROM i p WHERE p.id = regexp_replace(i.id, '\\.[^.]+$', '')) AS parent_found, len(string_split(i.id, '.'))::INT AS depth FROM i")
def id_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    ids = nation.select(F.concat_ws(".", F.lit("r"), "n_regionkey").alias("id")).union(nation.where("n_regionkey <> 2").select(F.concat_ws(".", F.lit("r"), "n_regionkey", "n_nationkey"))).distinct()
    return board.with_parent(ids, "id").select("id", "parent", "parent_found", F.size(id_prefixes("id")).alias("depth"))


@query("SELECT c_custkey, c_name || chr(10) || 'more' AS goal, '- ' || c_mktsegment AS blockers, NULL::VARCHAR AS evidence FROM customer")
def handoff_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# Handoff\n\n## Goal\n"), F.col("c_name"), F.lit("\nmore\n\n## blockers\n- "), F.col("c_mktsegment"), F.lit("\n"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    return documents.sections(rows, {"goal": "Goal", "blockers": "Blockers", "evidence": "Evidence"}).drop("text")


@query("SELECT c_custkey, c_name AS question, c_mktsegment AS hitl, NULL::VARCHAR AS reason FROM customer")
def decision_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Question: "), F.col("c_name"), F.lit(" \n- **HITL required**: "), F.col("c_mktsegment"), F.lit("\nquestion: other\n"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    return documents.labelled(rows, {"question": "Question", "hitl": "HITL required", "reason": "Reason"}).drop("text")


@query("SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INT AS position, n_nationkey::VARCHAR AS prd_id, lower(replace(n_name, ' ', '-')) AS slug FROM nation")
def prd_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("- [x](PRD"), F.col("n_nationkey").cast("string"), F.lit("_"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".md)"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", name.alias("line")))), lambda x: x["line"])
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("# Index\n"), F.concat_ws("\n", lines)).alias("text"))
    return documents.prd_index(rows.withColumn("path", F.col("n_regionkey"))).withColumnRenamed("path", "n_regionkey")


@query("SELECT o_orderkey, o_orderpriority AS label, CASE WHEN c_acctbal > 0 THEN c_name END AS goal FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def task_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("change_id"), "o_orderkey", F.col("o_orderpriority").alias("label"))
    context = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("change_id"), F.col("c_name").alias("goal"))
    return documents.packets(tasks, context, "change_id").select("packet.task.*", "packet.context.goal")


@query(f"WITH RECURSIVE {EDGES_SQL}, w(id, level) AS (SELECT p_partkey, 1 FROM part UNION SELECT g.id, w.level + 1 FROM w JOIN g ON g.blocker = w.id), l AS (SELECT id, max(level)::INT AS wave FROM w GROUP BY id) SELECT wave, count(*) AS n_tasks, count(*) FILTER (p_size > 45) AS n_failed, bool_and(p_size <= 45) AS all_verified FROM l JOIN part ON p_partkey = id GROUP BY wave")
def wave_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") <= 45).alias("verified"))
    return waves.wave_summary(waves.waves(*_graph(spark, sf_dir)), tasks)


QUERIES["waves"] = QUERIES.pop("waves_query")
ORACLES["waves"] = ORACLES.pop("waves_query")


# documents with front matter made of nations: without a header, without a description, with several tools
HEADED_SQL = """d AS (SELECT n_nationkey AS k, n_name AS name, CASE WHEN k % 5 = 0 THEN 'no tools' WHEN k % 2 = 0 THEN 'Bash, WebSearch' ELSE 'WebFetch' END AS tools, '# ' || n_name || chr(10) AS body FROM nation)"""


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    tools = F.when(k % 5 == 0, "no tools").when(k % 2 == 0, "Bash, WebSearch").otherwise("WebFetch")
    description = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("description:  about "), "n_name", F.lit(" \ndescription: second\n")))
    text = F.concat(F.lit("---\n"), description, F.lit("argument-hint: x\ntools: "), tools, F.lit("\n---\n# "), "n_name", F.lit("\n"))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.when(k % 11 == 3, F.concat(F.lit("# "), "n_name", F.lit("\n"))).otherwise(text).alias("text"))


AGENT_SQL = f"""WITH {HEADED_SQL} SELECT name, CASE WHEN k % 11 = 3 THEN body WHEN k % 7 = 0 THEN NULL ELSE concat_ws(chr(10), '---', 'description: second', 'mode: subagent', 'permission:', '  read: allow', '  glob: allow', '  grep: allow', '  edit: deny', '  task: deny', '  bash: ' || CASE WHEN tools LIKE '%Bash%' THEN 'allow' ELSE 'deny' END, CASE WHEN tools LIKE '%WebSearch%' THEN '  websearch: allow' END, CASE WHEN tools LIKE '%WebFetch%' THEN '  webfetch: allow' END, '---', body) END AS rendered, CASE WHEN k % 11 <> 3 AND k % 7 = 0 THEN 2 ELSE 0 END::INT AS severity FROM d"""


@query(AGENT_SQL)
def agent_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontmatter.agent_text(frontmatter.parsed(_headed(spark, sf_dir)))


@query(f"WITH {HEADED_SQL} SELECT name, CASE WHEN k % 11 <> 3 AND k % 7 <> 0 THEN concat_ws(chr(10), '---', 'description: about ' || name, 'argument-hint: x', '---', body) END AS rendered, CASE WHEN k % 11 = 3 OR k % 7 = 0 THEN 2 ELSE 0 END::INT AS severity FROM d")
def prompt_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontmatter.prompt_text(frontmatter.parsed(_headed(spark, sf_dir), frontmatter.PROMPT))


def _rendered_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = frontmatter.agent_text(frontmatter.parsed(_headed(spark, sf_dir)))
    copies = rendered.where("severity = 0 and name < 'S'").select("name", F.when(F.col("name") < "I", F.col("rendered")).otherwise("old").alias("text"))
    return mirror.rendered_drift(rendered, copies.union(spark.createDataFrame([("gone", "x")], "name string, text string")))


RENDERED_DRIFT_SQL = f"a AS ({AGENT_SQL}), r AS (SELECT name, CASE WHEN severity <> 0 THEN 'INVALID' WHEN name >= 'S' THEN 'MISSING' WHEN name < 'I' THEN 'OK' ELSE 'DRIFT' END AS action FROM a UNION ALL SELECT 'gone', 'ORPHAN')"


@query(f"WITH {RENDERED_DRIFT_SQL} SELECT name, action FROM r WHERE action <> 'OK'")
def check_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror.reported(_rendered_drift(spark, sf_dir))


@query(f"WITH {RENDERED_DRIFT_SQL} SELECT count(*) FILTER (action <> 'OK') > 0 AS drift, (count(*) FILTER (action <> 'OK') > 0)::INT AS severity FROM r")
def any_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror.any_drift(_rendered_drift(spark, sf_dir))


@query("""SELECT '{"servers":{' || string_agg('"' || r_name || '\\"]:b":{"command":"c' || r_regionkey || '"}', ',' ORDER BY r_regionkey) || '}}' AS document, count(*) AS n_servers FROM region""")
def config_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = table(spark, sf_dir, "region").select(F.concat("r_name", F.lit('"]:b')).alias("server"), F.col("r_regionkey").alias("ord"), F.concat(F.lit('{"command":"c'), "r_regionkey", F.lit('"}')).alias("shape"))
    return config_merge.document(shapes, "vscode")


@query("SELECT (SELECT count(DISTINCT n_regionkey) FROM nation) AS n_files, count(*) AS n_servers, count(*) FILTER (n_nationkey % 2 = 0) AS n_selected FROM nation")
def merge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    servers = nation.select(F.col("n_name").alias("server"))
    return config_merge.merge_summary(nation.select(F.col("n_regionkey").alias("ord")), servers, nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("server")))


@query("SELECT n_name AS server, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS present FROM nation")
def servers_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, rich = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return config_merge.servers_present(nation.select(F.col("n_name").alias("server")), nation.join(rich, "n_nationkey").select(F.col("n_name").alias("server")))


@query("SELECT CASE WHEN acct IS NULL THEN 'installed' ELSE acct END AS state, coalesce(n, 0) AS n FROM (SELECT unnest(['installed', 'missing']) AS acct) LEFT JOIN (SELECT CASE WHEN c_acctbal > 0 THEN 'installed' ELSE 'missing' END AS acct, count(*) AS n FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1) USING (acct)")
def census_unchecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_acctbal") > 0).alias("present"))
    return census.counts(deps)


@query("WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'x' || c_custkey ELSE (c_custkey % 40)::VARCHAR END AS answer FROM customer) SELECT answer, n_name AS name, n_name IS NOT NULL AS valid FROM a LEFT JOIN nation ON answer = (n_nationkey + 1)::VARCHAR")
def picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("position"), F.col("n_name").alias("name"))
    k = F.col("c_custkey")
    return selection.picked(options, table(spark, sf_dir, "customer").select(F.when(k % 7 == 0, F.concat(F.lit("x"), k)).otherwise((k % 40).cast("string")).alias("answer")))


@query("SELECT n_name FROM nation WHERE n_regionkey = 1 UNION SELECT n_name FROM nation WHERE n_nationkey < 4")
def with_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return selection.with_forced(nation.where("n_regionkey = 1"), nation.where("n_nationkey < 4"), "n_name")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'a/' || n_name WHEN n_nationkey % 3 = 0 THEN 'b/' || n_name ELSE 'none' END AS path FROM nation")
def first_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    both = nation.select(F.col("n_name").alias("name"), F.posexplode(F.array(F.concat(F.lit("a/"), "n_name"), F.concat(F.lit("b/"), "n_name"))).alias("rank", "path"))
    listing = nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("a/"), "n_name").alias("path")).union(nation.where("n_nationkey % 3 = 0").select(F.concat(F.lit("b/"), "n_name")))
    return selection.first_existing(both, listing, "none")


@query("SELECT n_name AS path, 'T' || chr(10) || 'Status: ' || CASE WHEN n_nationkey % 2 = 0 THEN '$1 done' ELSE 'draft' END || chr(10) || 'status: kept' AS text, CASE WHEN n_nationkey % 2 = 0 THEN 'UPDATE' ELSE 'KEEP' END AS action FROM nation")
def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    texts = nation.select(F.col("n_name").alias("path"), F.lit("T\nStatus: draft\nstatus: kept").alias("text"))
    return tables.status_plan(texts, nation.select(F.col("n_name").alias("path"), F.when(F.col("n_nationkey") % 2 == 0, "$1 done").otherwise("draft").alias("status")))


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tasks, edges = _graph(spark, sf_dir)
    return tasks.withColumn("label", F.when(F.col("id") % 3 == 0, "HITL").otherwise("AFK")), edges, tasks.where("id % 2 = 0").union(spark.createDataFrame([(0,)], "id long"))


AFK_SQL = "WITH e AS (SELECT DISTINCT p_partkey AS id, unnest([p_partkey // 2, p_partkey // 3]) AS blocker FROM part WHERE p_partkey > 1), r AS (SELECT p_partkey AS id, 'AFK' AS label FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.id = p_partkey AND blocker >= 1 AND blocker % 2 = 1)) "


@query(AFK_SQL + "SELECT * FROM r")
def afk_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.ready(*_labelled(spark, sf_dir), "AFK")


@query(AFK_SQL + "SELECT count(*) > 0 AS goes_on FROM r")
def loop_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.loop_gate(waves.next_unit(*_labelled(spark, sf_dir), ["id"], "AFK"))


@query("WITH e AS (SELECT DISTINCT p_partkey AS id, unnest([p_partkey // 2, p_partkey // 3]) AS blocker FROM part WHERE p_partkey > 1) SELECT DISTINCT id, blocker::BIGINT AS blocker FROM e WHERE id % 2 = 1 AND blocker >= 1 AND blocker % 3 = 0 AND blocker % 2 = 1 AND blocker IN (SELECT p_partkey FROM part)")
def hitl_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.open_blockers(*_labelled(spark, sf_dir), "HITL")


@query("WITH t AS (SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49) AS has_change, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09) AS has_task FROM part) SELECT p_partkey, has_change, has_task, concat_ws(',', CASE WHEN NOT has_change THEN 'change' END, CASE WHEN NOT has_task THEN 'task' END) AS gaps FROM t")
def trace_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    links = {"change": items.where("l_quantity > 49"), "task": items.where("l_discount > 0.09")}
    return board.trace(table(spark, sf_dir, "part").select("p_partkey"), links, "p_partkey").withColumn("gaps", F.concat_ws(",", "gaps"))


@query("SELECT event_id, user_id FROM events WHERE user_id = 3 AND event_type = 'error'")
def activity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.view(table(spark, sf_dir, "events"), {"user_id": 3, "event_type": "error"}).select("event_id", "user_id")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def entries_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.counts_by(table(spark, sf_dir, "documents"), "source")
