"""Ordered deep merge of configuration fragments, as rows of servers, and its projections to target shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.tables import written

#: Targets and the outer key of their documents; null means none.
TARGETS = {"cursor": "mcpServers", "vscode": "servers", "opencode": None, "antigravity": "mcpServers"}


def entries(text: Column) -> Column:
    """The members of a JSON object's text in their order, as structs (key, value) with the value as JSON text; null if it is no object.

    Values that are no strings keep their text, so nested keys keep their order.
    """
    raw, typed = F.from_json(text, "map<string,string>"), F.try_parse_json(text).cast("map<string,variant>")

    def member(key: Column) -> Column:
        value = typed[key]
        is_text = F.schema_of_variant(value) == "STRING"
        return F.struct(key.alias("key"), F.when(is_text, F.to_json(value)).otherwise(F.coalesce(raw[key], F.lit("null"))).alias("value"))

    return F.transform(F.json_object_keys(text), member)


def is_object(value: str | Column) -> Column:
    return F.startswith(F.col(value) if isinstance(value, str) else value, F.lit("{"))


def servers(fragments: DataFrame) -> DataFrame:
    """(ord, server, position, def) of fragments (ord, text): the entries under mcpServers if that key is present, else all top-level ones.

    def is JSON text. A fragment, or a wrapper, that is not an object fails the query.
    """
    top = F.filter("members", lambda m: m["key"] == "mcpServers")
    inner = F.when(F.size(top) > 0, entries(top[0]["value"])).otherwise(F.col("members"))
    bad = F.raise_error(F.concat(F.lit("fragment "), F.col("ord").cast("string"), F.lit(" is not an object")))
    rows = fragments.select("ord", entries(F.col("text")).alias("members")).select("ord", inner.alias("inner"))
    rows = rows.select("ord", F.posexplode(F.coalesce("inner", bad.cast("array<struct<key:string,value:string>>"))).alias("position", "m"))
    return rows.select("ord", F.col("m.key").alias("server"), "position", F.col("m.value").alias("def"))


def server_names(fragments: DataFrame) -> DataFrame:
    """Distinct names, and their rank in descending order."""
    return servers(fragments).select("server").distinct().withColumn("rank", F.row_number().over(Window.orderBy(F.col("server").desc())))


def merged(fragments: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(server, def, ord) of all fragments merged in order; with keep (server), only those servers.

    Objects are merged member by member, anything else replaces what came before it, an object too; a member keeps the
    place of its first mention since the last replacement above it. The merge goes down the documents a level at a
    time: a path's last value decides what it is, and if that is an object, members are taken from the objects behind
    the last value that was none. So a round shuffles what is left of the paths of one depth, and the largest ordinals
    are combined before. The document of a server is put together from its paths, sorted by their places.
    """
    rows = servers(fragments)
    if keep is not None:
        rows = rows.join(keep.select("server").distinct(), "server", "left_semi")
    level = rows.select("server", F.array().cast("array<string>").alias("path"), F.array().cast("array<struct<ord:bigint,position:int>>").alias("above"), F.col("ord").cast("bigint").alias("ord"), "position", F.col("def").alias("value"))
    level, paths, key = written(level), [], ["server", "path"]
    while not level.isEmpty():
        last = F.max_by("value", F.struct("ord", "position")).alias("last")
        reset = F.max(F.when(~is_object("value"), F.col("ord"))).alias("reset")
        stats = level.groupBy(*key).agg(F.min(F.struct("ord", "position")).alias("first"), last, reset, F.min("above").alias("above"))
        stats = written(stats.select(*key, F.concat("above", F.array("first")).alias("place"), F.when(~is_object("last"), F.col("last")).alias("leaf"), "reset"))
        paths.append(stats)
        open_paths = stats.where("leaf is null").select(*key, "place", "reset")
        members = level.where(is_object("value")).join(open_paths, key).where("reset is null or ord > reset")
        members = members.select("server", "path", "place", "ord", F.posexplode(entries(F.col("value"))).alias("at", "m"))
        level = written(members.select("server", F.concat("path", F.array("m.key")).alias("path"), F.col("place").alias("above"), "ord", F.col("at").alias("position"), "m.value"))
    if not paths:
        return level.select("server", F.col("value").alias("def"), F.struct("ord", "position").alias("ord"))
    nodes = paths[0]
    for p in paths[1:]:
        nodes = nodes.unionByName(p)
    return _documents(nodes)


def _documents(nodes: DataFrame) -> DataFrame:
    """(server, def, ord) from all paths of the servers: (server, path, place, leaf), a null leaf for an object.

    Sorted by place, a path stands before those below it; each writes its name, what it is, and the ends of the
    objects that no later path belongs to.
    """
    depth = F.size("path")
    after = F.lead(depth).over(Window.partitionBy("server").orderBy("place"))
    rows = nodes.select("server", "place", "leaf", depth.alias("depth"), after.alias("after"), F.to_json(F.array(F.try_element_at("path", F.lit(-1)))).alias("quoted"))
    name = F.when(F.col("depth") > 0, F.concat(F.expr("substring(quoted, 2, length(quoted) - 2)"), F.lit(":"))).otherwise("")
    below = F.coalesce(F.col("after") > F.col("depth"), F.lit(False))
    own = F.coalesce("leaf", F.when(below, "{").otherwise("{}"))
    ends = F.when(below, "").otherwise(F.concat(F.repeat(F.lit("}"), F.col("depth") - F.coalesce("after", F.lit(0))), F.when(F.col("after").isNotNull(), ",").otherwise("")))
    pieces = rows.select("server", "place", F.concat(name, own, ends).alias("piece"))
    return pieces.groupBy("server").agg(F.expr("listagg(piece, '') within group (order by place)").alias("def"), F.min("place")[0].alias("ord"))


def last_values(rows: DataFrame) -> DataFrame:
    """(server, field, value) of rows (ord, server, field, value, is_object), without Python: the depth of plain fields.

    A row with is_object false replaces the server whole; what came before it is dropped, and it leaves no fields.
    """
    reset = rows.groupBy("server").agg(F.max(F.when(~F.col("is_object"), F.col("ord"))).alias("reset"))
    live = rows.join(reset, "server").where("is_object and field is not null and (reset is null or ord > reset)")
    return live.groupBy("server", "field").agg(F.max_by("value", "ord").alias("value"))


def transport(text: Column) -> Column:
    """passthrough, remote or local of a server's JSON text; command wins over url."""
    keys = F.json_object_keys(text)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    return F.when(has("command"), "local").when(has("url"), "remote").otherwise("passthrough")


# The members that a server has in each target's shape, with the server's member that gives the value.
# A name that ends with ? is left out where the server lacks it; a value that starts with = is the text behind it.
REMOTE = {
    "cursor": [("url", "url"), ("headers?", "headers"), ("auth?", "auth")],
    "vscode": [("type", "http or sse"), ("url", "url"), ("headers?", "headers")],
    "opencode": [("enabled", "=true"), ("type", '="remote"'), ("url", "url"), ("headers?", "headers")],
    "antigravity": [("serverUrl", "url"), ("headers?", "headers"), ("env?", "env")],
}
LOCAL = {
    "cursor": [("type", '="stdio"'), ("command", "command"), ("args", "args or []"), ("env?", "env"), ("envFile?", "envFile"), ("cwd?", "cwd")],
    "vscode": [("type", '="stdio"'), ("command", "command"), ("args", "args or []"), ("env?", "env"), ("cwd?", "cwd")],
    "opencode": [("enabled", "=true"), ("type", '="local"'), ("command", "command and args"), ("environment?", "env")],
    "antigravity": [("command", "command"), ("args", "args or []"), ("env?", "env"), ("cwd?", "cwd")],
}


def _shape(members: list[tuple[str, str]]) -> Column:
    """JSON text of an object with these members, from the map `own` of a server's members to JSON text."""
    own = lambda k: F.col("own")[k]
    args = F.when(F.coalesce(own("args"), F.lit("null")).isin("null", "false"), "[]").otherwise(own("args"))
    no_list = F.raise_error(F.concat(F.lit("args of "), F.col("server"), F.lit(" is no array"))).cast("string")
    made = {
        "http or sse": F.when(own("type") == '"sse"', '"sse"').otherwise('"http"'),
        "args or []": args,
        "command and args": F.when(args == "[]", F.concat(F.lit("["), own("command"), F.lit("]"))).when(F.startswith(args, F.lit("[")), F.concat(F.lit("["), own("command"), F.lit(","), F.expr("substring(own['args'], 2)"))).otherwise(no_list),
    }
    parts = []
    for name, of in members:
        value = F.lit(of[1:]) if of.startswith("=") else made.get(of, own(of))
        text = F.concat(F.lit(f'"{name.rstrip("?")}":'), value)
        parts.append(F.when(F.map_contains_key("own", of), text) if name.endswith("?") else text)
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def emitted(defs: DataFrame, target: str) -> DataFrame:
    """(server, ord, transport, shape) of merged servers in the shape of a target; what is not an object passes through.

    args that are missing, null or false become an empty list. args that are no list fail where they are joined to the command.
    """
    rows = defs.select("server", "ord", F.col("def"), transport(F.col("def")).alias("transport"), F.map_from_entries(entries(F.col("def"))).alias("own"))
    shape = F.when(F.col("transport") == "remote", _shape(REMOTE[target])).when(F.col("transport") == "local", _shape(LOCAL[target])).otherwise(F.col("def"))
    if target == "antigravity":
        shape = F.when(F.coalesce(F.map_contains_key("own", "serverUrl"), F.lit(False)), F.col("def")).otherwise(shape)
    return rows.select("server", "ord", "transport", shape.alias("shape"))


def document(shapes: DataFrame, target: str) -> DataFrame:
    """One row with the target's JSON document and its number of servers: one small document, by its nature."""
    # to_json of a one-element array is the quoted name in brackets
    quoted = F.to_json(F.array("server"))
    entry = F.struct("ord", F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":"), F.col("shape")).alias("e"))
    body = shapes.agg(F.array_sort(F.collect_list(entry)).alias("e"), F.count(F.lit(1)).alias("n_servers"))
    text = F.concat_ws(",", "e.e")
    outer = TARGETS[target]
    whole = F.concat(F.lit("{"), text, F.lit("}"))
    return body.select((whole if outer is None else F.concat(F.lit(f'{{"{outer}":'), whole, F.lit("}"))).alias("document"), "n_servers")


def merge_summary(fragments: DataFrame, merged: DataFrame, selected: DataFrame) -> DataFrame:
    """One row of figures of a merge: files merged, servers found, servers selected among them."""
    n = merged.select("server").distinct()
    chosen = n.join(selected.select("server").distinct(), "server", "left_semi")
    files = fragments.agg(F.count_distinct("ord").alias("n_files"))
    return files.join(n.agg(F.count(F.lit(1)).alias("n_servers")), F.lit(True)).join(chosen.agg(F.count(F.lit(1)).alias("n_selected")), F.lit(True))


def servers_present(expected: DataFrame, merged: DataFrame) -> DataFrame:
    """(server, present) of expected servers in a merged configuration."""
    found = merged.select("server", F.lit(True).alias("present")).distinct()
    return expected.select("server").join(found, "server", "left").select("server", F.coalesce("present", F.lit(False)).alias("present"))
