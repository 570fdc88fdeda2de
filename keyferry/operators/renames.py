"""Settling renames: what each one moves, with old keys that may not have been there.

A rename moves what its old key held at that time, if the old key was there; otherwise the new key keeps what it had. So
each rename has two predecessors, the last write of the old key and the last write of the new key itself, and both may
again be renames. Two doublings over the renames alone, taking their steps together, settle them:

1. Presence. A key was there after a rename if it was there after either predecessor. Predecessors known to be there or
   not decide a rename; one with a single open predecessor left stands for it, so chains shrink by jumping.
2. Value. With presence known, each rename has one predecessor left, and these chains are followed by doubling.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyferry.functions.values import normal_ttl
from keyferry.session import stored, stored_with_count

ORDER = ["ts", "offset", "node_id"]
OLD, NEW = 0, 1
#: Events of one key that one task puts in order.
CHUNK = 200_000


def is_rename() -> Column:
    """Whether an event moves a key: one to the same key, or without either key, is nothing."""
    return F.coalesce((F.col("op") == "rename") & (F.col("key") != F.col("new_key")), F.lit(False))


def _keyed(key: str, op: str | Column, **columns: Column) -> Column:
    """One step as a struct: its moment, its key, what it does and further columns."""
    op = F.lit(op) if isinstance(op, str) else op
    return F.struct(
        *[F.col(c) for c in ORDER], F.col(key).alias("key"), op.alias("op"), *[c.alias(name) for name, c in columns.items()]
    )


def _events(changes: DataFrame) -> DataFrame:
    """Events that do something: renames within one key, or without either key, are left out."""
    rows = changes if "new_key" in changes.columns else changes.withColumn("new_key", F.lit(None).cast("string"))
    return rows.filter(is_rename() | (F.col("op") != "rename"))


def steps_of(changes: DataFrame) -> DataFrame:
    """Events with a rename as a del of the old key and a ``move`` to the new one."""
    none = {"value": F.lit(None).cast("string"), "ttl_s": F.lit(None).cast("long")}
    plain = F.array(_keyed("key", F.col("op"), value=F.col("value"), ttl_s=F.col("ttl_s")))
    moved = F.array(_keyed("key", "del", **none), _keyed("new_key", "move", **none))
    return _events(changes).select(F.inline(F.when(is_rename(), moved).otherwise(plain)))


def _crowded(changes: DataFrame) -> DataFrame:
    """Keys with more events than one task should put in order, with the times between which these lie."""
    keys = F.array("key", F.when(is_rename(), F.col("new_key")))
    moment = F.unix_micros("ts")
    each = changes.select(F.explode(keys).alias("key"), moment.alias("us")).filter(F.col("key").isNotNull())
    found = each.groupBy("key").agg(F.count("*").alias("events"), F.min("us").alias("first"), F.max("us").alias("last"))
    return found.filter(F.col("events") > CHUNK)


def _predecessors(changes: DataFrame) -> DataFrame:
    """Per rename (to, at) its predecessors ``old`` and ``new``: the last write of the old key and of the new key before
    it, each with the last expire after that write. Without any write the state is ``base``.

    The events are passed over without their values. A rename asks for both keys; answers are running maxima along the
    events of a key. Those of a crowded key are put in order within chunks of time, of which it gets as many as its
    events need, and joined with the maxima of the chunks before.
    """
    none = {"ttl_s": F.lit(None).cast("long"), "to": F.lit(None).cast("string"), "role": F.lit(None).cast("int")}

    def asks(key: str, role: int) -> Column:
        return _keyed(key, "ask", **none | {"to": F.col("new_key"), "role": F.lit(role)})

    plain = F.array(_keyed("key", F.col("op"), **none | {"ttl_s": F.col("ttl_s")}))
    moved = F.array(_keyed("key", "del", **none), _keyed("new_key", "move", **none), asks("key", OLD), asks("new_key", NEW))
    steps = _events(changes).select(F.inline(F.when(is_rename(), moved).otherwise(plain)))
    at, op = F.struct(*ORDER), F.col("op")
    rows = steps.select(
        "key",
        at.alias("at"),
        # a rename sees what was there before it
        (op != "ask").alias("rank"),
        "to",
        "role",
        F.when(op.isin("set", "del", "move"), F.struct(at.alias("at"), "op")).alias("write"),
        F.when(op == "expire", F.struct(at.alias("at"), "ttl_s")).alias("expire"),
    )
    last = ("write", "expire")
    crowded = stored(_crowded(changes), "crowded-keys")
    if crowded.isEmpty():
        so_far = Window.partitionBy("key").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
        answers = rows.select("key", "at", "rank", "to", "role", *[F.max(c).over(so_far).alias(c) for c in last])
        answers = answers.filter(~F.col("rank"))
        for c in last:
            answers = answers.withColumn(f"_{c}", F.lit(None).cast(answers.schema[c].dataType))
    else:
        share = (F.unix_micros("at.ts") - F.col("first")) / (F.col("last") - F.col("first") + 1)
        chunk = F.coalesce(F.floor(share * F.ceil(F.col("events") / CHUNK)), F.lit(-1)).alias("chunk")
        rows = rows.join(crowded, "key", "left").select(*rows.columns, chunk)
        so_far = Window.partitionBy("key", "chunk").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
        within = rows.select("key", "chunk", "at", "rank", "to", "role", *[F.max(c).over(so_far).alias(c) for c in last])
        chunks = within.groupBy("key", "chunk").agg(*[F.max(c).alias(c) for c in last])
        before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        earlier = chunks.select("key", "chunk", *[F.max(c).over(before).alias(f"_{c}") for c in last])
        answers = within.filter(~F.col("rank")).join(earlier, ["key", "chunk"])
    write, expire = F.coalesce("write", "_write"), F.coalesce("expire", "_expire")
    has_ttl = F.coalesce(expire.isNotNull() & (write.isNull() | (expire["at"] > write["at"])), F.lit(False))
    found = F.struct(
        "key",
        F.coalesce(write["op"], F.lit("base")).alias("state"),
        write["at"].alias("next"),
        has_ttl.alias("has_ttl"),
        F.when(has_ttl, expire["ttl_s"]).alias("ttl_s"),
    )
    roles = {OLD: "old", NEW: "new"}
    return answers.groupBy("to", "at").agg(*[F.max(F.when(F.col("role") == r, found)).alias(n) for r, n in roles.items()])


def _first_presence(nodes: DataFrame, target: DataFrame) -> DataFrame:
    """``nodes`` with where to look on, ``*_key`` and ``*_at``, and whether a predecessor is there, ``*_there``."""
    base = F.array(*[F.when(F.col(f"{n}.state") == "base", F.col(f"{n}.key")) for n in ("old", "new")])
    asked = nodes.select(F.explode(base).alias("key")).filter(F.col("key").isNotNull()).distinct()
    held = stored(target.select("key").join(asked, "key", "left_semi").distinct(), "rename-held")
    for name in ("old", "new"):
        one = F.col(name)
        nodes = nodes.join(held.select(F.col("key").alias("_held")), F.col("_held") == one["key"], "left").select(
            *nodes.columns,
            one["key"].alias(f"{name}_key"),
            one["next"].alias(f"{name}_at"),
            F.when(one["state"] == "set", F.lit(True))
            .when(one["state"] == "del", F.lit(False))
            .when(one["state"] == "base", F.col("_held").isNotNull())
            .alias(f"{name}_there"),
        )
    return nodes


# One step of both doublings. Presence: a rename with one open predecessor, the other not being there, stands for the
# open one. Link: once it is known which predecessor counts, and that one is a rename with a link, its link is taken over;
# of two expires on the way the later counts.
STEP = """
  WITH here AS (
    SELECT to, at, old, new, old_key, old_at, old_there, new_key, new_at, new_there,
      coalesce(link, CASE WHEN old_there THEN old WHEN NOT old_there AND new_there THEN new END) AS link,
      old_there OR new_there AS there,
      CASE WHEN NOT new_there THEN struct(old_key AS key, old_at AS at) WHEN NOT old_there THEN struct(new_key AS key, new_at AS at) END AS instead
    FROM {nodes}
  )
  SELECT n.to, n.at, n.old, n.new,
    coalesce(IF(o.there IS NULL, o.instead.key, NULL), n.old_key) AS old_key,
    coalesce(IF(o.there IS NULL, o.instead.at, NULL), n.old_at) AS old_at,
    coalesce(n.old_there, o.there) AS old_there,
    coalesce(IF(w.there IS NULL, w.instead.key, NULL), n.new_key) AS new_key,
    coalesce(IF(w.there IS NULL, w.instead.at, NULL), n.new_at) AS new_at,
    coalesce(n.new_there, w.there) AS new_there,
    IF(a.link IS NULL, n.link, struct(a.link.key AS key, a.link.state AS state, a.link.next AS next,
      n.link.has_ttl OR a.link.has_ttl AS has_ttl, IF(n.link.has_ttl, n.link.ttl_s, a.link.ttl_s) AS ttl_s)) AS link
  FROM here n
  LEFT JOIN here o ON n.old_there IS NULL AND n.old_key = o.to AND n.old_at = o.at
  LEFT JOIN here w ON n.new_there IS NULL AND NOT coalesce(n.old_there, false) AND n.new_key = w.to AND n.new_at = w.at
  LEFT JOIN here a ON n.link.state = 'move' AND n.link.key = a.to AND n.link.next = a.at
"""
OPEN = """
  old_there IS NULL OR (NOT old_there AND new_there IS NULL)
  OR (coalesce(old_there OR new_there, false) AND coalesce(link.state = 'move', true))
"""


def _linked(nodes: DataFrame) -> DataFrame:
    """``nodes`` with presence known and, where a key was there, the ``link``: the set or target row its value comes from."""
    nodes = nodes.withColumn("link", F.when(F.lit(False), F.col("old")))
    while True:
        nodes, left = stored_with_count(nodes, "rename-links", F.expr(OPEN))
        if not left:
            return nodes
        nodes = nodes.sparkSession.sql(STEP, nodes=nodes)


def settle_renames(changes: DataFrame, target: DataFrame) -> DataFrame:
    """Events without renames: the new key is set to value, type, TTL and node of the old key at that time.

    That state comes from the log before the rename or else from ``target``. If the old key was not there, the new key
    keeps what it had and no event is left; if neither was there, the event is a set without a value that only a source
    can fill (``absent``). The number of passes grows with the logarithm of the longest chain of renames, and no pass
    reads anything but the renames; values are read at the end, for the ends of chains.
    """
    steps = steps_of(changes)
    plain = steps.filter(F.col("op") != "move")
    if "new_key" not in changes.columns or changes.filter(is_rename()).isEmpty():
        return plain
    nodes = _linked(_first_presence(stored(_predecessors(changes), "renames"), target))
    links = nodes.filter("old_there").select("to", "at", "link.*")
    sets = steps.filter(F.col("op") == "set").groupBy("key", F.struct(*ORDER).alias("next"))
    sets = sets.agg(F.max(F.struct("value", "ttl_s")).alias("set"))
    held = target.join(links.select("key").distinct(), "key", "left_semi").select(
        "key", F.struct("type", "value", normal_ttl(F.col("ttl_s")).alias("ttl_s"), "node").alias("held")
    )
    was_set = F.col("state") == "set"
    settled = links.join(held, "key", "left").join(sets, ["key", "next"], "left").select(
        "at.*",
        F.col("to").alias("key"),
        F.lit("set").alias("op"),
        F.when(was_set, F.col("set.value")).otherwise(F.col("held.value")).alias("value"),
        F.when(F.col("has_ttl"), F.col("ttl_s"))
        .when(was_set, F.col("set.ttl_s"))
        .otherwise(F.col("held.ttl_s"))
        .alias("ttl_s"),
        F.coalesce("held.type", F.lit("string")).alias("type"),
        F.coalesce("held.node", F.lit(0)).alias("node"),
        F.when(was_set, F.col("held.value")).alias("fallback"),
        F.lit(False).alias("absent"),
    )
    touched = nodes.filter("NOT (old_there OR new_there)").select(
        "at.*", F.col("to").alias("key"), F.lit("set").alias("op"), F.lit(True).alias("absent")
    )
    return plain.unionByName(settled.unionByName(touched, allowMissingColumns=True), allowMissingColumns=True)
