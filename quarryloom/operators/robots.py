"""Robots rules as tables: parse, decide, delays, schedules and audits of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import origin_of, path_of, query_of

NO_ROBOTS = "无法获取 robots.txt，按禁止处理"
#: ends of a line, white space at the ends of a value, and what counts as a number
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
OUTER = r"(?U)^\s+|\s+$"
NUMBER = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))$"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, OUTER, "")


def regex_of(path: Column) -> Column:
    """The regular expression of a robots path: * is anything, a final $ the end."""
    body = F.regexp_replace(F.regexp_replace(path, r"\$$", ""), r"([\\^$.|?+(){}\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(path.endswith("$"), "$").otherwise(""))


def literal_of(path: Column) -> Column:
    """What a robots path begins with before its first * or final $."""
    return F.regexp_extract(path, r"^(.*?)(?:\*.*|\$)?$", 1)


def parse_robots(texts: DataFrame) -> DataFrame:
    """(origin, text) → rows (origin, seq, agent, allow, path, regex, crawl_delay).

    Each directive stands once for each agent of its group, and a row without a path for each agent. A group begins with
    an agent's line that no agent's line precedes; groups are numbered by a running sum over the lines of a text.
    """
    lines = texts.select("origin", "text", F.monotonically_increasing_id().alias("_text")).select("origin", "_text", F.posexplode(F.split("text", LINE_END)).alias("seq", "line"))
    bare = F.regexp_replace("line", "#.*$", "")
    told = lines.where(bare.contains(":")).select("origin", "_text", "seq", F.lower(_trimmed(F.substring_index(bare, ":", 1))).alias("key"), _trimmed(F.regexp_replace(bare, "^[^:]*:", "")).alias("value"))
    in_text = Window.partitionBy("origin", "_text")
    names = F.col("key") == "user-agent"
    opens = names & ~F.coalesce(F.lag("key").over(in_text.orderBy("seq")) == "user-agent", F.lit(False))
    numbered = told.withColumn("_opens", opens.cast("int")).withColumn("_group", F.sum("_opens").over(in_text.orderBy("seq")))
    agents = F.collect_list(F.when(names, F.lower("value"))).over(Window.partitionBy("origin", "_text", "_group"))
    grouped = numbered.where("_group > 0").withColumn("_agents", F.when(names, F.array(F.lower("value"))).otherwise(agents))
    rule = F.col("key").isin("allow", "disallow") & (F.col("value") != "")
    delay = (F.col("key") == "crawl-delay") & F.col("value").rlike(NUMBER)
    path = F.when(rule, F.col("value"))
    return grouped.where(names | rule | delay).select(
        "origin", "seq", F.explode("_agents").alias("agent"), F.when(rule, F.col("key") == "allow").alias("allow"), path.alias("path"), regex_of(path).alias("regex"),
        F.when(delay, F.expr("try_cast(value as double)")).alias("crawl_delay"),
    )


def groups_for(rules: DataFrame, user_agent: str) -> DataFrame:
    """The rows of each origin's group for an agent: the longest name that the agent holds, else ``*``."""
    fits = (F.col("agent") == "*") | ((F.col("agent") != "") & F.instr(F.lit(user_agent.lower()), F.col("agent")).cast("boolean"))
    size = F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))
    own = rules.where(fits).withColumn("_size", size)
    best = own.groupBy("origin").agg(F.max_by("agent", F.struct("_size", "agent")).alias("agent"))
    return own.drop("_size").join(best, ["origin", "agent"], "left_semi")


def robots_path(url: Column) -> Column:
    path, query = path_of(url), query_of(url)
    return F.concat(F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def rules_met(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths (origin, _path) with the rules (origin, _begins) that they begin with."""
    # a path has a few thousand characters at most, so an origin has few lengths
    lengths = rules.groupBy("origin").agg(F.collect_set(F.length("_begins")).alias("_lengths"))
    cut = asked.join(lengths, "origin").withColumn("_n", F.explode("_lengths")).where(F.col("_n") <= F.length("_path"))
    return cut.withColumn("_begins", F.expr("substring(_path, 1, _n)")).join(rules, ["origin", "_begins"])


def check_robots(urls: DataFrame, rules: DataFrame, user_agent: str, status: DataFrame | None = None) -> DataFrame:
    """Adds ``allowed``, ``rule``, ``robots_url``, ``reason`` to rows of (url).

    Of the patterns that match the longest path wins, Allow wins ties. ``status`` (origin, status) says how robots.txt
    was answered: 5xx or no answer closes an origin, 4xx opens it. Each distinct URL is decided once.

    Rules are found by what they begin with: a URL is cut to the lengths that beginnings of its origin's rules have, and
    meets the rules by (origin, beginning). Only rules with * or $ are then compared as expressions.
    """
    asked = urls.select("url").distinct().withColumns({"origin": origin_of(F.col("url")), "_path": robots_path(F.col("url"))})
    own = groups_for(rules, user_agent).where("path is not null").select("origin", "allow", "path", "regex", literal_of(F.col("path")).alias("_begins")).distinct()
    fits = (F.col("_begins") == F.col("path")) | F.expr("_path rlike regex")
    hit = rules_met(asked, own).where(fits).groupBy("url").agg(F.max_by(F.struct("allow", "path"), F.struct(F.length("path"), F.col("allow"))).alias("best"))
    out = asked.drop("_path").join(hit, "url", "left")
    closed = F.lit(False)
    if status is not None:
        out = out.join(status.select("origin", "status"), "origin", "left")
        closed = F.coalesce(F.col("status") >= 500, F.lit(True))
        out = out.withColumn("best", F.when(F.col("status") < 400, F.col("best")))
    denied = F.coalesce(~F.col("best.allow"), F.lit(False))
    decision = out.select(
        "url",
        (~closed & ~denied).alias("allowed"),
        F.when(~closed & denied, F.concat(F.lit("Disallow: "), F.col("best.path"))).alias("rule"),
        F.concat("origin", F.lit("/robots.txt")).alias("robots_url"),
        F.when(closed, NO_ROBOTS).when(denied, "robots").alias("reason"),
    )
    # a row without a url stays, and isn't allowed
    return urls.join(decision, "url", "left").withColumns({"allowed": F.coalesce("allowed", F.lit(False)), "reason": F.when(F.col("url").isNull(), "no_url").otherwise(F.col("reason"))})


def crawl_delays(rules: DataFrame, user_agent: str) -> DataFrame:
    """(origin, crawl_delay) of the group that applies; the last stated delay counts."""
    return groups_for(rules, user_agent).groupBy("origin").agg(F.max_by("crawl_delay", F.when(F.col("crawl_delay").isNotNull(), F.col("seq"))).alias("crawl_delay"))


#: requests of an origin that one task orders; an origin with more is cut into spans of time
SPAN_ROWS = 200_000


def schedule_requests(requests: DataFrame, interval: float, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Adds ``granted`` and ``delay`` (seconds) to (origin, at double, seq): no two grants of an origin are nearer.

    g(i) = max(t(i), g(i-1) + d) in closed form: i*d plus the running maximum of t(j) - j*d, from one sort. If the
    largest origin has more than ``span_rows`` requests, histories are numbered in spans of time, a task each; what a
    span takes over from those before is their number of requests and their maximum, a prefix over one row a span.
    """
    d = F.lit(interval)
    most = requests.groupBy("origin").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    cut = (most.n or 0) > span_rows and most.hi > most.lo
    rows = requests.withColumn("_span", F.floor((F.col("at") - most.lo) / ((most.hi - most.lo) * span_rows / most.n)) if cut else F.lit(0))
    order = Window.partitionBy("origin", *(["_span"] if cut else [])).orderBy("at", "seq")
    rows = rows.withColumn("_i", F.row_number().over(order) - 1)
    rows = rows.withColumn("_top", F.max(F.col("at") - F.col("_i") * d).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if not cut:
        return rows.withColumn("granted", F.col("_i") * d + F.col("_top")).withColumn("delay", F.col("granted") - F.col("at")).drop("_span", "_i", "_top")
    before = Window.partitionBy("origin").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("origin", "_span").agg(F.count("*").alias("_n"), F.max("_top").alias("_most")).withColumn("_had", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    spans = spans.withColumn("_lead", F.max(F.col("_most") - F.col("_had") * d).over(before)).select(F.col("origin").alias("_origin"), F.col("_span").alias("_of"), "_had", "_lead")
    both = rows.join(spans, F.col("origin").eqNullSafe(F.col("_origin")) & (F.col("_span") == F.col("_of")))
    granted = (F.col("_had") + F.col("_i")) * d + F.greatest(F.col("_lead"), F.col("_top") - F.col("_had") * d)
    return both.withColumn("granted", granted).withColumn("delay", F.col("granted") - F.col("at")).drop("_span", "_i", "_top", "_origin", "_of", "_had", "_lead")


def rate_violations(log: DataFrame, interval: float, span: float = 3600.0) -> DataFrame:
    """Neighbouring requests (at in seconds) of an origin that are nearer than the interval: (origin, seq, at, gap).

    Neighbours are looked for in spans, a task each; the first of a span follows the last of the span before.
    """
    rows = log.withColumn("_span", F.floor(F.col("at") / span))
    last = rows.groupBy("origin", "_span").agg(F.max("at").alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy("origin").orderBy("_span"))).drop("_last")
    near = F.lag("at").over(Window.partitionBy("origin", "_span").orderBy("at", "seq"))
    own = rows.withColumn("_near", near).join(before, ["origin", "_span"])
    return own.withColumn("gap", F.col("at") - F.coalesce("_near", "_before")).where(F.col("gap") < interval).select("origin", "seq", "at", "gap")


def concurrency(log: DataFrame, cap: int, span: float = 3600.0) -> DataFrame:
    """Moments when more than ``cap`` requests (origin, at, until in seconds) of an origin run: (origin, moment, running).

    Summed up in spans, a task each, on top of what the spans before leave running.
    """
    edges = log.select("origin", F.explode(F.array(F.struct(F.col("at").alias("moment"), F.lit(1).alias("step")), F.struct(F.col("until").alias("moment"), F.lit(-1).alias("step")))).alias("e")).select("origin", "e.*")
    each = edges.groupBy("origin", "moment").agg(F.sum("step").alias("step")).withColumn("_span", F.floor(F.col("moment") / span))
    before = Window.partitionBy("origin").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    had = each.groupBy("origin", "_span").agg(F.sum("step").alias("_n")).withColumn("_had", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    running = F.sum("step").over(Window.partitionBy("origin", "_span").orderBy("moment"))
    own = each.withColumn("_running", running).join(had, ["origin", "_span"])
    return own.withColumn("running", F.col("_running") + F.col("_had")).where(F.col("running") > cap).select("origin", "moment", "running")


def fetch_outcomes(attempts: DataFrame, retries: int = 3) -> DataFrame:
    """(url, attempts, last_status, outcome) of attempts (url, attempt, status).

    ok; gave_up if the last status is a limit or a server's fault and all retries are used; else failed. Null is a
    network error.
    """
    last = attempts.groupBy("url").agg(F.count("*").alias("attempts"), F.max_by("status", "attempt").alias("last_status"))
    again = F.col("last_status").isNull() | (F.col("last_status") == 429) | (F.col("last_status") >= 500)
    return last.withColumn("outcome", F.when(F.col("last_status") < 400, "ok").when(again & (F.col("attempts") > retries), "gave_up").otherwise("failed"))


def status_class(status: Column) -> Column:
    """The kind of error that a status is."""
    return F.when(status.isin(401, 403), "auth").when(status == 429, "rate_limit").when(status >= 500, "unavailable").when(status >= 400, "rejected").when(status.isNull(), "network").otherwise("ok")
