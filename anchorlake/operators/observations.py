"""Joining stored observations: robots.txt bodies, hosting records, archive snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorlake import fixed_values as fixed
from anchorlake.functions import urls as U
from anchorlake.operators.columns import Row
from anchorlake.operators.keyed import first_per_key, last_per_key, lookup

ROBOTS_AGENT = "Googlebot"


# ---------------------------------------------------------------- robots -----
def robots_lines(robots: DataFrame) -> DataFrame:
    """origin, at, kind, value for the lines of stored robots files that mean something.

    Kinds: ``agent``, ``allow``, ``disallow``, ``other`` (a directive that closes a list of
    agents) and ``blank``.
    """
    usable = first_per_key(robots.where(F.col("status") == 200).select("origin", "body"), ["origin"], [F.col("body")])
    lines = usable.select("origin", F.posexplode(F.split("body", "\r\n|\n|\r")).alias("at", "line"))
    bare = F.trim(F.regexp_replace(F.substring_index("line", "#", 1), r"^\s+|\s+$", ""))
    field = F.lower(F.trim(F.substring_index(bare, ":", 1)))
    value = F.regexp_replace(F.regexp_replace(bare, "^[^:]*:", ""), r"^\s+|\s+$", "")
    kind = (
        F.when(F.col("line").rlike(r"^\s*$"), "blank").when(~bare.contains(":"), None)
        .when(field == "user-agent", "agent").when(field.isin("allow", "disallow"), field)
        .when(field.isin("crawl-delay", "request-rate"), "other"))
    return lines.select("origin", "at", kind.alias("kind"), value.alias("value")).where(F.col("kind").isNotNull())


def _decoded(path: Column) -> Column:
    """Percent-decoded; a path that is no valid encoding stays as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path)


def robots_rules(robots: DataFrame) -> DataFrame:
    """The rules of the group that applies to our agent, in file order, for each origin.

    Agent lines in a row and the rules below them, up to a blank line, are a group. The
    first group that names our agent applies, else the first one for all agents. A missing
    or failed file has no rules, and so does a group without any: everything is allowed.
    """
    in_file = W.partitionBy("origin").orderBy("at")
    lines = robots_lines(robots).withColumn("before", F.lag("kind").over(in_file))
    opens = (F.col("kind") == "blank") | (F.col("kind") == "agent") & (
        F.coalesce("before", F.lit("")) != "agent")
    grouped = lines.withColumn("part", F.sum(opens.cast("int")).over(in_file))
    agent, named = F.lower("value"), F.col("kind") == "agent"
    groups = grouped.groupBy("origin", "part").agg(
        F.count_if(named).alias("agents"), F.count_if(~named & (F.col("kind") != "blank")).alias("rules"),
        F.max(named & (F.col("value") == "*")).alias("for_all"),
        F.max(named & (F.instr(F.lit(ROBOTS_AGENT.lower()), agent) > 0)).alias("for_us"))
    rank = F.when(F.col("for_all"), 1).when(F.col("for_us"), 0)
    ours = groups.where((F.col("agents") > 0) & (F.col("rules") > 0) & rank.isNotNull()).groupBy("origin").agg(
        F.min_by("part", F.struct(rank.alias("rank"), "part")).alias("part"))
    rules = grouped.where(F.col("kind").isin("allow", "disallow")).join(ours, ["origin", "part"])
    # one file's rules are one value; closing nothing means allowing everything
    rule = F.struct("at", _decoded(F.col("value")).alias("path"), (
        (F.col("kind") == "allow") | (F.col("value") == "")).alias("allow"))
    return rules.groupBy("origin").agg(F.array_sort(F.collect_list(rule)).alias("rules"))


def robots_verdict(urls: DataFrame, robots: DataFrame, url_col: str = "url") -> DataFrame:
    """Add robots_blocked: the first rule whose path prefixes the URL's path decides."""
    path = F.regexp_extract(
        F.col(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?[^/?#]*([^#]*)", 1)
    decoded = _decoded(path)
    keyed = urls.withColumn("_origin", U.origin_of(F.col(url_col))).withColumn(
        "_path", F.when(decoded == "", "/").otherwise(decoded))
    rules = robots_rules(robots).withColumnRenamed("origin", "_origin")
    first = F.get(F.filter("rules", lambda r: (r["path"] == "*") | F.startswith(
        F.col("_path"), r["path"])), F.lit(0))
    return lookup(keyed, rules, "_origin").withColumn(
        "robots_blocked", ~F.coalesce(first["allow"], F.lit(True))).drop("_origin", "_path", "rules")


# --------------------------------------------------------------- hosting -----
_RDAP = ("name string, handle string, startAddress string, endAddress string, "
         "cidr0_cidrs array<struct<v4prefix:string,v6prefix:string,length:int>>, "
         "entities array<struct<roles:array<string>,vcardArray:string>>")


def hosting_class(label: Column) -> tuple[Column, Column]:
    """(shared, vps): a VPS name outranks a shared-hosting name."""
    vps = label.rlike("(?i)" + fixed.VPS_HOSTING)
    return label.rlike("(?i)" + fixed.SHARED_HOSTING) & ~vps, vps


def hosting_from_rdap(df: DataFrame) -> DataFrame:
    """Network name, owner, range and hosting class per IP from RDAP payloads."""
    d = df.withColumn("_d", F.from_json("payload", _RDAP))

    def owner(entity: Column) -> Column:
        roles = F.transform(F.coalesce(entity["roles"], F.array().cast("array<string>")), F.lower)
        card = F.from_json(entity["vcardArray"], "array<string>")
        items = F.transform(F.from_json(F.get(card, F.lit(1)), "array<string>"),
                            lambda item: F.from_json(item, "array<string>"))
        names = F.filter(items, lambda item: (F.size(item) >= 4) & (F.get(item, F.lit(0)) == "fn"))
        return F.when(
            F.arrays_overlap(roles, F.array(*[F.lit(x) for x in ("registrant", "administrative", "owner")])),
            F.get(F.get(names, F.lit(0)), F.lit(3)))

    owners = F.filter(F.transform("_d.entities", owner), lambda o: o.isNotNull() & (o != ""))
    ranges = F.filter(
        F.transform("_d.cidr0_cidrs", lambda c: F.when(
            F.coalesce(c["v4prefix"], c["v6prefix"]).isNotNull(),
            F.concat(F.coalesce(c["v4prefix"], c["v6prefix"]), F.lit("/"), c["length"].cast("string")))),
        lambda r: r.isNotNull())
    out = d.withColumns({
        "net_name": F.coalesce("_d.name", F.lit("")),
        "net_handle": F.coalesce("_d.handle", F.lit("")),
        "net_org": F.coalesce(F.get(owners, F.lit(0)), F.lit("")),
        "net_range": F.coalesce(
            F.get(ranges, F.lit(0)),
            F.concat("_d.startAddress", F.lit("-"), F.coalesce("_d.endAddress", F.lit(""))),
            F.lit(""))})
    label = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("net_org", "net_name", "net_handle")],
                       F.lit(""))
    shared, vps = hosting_class(F.col("_label"))
    return out.withColumn("_label", label).withColumns(
        {"shared_host": shared, "vps_host": vps}).drop("_d", "_label")


def attach_hosting(rows: DataFrame, hosting: DataFrame) -> DataFrame:
    """Hosting columns by IP; IPv6 addresses are not looked up."""
    names = ["net_name", "net_handle", "net_org", "net_range", "shared_host", "vps_host"]
    per_ip = first_per_key(
        hosting.select(F.col("ip").alias("_ip"), *names), ["_ip"], [F.col("net_org"), F.col("net_name")])
    ip = F.trim(F.coalesce("ip", F.lit("")))
    asked = rows.drop(*names).withColumn("_ip", F.when((ip != "") & ~ip.contains(":"), ip))
    out = lookup(asked, per_ip, "_ip").drop("_ip")
    return out.withColumns({
        **{c: F.coalesce(c, F.lit("")) for c in names[:4]},
        **{c: F.coalesce(c, F.lit(False)) for c in names[4:]}})


def hosting_stats(hosting: DataFrame) -> DataFrame:
    named = (F.col("net_org") != "") | (F.col("net_name") != "")
    return hosting.agg(
        F.count("*").alias("ips"), F.count_if(named).alias("identified"),
        F.count_if("shared_host").alias("shared_hosts"), F.count_if("vps_host").alias("vps_hosts"))


# --------------------------------------------------------------- archive -----
def recover_from_archive(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What dead pages used to say, from the newest analysed snapshot of each.

    ``snapshots`` has url, snapshot_url, ts (YYYYMMDD...) and, where the snapshot
    could be read, the page features page_title, link_found and anchor_texts.
    """
    r = Row(snapshots)
    facts = snapshots.select(
        F.col("url").alias("_dead"), F.col("snapshot_url"), r.text("ts").alias("_ts"),
        r.get("page_title").cast("string").alias("_title"),
        r.get("link_found").cast("boolean").alias("_found"), r.text("anchor_texts").alias("_anchor"))
    newest = last_per_key(facts, ["_dead"], [F.col("_ts"), F.col("snapshot_url")])
    dead = F.col("status_verdict").isin("DEAD", "GONE", "DNS_ERROR")
    out = lookup(rows.withColumn("_dead", F.when(dead, F.col("url"))), newest, "_dead")
    have = F.coalesce("snapshot_url", F.lit("")) != ""
    ts = F.col("_ts")
    date = F.when(~have, "").when(F.length(ts) >= 8, F.concat_ws(
        "-", F.substring(ts, 1, 4), F.substring(ts, 5, 2), F.substring(ts, 7, 2))).otherwise(ts)
    found, anchor = F.coalesce("_found", F.lit(False)), F.coalesce("_anchor", F.lit(""))
    note = (
        F.when(~dead, "").when(~have, "no snapshot")
        .when(F.col("_found").isNull(), "the snapshot could not be read")
        .when(found & (anchor != ""), F.concat(
            F.lit("the snapshot of "), date, F.lit(" shows the link as "), anchor))
        .when(found, F.concat(F.lit("the snapshot of "), date, F.lit(" shows the link")))
        .otherwise(F.concat(F.lit("the snapshot of "), date, F.lit(" has no link"))))
    return out.withColumns({
        "archive_available": dead & have,
        "archive_url": F.when(have, F.col("snapshot_url")).otherwise(""),
        "archive_date": date, "archive_title": F.coalesce("_title", F.lit("")),
        "archive_link_found": found, "archive_anchor": anchor, "archive_note": note,
    }).drop("_dead", "snapshot_url", "_ts", "_title", "_found", "_anchor")
