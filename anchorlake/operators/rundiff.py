"""Comparing two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake import fixed_values as fixed
from anchorlake.operators.columns import Row
from anchorlake.operators.keyed import last_per_key

ALIVE = ["GOOD", "REVIEW", "LOW_VALUE"]
RUN_COLUMNS = ["url", "registered", "verdict", "score", "link_found", "is_followed", "is_nofollow",
               "is_sponsored", "is_ugc", "target_checked", "redirect_hops", "da", "error",
               "status_code", "issues", "anchor_texts", "link_rel", "final_url"]


def severity(verdict: Column) -> Column:
    rank = F.lit(9)
    for name, value in fixed.DIFF_SEVERITY.items():
        rank = F.when(verdict == name, value).otherwise(rank)
    return rank


def _facts(rows: DataFrame) -> list[Column]:
    """Every compared column, present or not."""
    r = Row(rows)
    flags = {"link_found", "is_followed", "is_nofollow", "is_sponsored", "is_ugc", "target_checked"}
    numbers = {"score", "da"}
    return [(r.flag(c) if c in flags else r.number(c) if c in numbers
             else r.count(c) if c == "redirect_hops" else r.text(c)).alias(c) for c in RUN_COLUMNS[1:]]


def compared(rows: DataFrame) -> Column:
    """The compared columns of a row of a run as one struct."""
    return F.struct(*_facts(rows))


def last_rows(rows: DataFrame) -> DataFrame:
    """One row per URL with every compared column present; the last row of a URL counts."""
    order = F.col("seq") if "seq" in rows.columns else F.lit(0)
    picked = rows.where(F.coalesce("url", F.lit("")) != "").select("url", *_facts(rows), order.alias("_seq"))
    return last_per_key(picked, ["url"], [F.col("_seq"), F.col("verdict")]).drop("_seq")


def stamped(rows: DataFrame, run_at: str, earlier: DataFrame | None = None) -> DataFrame:
    """The rows of a run, one per URL, with its time and that of the run before it.

    ``earlier`` has the ``run_at`` of all runs known; the newest one before this run is the
    run before it, null if there is none.
    """
    now = F.lit(run_at).cast("timestamp")
    before = F.lit(None).cast("timestamp") if earlier is None else earlier.where(
        F.col("run_at") < now).agg(F.max("run_at")).scalar()
    return last_rows(rows).withColumn("run_at", now).withColumn("prev_run_at", before)


def closing(stamped_rows: DataFrame) -> DataFrame:
    """One row without a URL that says that a run is over, for streams to take as the start of a later run."""
    last = stamped_rows.agg(F.max("run_at").alias("prev_run_at"))
    empty = [F.lit("").alias("url") if f.name == "url" else F.lit(None).cast(f.dataType).alias(f.name)
             for f in stamped_rows.schema if f.name not in ("run_at", "prev_run_at")]
    return last.select(*empty, (F.col("prev_run_at") + F.expr("INTERVAL 1 SECOND")).alias("run_at"), "prev_run_at").select(
        *stamped_rows.columns)


def run_diff(old: DataFrame, new: DataFrame, score_delta: float = 10.0) -> DataFrame:
    """All changes between two runs as (change, priority, url, ...), several per URL.

    One full outer join on URL and one explode over the conditions.
    """
    was = last_rows(old).select("url", F.struct(*RUN_COLUMNS[1:]).alias("a"))
    now = last_rows(new).select("url", F.struct(*RUN_COLUMNS[1:]).alias("b"))
    return changes(was.join(now, "url", "full_outer"), score_delta)


def changes(both: DataFrame, score_delta: float = 10.0, *more: str) -> DataFrame:
    """The changes of URLs with their facts ``a`` in one run and ``b`` in the next; either may be null."""
    a, b = F.col("a"), F.col("b")
    common = a.isNotNull() & b.isNotNull()
    va, vb = a["verdict"], b["verdict"]
    sa, sb = F.coalesce(a["score"], F.lit(0.0)), F.coalesce(b["score"], F.lit(0.0))
    delta = F.bround(sb - sa, 1)
    reachable = vb.isin(ALIVE + ["LINK_LOST"])
    tagged_now = b["is_nofollow"] | b["is_sponsored"] | b["is_ugc"]
    tagged_was = a["is_nofollow"] | a["is_sponsored"] | a["is_ugc"]
    worse, better = severity(vb) > severity(va), severity(vb) < severity(va)
    died = va.isin(ALIVE) & (vb == "DEAD")
    restored = ~a["link_found"] & b["link_found"]
    went = b["link_found"] & tagged_now & ~tagged_was
    toxic = (va != "TOXIC") & (vb == "TOXIC")
    conditions: dict[str, tuple[Column, Column]] = {
        "died": (died, F.when(b["error"] != "", b["error"]).otherwise(
            F.concat(F.lit("HTTP "), b["status_code"]))),
        "revived": ((va == "DEAD") & vb.isin(ALIVE), F.lit("the page answers again")),
        "link_lost": (a["link_found"] & ~b["link_found"] & b["target_checked"] & reachable,
                      F.lit("the page loads without the link")),
        "link_restored": (restored, F.concat(F.lit("anchor: "), b["anchor_texts"])),
        "went_nofollow": (went, F.concat(F.lit("rel: "), F.when(
            b["link_rel"] == "", "nofollow").otherwise(b["link_rel"]))),
        "became_followed": (b["link_found"] & tagged_was & ~tagged_now & b["is_followed"],
                            F.lit("rel attribute dropped")),
        "turned_toxic": (toxic, b["issues"]),
        "cleared": ((va == "TOXIC") & (vb != "TOXIC"), F.lit("no spam signals any more")),
        "redirect_new": ((a["redirect_hops"] == 0) & (b["redirect_hops"] > 0),
                         F.concat(F.lit("now at "), b["final_url"])),
        "score_up": (sb - sa >= score_delta, F.lit("")),
        "score_down": (sa - sb >= score_delta, F.lit("")),
        "verdict_worse": (worse, F.lit("")),
        "verdict_better": (better, F.lit("")),
        "added": (a.isNull(), F.lit("not in the earlier run")),
        "removed": (b.isNull(), F.lit("not in this run")),
    }
    rows = []
    for change, priority in fixed.CHANGE_KINDS:
        condition, detail = conditions[change]
        applies = condition if change in ("added", "removed") else common & condition
        rows.append(F.when(applies, F.struct(
            F.lit(change).alias("change"), F.lit(priority).alias("priority"), detail.alias("detail"))))
    return (
        both.withColumn("_c", F.explode(F.array(*rows))).where(F.col("_c").isNotNull())
        .select(F.col("_c.change"), F.col("_c.priority"), "url", *more,
                F.coalesce(b["registered"], a["registered"]).alias("domain"),
                va.alias("was"), vb.alias("now"),
                F.when(a.isNotNull(), sa).alias("score_was"), F.when(b.isNotNull(), sb).alias("score_now"),
                F.when(common, delta).alias("delta"),
                F.when(b.isNotNull(), b["da"]).otherwise(a["da"]).alias("da"),
                F.col("_c.detail")))


def headline_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change", "priority").agg(F.count("*").alias("n"))


def fold_domains(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Worst verdict per domain; the first row wins among equals."""
    facts = rows.where(F.coalesce("registered", F.lit("")) != "").select(
        "registered", "url", "verdict", F.col(seq).alias("_seq"))
    return last_per_key(
        facts, ["registered"], [severity(F.col("verdict")), -F.col("_seq")]).drop("_seq")


def domain_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Registered domains that are new or gone."""
    was = old.where(F.col("registered") != "").select("registered").distinct()
    now = new.where(F.col("registered") != "").select("registered").distinct()
    return now.join(was, "registered", "left_anti").withColumn("change", F.lit("new")).unionByName(
        was.join(now, "registered", "left_anti").withColumn("change", F.lit("gone")))


def run_verdicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Verdict counts of both runs side by side."""
    return old.select("verdict", F.lit(1).alias("o")).unionByName(
        new.select("verdict", F.lit(0).alias("o"))).groupBy("verdict").agg(
            F.sum("o").cast("long").alias("n_old"), F.sum(1 - F.col("o")).cast("long").alias("n_new"))
