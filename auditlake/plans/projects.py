"""Projects: dashboard, validation, scheduler."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.plans import listing

INTERVAL_MIN, INTERVAL_MAX = 15, 525_600


def dashboard(projects: DataFrame, crawls: DataFrame) -> DataFrame:
    """projects with the scores of the latest two completed crawls and their difference, in one pass."""
    order = Window.partitionBy("project_id").orderBy(F.desc("id"))
    two = crawls.filter("status = 'completed'").withColumn("n", F.row_number().over(order)).filter("n <= 2")
    pick = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    two = two.groupBy("project_id").agg(pick(1, "id").alias("latest_id"), pick(1, "score").alias("latest_score"),
        pick(2, "id").alias("previous_id"), pick(2, "score").alias("previous_score"))
    x = projects.join(two, projects["id"] == two["project_id"], "left")
    delta = F.floor((F.col("latest_score") - F.col("previous_score")) * 10 + 0.5) / 10
    return x.select(projects["id"].alias("project_id"), "latest_id", "latest_score", "previous_id", "previous_score",
        delta.alias("delta")).orderBy("project_id")


def invalid(projects: DataFrame) -> DataFrame:
    """(id, problem) of projects that can't be stored."""
    problems = F.array(
        F.when(~F.coalesce(F.length("name").between(1, 255), F.lit(False)), "name"),
        F.when(~F.coalesce(F.length("domain").between(1, 255), F.lit(False)), "domain"),
        F.when(F.col("schedule_interval_minutes").isNotNull()
            & ~F.col("schedule_interval_minutes").between(INTERVAL_MIN, INTERVAL_MAX), "schedule_interval_minutes"),
    )
    twice = projects.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and domain is not null")
    wrong = projects.select("id", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))
    return wrong.union(projects.join(twice, "domain", "left_semi").select("id",
            F.lit("domain is taken").alias("problem")))


def _clock(now: datetime | Column | None) -> Column:
    return F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)


def due(projects: DataFrame, now: datetime | Column | None = None) -> DataFrame:
    """Projects whose next crawl is due."""
    return projects.filter(F.col("schedule_interval_minutes").isNotNull() & (F.col("next_scheduled_at") <= _clock(now)))


def tick(projects: DataFrame, crawls: DataFrame, now: datetime | Column | None = None) -> DataFrame:
    """Due projects with action enqueue, or skip where a crawl is active, and the next time, counted from now."""
    active = crawls.filter(F.col("status").isin("queued", "running")).select(F.col("project_id").alias("id"),
        F.lit(True).alias("busy")).distinct()
    next_ = _clock(now) + F.make_dt_interval(mins=F.col("schedule_interval_minutes"))
    return due(projects, now).join(active, "id", "left").select(F.col("id").alias("project_id"),
        F.when(F.col("busy"), "skip").otherwise("enqueue").alias("action"), next_.alias("next_scheduled_at"))


def tick_counts(ticked: DataFrame) -> DataFrame:
    return ticked.agg(F.count_if(F.col("action") == "enqueue").alias("enqueued"),
        F.count_if(F.col("action") == "skip").alias("skipped_in_flight"), F.count(F.lit(1)).alias("advanced"))


def compare_candidates(crawls: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """(project_id, id): for each project its completed crawls but the current one, the latest first.

    current: (project_id, id), by default each project's latest crawl of whatever status.
    """
    if current is None:
        current = crawls.groupBy("project_id").agg(F.max("id").alias("id"))
    others = crawls.filter("status = 'completed'").join(current.select("id"), "id", "left_anti")
    return others.select("project_id", "id").orderBy("project_id", F.desc("id"))


def list_projects(projects: DataFrame) -> DataFrame:
    return projects.orderBy("id")


def get_project(projects: DataFrame, project_id: int) -> DataFrame:
    """The project's row; LookupError if there is none."""
    row = projects.filter(F.col("id") == project_id)
    if row.isEmpty():
        raise LookupError("Project not found")
    return row


def list_crawls(projects: DataFrame, crawls: DataFrame, project_id: int) -> DataFrame:
    """A project's crawls, the latest first."""
    get_project(projects, project_id)
    return crawls.filter(F.col("project_id") == project_id).orderBy(F.desc("id"))


def get_crawl(projects: DataFrame, crawls: DataFrame, project_id: int, crawl_id: int) -> DataFrame:
    """The crawl's row; LookupError if the project or its crawl isn't there."""
    row = list_crawls(projects, crawls, project_id).filter(F.col("id") == crawl_id)
    if row.isEmpty():
        raise LookupError("Crawl not found")
    return row


def list_sitemaps(projects: DataFrame, sitemaps: DataFrame, project_id: int) -> DataFrame:
    get_project(projects, project_id)
    return sitemaps.filter(F.col("project_id") == project_id).orderBy("id")


def next_time(minutes: Column, now: datetime | Column | None = None) -> Column:
    """When a project with that interval is due first: one interval from now, never without one."""
    return F.when(minutes.isNotNull(), _clock(now) + F.make_dt_interval(mins=minutes))


def created(projects: DataFrame, new: DataFrame, now: datetime | Column | None = None) -> DataFrame:
    """(row, problem): rows of new with ids after the last and their first time, or why a row is refused.

    new: (name, domain, schedule_interval_minutes, ...), in order of domain; of rows with one
    domain, and of those whose domain is taken, only the first is taken.
    """
    last = projects.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered = listing.laid_out(new, "domain", "name").withColumnRenamed("place", "id")
    bad = invalid(numbered).filter("problem <> 'domain is taken'").groupBy("id").agg(F.min("problem").alias("problem"))
    taken = projects.select("domain").distinct().withColumn("taken", F.lit(True))
    first = F.row_number().over(Window.partitionBy("domain").orderBy("id")) == 1
    x = numbered.join(bad, "id", "left").join(taken, "domain", "left").withColumn("first", first)
    problem = F.coalesce("problem", F.when(F.col("taken") | ~F.col("first"), "domain is taken"))
    x = x.withColumn("problem", problem).withColumn("ok", F.when(F.col("problem").isNull(), 1).otherwise(0))
    x = listing.running(x.withColumnRenamed("id", "place"), "ok", "n").withColumn("one", F.lit(1)).join(F.broadcast(last.withColumn("one", F.lit(1))), "one")
    return x.select(*new.columns, F.when(F.col("ok") == 1, F.col("last") + F.col("n")).alias("id"),
        F.when(F.col("ok") == 1, next_time(F.col("schedule_interval_minutes"), now)).alias("next_scheduled_at"),
        "problem")


def patched(projects: DataFrame, patches: DataFrame, now: datetime | Column | None = None) -> DataFrame:
    """projects after patches (id, sent array<string>, and the columns they may set): a column changes only if it was sent, also to null.

    The next time is made anew if the interval was sent, whatever its value, and else left alone.
    """
    fields = [c for c in patches.columns if c in projects.columns and c != "id"]
    p = patches.select("id", "sent", *[F.col(c).alias(f"__new_{c}") for c in fields])
    x = projects.join(p, "id", "left")
    was_sent = lambda c: F.coalesce(F.array_contains("sent", c), F.lit(False))
    out = {c: F.when(was_sent(c), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in fields}
    interval = "schedule_interval_minutes"
    if interval in fields:
        out["next_scheduled_at"] = F.when(was_sent(interval),
            next_time(F.col(f"__new_{interval}"), now)).otherwise(F.col("next_scheduled_at"))
    return x.select(*[out.get(c, F.col(c)).alias(c) for c in projects.columns])


#: The column of each table that names its owner, and the owner's table: what goes with a project.
OWNERS = {"crawls": ("project_id", "projects"), "sitemaps": ("project_id", "projects"), "pages": ("crawl_id", "crawls"),
    "issues": ("crawl_id", "crawls"), "links": ("crawl_id", "crawls"), "resources": ("crawl_id", "crawls"),
    "images": ("page_id", "pages"), "content_blocks": ("page_id", "pages")}


def deleted(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """tables without the projects in gone (id) and all that hangs on them."""
    out = dict(tables)
    out["projects"] = tables["projects"].join(gone.select("id"), "id", "left_anti")
    left = {"projects": gone.select("id").distinct()}
    for name, (column, owner) in OWNERS.items():
        if name in tables and owner in left:
            keys = left[owner].select(F.col("id").alias(column))
            out[name] = tables[name].join(keys, column, "left_anti")
            if "id" in tables[name].columns:
                left[name] = tables[name].join(keys, column, "left_semi").select("id")
    return out


def triggered(projects: DataFrame, crawls: DataFrame, project_id: int) -> DataFrame:
    """(id, project_id, status, job_id) of the queued crawl that a request for the project makes."""
    get_project(projects, project_id)
    new = crawls.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    return new.select("id", F.lit(project_id).cast("long").alias("project_id"), F.lit("queued").alias("status"),
        F.concat(F.lit("crawl-"), F.col("id").cast("string")).alias("job_id"))
