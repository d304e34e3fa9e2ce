"""The job plane over relational tables: reports, admission, transitions, and rules of the tables.

Tables and the columns that operators use (each names what it needs):

* ``jobs``: job_id, tenant, state, created_at, queued_at, completed_at, upload_expires_at,
  retention_expires_at, idempotency_key, input_digest, reserved_pages, pages_actual,
  unit_price_micros, estimated_cost_micros, accepted_attempt_id, failure_code, result_uri,
  result_digest, compact_result_uri, compact_result_digest, compact_result_bytes
* ``attempts``: attempt_id, job_id, state, created_at, completed_at, reconcile_after, call_id,
  replaces_attempt_id, failure_code
* ``grants``: tenant, pages; ``users``: tenant, status

A transition is a function from tables to the next version of a table, so it can be written
with any sink; what a row was decides what it becomes, never what a reader saw before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States, limits, time spans and failure codes of the job plane.
JOB_STATES = ("uploading", "queued", "dispatched", "succeeded", "failed")
ACTIVE, PROCESSING = ("uploading", "queued", "dispatched"), ("queued", "dispatched")
ATTEMPT_STATES = ("dispatching", "dispatch_unknown", "dispatched", "succeeded", "failed")
OPEN_ATTEMPTS = ("dispatching", "dispatch_unknown", "dispatched")
PAGE, MOST_ACTIVE, MOST_ACTIVE_OF_TENANT, MOST_PAGES, TRIAL_PAGES = 25, 100, 5, 200, 100
MOST_INPUT_BYTES, MOST_RESULT_BYTES = 90 << 20, 128 << 20
UPLOAD, PROCESS, RETENTION, DEFERRAL = "1 hour", "24 hours", "2 days", "60 seconds"
FAILURE_CODES = ("upload_expired", "invalid_upload", "input_digest_mismatch", "input_too_large", "invalid_pdf", "page_limit_exceeded", "processing_deadline_exceeded", "dispatch_failed", "processing_failed")
#: Which code of several failed attempts a job reports; the others come after these.
CODE_ORDER = ("input_digest_mismatch", "page_limit_exceeded", "invalid_pdf", "dispatch_failed")
STATE_FILTERS = {"all": None, "active": ACTIVE, "succeeded": ("succeeded",), "failed": ("failed",)}
DATE_WINDOWS = {"24h": "24 hours", "7d": "7 days", "30d": "30 days", "all": None}
SHA256 = "^[0-9a-f]{64}$"


def _time(now) -> Column:
    return F.lit(now).cast("timestamp")


def _at(name: str) -> Column:
    return F.col(name).cast("timestamp")


# -- reports ------------------------------------------------------------------------------


def parse_jobs_query(query: dict[str, str]) -> tuple[str, str, int]:
    """State filter, date window and page of a list request (FLT20); anything else is an error."""
    state, date, page = query.get("state", "all"), query.get("date", "7d"), query.get("page", "1")
    if state not in STATE_FILTERS or date not in DATE_WINDOWS or not (page.isascii() and page.isdigit() and not page.startswith("0")) or int(page) > 2**53 - 1:
        raise TypeError("invalid jobs query")
    return state, date, int(page)


def jobs_where(jobs: DataFrame, *, tenant=None, state: str = "all", date: str = "all", now=None) -> DataFrame:
    """The jobs of a list request (FLT14)."""
    df = jobs if tenant is None else jobs.where(F.col("tenant") == tenant)
    if states := STATE_FILTERS[state]:
        df = df.where(F.col("state").isin(*states))
    if window := DATE_WINDOWS[date]:
        df = df.where(_at("created_at") >= _time(now) - F.expr(f"interval {window}"))
    return df


def jobs_page(jobs: DataFrame, page: int = 1, size: int = PAGE) -> DataFrame:
    """One page of the list, newest first (SRT1)."""
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).offset((page - 1) * size).limit(size)


def page_counts(jobs: DataFrame, size: int = PAGE) -> DataFrame:
    """``total`` and ``page_count``, 1 at least (SRT1)."""
    return jobs.agg(F.count("*").alias("total")).withColumn("page_count", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def jobs_summary(jobs: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Documents, and pages and cost of those that succeeded (AGG32)."""
    done = lambda c: F.coalesce(F.sum(F.when(F.col("state") == "succeeded", F.col(c))), F.lit(0)).cast("long")
    return jobs.groupBy(*keys).agg(F.count("*").alias("documents"), done("pages_actual").alias("pages"), done("estimated_cost_micros").alias("cost"))


def usage_days(jobs: DataFrame, month_start) -> DataFrame:
    """What finished since the start of the month, by tenant and day in UTC (AGG33)."""
    done = jobs.where((F.col("state") == "succeeded") & (_at("completed_at") >= _time(month_start)))
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return done.groupBy("tenant", F.to_date(_at("completed_at")).alias("day")).agg(F.count("*").alias("documents"), sums("pages_actual").alias("pages"), sums("estimated_cost_micros").alias("cost"))


def credit_summary(grants: DataFrame, jobs: DataFrame) -> DataFrame:
    """Granted, used, reserved and available pages of every tenant of either table (AGG31): what
    succeeded is used, what is active is reserved. One aggregation over both sides."""
    zero = F.lit(0).cast("long")
    g = grants.select("tenant", F.col("pages").cast("long").alias("granted"), zero.alias("used"), zero.alias("reserved"))
    part = lambda states, c: F.when(F.col("state").isin(*states), F.col(c)).otherwise(0).cast("long")
    u = jobs.select("tenant", zero.alias("granted"), part(("succeeded",), "pages_actual").alias("used"), part(ACTIVE, "reserved_pages").alias("reserved"))
    sums = g.unionByName(u).groupBy("tenant").agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("granted", "used", "reserved")])
    return sums.withColumn("available", F.greatest(zero, F.col("granted") - F.col("used") - F.col("reserved")))


def admission_counts(jobs: DataFrame) -> DataFrame:
    """Active jobs of each tenant, ``owned``, and of all, ``global`` (AGG34)."""
    active = jobs.where(F.col("state").isin(*ACTIVE)).groupBy("tenant").agg(F.count("*").alias("owned"))
    return active.join(F.broadcast(active.agg(F.coalesce(F.sum("owned"), F.lit(0)).alias("global"))))


def job_view(jobs: DataFrame) -> DataFrame:
    """What an owner sees of a job (REC15): an unknown failure code reads processing_failed; the
    deadline is a day after it was queued."""
    code = F.when(F.col("state") == "failed", F.when(F.col("failure_code").isin(*FAILURE_CODES), F.col("failure_code")).otherwise("processing_failed"))
    return jobs.select(
        F.col("job_id").alias("id"), "state", F.lit("parse-v1").alias("processing_profile"), F.col("input_digest").alias("input_sha256"), F.col("pages_actual").alias("pages"), F.col("reserved_pages").alias("page_limit"),
        "estimated_cost_micros", "created_at", "queued_at", "completed_at", (_at("queued_at") + F.expr(f"interval {PROCESS}")).alias("processing_deadline_at"), "retention_expires_at", code.alias("error_code"),
    )


def result_descriptors(jobs: DataFrame, now, *, view: str = "compact", bucket: str = "results") -> DataFrame:
    """For each job, where its result lies or why it has none (REC16): ``job_id``, ``status``, ``key``, ``digest``, ``bytes``."""
    if view not in ("compact", "evidence"):
        raise ValueError("view must be compact or evidence")
    compact = view == "compact"
    prefix = f"r2://{bucket}/"
    uri, digest = (F.col(f"compact_{c}" if compact else c) for c in ("result_uri", "result_digest"))
    size = F.col("compact_result_bytes") if compact else F.lit(None).cast("long")
    whole = F.col("accepted_attempt_id").isNotNull() & F.col("result_uri").isNotNull() & F.col("result_digest").isNotNull()
    whole = whole & (uri.isNotNull() & digest.isNotNull() & (F.coalesce(size, F.lit(0)) > 0) if compact else F.lit(True))
    late = F.col("retention_expires_at").isNull() | (_at("retention_expires_at") <= _time(now))
    status = F.when(F.col("state") == "failed", "job_failed").when(F.col("state") != "succeeded", "result_not_ready").when(late, "result_expired").when(~F.coalesce(whole & uri.startswith(prefix), F.lit(False)), "service_unavailable").otherwise("ok")
    shown = lambda c: F.when(status == "ok", c)
    return jobs.select("job_id", status.alias("status"), shown(F.substring(uri, F.lit(len(prefix) + 1), F.length(uri))).alias("key"), shown(digest).alias("digest"), shown(size).alias("bytes"))


def date_groups(jobs: DataFrame, now) -> DataFrame:
    """The list's rows with ``heading`` where the UTC day changes (REC18); null elsewhere."""
    day, today = F.to_date(_at("created_at")), F.to_date(_time(now))
    prefix = F.when(day == today, "Today · ").when(day == F.date_sub(today, 1), "Yesterday · ").otherwise("")
    name = F.concat(prefix, F.date_format(day, "d MMMM yyyy"))
    before = F.lag(day).over(Window.partitionBy("tenant").orderBy(F.desc("created_at"), F.desc("job_id")))
    return jobs.withColumn("heading", F.when(before.isNull() | (before != day), name))


# -- admission ----------------------------------------------------------------------------


def admit(requests: DataFrame, jobs: DataFrame, grants: DataFrame) -> DataFrame:
    """Decision on the next request of each tenant (SQL8): ``verdict``, ``replays``, ``reserved_pages``.

    A known idempotency key replays its job, or is refused if the input differs; then come the
    limits on active jobs, of all and of the tenant; then a page of credit must be left, and as
    many pages as are left are reserved, up to the most of a job. ``requests``: tenant,
    idempotency_key, input_digest. Requests are decided against the tables as they are: one that
    another one in the same batch would displace is decided in the next version.
    """
    known = jobs.where("idempotency_key is not null").select("tenant", "idempotency_key", F.col("job_id").alias("replays"), F.col("input_digest").alias("_digest"))
    counts = jobs.where(F.col("state").isin(*ACTIVE)).groupBy("tenant").agg(F.count("*").alias("_owned"))
    total = counts.agg(F.coalesce(F.sum("_owned"), F.lit(0)).alias("_global"))
    credit = credit_summary(grants, jobs).select("tenant", (F.col("granted") - F.col("used") - F.col("reserved")).alias("_left"))
    df = requests.join(known, ["tenant", "idempotency_key"], "left").join(counts, "tenant", "left").join(credit, "tenant", "left").join(F.broadcast(total))
    left = F.coalesce("_left", F.lit(0))
    verdict = (
        F.when(~F.coalesce(F.col("idempotency_key").rlike("^[\\x21-\\x7e]{1,128}$") & F.col("input_digest").rlike(SHA256), F.lit(False)), "invalid_request")
        .when(F.col("replays").isNotNull(), F.when(F.col("_digest") == F.col("input_digest"), "replayed").otherwise("idempotency_mismatch"))
        .when((F.col("_global") >= MOST_ACTIVE) | (F.coalesce("_owned", F.lit(0)) >= MOST_ACTIVE_OF_TENANT), "admission_limit")
        .when(left < 1, "credits_exhausted")
        .otherwise("admitted")
    )
    pages = F.when(verdict == "admitted", F.least(F.lit(MOST_PAGES).cast("long"), left))
    return df.select(*requests.columns, F.when(verdict == "replayed", F.col("replays")).alias("replays"), verdict.alias("verdict"), pages.alias("reserved_pages"))


def backfill_grants(users: DataFrame, jobs: DataFrame, grants: DataFrame, pages: int = TRIAL_PAGES) -> DataFrame:
    """A first grant for every user without one: the trial's pages and what they have used before (SQL6)."""
    used = jobs.where("state = 'succeeded'").groupBy("tenant").agg(F.sum("pages_actual").alias("_used"))
    new = users.select("tenant").distinct().join(grants.select("tenant").distinct(), "tenant", "left_anti").join(used, "tenant", "left")
    return new.select("tenant", (F.lit(pages) + F.coalesce("_used", F.lit(0))).cast("long").alias("pages"))


def provision_users(logins: DataFrame, users: DataFrame, *, self_signup: bool = False) -> DataFrame:
    """Status of the account behind each login (SQL13): invited ones become active, suspended ones stay
    shut, unknown ones are made only where signing up is open. ``logins``: tenant; null is refused."""
    df = logins.select("tenant").distinct().join(users.select("tenant", "status"), "tenant", "left")
    status = F.when(F.col("status") == "suspended", None).when(F.col("status").isNull(), "active" if self_signup else None).otherwise("active")
    return df.select("tenant", status.alias("status"))


def request_credits(requests: DataFrame, users: DataFrame, pending: DataFrame) -> DataFrame:
    """Whether a request for credits is made, stands already, or is refused (SQL13)."""
    df = requests.select("tenant").distinct().join(users.select("tenant", "status"), "tenant", "left").join(pending.select("tenant", F.lit(True).alias("_open")).distinct(), "tenant", "left")
    return df.select("tenant", F.when(F.col("_open"), "pending").when(F.col("status") == "active", "created").otherwise("forbidden").alias("outcome"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key: the next version of a table."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


# -- keys ---------------------------------------------------------------------------------

#: How a key begins, and how much of it is shown.
KEY_PATTERN, KEY_PREFIX = "^ps_live_[A-Za-z0-9_-]{43}$", 16


def issue_keys(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of new keys for active users (SQL14): only the digest is kept. ``requests``: tenant, name, secret."""
    name = F.trim("name")
    ok = (F.length(name) >= 1) & (F.length(name) <= 64) & F.col("secret").rlike(KEY_PATTERN)
    active = users.where("status = 'active'").select("tenant")
    return requests.where(ok).join(active, "tenant", "left_semi").select("tenant", name.alias("name"), F.substring("secret", 1, KEY_PREFIX).alias("prefix"), F.sha2("secret", 256).alias("hash"))


def revoke_keys(keys: DataFrame, revoked: DataFrame, now) -> DataFrame:
    """Next version of keys (SQL14): a key is revoked by its owner, and the first time counts. ``revoked``: key_id, tenant."""
    r = revoked.select("key_id", "tenant", F.lit(True).alias("_r")).distinct()
    return keys.join(r, ["key_id", "tenant"], "left").withColumn("revoked_at", F.when(F.col("_r"), F.coalesce(_at("revoked_at"), _time(now))).otherwise(_at("revoked_at"))).drop("_r").select(*keys.columns)


def authenticate(headers: DataFrame, keys: DataFrame, users: DataFrame) -> DataFrame:
    """Key and tenant of each Authorization header, null where it is not accepted (SQL14). ``headers``: request_id, authorization."""
    secret = F.regexp_extract("authorization", "(?i)^Bearer ([^ ]+)$", 1)
    h = headers.withColumn("_s", F.when(secret.rlike(KEY_PATTERN), secret)).withColumns({"prefix": F.substring("_s", 1, KEY_PREFIX), "hash": F.sha2("_s", 256)})
    live = keys.where("revoked_at is null").join(users.where("status = 'active'").select("tenant"), "tenant", "left_semi").select("key_id", "tenant", "prefix", "hash")
    return h.join(live, ["prefix", "hash"], "left").select("request_id", "key_id", "tenant")


# -- transitions --------------------------------------------------------------------------


def finalize_uploads(jobs: DataFrame, uploads: DataFrame, now) -> DataFrame:
    """Next version of uploading jobs (SQL9): expired, empty, too large or of another type they fail;
    what is not stored yet stays; else they are queued. ``uploads``: job_id, bytes, content_type."""
    u = uploads.select("job_id", F.col("bytes").alias("_b"), F.col("content_type").alias("_t"), F.lit(True).alias("_u"))
    code = F.when(_at("upload_expires_at") <= _time(now), "upload_expired").when(F.col("_u") & (F.coalesce("_b", F.lit(0)) < 1), "invalid_upload").when(F.col("_b") > MOST_INPUT_BYTES, "input_too_large").when(F.col("_u") & ~F.col("_t").eqNullSafe(F.lit("application/pdf")), "invalid_upload")
    mine = F.col("state") == "uploading"
    state = F.when(~mine, F.col("state")).when(code.isNotNull(), "failed").when(F.col("_u"), "queued").otherwise("uploading")
    df = jobs.join(u, "job_id", "left")
    return df.withColumns({"_s": state, "_c": F.when(mine, code)}).withColumns(
        {"queued_at": F.when(mine & (F.col("_s") == "queued"), _time(now)).otherwise(_at("queued_at")), "failure_code": F.coalesce("_c", "failure_code"), "completed_at": F.when(F.col("_c").isNotNull(), _time(now)).otherwise(_at("completed_at")), "state": F.col("_s")}
    ).select(*jobs.columns)


def queued_without_attempt(jobs: DataFrame, attempts: DataFrame, limit: int = 8) -> DataFrame:
    """Oldest queued jobs that nothing serves (JOIN27, SRT2)."""
    return jobs.where("state = 'queued' and accepted_attempt_id is null").join(attempts.select("job_id"), "job_id", "left_anti").orderBy("queued_at", "job_id").limit(limit)


def create_attempts(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """The initial attempt of every open job without one (SQL12, STR16): ``job_id``, ``state``, ``replaces_attempt_id``."""
    new = jobs.where(F.col("state").isin(*PROCESSING) & F.col("accepted_attempt_id").isNull()).join(attempts.select("job_id"), "job_id", "left_anti")
    return new.select("job_id", F.lit("dispatching").alias("state"), F.lit(None).cast(attempts.schema["attempt_id"].dataType).alias("replaces_attempt_id"))


def create_replacements(jobs: DataFrame, attempts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The one replacement of attempts whose dispatch is unknown (SQL12): not of a replacement, and not
    where one exists. ``wanted``: attempt_id."""
    open_ = jobs.where(F.col("state").isin(*PROCESSING) & F.col("accepted_attempt_id").isNull()).select("job_id")
    prior = attempts.where("state = 'dispatch_unknown' and replaces_attempt_id is null").join(wanted.select("attempt_id").distinct(), "attempt_id", "left_semi").join(open_, "job_id", "left_semi")
    taken = attempts.where("replaces_attempt_id is not null").select(F.col("replaces_attempt_id").alias("attempt_id"))
    return prior.join(taken, "attempt_id", "left_anti").select("job_id", F.lit("dispatching").alias("state"), F.col("attempt_id").alias("replaces_attempt_id"))


def mark_dispatched(jobs: DataFrame, attempts: DataFrame, calls: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Next versions of jobs and attempts whose calls are known (SQL11): ``calls`` has job_id, attempt_id
    and a call_id that is not blank; finished attempts stay; a queued job becomes dispatched."""
    c = calls.where("trim(call_id) <> ''").select("job_id", "attempt_id", F.col("call_id").alias("_call"))
    df = attempts.join(c, ["job_id", "attempt_id"], "left")
    hit = F.col("_call").isNotNull() & F.col("state").isin("dispatching", "dispatch_unknown") & F.col("completed_at").isNull()
    marked = df.where(hit).select("job_id", F.lit(True).alias("_m")).distinct()
    new = df.withColumn("_h", hit).withColumns({"state": F.when(F.col("_h"), "dispatched").otherwise(F.col("state")), "call_id": F.when(F.col("_h"), F.col("_call")).otherwise(F.col("call_id"))}).select(*attempts.columns)
    return jobs.join(marked, "job_id", "left").withColumn("state", F.when(F.col("_m") & (F.col("state") == "queued"), "dispatched").otherwise(F.col("state"))).select(*jobs.columns), new


def mark_unknown(attempts: DataFrame, lost: DataFrame) -> DataFrame:
    """Next version of attempts whose call never became known (SQL11): only one that is being dispatched. ``lost``: job_id, attempt_id."""
    l = lost.select("job_id", "attempt_id", F.lit(True).alias("_l")).distinct()
    return attempts.join(l, ["job_id", "attempt_id"], "left").withColumn("state", F.when(F.col("_l") & (F.col("state") == "dispatching"), "dispatch_unknown").otherwise(F.col("state"))).select(*attempts.columns)


def accept_attempts(jobs: DataFrame, attempts: DataFrame, reports: DataFrame) -> DataFrame:
    """What becomes of each completed report (STR9): ``recorded``, ``won``.

    A report is recorded if the attempt belongs to the job, has not completed, and the job has
    left the upload; repeated reports of an attempt are decided in order of arrival. The first
    recorded one of a job that is queued or dispatched and has no result wins; a job that has
    ended stays as it is. ``reports``: job_id, attempt_id, arrival.
    """
    first = F.row_number().over(Window.partitionBy("job_id", "attempt_id").orderBy("arrival")) == 1
    a = attempts.select("job_id", "attempt_id", F.col("completed_at").isNull().alias("_open"))
    j = jobs.select("job_id", F.col("state").alias("_state"), F.col("accepted_attempt_id").alias("_won"))
    df = reports.withColumn("_first", first).join(a, ["job_id", "attempt_id"], "left").join(j, "job_id", "left")
    df = df.withColumn("recorded", F.coalesce(F.col("_first") & F.col("_open") & F.col("_state").isin("queued", "dispatched", "succeeded", "failed"), F.lit(False)))
    place = F.sum(F.col("recorded").cast("int")).over(Window.partitionBy("job_id").orderBy("arrival", "attempt_id").rowsBetween(Window.unboundedPreceding, 0))
    won = F.col("recorded") & (place == 1) & F.col("_won").isNull() & F.col("_state").isin(*PROCESSING)
    return df.withColumn("won", F.coalesce(won, F.lit(False))).select(*reports.columns, "recorded", "won")


def fail_attempts(attempts: DataFrame, failures: DataFrame, now) -> DataFrame:
    """Next version of attempts (SQL10): one that has not completed fails; a completed one stays.
    ``failures``: job_id, attempt_id, failure_code, which must be known (FLT21)."""
    f = failures.select("job_id", "attempt_id", F.when(F.col("failure_code").isin(*FAILURE_CODES), F.col("failure_code")).otherwise(F.raise_error(F.concat(F.lit("unknown failure code: "), F.coalesce("failure_code", F.lit("null"))))).alias("_code"))
    hit = F.col("completed_at").isNull() & F.col("_code").isNotNull()
    df = attempts.join(f, ["job_id", "attempt_id"], "left").withColumn("_h", hit)
    return df.withColumns({"state": F.when(F.col("_h"), "failed").otherwise(F.col("state")), "failure_code": F.when(F.col("_h"), F.col("_code")).otherwise(F.col("failure_code")), "completed_at": F.when(F.col("_h"), _time(now)).otherwise(_at("completed_at"))}).select(*attempts.columns)


def failure_of(attempts: DataFrame) -> DataFrame:
    """The code that a job reports of its failed attempts: by priority, then time, then id (WIN11)."""
    rank = F.coalesce(*[F.when(F.col("failure_code") == c, k) for k, c in enumerate(CODE_ORDER)], F.lit(len(CODE_ORDER)))
    return attempts.where("state = 'failed'").groupBy("job_id").agg(F.min(F.struct(rank.alias("r"), "completed_at", "attempt_id", "failure_code"))["failure_code"].alias("failure_code"))


def exhausted_jobs(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Open jobs without a result whose attempts have all failed, with the code they get (JOIN28, STR12, WIN11)."""
    done = attempts.groupBy("job_id").agg(F.count("*").alias("attempts"), F.min(F.col("state") == "failed").alias("_all")).where("_all")
    open_ = jobs.where(F.col("state").isin(*PROCESSING) & F.col("accepted_attempt_id").isNull())
    code = F.coalesce("failure_code", F.lit("processing_failed")).alias("failure_code")
    return open_.select("job_id", "tenant").join(done, "job_id").join(failure_of(attempts), "job_id", "left").select("job_id", "tenant", "attempts", code)


def deadline_sweep(jobs: DataFrame, attempts: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Jobs past their deadline and the open attempts that fail with them (STR8): an upload at its own
    time, a queued or dispatched job a day after it was queued, or if nobody knows when.
    Both: the id and ``failure_code``."""
    upload = (F.col("state") == "uploading") & (_at("upload_expires_at") <= _time(now))
    process = F.col("state").isin(*PROCESSING) & (F.col("queued_at").isNull() | (_at("queued_at") <= _time(now) - F.expr(f"interval {PROCESS}")))
    late = jobs.where(upload | process).select("job_id", F.when(F.col("state") == "uploading", "upload_expired").otherwise("processing_deadline_exceeded").alias("failure_code"))
    return late, attempts.where(F.col("state").isin(*OPEN_ATTEMPTS)).select("job_id", "attempt_id").join(late, "job_id").select("attempt_id", "failure_code")


def due_attempts(attempts: DataFrame, now, limit: int = 32) -> DataFrame:
    """Open attempts whose time has come, longest due first (SRT3, SQL4)."""
    return attempts.where(F.col("state").isin(*OPEN_ATTEMPTS) & (_at("reconcile_after") <= _time(now))).orderBy("reconcile_after", "attempt_id").limit(limit)


def defer_attempts(attempts: DataFrame, looked_at: DataFrame, now, wait: str = DEFERRAL) -> DataFrame:
    """Next version of open attempts that were looked at (STR11): again a minute later. ``looked_at``: attempt_id."""
    l = looked_at.select("attempt_id", F.lit(True).alias("_l")).distinct()
    hit = F.col("_l") & F.col("state").isin(*OPEN_ATTEMPTS)
    return attempts.join(l, "attempt_id", "left").withColumn("reconcile_after", F.when(hit, _time(now) + F.expr(f"interval {wait}")).otherwise(_at("reconcile_after"))).select(*attempts.columns)


def reconcile_decisions(attempts: DataFrame, remote: DataFrame, stored: DataFrame, now, *, unknown_wait: str = "10 minutes") -> DataFrame:
    """What to do with each open attempt (STR10, STR15): ``decision``.

    A call that runs is ``pending``. Otherwise a valid stored result is ``recovered`` before
    anything becomes final. A call that completed with a valid result is ``completed``; one that
    is not available now is ``unavailable``; else it is ``failed``. Where the call never became
    known, it is ``waiting_unknown`` for a while; then it gets its one replacement
    (``replace``, or ``replacement_exists``), and a replacement of unknown fate is ``failed``.
    ``remote``: attempt_id, outcome (pending, completed, invalid, failed, unavailable);
    ``stored``: attempt_id.
    """
    taken = attempts.where("replaces_attempt_id is not null").select(F.col("replaces_attempt_id").alias("attempt_id"), F.lit(True).alias("_taken")).distinct()
    df = attempts.where(F.col("state").isin(*OPEN_ATTEMPTS)).join(remote.select("attempt_id", "outcome"), "attempt_id", "left").join(stored.select("attempt_id", F.lit(True).alias("_has")).distinct(), "attempt_id", "left").join(taken, "attempt_id", "left")
    known = F.col("state") == "dispatched"
    young = _at("created_at") > _time(now) - F.expr(f"interval {unknown_wait}")
    what = (
        F.when(known & (F.col("outcome") == "pending"), "pending")
        .when(known & (F.col("outcome") == "completed"), "completed")
        .when(F.col("_has"), "recovered")
        .when(known, F.when(F.coalesce("outcome", F.lit("unavailable")) == "unavailable", "unavailable").otherwise("failed"))
        .when(young, "waiting_unknown")
        .when(F.col("_taken"), "replacement_exists")
        .when(F.col("replaces_attempt_id").isNotNull(), "failed")
        .otherwise("replace")
    )
    return df.select("job_id", "attempt_id", what.alias("decision"))


def running_budget(requests: DataFrame, keys: list[str], order: list[str], cost: str, ceiling: float) -> DataFrame:
    """Requests in order as long as the total stays within a ceiling (STR13)."""
    total = F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return requests.withColumn("spent", total).where(F.col("spent") <= ceiling)


def enrichment_state(plans: DataFrame, submitted: DataFrame, answers: DataFrame, digests: DataFrame) -> DataFrame:
    """State of each planned page (STR6): stale if its record changed, complete if answered, else
    submitted, pending, or unavailable where nothing is asked. ``plans``: page_id, base_digest, asked."""
    df = plans.join(submitted.select("page_id", F.lit(True).alias("sent")).distinct(), "page_id", "left").join(answers.select("page_id", F.lit(True).alias("answered")).distinct(), "page_id", "left").join(digests, "page_id", "left")
    state = F.when(~F.col("asked"), "unavailable").when(~F.col("digest").eqNullSafe(F.col("base_digest")), "stale").when(F.col("answered"), "complete").when(F.col("sent"), "submitted").otherwise("pending")
    return df.select("page_id", state.alias("state"))


# -- rules of the tables ------------------------------------------------------------------


def job_rules() -> dict[str, Column]:
    """What must hold of every job row (SQL1-SQL3, SQL5, SQL7, SQL8); null passes, as in a CHECK."""
    state, done = F.col("state"), F.col("state") == "succeeded"
    parts = [F.col(f"compact_result_{c}").isNull().cast("int") for c in ("uri", "digest", "bytes")]
    return {
        "jobs_state_known": state.isin(*JOB_STATES) & state.isNotNull(),
        "jobs_input_digest": F.col("input_digest").rlike(SHA256),
        "jobs_pages_actual": F.col("pages_actual") >= 0,
        "jobs_upload_window_bounded": (_at("upload_expires_at") > _at("created_at")) & (_at("upload_expires_at") <= _at("created_at") + F.expr(f"interval {UPLOAD}")),
        "jobs_succeeded_has_retention": ~done | F.col("retention_expires_at").isNotNull(),
        "jobs_failure_code_known": F.col("failure_code").isin(*FAILURE_CODES),
        "jobs_failed_has_code": (state == "failed") == F.col("failure_code").isNotNull(),
        "jobs_succeeded_has_accepted_result": ~done | (F.col("accepted_attempt_id").isNotNull() & F.col("result_uri").isNotNull() & F.coalesce(F.col("result_digest").rlike(SHA256), F.lit(False)) & F.col("pages_actual").isNotNull() & F.col("completed_at").isNotNull()),
        "jobs_reserved_pages_bounded": F.col("reserved_pages").between(1, MOST_PAGES) & F.col("reserved_pages").isNotNull(),
        "jobs_succeeded_within_reservation": ~done | (F.col("pages_actual") <= F.col("reserved_pages")),
        "jobs_compact_result_complete": (parts[0] + parts[1] + parts[2]).isin(0, 3),
        "jobs_compact_result_digest_valid": F.col("compact_result_digest").rlike(SHA256),
        "jobs_compact_result_bytes_bounded": F.col("compact_result_bytes").between(1, MOST_RESULT_BYTES),
    }


def attempt_rules() -> dict[str, Column]:
    """What must hold of every attempt row (SQL1, SQL2, SQL5)."""
    state = F.col("state")
    return {
        "attempts_state_known": state.isin(*ATTEMPT_STATES) & state.isNotNull(),
        "attempts_call_id_nonblank": F.trim("call_id") != "",
        "attempts_dispatched_has_call_id": (state != "dispatched") | F.col("call_id").isNotNull(),
        "attempts_failure_code_known": F.col("failure_code").isin(*FAILURE_CODES),
        "attempts_failed_has_code": (state == "failed") == F.col("failure_code").isNotNull(),
    }


def invariant_violations(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Rows that break a rule of the tables (SQL1-SQL3, SQL5, SQL7): ``rule``, ``job_id``.

    Checks that lack a column are left out of a table without it. Each table is read once for
    its row rules; keys and references cost one aggregation or anti join each.
    """

    def rows(df: DataFrame, rules: dict[str, Column], needs: dict[str, set[str]]) -> DataFrame:
        own = {k: c for k, c in rules.items() if needs[k] <= set(df.columns)}
        broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(True)), k) for k, c in own.items()], F.lit(None).cast("string")))
        return df.select(F.explode(broken).alias("rule"), "job_id")

    repeated = lambda df, keys, rule: df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("job_id").alias("_j")).where("_n > 1").select(F.lit(rule).alias("rule"), F.col("_j").alias("job_id"))
    found = rows(jobs, job_rules(), JOB_NEEDS).unionByName(rows(attempts, attempt_rules(), ATTEMPT_NEEDS))
    found = found.unionByName(repeated(jobs.withColumn("_id", F.col("job_id")), ["_id"], "jobs_primary_key"))
    found = found.unionByName(attempts.join(jobs.select("job_id"), "job_id", "left_anti").select(F.lit("attempts_job").alias("rule"), "job_id"))
    if "attempt_id" in attempts.columns:
        found = found.unionByName(repeated(attempts, ["attempt_id"], "attempts_primary_key"))
    if "replaces_attempt_id" in attempts.columns:
        found = found.unionByName(repeated(attempts.where("replaces_attempt_id is null").withColumn("_id", F.col("job_id")), ["_id"], "attempts_one_initial"))
        found = found.unionByName(repeated(attempts.where("replaces_attempt_id is not null"), ["replaces_attempt_id"], "attempts_one_replacement"))
        prior = attempts.select("job_id", F.col("attempt_id").alias("replaces_attempt_id"))
        found = found.unionByName(attempts.where("replaces_attempt_id is not null").join(prior, ["job_id", "replaces_attempt_id"], "left_anti").select(F.lit("attempts_replaces_same_job").alias("rule"), "job_id"))
    if "call_id" in attempts.columns:
        found = found.unionByName(repeated(attempts.where("call_id is not null"), ["call_id"], "attempts_call_unique"))
    if "idempotency_key" in jobs.columns:
        found = found.unionByName(repeated(jobs.where("idempotency_key is not null"), ["tenant", "idempotency_key"], "jobs_idempotency"))
    if "accepted_attempt_id" in jobs.columns:
        own = attempts.select("job_id", F.col("attempt_id").alias("accepted_attempt_id"))
        found = found.unionByName(jobs.where("accepted_attempt_id is not null").join(own, ["job_id", "accepted_attempt_id"], "left_anti").select(F.lit("jobs_accepted_attempt").alias("rule"), "job_id"))
    return found


#: The columns that each row rule looks at.
JOB_NEEDS = {
    "jobs_state_known": {"state"}, "jobs_input_digest": {"input_digest"}, "jobs_pages_actual": {"pages_actual"}, "jobs_upload_window_bounded": {"upload_expires_at", "created_at"},
    "jobs_succeeded_has_retention": {"state", "retention_expires_at"}, "jobs_failure_code_known": {"failure_code"}, "jobs_failed_has_code": {"state", "failure_code"},
    "jobs_succeeded_has_accepted_result": {"state", "accepted_attempt_id", "result_uri", "result_digest", "pages_actual", "completed_at"}, "jobs_reserved_pages_bounded": {"reserved_pages"},
    "jobs_succeeded_within_reservation": {"state", "pages_actual", "reserved_pages"}, "jobs_compact_result_complete": {"compact_result_uri", "compact_result_digest", "compact_result_bytes"},
    "jobs_compact_result_digest_valid": {"compact_result_digest"}, "jobs_compact_result_bytes_bounded": {"compact_result_bytes"},
}
ATTEMPT_NEEDS = {"attempts_state_known": {"state"}, "attempts_call_id_nonblank": {"call_id"}, "attempts_dispatched_has_call_id": {"state", "call_id"}, "attempts_failure_code_known": {"failure_code"}, "attempts_failed_has_code": {"state", "failure_code"}}
