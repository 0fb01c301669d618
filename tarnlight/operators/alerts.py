"""Alerts to authorities: matching, composing, and the state that commands make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions import rules as R

NO_AUTHORITY = "No matching authority; assign before sending."
DRY_RUN = "Dry run: composed and stored, not sent."


def match_authority(bodies: DataFrame, authorities: DataFrame) -> DataFrame:
    """(id, authority_ord): the first authority by ord whose jurisdiction is the body's city or state, else the first default.

    Names are compared trimmed and in lower case. Authorities without jurisdiction match nobody.
    """
    place = F.explode(F.array_distinct(F.array_compact(F.array(F.lower(F.trim("city")), F.lower(F.trim("state")))))).alias("place")
    wanted = bodies.select("id", place)
    held = authorities.select(F.col("ord"), F.lower(F.trim("jurisdiction")).alias("place"), "is_default")
    first = wanted.join(held.select("ord", "place"), "place").groupBy("id").agg(F.min("ord").alias("_own"))
    default = held.where("is_default").agg(F.min("ord").alias("_default"))
    return bodies.select("id").join(first, "id", "left").crossJoin(F.broadcast(default)).select("id", F.coalesce("_own", "_default").alias("authority_ord"))  # one row


def subject(level: Column, name: Column, sender: str) -> Column:
    """F23"""
    return F.concat(F.lit(f"[{sender}] "), F.upper(level), F.lit(" pollution risk: "), F.coalesce(name, F.lit("an unnamed water body")))


def body(authority: Column, name: Column, city: Column, state: Column, lat: Column, lon: Column, level: Column, score: Column, kind: Column, satellite: Column, at: Column, report_id: Column, notes: Column) -> Column:
    """the message with fallbacks; coordinates with five decimals, the score with one. No notes: no line of notes."""
    say = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    lines = [
        say("To", F.coalesce(authority, F.lit("Water Quality Authority"))), say("Water body", F.coalesce(name, F.lit("an unnamed water body"))),
        say("Location", F.format_string("%s, %s (%.5f, %.5f)", F.coalesce(city, F.lit("unknown")), F.coalesce(state, F.lit("unknown")), lat, lon)),
        say("Risk", F.format_string("%s (%.1f/100)", F.upper(level), score)), say("Contamination", kind), say("Satellite", F.coalesce(satellite, F.lit("unavailable"))),
        say("Reported at", F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("n/a"))), say("Report", report_id.cast("string")),
        F.when(F.length(F.coalesce(notes, F.lit(""))) > 0, say("Notes", notes)), F.lit("Screening by appearance only; please verify on site."),
    ]
    return F.concat_ws("\n", *lines)


def candidates(reports: DataFrame, bodies: DataFrame, authorities: DataFrame, least: str = "high", enabled: bool = True, sender: str = "Water watch") -> DataFrame:
    """H2: one pending alert for each report of the least level or above, with its composed message.

    Ids are hashes of report ids, so that a replay makes the same alerts. Without an authority the note says so.
    """
    kept = reports.where(R.let(F.col("risk_level"), lambda x: R.meets_threshold(x, F.lit(least))) & F.lit(enabled))
    matched = match_authority(bodies, authorities)
    held = authorities.select(F.col("ord").alias("authority_ord"), F.col("name").alias("authority"))
    place = bodies.select(F.col("id").alias("water_body_id"), F.col("name").alias("body_name"), "city", "state").join(matched.withColumnRenamed("id", "water_body_id"), "water_body_id").join(held, "authority_ord", "left")
    joined = kept.join(place, "water_body_id")
    c = F.col
    satellite = c("satellite_corroboration") if "satellite_corroboration" in reports.columns else F.lit(None).cast("string")
    notes = c("notes") if "notes" in reports.columns else F.lit(None).cast("string")
    return joined.select(
        F.sha2(c("report_id").cast("string"), 256).alias("alert_id"), "report_id", "water_body_id", "authority_ord", "risk_level", "composite_score",
        F.lit("pending_review").alias("status"), subject(c("risk_level"), c("body_name"), sender).alias("subject"),
        body(c("authority"), c("body_name"), c("city"), c("state"), c("latitude"), c("longitude"), c("risk_level"), c("composite_score"), c("contamination_type"), satellite, c("created_at"), c("report_id"), notes).alias("body"),
        F.when(c("authority_ord").isNull(), NO_AUTHORITY).alias("send_note"), "created_at",
    )


#: What a run of commands does, told for each of the states it may begin with: the state after it, whether there is a
#: recipient then, which recipient and note it has set (if any), and how many commands failed.
_STATE = "struct<status:string,held:boolean,assigned:boolean,recipient:bigint,noted:boolean,note:string,errors:bigint>"
STATUSES = ("pending_review", "sent", "dismissed")
#: Commands of one alert that are folded at a time, and runs that are composed at a time.
RUN = 1024


def _state(status: Column, held: Column, assigned: Column, recipient: Column, noted: Column, note: Column, errors: Column) -> Column:
    names = ("status", "held", "assigned", "recipient", "noted", "note", "errors")
    return F.struct(*[c.alias(n) for c, n in zip((status, held, assigned, recipient, noted, note, errors), names, strict=True)]).cast(_STATE)


def _begun(status: str, held: bool) -> Column:
    none = F.lit(None)
    return _state(F.lit(status), F.lit(held), F.lit(False), none, F.lit(False), none, F.lit(0))


#: The states to begin with, in the order of a run's table.
_BEGINNINGS = [(s, h) for s in STATUSES for h in (False, True)]


def apply_command(s: Column, c: Column) -> Column:
    """H3: the state after one command (command, authority_id, reason).

    assign sets the recipient and clears the note. send: of a dismissed alert an error; of a sent one nothing; without a
    recipient an error; else sent with the dry-run note. dismiss overwrites any status with its reason.
    """
    failed = _state(s["status"], s["held"], s["assigned"], s["recipient"], s["noted"], s["note"], s["errors"] + 1)
    sent = _state(F.lit("sent"), s["held"], s["assigned"], s["recipient"], F.lit(True), F.lit(DRY_RUN), s["errors"])
    to = c["authority_id"].cast("bigint")
    return (
        F.when(c["command"] == "assign", _state(s["status"], to.isNotNull(), F.lit(True), to, F.lit(True), F.lit(None), s["errors"]))
        .when((c["command"] == "send") & (s["status"] != "sent"), F.when((s["status"] == "dismissed") | ~s["held"], failed).otherwise(sent))
        .when(c["command"] == "dismiss", _state(F.lit("dismissed"), s["held"], s["assigned"], s["recipient"], F.lit(True), F.coalesce(c["reason"], F.lit("Dismissed")), s["errors"]))
        .otherwise(s)
    )


def _then(s: Column, table: Column) -> Column:
    """The state after a run of commands, given by its table."""
    place = F.array_position(F.lit(list(STATUSES)), s["status"]) * 2 - F.when(s["held"], 0).otherwise(1)

    def follow(e: Column) -> Column:
        recipient, note = F.when(e["assigned"], e["recipient"]).otherwise(s["recipient"]), F.when(e["noted"], e["note"]).otherwise(s["note"])
        return _state(e["status"], e["held"], s["assigned"] | e["assigned"], recipient, s["noted"] | e["noted"], note, s["errors"] + e["errors"])

    return R.let(F.element_at(table, place.cast("int")), follow)


def run_table(commands: Column) -> Column:
    """A run's table from its commands in order."""
    return F.array(*[F.aggregate(commands, _begun(*b), apply_command) for b in _BEGINNINGS])


def composed(tables: Column) -> Column:
    """The table of runs one after the other; an associative product."""
    return F.array(*[F.aggregate(tables, _begun(*b), _then) for b in _BEGINNINGS])


def _final(table: Column) -> list[Column]:
    first = table[0]  # pending, without a recipient
    return [first["status"].alias("status"), first["recipient"].alias("recipient"), first["note"].alias("note"), first["errors"].cast("int").alias("errors")]


def fold(commands: DataFrame, key: str = "alert_id", order: str = "seq") -> DataFrame:
    """The state of each alert after its commands in order.

    ``order`` numbers an alert's commands. RUN numbers in a row make a run, which one group folds into a table of fixed size;
    RUN runs in a row are composed into one, until an alert has one. So an alert's commands are dealt over tasks however many
    they are, and no group is larger than RUN numbers. Commands with one number go by command, authority and reason; commands
    without a number come first. An alert's key may be null.
    """
    number = F.coalesce(F.col(order).cast("bigint"), F.lit(-(1 << 62)))
    sorted_ = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(order).cast("bigint"), F.lit(-(1 << 62))).alias("n"), "command", "authority_id", "reason")))
    span = commands.agg(F.min(order).cast("bigint"), F.max(order).cast("bigint")).first()
    low, high = (span[0] or 0), (span[1] or 0)
    run = F.floor((F.greatest(number, F.lit(low)) - low) / RUN)
    level = commands.groupBy(key, run.alias("run")).agg(run_table(sorted_).alias("t"))
    n = (high - low) // RUN + 1
    while n > 1:
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("run", "t"))), lambda x: x["t"])
        level = level.groupBy(key, F.floor(F.col("run") / RUN).alias("run")).agg(composed(in_order).alias("t"))
        n = -(-n // RUN)
    return level.select(key, *_final(F.col("t")))


def payload(alerts: DataFrame, authorities: DataFrame) -> DataFrame:
    """An alert as one JSON text, with the authority's name and address; times in ISO 8601, absent values as nulls."""
    held = authorities.select(F.col("ord").alias("authority_ord"), *[F.col(c) if c in authorities.columns else F.lit(None).cast("string").alias(c) for c in ("name", "email")])
    held = held.withColumnsRenamed({"name": "authority", "email": "recipient"})
    joined = alerts.join(held, "authority_ord", "left")
    has = lambda c, kind="string": F.col(c) if c in alerts.columns else F.lit(None).cast(kind).alias(c)
    at = lambda c: F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss").alias(c) if c in alerts.columns else F.lit(None).cast("string").alias(c)
    fields = [
        F.col("alert_id").alias("id"), "report_id", "water_body_id", F.col("authority_ord").alias("authority_id"), "recipient", "risk_level", "composite_score",
        has("satellite_corroboration"), "status", F.lit("email").alias("channel"), "subject", "body", has("send_note"), at("created_at"), at("sent_at"),
    ]
    return joined.select("alert_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def list_alerts(alerts: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """The newest alerts of a status (of any if None) with ``total``, the number of rows listed. A page of 1 to 200 rows."""
    kept = alerts if status is None else alerts.where(F.col("status") == status)
    page = kept.orderBy(F.col("created_at").desc(), "alert_id").limit(max(1, min(limit, 200)))
    return page.withColumn("total", F.count("*").over(Window.partitionBy()))


def list_authorities(authorities: DataFrame) -> DataFrame:
    """All authorities in their order, each with the number of all."""
    total = authorities.agg(F.count("*").alias("total"))
    return authorities.crossJoin(F.broadcast(total)).orderBy("ord")  # one row
